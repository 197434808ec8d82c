"""URL filter: fixed rules, and host reputation by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut

#: Rules (host and path) and what they say.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: The posterior bound of a host is the rate of bad pages that it exceeds with a confidence of 95 % (Z: the normal quantile).
Z = 1.645
#: Blocked are at most this share of the hosts with labelled pages: those of the highest bounds, if their rate is over that
#: of all pages. Bounds are told apart to one of BINS parts.
WORST, BINS = 0.05, 1 << 16
# Public suffixes of two labels; of other hosts the last label is the suffix.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.tw", "co.kr", "co.in", "com.mx", "com.tr", "co.za", "com.ar", "com.sg", "com.hk")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains, if the path starts with its path."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def concentration(groups: DataFrame) -> tuple[float, float]:
    """Rate and beta-binomial concentration of groups with n rows, k of them bad, by moments; from one row of sums."""
    rate = groups.agg((F.sum("k") / F.sum("n")).alias("p")).first().p if groups.columns else None
    if rate is None:
        return 0.5, 1.0
    r = groups.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - rate, 2)).alias("q")).first()
    spread = rate * (1 - rate)
    free = r.n - r.nn / r.n - (r.m - 1)
    if spread <= 0 or free <= 0:
        return float(rate), 100.0
    share = (r.q - (r.m - 1) * spread) / (spread * free)
    return float(rate), 1 / min(max(share, 1e-4), 0.9) - 1


def lower_quantile(a: Column, b: Column, z: float) -> Column:
    """Quantile of a beta distribution, z standard normal deviations down, by the usual expansion in the logit (Abramowitz
    and Stegun 26.5.22). Parameters under one count as one, where the expansion doesn't hold."""
    a, b, y = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0)), (z * z - 3) / 6
    p, q = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h = 2 / (p + q)
    w = z * F.sqrt(h + y) / h - (q - p) * (y + 5 / 6 - 2 / (3 * h))
    return a / (a + b * F.exp(2 * w))


def parts_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix and registered domain (suffix and the label before it) of a host, its port left out; of a number both are itself."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    number, long = name.rlike(r"^[0-9.]+$"), two.isin(*suffixes)
    return F.when(number, name).when(long, two).otherwise(F.element_at(labels, -1)), F.when(number, name).when(long, three).otherwise(two)


def fit_hosts(pages: DataFrame, outcomes: DataFrame, *, worst: float = WORST, z: float = Z) -> DataFrame:
    """Reputation of every host: (host, n, k, posterior_rate, low_rate, blocked).

    outcomes: (page_id, bad). Rates shrink along all -> suffix -> registered domain -> host; each level's beta prior has
    its parent's posterior mean and a concentration fitted to that level's groups. low_rate is the lower quantile of the
    host's beta posterior. The bar follows from all hosts: at most ``worst`` of those with outcomes are blocked, those of
    the highest low_rate, and only if their posterior rate is over the rate of all pages; of equal ones all or none.
    """
    known = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("page_id is not null").join(known, "page_id", "left")
    hosts = hosts.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    suffix, domain = parts_of(F.col("host"))
    hosts = cut(hosts.withColumn("suffix", suffix).withColumn("domain", domain))
    shrink = lambda prior, s: (F.col("k") + F.lit(s) * prior) / (F.col("n") + F.lit(s))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate, s = concentration(suffixes.where("n > 0"))
    suffixes = suffixes.select("suffix", shrink(F.lit(rate), s).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix")
    _, s = concentration(domains.where("n > 0"))
    domains = domains.select("domain", shrink(F.col("suffix_rate"), s).alias("domain_rate"))
    _, s = concentration(hosts.where("n > 0"))
    mean = shrink(F.col("domain_rate"), s)
    low = lower_quantile(mean * (F.col("n") + F.lit(s)), (1 - mean) * (F.col("n") + F.lit(s)), z)
    hosts = cut(hosts.join(domains, "domain").select("host", "n", "k", mean.alias("posterior_rate"), low.alias("low_rate")))
    place = F.floor(F.col("low_rate") * BINS)
    bins = hosts.where("n > 0").groupBy(place.alias("bin")).count().orderBy(F.desc("bin")).collect()  # BINS rows at most
    room, bar = worst * sum(r["count"] for r in bins), BINS + 1
    for r in bins:
        room -= r["count"]
        if room < 0:
            break
        bar = r.bin
    return hosts.withColumn("blocked", (F.col("n") > 0) & (place >= bar) & (F.col("posterior_rate") > rate))


def judge_urls(pages: DataFrame, hosts: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Verdict for each page: of the longest rule that fits, else by the host's reputation.

    A host may own most pages: only ids and urls are joined, and the join's hot partitions are split as it runs. Null urls
    and urls without :// have an empty host and path and are judged as that host. Rows that repeat are each judged.
    """
    p = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).drop("url")
    p = p.join(hosts.select("host", "posterior_rate", "low_rate", "blocked"), "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.when(F.col("blocked"), "block").otherwise("allow"))
    return p.select("page_id", "host", "path", "rule", said.alias("verdict"), "posterior_rate", "low_rate")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The last part of a page's path is the number of the document it shows, whole or with a file's ending; the page is
    bad if that document is labelled toxic or of low quality. Pages without such a number have no outcome."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]+)(\.[A-Za-z]+)?/?$", 1)
    shown = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return shown.join(bad, "doc_id").select("page_id", "bad")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_urls(pages, fit_hosts(pages, page_outcomes(pages, labels))).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, by: str) -> str:
    """Beta-binomial rate and concentration of the labelled groups of a level, by moments."""
    return f"""{name}_g AS (SELECT {by}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM hosts GROUP BY {by} HAVING sum(n) > 0), {name}_p AS (SELECT sum(k) / sum(n) AS p FROM {name}_g),
{name}_m AS (SELECT count(*) AS m, sum(n) AS n, sum(n * n) AS nn, sum(n * pow(k / n - p, 2)) AS q, any_value(p) AS p, any_value(p) * (1 - any_value(p)) AS v FROM {name}_g, {name}_p),
{name}_s AS (SELECT coalesce(p, 0.5) AS p, CASE WHEN p IS NULL THEN 1 WHEN v <= 0 OR n - nn / n - (m - 1) <= 0 THEN 100 ELSE 1 / least(greatest((q - (m - 1) * v) / (v * (n - nn / n - (m - 1))), 0.0001), 0.9) - 1 END AS s FROM {name}_m)"""


_REST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"
_TWO = "array_to_string(list_slice(labels, greatest(len(labels) - 1, 1), len(labels)), '.')"
_THREE = "array_to_string(list_slice(labels, greatest(len(labels) - 2, 1), len(labels)), '.')"
_LONG = f"{_TWO} IN ({', '.join(repr(x) for x in SUFFIXES)})"
_Y = (Z * Z - 3) / 6
SQL = rf"""WITH u AS (SELECT page_id, translate({_REST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
shown AS (SELECT page_id, try_cast(nullif(regexp_extract(path, '/([0-9]+)(\.[A-Za-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM u),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
known AS (SELECT page_id, max(bad) AS bad FROM shown JOIN bad USING (doc_id) GROUP BY 1),
counted AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM u LEFT JOIN known USING (page_id) WHERE page_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, n, k, CASE WHEN number THEN name WHEN {_LONG} THEN {_TWO} ELSE labels[-1] END AS suffix, CASE WHEN number THEN name WHEN {_LONG} THEN {_THREE} ELSE {_TWO} END AS domain FROM (SELECT *, string_split(name, '.') AS labels, regexp_matches(name, '^[0-9.]+$') AS number FROM counted)),
{_level('suffix', 'suffix')}, {_level('domain', 'suffix, domain')}, {_level('host', 'host')},
suffix_r AS (SELECT suffix, (sum(k) + any_value(s) * any_value(p)) / (sum(n) + any_value(s)) AS r FROM hosts, suffix_s GROUP BY 1),
domain_r AS (SELECT domain, (sum(k) + any_value(s) * any_value(r)) / (sum(n) + any_value(s)) AS r FROM hosts JOIN suffix_r USING (suffix), domain_s GROUP BY 1),
post_m AS (SELECT host, n, (k + s * r) / (n + s) AS m, n + s AS mass FROM hosts JOIN domain_r USING (domain), host_s),
host_h AS (SELECT host, n, m, a, b, 1 / (2 * a - 1) AS p, 1 / (2 * b - 1) AS q FROM (SELECT *, greatest(m * mass, 1.0::DOUBLE) AS a, greatest((1 - m) * mass, 1.0::DOUBLE) AS b FROM post_m)),
host_w AS (SELECT host, n, m, a, b, {Z} * sqrt(2 / (p + q) + {_Y}) / (2 / (p + q)) - (q - p) * ({_Y} + {5 / 6} - 2 / (3 * (2 / (p + q)))) AS w FROM host_h),
host_r AS (SELECT host, n, m, floor(a / (a + b * exp(2 * w)) * {BINS}) AS bin FROM host_w),
bins AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin DESC) AS above, sum(count(*)) OVER () AS hosts FROM host_r WHERE n > 0 GROUP BY bin),
bar AS (SELECT coalesce(min(bin), {BINS} + 1) AS bar FROM bins WHERE above <= {WORST} * hosts),
ruled AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r)))} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())} WHEN n > 0 AND bin >= bar AND m > suffix_s.p THEN 'block' ELSE 'allow' END AS verdict FROM ruled LEFT JOIN host_r USING (host), bar, suffix_s"""
