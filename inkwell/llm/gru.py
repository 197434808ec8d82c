"""A small gated recurrent language model in numpy, with a class-factored output softmax."""

from __future__ import annotations

import numpy as np

HIDDEN, CLASSES, WINDOW = 12, 32, 32
#: Texts that run side by side: at most so many in training and scoring, and in training so few that a stream of tokens
#: gives this many steps.
SIDE, STEPS = 512, 150


class Work:
    """Arrays that are filled again and again, by name, so that memory isn't asked for in each step."""

    def __init__(self, kind: np.dtype = np.float32):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        a = self.held.get(name)
        if a is None or a.shape != shape:
            a = self.held[name] = np.empty(shape, self.kind)
        return a


class Gru:
    """Tokens 0 to words - 1 are words of their own, by falling frequency (0 ends a text); each token after that is a
    class without a softmax inside (a group), of so much ``mass``. Words are cut into classes of like mass of root
    frequency. A group without mass is never foreseen."""

    def __init__(self, counts: np.ndarray, mass: np.ndarray, *, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words, self.groups, self.hidden = len(counts), len(mass), hidden
        share = np.cumsum(np.sqrt(counts + 1.0))
        # a class has as many words as its share of the mass gives, four times the even share at most
        inner, edge = np.minimum((share / share[-1] * classes).astype(int), classes - 1), [0]
        most = max(1, 4 * self.words // classes)
        for k in range(1, self.words):
            if inner[k] != inner[k - 1] or k - edge[-1] >= most:
                edge.append(k)
        self.edge = np.array([*edge, self.words])
        self.classes = len(edge) + self.groups
        self.class_of = np.concatenate([np.searchsorted(self.edge, np.arange(self.words), "right") - 1, len(edge) + np.arange(self.groups)])
        tokens, small = self.words + self.groups, 1 / np.sqrt(hidden)
        shapes = {"embed": (tokens, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, self.classes), "ww": (hidden, self.words)}
        self.p = {k: (rng.normal(size=s) * small).astype(np.float32) for k, s in shapes.items()}
        each = np.concatenate([np.add.reduceat(counts + 1.0, self.edge[:-1]), mass])
        self.p["bc"] = np.where(each > 0, np.log(np.maximum(each, 1.0)) - np.log(each.sum() + 1), -60).astype(np.float32)
        self.p["bw"] = np.log(counts + 1.0).astype(np.float32)

    def steps(self, x: np.ndarray, h: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run tokens x (time, rows) from state h: the state before each token's successor, and the last one. What BPTT needs
        (states before, gates, candidates, the candidates' recurrent part) is left in work."""
        n, u, shape = self.hidden, self.p["u"], (len(x), len(h))
        work = Work(u.dtype) if work is None else work
        seen = np.take(self.p["embed"], x, axis=0, out=work("seen", (*shape, 3 * n)))
        out, before, gates, new, inner = (work(k, (*shape, w * n)) for k, w in (("out", 1), ("before", 1), ("gates", 2), ("new", 1), ("inner", 1)))
        carried = (x != 0)[:, :, None].astype(u.dtype)  # nothing is carried into a new text
        b, change = work("b", (shape[1], 3 * n)), work("change", (shape[1], n))
        for t in range(len(x)):
            np.multiply(h, carried[t], out=before[t])
            np.matmul(before[t], u, out=b)
            zr = np.add(seen[t, :, : 2 * n], b[:, : 2 * n], out=gates[t])
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            inner[t] = b[:, 2 * n :]
            c = np.multiply(zr[:, n:], inner[t], out=new[t])
            c += seen[t, :, 2 * n :]
            np.tanh(c, out=c)
            np.subtract(before[t], c, out=change)
            change *= zr[:, :n]
            h = np.add(c, change, out=out[t])
        return out, h.copy()

    def bounded(self) -> bool:
        """States lie between -1 and 1, so weights bound the logits. Where no exponential can overflow, logits needn't be
        shifted by their maximum first."""
        p = self.p
        return all(float((np.abs(p[w]).sum(0) + p[b]).max(initial=0)) < 60 for w, b in (("wc", "bc"), ("ww", "bw")))

    def by_class(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in order of their class, and where each class begins."""
        order = np.argsort(c.astype(np.int16), kind="stable")
        return order, np.searchsorted(c[order], np.arange(self.classes + 1))

    def logp(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural-log probability of tokens y (a group's token: of its class) in states h. Logits stand in columns, one for
        each state, so that sums over them run along rows."""
        order, at = self.by_class(self.class_of[y])
        h, y = h[order].T, y[order]
        c, rows = self.class_of[y], np.arange(len(y))

        shift = not self.bounded()

        def chosen(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
            if shift:
                logits -= logits.max(0)
            got = logits[which, rows[: len(which)]]
            return got - np.log(np.exp(logits, out=logits).sum(0))

        got = chosen(self.p["wc"].T @ h + self.p["bc"][:, None], c)
        for k in range(self.classes - self.groups):
            a, b, lo, hi = at[k], at[k + 1], self.edge[k], self.edge[k + 1]
            if b > a and hi - lo > 1:
                got[a:b] += chosen(self.p["ww"][:, lo:hi].T @ h[:, a:b] + self.p["bw"][lo:hi, None], y[a:b] - lo)
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, work: Work | None = None) -> tuple[dict, np.ndarray, float]:
        """Truncated backpropagation through one window."""
        n, u = self.hidden, self.p["u"]
        work = Work(u.dtype) if work is None else work
        out, last = self.steps(x, h, work)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, at = self.by_class(self.class_of[y.ravel()])
        flat, target = out.reshape(-1, n)[order].T, y.ravel()[order]
        c, rows = self.class_of[target], np.arange(len(target))

        shift = not self.bounded()

        def softmax(d: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, float]:
            """The loss's slope by the logits, which stand in columns, and the loss."""
            if shift:
                d -= d.max(0)
            np.exp(d, out=d)
            d /= d.sum(0)
            picked = d[which, rows[: len(which)]]
            d[which, rows[: len(which)]] -= 1
            return d, -float(np.log(picked + 1e-30).sum())

        d, loss = softmax(self.p["wc"].T @ flat + self.p["bc"][:, None], c)
        g["wc"], g["bc"], dh = flat @ d.T, d.sum(1), self.p["wc"] @ d
        for k in range(self.classes - self.groups):
            a, b, lo, hi = at[k], at[k + 1], self.edge[k], self.edge[k + 1]
            if b > a and hi - lo > 1:
                w = self.p["ww"][:, lo:hi]
                d, more = softmax(w.T @ flat[:, a:b] + self.p["bw"][lo:hi, None], target[a:b] - lo)
                loss += more
                g["ww"][:, lo:hi], g["bw"][lo:hi] = flat[:, a:b] @ d.T, d.sum(1)
                dh[:, a:b] += w @ d
        dh = dh.T
        back = work("back", dh.shape)
        back[order] = dh
        dh, da, db = back.reshape(out.shape), work("da", (*x.shape, 3 * n)), work("db", (*x.shape, 3 * n))
        before, gates, new, inner = (work(k, (*x.shape, w * n)) for k, w in (("before", 1), ("gates", 2), ("new", 1), ("inner", 1)))
        carried = (x != 0)[:, :, None].astype(u.dtype)
        carry = np.zeros_like(h)
        for t in reversed(range(len(x))):
            z, r, c = gates[t, :, :n], gates[t, :, n:], new[t]
            d = dh[t]
            d += carry
            dc = (1 - c * c) * (1 - z) * d
            da[t, :, :n] = d * (before[t] - c) * z * (1 - z)
            da[t, :, n : 2 * n] = dc * inner[t] * r * (1 - r)
            da[t, :, 2 * n :] = dc
            db[t, :, : 2 * n] = da[t, :, : 2 * n]
            np.multiply(dc, r, out=db[t, :, 2 * n :])
            carry = db[t] @ u.T
            carry += d * z
            carry *= carried[t]
        g["u"] = before.reshape(-1, n).T @ db.reshape(-1, 3 * n)
        token = x.ravel()
        order = np.argsort(token.astype(np.int16), kind="stable")
        token = token[order]
        first = np.flatnonzero(np.diff(token, prepend=-1))
        g["embed"][token[first]] = np.add.reduceat(da.reshape(-1, 3 * n)[order], first)
        return {k: v / len(target) for k, v in g.items()}, last, loss / len(target)

    def fit(self, texts: list[np.ndarray], *, epochs: int = 1, rate: float = 0.01, to: float = 0.0) -> Gru:
        """Adam on windows of WINDOW tokens. The texts, whole, are laid end to end and cut into rows that run side by
        side, their states carried on; the rate falls to the share ``to`` of itself."""
        if not texts:
            return self
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        stream = np.concatenate([np.append(0, t) for t in texts] + [np.zeros(1, np.int64)])
        rows = int(np.clip((len(stream) - 1) // (WINDOW * STEPS), 4, SIDE))
        long = -(-(len(stream) - 1) // rows)
        stream = np.append(stream, np.zeros(rows * long + 1 - len(stream), stream.dtype))  # ends fill the last row
        x, y = stream[: rows * long].reshape(rows, long).T, stream[1 : rows * long + 1].reshape(rows, long).T
        total, k, work = epochs * -(-long // WINDOW), 0, Work()
        for _ in range(epochs):
            h = np.zeros((rows, self.hidden), np.float32)
            for a in range(0, long, WINDOW):
                g, h, _ = self.gradients(x[a : a + WINDOW], y[a : a + WINDOW], h, work)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step, k = rate * (1 - (1 - to) * k / total) + 1e-5, k + 1
                for n, v in g.items():
                    v *= min(1.0, 1.0 / (norm + 1e-9))
                    mean[n] += 0.1 * (v - mean[n])
                    square[n] += 0.01 * (v * v - square[n])
                    self.p[n] -= (step * (mean[n] / (1 - 0.9**k)) / (np.sqrt(square[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each text's tokens and its end. SIDE texts of like length run side by side, window by
        window with the state carried on; a text leaves when it has ended."""
        size = np.array([len(t) + 1 for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(texts))
        work = Work()
        for k in range(0, len(texts), SIDE):
            self._score(texts, order[k : k + SIDE], size, out, work)
        return out

    def _score(self, texts: list[np.ndarray], order: np.ndarray, size: np.ndarray, out: np.ndarray, work: Work) -> None:
        h, size, last = np.zeros((len(order), self.hidden), np.float32), size[order], np.zeros(len(order), np.int64)
        for a in range(0, int(size[0]), WINDOW):
            n = int(np.searchsorted(-size, -a))
            y = np.zeros((n, WINDOW), np.int64)
            for k in range(n):
                part = texts[order[k]][a : a + WINDOW]
                y[k, : len(part)] = part
            x = np.concatenate([last[:n, None], y[:, :-1]], 1)
            valid = (a + np.arange(WINDOW))[:, None] < size[None, :n]
            states, h = self.steps(np.ascontiguousarray(x.T), h[:n], work)
            got = self.logp(states[valid], y.T[valid])
            out[order[:n]] += np.bincount(np.nonzero(valid)[1], got, n)
            last = y[:, -1]
