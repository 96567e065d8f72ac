"""A small causal self-attention model over subword symbols, in numpy.

Input symbols index tables of queries, keys, values and embeddings. A position
attends to itself and to the positions before it in its window, with a learned bias per
distance; ``h = tanh(embedding + attention)`` alone predicts the next symbol in two
soft-max steps of about the square root of the vocabulary each: its class,
then the member of that class. Classes come from splitting symbols in halves along
the main direction of their neighbour counts.

A text is cut into windows of ``span`` positions that advance by ``stride``:
only the last ``stride`` of a window are predicted, so each token is scored
once, with at least ``span - stride`` tokens of context where the text
has them.
"""

from __future__ import annotations

import numpy as np

SPAN, STRIDE, WIDTH, SIDE = 24, 16, 32, 32
SYMBOLS = SIDE * SIDE  # the last one stands for all rare subwords
RARE, START, PAD = SYMBOLS - 1, SYMBOLS, SYMBOLS + 1
BLOCK = 512


def balanced_classes(neighbours: np.ndarray) -> np.ndarray:
    """A slot (class * SIDE + member) for each symbol; symbols with similar rows share a class."""
    rows = np.log1p(neighbours)
    rows = rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
    groups = [np.arange(SYMBOLS)]
    while len(groups) < SIDE:
        halves = []
        for g in groups:
            x = rows[g] - rows[g].mean(0)
            v = np.ones(x.shape[1]) + np.arange(x.shape[1]) % 7
            for _ in range(12):
                v = x.T @ (x @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = g[np.argsort(x @ v, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    slot = np.empty(SYMBOLS, np.int64)
    for c, g in enumerate(groups):
        slot[g] = c * SIDE + np.arange(len(g))
    return slot


class Attention:
    def __init__(self, slot: np.ndarray, params: dict[str, np.ndarray]):
        self.slot, self.p = slot, params
        i, j = np.arange(STRIDE)[:, None] + SPAN - STRIDE, np.arange(SPAN)[None, :]
        self.distance, self.seen = np.clip(i - j, 0, SPAN - 1), j <= i
        self._held: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_held": {}}

    def _space(self, name: str, shape: tuple[int, ...], dtype=np.float32) -> np.ndarray:
        """An array of this name and shape, the same one at each call: new pages for each step would cost as much as a third of it."""
        key = name, shape, np.dtype(dtype)
        if key not in self._held:
            self._held[key] = np.empty(shape, dtype)
        return self._held[key]

    @classmethod
    def fresh(cls, slot: np.ndarray, counts: np.ndarray, seed: int = 11) -> Attention:
        """Starts as the unigram model of ``counts``."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        p = {k: draw(SYMBOLS + 2, WIDTH) for k in ("query", "key", "value", "embed")}
        by_slot = np.zeros(SYMBOLS)
        by_slot[slot] = counts + 0.5
        grid = by_slot.reshape(SIDE, SIDE)
        p["class"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        p["member"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
        p |= {"to_class": draw(WIDTH, SIDE), "to_member": draw(WIDTH, SIDE), "gate": 1 + draw(SIDE, WIDTH), "bias": np.zeros(SPAN, np.float32)}
        return cls(slot, p)

    def to_bytes(self) -> bytes:
        return b"".join(self.p[k].astype(np.float32).tobytes() for k in sorted(self.p))

    def from_bytes(self, data: bytes) -> Attention:
        flat, at, out = np.frombuffer(data, np.float32), 0, {}
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n
        return Attention(self.slot, out)

    def _forward(self, ids: np.ndarray, target: np.ndarray):
        p, q_ids = self.p, ids[:, SPAN - STRIDE :]
        q, k, v = p["query"][q_ids], p["key"][ids], p["value"][ids]
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(WIDTH**-0.5)
        a += np.where(self.seen, p["bias"][self.distance], np.float32(-1e9))
        a += np.where(ids == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        h = a @ v
        h += p["embed"][q_ids]
        np.tanh(h, out=h)
        slot = self.slot[target]
        c, m = slot // SIDE, slot % SIDE
        flat = h.reshape(-1, WIDTH)
        lc = (flat @ p["to_class"]).reshape(*c.shape, SIDE) + p["class"]
        u = h * p["gate"][c]
        lm = (u.reshape(-1, WIDTH) @ p["to_member"]).reshape(*c.shape, SIDE) + p["member"][c]
        return q_ids, q, k, v, a, h, c, m, lc, u, lm

    def frozen(self) -> Attention:
        """Lays the tables out for scoring; call again if parameters change.

        There are few symbols, so the exponentials of all products of a query and a key are a table; what is not seen weighs 0.
        """
        p = self.p
        with np.errstate(over="ignore"):
            self._near = np.where(self.seen, np.exp(p["bias"][self.distance]), 0).astype(p["key"].dtype)
            self._pairs = np.exp(p["query"] @ (p["key"] * p["key"].dtype.type(WIDTH**-0.5)).T)
        self._pairs[:, PAD] = 0
        self._choice = np.concatenate([p["gate"], p["member"]], 1)
        return self

    def log_prob(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability (windows x STRIDE), by batched masked attention.

        Sums of exponentials are taken as they are; a batch in which one leaves the range of floats is done again on shifted logits.
        """
        if not hasattr(self, "_pairs"):
            self.frozen()
        p, n, kind = self.p, len(ids), self._pairs.dtype
        new = lambda name, *shape: self._space(name, shape, kind)
        pick = lambda name, table, at: np.take(table, at, 0, new(name, len(at), table.shape[1]), "clip")
        q_ids = ids[:, SPAN - STRIDE :]
        pair = np.add((q_ids * len(self._pairs))[:, :, None], ids[:, None, :], out=self._space("pair", (n, STRIDE, SPAN), np.int64))
        a = np.take(self._pairs.reshape(-1), pair, out=new("a", n, STRIDE, SPAN), mode="clip")
        value = pick("value", p["value"], ids.ravel()).reshape(n, SPAN, WIDTH)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            a *= self._near
            total = a.reshape(-1, SPAN) @ np.ones((SPAN, 1), kind)
            h = np.matmul(a, value, out=new("h", n, STRIDE, WIDTH)).reshape(-1, WIDTH)
            h /= total
            h += pick("embed", p["embed"], q_ids.ravel())
            np.tanh(h, out=h)
            c, m = np.divmod(self.slot.take(target.ravel()), SIDE)
            choice = pick("choice", self._choice, c)
            lc = np.matmul(h, p["to_class"], out=new("lc", len(c), SIDE))
            lc += p["class"]
            h *= choice[:, :WIDTH]
            lm = np.matmul(h, p["to_member"], out=new("lm", len(c), SIDE))
            lm += choice[:, WIDTH:]
            at, one = np.arange(len(c)) * SIDE, np.ones(SIDE, kind)
            out = (lc.reshape(-1).take(at + c) + lm.reshape(-1).take(at + m)).astype(np.float64)
            np.exp(lc, out=lc)
            np.exp(lm, out=lm)
            out -= np.log((lc @ one).astype(np.float64)) + np.log((lm @ one).astype(np.float64))
        if not np.isfinite(out).all():
            return self._stable(ids, target)
        return out.reshape(n, STRIDE)

    def _stable(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        *_, c, m, lc, _, lm = self._forward(ids, target)
        out = np.zeros(c.shape)
        for x, at in ((lc, c), (lm, m)):
            x = x.astype(np.float64)
            x -= x.max(-1, keepdims=True)
            out += np.take_along_axis(x, at[..., None], -1)[..., 0] - np.log(np.exp(x).sum(-1))
        return out

    def gradients(self, ids: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability over the ``real`` targets; the next call writes over them.

        Logits are shifted by their largest only where they leave the range in which exponentials are safe.
        """
        p, n, kind = self.p, len(ids), self.p["key"].dtype
        every = n * STRIDE
        root, one = WIDTH**-0.5, np.ones(max(SIDE, SPAN, every), kind)
        all_ids, q_ids = ids.ravel(), ids[:, SPAN - STRIDE :].ravel()
        new = lambda name, *shape: self._space(name, shape, kind)
        pick = lambda name, at, *shape: np.take(p[name], at, 0, new(name, len(at), p[name].shape[1]), "clip").reshape(*shape, -1)
        calm = lambda x: x.max() < 60 and x.min() > -60
        q, k, v = pick("query", q_ids, n, STRIDE), pick("key", all_ids, n, SPAN), pick("value", all_ids, n, SPAN)
        q *= root

        a = np.matmul(q, k.transpose(0, 2, 1), out=new("a", n, STRIDE, SPAN))
        level = calm(a) and calm(p["bias"])
        a += np.where(self.seen, p["bias"][self.distance], -1e9).astype(kind)
        pad = ids == PAD
        some = np.flatnonzero(pad.any(1))
        if len(some):
            a[some] += np.where(pad[some], kind.type(-1e9), kind.type(0))[:, None, :]
        if not level:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= (a.reshape(-1, SPAN) @ one[:SPAN]).reshape(n, STRIDE, 1)
        h = np.matmul(a, v, out=new("h", n, STRIDE, WIDTH)).reshape(-1, WIDTH)
        h += pick("embed", q_ids, every)
        np.tanh(h, out=h)

        c, m = np.divmod(self.slot.take(target.ravel()), SIDE)
        gate = pick("gate", c, every)
        lc = np.matmul(h, p["to_class"], out=new("lc", every, SIDE))
        lc += p["class"]
        u = np.multiply(h, gate, out=new("u", every, WIDTH))
        both = new("both", every, SIDE + WIDTH)  # slopes of members and of gates, which are added up by class
        lm = np.matmul(u, p["to_member"], out=new("lm", every, SIDE))
        lm += pick("member", c, every)
        scale = (real.ravel() / max(1, real.sum())).astype(kind)
        for x, at in ((lc, c), (lm, m)):
            if not calm(x):
                x -= x.max(1, keepdims=True)
            np.exp(x, out=x)
            x *= (scale / (x @ one[:SIDE]))[:, None]
            x.reshape(-1)[np.arange(every) * SIDE + at] -= scale

        g = {"to_class": h.T @ lc, "to_member": u.T @ lm, "class": one[:every] @ lc}
        du = np.matmul(lm, p["to_member"].T, out=new("du", every, WIDTH))
        both[:, :SIDE] = lm
        np.multiply(du, h, out=both[:, SIDE:])
        ds = np.matmul(lc, p["to_class"].T, out=new("ds", every, WIDTH))
        du *= gate
        ds += du
        h *= h
        np.subtract(1, h, out=h)
        ds *= h
        ds = ds.reshape(n, STRIDE, WIDTH)
        da = np.matmul(ds, v.transpose(0, 2, 1), out=new("da", n, STRIDE, SPAN))
        da *= a
        da -= np.multiply(a, (da.reshape(-1, SPAN) @ one[:SPAN]).reshape(n, STRIDE, 1), out=new("part", n, STRIDE, SPAN))
        g["bias"] = np.bincount(self.distance.ravel(), one[:n] @ da.reshape(n, -1), minlength=SPAN).astype(kind)
        local, memory = new("d-local", n, STRIDE, 2 * WIDTH), new("d-memory", n, SPAN, 2 * WIDTH)
        np.matmul(da, k, out=local[..., :WIDTH])
        local[..., :WIDTH] *= root
        local[..., WIDTH:] = ds
        np.matmul(da.transpose(0, 2, 1), q, out=memory[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), ds, out=memory[..., WIDTH:])
        for names, at, rows, size in ((("query", "embed"), q_ids, local, SYMBOLS + 2), (("key", "value"), all_ids, memory, SYMBOLS + 2), (("member", "gate"), c, both, SIDE)):
            g[names[0]], g[names[1]] = np.hsplit(self._scatter(names[0], at, rows, size), 2)
        return g

    def _scatter(self, name: str, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the rows of each id, two columns at a time as one complex number."""
        pairs = rows.view(np.result_type(rows.dtype, np.complex64)).reshape(len(ids), -1)
        out, place = self._space(f"sum-{name}", (n, pairs.shape[1]), pairs.dtype), self._space(f"place-{name}", pairs.shape, np.int64)
        np.add((ids * pairs.shape[1])[:, None], np.arange(pairs.shape[1]), out=place)
        out.fill(0)
        np.add.at(out.reshape(-1), place.reshape(-1), pairs.reshape(-1))
        return out.view(rows.dtype)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v, self.part = rate, 0, {}, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], share: float) -> None:
        self.t += 1
        rate = self.rate * share * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            if k not in self.m:
                self.m[k], self.v[k], self.part[k] = (np.zeros(g.shape, g.dtype) for _ in range(3))
            m, v, x = self.m[k], self.v[k], self.part[k]
            m *= 0.9  # 10 times the mean of the slopes, and 100 times that of their squares
            m += g
            v *= 0.99
            v += np.multiply(g, g, out=x)
            np.sqrt(v, out=x)
            x += 1e-7
            np.divide(m, x, out=x)
            x *= rate
            params[k] -= x


def windows(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first predicted position) of every window, for rows of these lengths."""
    n = -(-length // STRIDE)
    row = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k * STRIDE


def window_ids(inputs: np.ndarray, outputs: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, at: np.ndarray):
    """(ids, targets, real) of windows over concatenated rows of inputs and outputs."""
    pos = at[:, None] + np.arange(STRIDE - SPAN, STRIDE)
    inside = (pos >= 0) & (pos < length[row][:, None])
    where = np.where(inside, pos + start[row][:, None], 0)
    ids = np.where(inside, inputs[where], PAD)
    return ids, outputs[where[:, SPAN - STRIDE :]], inside[:, SPAN - STRIDE :]
