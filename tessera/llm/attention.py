"""A small causal self-attention language model in numpy, on subword ids.

One attention layer over embeddings of subwords and places in the window; the
output map of the single head is part of its value map. The next id is
predicted in two steps, its class and the id within the class, so that a
prediction costs 2*sqrt(V) terms rather than V. The last hidden unit is held at
one, so that its weights are biases; they begin at the corpus's own counts.

Documents lie end to end as one row of ids. A window scores SCORED places and
sees CONTEXT places before them; windows of a document follow each other, so
that each place is scored once. A place's input is the id before it, ``bos`` at
the document's start. Empty input gives empty output; ids must be below
CLASSES * CLASSES, and documents have one token at least.
"""

from __future__ import annotations

import numpy as np

#: Production parameters: width, ids of the vocabulary = CLASSES * CLASSES, scored places of a window and places of context before them.
WIDTH, CLASSES, SCORED, CONTEXT = 16, 40, 24, 8
SPAN = CONTEXT + SCORED
#: Windows scored at once, and to a step of training.
BATCH, STEP = 256, 160
#: Adam's step, decays and the number of steps after which its start counts no more.
RATE, FIRST, SECOND, WARM = 0.01, 0.9, 0.99, 500
_F = np.float32
#: Parameters in the order of the flat vector: embeddings, places, maps to query, key, value and rest side by side, classes, ids within classes.
SHAPES = {"E": (CLASSES * CLASSES, WIDTH), "P": (SPAN, WIDTH), "W": (WIDTH, 4 * WIDTH), "C": (CLASSES, WIDTH), "U": (CLASSES, CLASSES, WIDTH)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named parts of the flat vector, without a copy."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """The flat vector, with biases from the counts of each id."""
    flat = (np.random.default_rng(seed).standard_normal(SIZE) * 0.1).astype(_F)
    p = views(flat)
    c = counts.reshape(CLASSES, CLASSES) + 0.1
    total = c.sum(axis=1)
    p["W"][:, 3 * WIDTH :] = np.eye(WIDTH) * 1.5
    p["C"][:, -1], p["U"][:, :, -1] = np.log(total / total.sum()), np.log(c / total[:, None])
    return flat


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: the first scored place of each window, and its document's first place and end."""
    n = -(-sizes // SCORED)
    doc = np.repeat(np.arange(len(sizes)), n)
    end = np.cumsum(sizes)
    first = end - sizes
    return first[doc] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * SCORED, first[doc], end[doc]


_MASK = (np.arange(SPAN)[None, :] <= (CONTEXT + np.arange(SCORED))[:, None]).astype(_F)
_PLACES = np.arange(SPAN) - CONTEXT


#: To query and rest, to key and value.
Pair = tuple[np.ndarray, np.ndarray]


class Pass:
    """The forward half for some windows: inputs, attention and hidden states, targets sorted by class."""

    def __init__(self, p: dict[str, np.ndarray], table: Pair, place: Pair, wild: tuple[bool, bool], ids: np.ndarray, start: np.ndarray, first: np.ndarray, end: np.ndarray, bos: int):
        d = WIDTH
        at = start[:, None] + _PLACES
        self.x = ids.take(at - 1, mode="clip")
        edge = np.flatnonzero((start - CONTEXT <= first) | (start + SCORED > end))
        inside = at[edge]
        self.x[edge] = np.where(inside > first[edge, None], self.x[edge], bos)
        real = (inside >= first[edge, None]) & (inside < end[edge, None])
        own, seen = table[0].take(self.x[:, CONTEXT:], axis=0, mode="clip"), table[1].take(self.x, axis=0, mode="clip")
        own += place[0]
        seen += place[1]
        self.q, self.k, self.v, r = own[:, :, :d], seen[:, :, :d], seen[:, :, d:], own[:, :, d:]
        s = np.matmul(self.q, self.k.transpose(0, 2, 1))
        if wild[0]:
            np.minimum(s, _F(60), out=s)  # exp stays finite without a look for the largest
        np.exp(s, out=s)
        s *= _MASK
        s[edge] *= real[:, None, :]
        o = np.matmul(s, self.v)  # the last column is the sum of the weights, as that of v is one
        self.s, self.share = s, 1 / (o[:, :, -1:] + _F(1e-30))
        o *= self.share
        r += o
        g = np.tanh(r)
        g[:, :, -1] = 1
        self.o, self.g = o, g.reshape(-1, d)
        self.at = at[:, CONTEXT:].reshape(-1)
        #: places of the windows that lie beyond their document
        self.none = (edge[:, None] * SCORED + np.arange(SCORED))[~real[:, CONTEXT:]]
        t = ids.take(self.at, mode="clip")
        self.order = np.argsort(t.astype(np.int16), kind="stable")
        t = t[self.order]
        c = t // CLASSES
        self.gs = self.g.take(self.order, axis=0, mode="clip")  # much faster than by an index in brackets
        self.cut = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        rows = np.arange(0, len(t) * CLASSES, CLASSES)
        #: where the target's class, and its id within the class, lie in z and y laid out as one row
        self.of_class = rows + c
        self.of_id = rows + t
        self.of_id -= c * CLASSES
        self.z, self.zs = _exp(self.gs @ p["C"].T, wild[1])
        y = np.empty((len(t), CLASSES), _F)
        for k in range(CLASSES):
            if self.cut[k] < self.cut[k + 1]:
                np.matmul(self.gs[self.cut[k] : self.cut[k + 1]], p["U"][k].T, out=y[self.cut[k] : self.cut[k + 1]])
        self.y, self.ys = _exp(y, wild[1])

    def put(self, out: np.ndarray) -> None:
        """ln p of each scored place into out; before ``Trainer`` goes back."""
        # each a share first: the product of two exps may be beyond the largest number
        chance = (self.z.reshape(-1).take(self.of_class) * self.zs) * (self.y.reshape(-1).take(self.of_id) * self.ys)
        ln = np.empty(len(chance), _F)
        ln[self.order] = np.log(np.maximum(chance, _F(1e-37)))
        if len(self.none):
            keep = np.ones(len(ln), dtype=bool)
            keep[self.none] = False
            out[self.at[keep]] = ln[keep]
        else:
            out[self.at] = ln


_ONES = np.ones(CLASSES, _F)


def _exp(z: np.ndarray, wild: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows in place, and one over their sums."""
    if wild:
        np.minimum(z, _F(80), out=z)
    np.exp(z, out=z)
    return z, 1 / (z @ _ONES + _F(1e-30))


_UNITS = np.ones(WIDTH, _F)
_HALF = np.repeat(_F([1, 0]), WIDTH)


def _wild(p: dict[str, np.ndarray], table: Pair, place: Pair) -> tuple[bool, bool]:
    """Whether exp of attention, and of the predictions, may overflow.

    Products of two vectors are at most those of their lengths. Hidden units are at most one, the last one is one, so
    that a prediction is at most the sum of its other weights without their signs, and its bias.
    """
    q, k = (sum(float(np.sqrt((np.square(x) @ _HALF).max())) for x in two) for two in zip(table, place, strict=True))
    most = max(float((np.abs(w) @ _UNITS + np.minimum(0, 2 * w[:, -1])).max()) for w in (p["C"], p["U"].reshape(-1, WIDTH)))
    return q * k > 60, most > 80


def _tables(p: dict[str, np.ndarray]) -> tuple[Pair, Pair]:
    """All ids and all places (those that are scored) under the maps to query and rest, and under those to key and value; the query is scaled."""
    d = WIDTH
    w = p["W"] * _SCALE
    own, seen = np.hstack([w[:, :d], w[:, 3 * d :]]), np.ascontiguousarray(w[:, d : 3 * d])
    table, place = (p["E"] @ own, p["E"] @ seen), (p["P"][CONTEXT:] @ own, p["P"] @ seen)
    # the last value is one everywhere
    table[1][:, -1], place[1][:, -1] = 0, 1
    return table, place


#: What the columns of W are multiplied by: the query is scaled.
_SCALE = np.repeat(_F([WIDTH**-0.5, 1, 1, 1]), WIDTH)


def score(flat: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bos: int) -> np.ndarray:
    """ln p of each id given its window, with fixed weights: each token once."""
    p = views(flat)
    table, place = _tables(p)
    wild = _wild(p, table, place)
    start, first, end = windows(sizes)
    out = np.zeros(len(ids), dtype=_F)
    for lo in range(0, len(start), BATCH):
        part = slice(lo, lo + BATCH)
        Pass(p, table, place, wild, ids, start[part], first[part], end[part], bos).put(out)
    return out


class Trainer:
    """Adam on batches of windows."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(_F)
        self.p = views(self.flat)
        self.m, self.v = np.zeros(SIZE, _F), np.zeros(SIZE, _F)
        self.grad, self.room = np.zeros(SIZE, _F), np.zeros(SIZE, _F)
        self.d = views(self.grad)
        self.steps = 0

    def train(self, ids: np.ndarray, sizes: np.ndarray, bos: int, rng: np.random.Generator, wanted: bool = True) -> np.ndarray:
        """One step for each STEP windows, dealt by rng. Returns ln p of each token when its step began (zeros if not wanted)."""
        start, first, end = windows(sizes)
        out = np.zeros(len(ids), dtype=_F)
        order = rng.permutation(len(start))
        for lo in range(0, len(order), STEP):
            pick = order[lo : lo + STEP]
            table, place = _tables(self.p)
            f = Pass(self.p, table, place, _wild(self.p, table, place), ids, start[pick], first[pick], end[pick], bos)
            if wanted:
                f.put(out)
            self._backward(f)
            self._adam()
        return out

    def _backward(self, f: Pass) -> None:
        p, g, d = self.p, self.d, WIDTH
        size = _F(1 / max(1, len(f.at) - len(f.none)))
        gone = np.zeros(len(f.at), dtype=bool)
        gone[f.none] = True
        gone = np.flatnonzero(gone[f.order])
        # through both softmaxes
        z, y = f.z, f.y
        z *= f.zs[:, None]
        y *= f.ys[:, None]
        z.reshape(-1)[f.of_class] -= 1
        y.reshape(-1)[f.of_id] -= 1
        z[gone], y[gone] = 0, 0
        gs = f.gs * size
        g["C"][:] = z.T @ gs
        dg = z @ p["C"]
        g["U"][:] = 0
        for k in range(CLASSES):
            lo, hi = f.cut[k], f.cut[k + 1]
            if lo < hi:
                np.matmul(y[lo:hi].T, gs[lo:hi], out=g["U"][k])
                dg[lo:hi] += y[lo:hi] @ p["U"][k]
        dg *= size - gs * f.gs
        back = np.empty(len(f.order), f.order.dtype)
        back[f.order] = np.arange(len(back))
        da = dg.take(back, axis=0, mode="clip").reshape(-1, SCORED, d)
        # through attention; the last column of da is 0, as that hidden unit is held
        s = f.s
        every = np.empty((len(da), SPAN, 4 * d), _F)  # to query, key, value and rest of all places
        every[:, :CONTEXT, :d] = every[:, :CONTEXT, 3 * d :] = 0
        every[:, CONTEXT:, 3 * d :] = da
        da *= f.share
        np.matmul(s.transpose(0, 2, 1), da, out=every[:, :, 2 * d : 3 * d])
        # the mean of what the weights of a place get is taken off by the values' column of ones
        da[:, :, -1] = -np.einsum("bij,bij->bi", da, f.o)
        ds = np.matmul(da, f.v.transpose(0, 2, 1))
        ds *= s
        np.matmul(ds, f.k, out=every[:, CONTEXT:, :d])
        np.matmul(ds.transpose(0, 2, 1), f.q, out=every[:, :, d : 2 * d])
        # to the maps, and by id to the embeddings
        every = every.reshape(-1, 4 * d)
        e = p["E"].take(f.x, axis=0, mode="clip")
        e += p["P"]
        np.matmul(e.reshape(-1, d).T, every, out=g["W"])
        g["W"] *= _SCALE
        de = (every @ np.ascontiguousarray((p["W"] * _SCALE).T)).reshape(-1, SPAN, d)
        g["P"][:] = de.sum(axis=0)
        x = f.x.ravel()
        order = np.argsort(x.astype(np.int16), kind="stable")
        x = x[order]
        cut = np.append(0, np.flatnonzero(x[1:] != x[:-1]) + 1)
        g["E"][:] = 0
        # two columns at once, as the parts of a complex number
        pairs = de.reshape(-1, d).take(order, axis=0, mode="clip").view(np.complex64)
        g["E"][x[cut]] = np.add.reduceat(pairs, cut, axis=0).view(_F)

    def _adam(self) -> None:
        self.steps += 1
        n = min(self.steps, WARM)
        g, x = self.grad, self.room
        self.m *= _F(FIRST)
        np.multiply(g, _F(1 - FIRST), out=x)
        self.m += x
        self.v *= _F(SECOND)
        np.multiply(g, g, out=x)
        x *= _F(1 - SECOND)
        self.v += x
        np.sqrt(self.v, out=x)
        x += _F(1e-8)
        np.divide(self.m, x, out=x)
        x *= _F(RATE / (1 - FIRST**n) * (1 - SECOND**n) ** 0.5)
        self.flat -= x
