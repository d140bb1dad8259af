"""A small causal self-attention model in numpy, on subword ids.

One head, one layer: with x the sum of a subword and a place embedding, scores x A x' are
masked to the past and normalised, and y = x + (softmax(scores) x) W. The next subword's
probability is exact at every step: that of its class, softmax(y U + b), times that of the
subword among the members of its class, softmax(y V' + c) over those. Frequent subwords are
classes of their own; the others share classes by frequency, so most steps look at few members.

Sequences are cut into windows of LENGTH inputs. In scoring they overlap by LENGTH - STRIDE,
and each token is scored once, in the first window that holds it. In training they do not
overlap, and each token is a target once.
"""

from dataclasses import dataclass

import numpy as np

LENGTH, STRIDE, WIDTH = 16, 12, 16
#: The most frequent subwords are classes of their own. The others are cut by their rank into
#: EVEN bands of BAND and then DOUBLING ones, each of two classes; the end is the last class.
ALONE, BAND, EVEN, DOUBLING = 23, 64, 12, 8
CLASSES = ALONE + 2 * (EVEN + DOUBLING) + 1
_PAST = np.tril(np.ones((LENGTH, LENGTH), dtype=np.float32))
_SCALE = np.float32(WIDTH**-0.5)


def classes_of(counts: np.ndarray, starts_word: np.ndarray) -> np.ndarray:
    """A class for each id, the last of which is the end. Classes of several ids hold a range
    of ranks by frequency, apart by whether they start a word."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    rank = np.empty(len(counts), dtype=np.int64)
    rank[order] = np.arange(len(counts))
    sizes = [BAND] * EVEN + [BAND << k for k in range(1, DOUBLING)]  # the last band has no end
    band = np.searchsorted(np.cumsum(sizes), rank - ALONE, side="right")
    out = np.where(rank < ALONE, rank, ALONE + 2 * band + starts_word)
    out[-1] = CLASSES - 1
    return out


@dataclass
class Layout:
    """Where the ids' rows are: slots are sorted by class. begin: CLASSES + 1 edges of the slots."""

    kind: np.ndarray
    slot: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, kind: np.ndarray) -> "Layout":
        slot = np.empty(len(kind), dtype=np.int64)
        slot[np.argsort(kind, kind="stable")] = np.arange(len(kind))
        return cls(kind, slot, np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES))))


@dataclass
class Weights:
    """E: inputs (ids, the end and the beginning of a text), P: places; V, c: slots."""

    E: np.ndarray
    P: np.ndarray
    A: np.ndarray
    W: np.ndarray
    U: np.ndarray
    b: np.ndarray
    V: np.ndarray
    c: np.ndarray

    @classmethod
    def initial(cls, layout: Layout, counts: np.ndarray, seed: int = 3) -> "Weights":
        """Small random weights; the biases give classes and members their shares."""
        rng, n = np.random.default_rng(seed), len(layout.kind)
        some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        smooth = counts + 0.05
        total = np.bincount(layout.kind, weights=smooth, minlength=CLASSES)
        c = np.empty(n, dtype=np.float32)
        c[layout.slot] = np.log(smooth / total[layout.kind])
        b = np.log((total + 1e-3) / total.sum()).astype(np.float32)
        eye = np.eye(WIDTH, dtype=np.float32) * 0.3
        return cls(some(n + 1, WIDTH, scale=0.3), some(LENGTH, WIDTH, scale=0.1), eye.copy(), eye.copy(), some(WIDTH, CLASSES, scale=0.1), b, some(n, WIDTH, scale=0.1), c)

    def parts(self) -> list[np.ndarray]:
        return [self.E, self.P, self.A, self.W, self.U, self.b, self.V, self.c]

    def copy(self) -> "Weights":
        return Weights(*[x.copy() for x in self.parts()])


def windows(ids: np.ndarray, edges: np.ndarray, begin: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, where, fresh) of the windows of sequences that begin at edges[:-1]; none is empty.
    inputs[w, i] is what stands before the token at where[w, i], the beginning for a first
    one; fresh says which tokens are there and in no window before."""
    sizes = np.diff(edges)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[edges[:-1]] = begin
    per = 1 + np.maximum(0, -(-(sizes - LENGTH) // stride))
    seq = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    span = np.arange(LENGTH)
    where = (edges[:-1][seq] + nth * stride)[:, None] + span
    fresh = (where < edges[1:][seq][:, None]) & (span >= np.where(nth > 0, LENGTH - stride, 0)[:, None])
    return before.take(where, mode="clip"), where, fresh


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), overwriting z, and the sums of the rows. Should they overflow or vanish, the
    caller shifts the rows and calls again."""
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], dtype=z.dtype)


def _scores(y: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in proportion to softmax(y weights + bias), and their sums."""
    with np.errstate(over="ignore"):
        z = y @ weights
        z += bias
        z, total = _exp(z)
    if not (np.isfinite(total) & (total > 0)).all():
        z = y @ weights + bias
        z, total = _exp(z - z.max(axis=1)[:, None])
    return z, total


def _log_share(y: np.ndarray, weights: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of softmax(y weights + bias) at one column for each row."""
    z, total = _scores(y, weights, bias)
    own = z.ravel().take(np.arange(len(z)) * z.shape[1] + which)
    return np.log(np.maximum(own, np.float32(1e-38))) - np.log(total)


def _shares(y: np.ndarray, weights: np.ndarray, bias: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The losses -log softmax(y weights + bias) at one column for each row, and the gradient
    of their sum over n in those scores."""
    z, total = _scores(y, weights, bias)
    at = np.arange(len(z)) * z.shape[1] + which
    loss = np.log(total) - np.log(np.maximum(z.ravel().take(at), np.float32(1e-38)))
    z *= (1 / (total * np.float32(n)))[:, None]
    z.reshape(-1)[at] -= np.float32(1 / n)
    return loss, z


def _attend(w: Weights, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, attention weights, what they gather, and y, of windows of inputs."""
    x = w.E.take(inputs, axis=0)
    x += w.P
    a = np.matmul((x.reshape(-1, WIDTH) @ (w.A * _SCALE)).reshape(x.shape), x.transpose(0, 2, 1))
    np.minimum(a, np.float32(60), out=a)
    np.exp(a, out=a)
    a *= _PAST
    a /= (a @ np.ones(LENGTH, dtype=np.float32))[:, :, None] + np.float32(1e-30)
    h = np.matmul(a, x)
    y = (h.reshape(-1, WIDTH) @ w.W).reshape(x.shape)
    y += x
    return x, a, h, y


def _by_class(layout: Layout, kind: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(first slot, end, rows) of the classes of several members that rows are in."""
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    sizes = np.diff(layout.begin)
    return [(int(layout.begin[k]), int(layout.begin[k + 1]), order[cuts[k] : cuts[k + 1]]) for k in range(CLASSES) if cuts[k] < cuts[k + 1] and sizes[k] > 1]


def log_probabilities(w: Weights, layout: Layout, ids: np.ndarray, edges: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Natural log probability of each id in its sequence; no sequence is empty."""
    inputs, where, fresh = windows(ids, edges, len(layout.kind), STRIDE)
    out = np.zeros(len(ids), dtype=np.float32)
    for i in range(0, len(inputs), batch):
        keep = np.flatnonzero(fresh[i : i + batch])
        at = where[i : i + batch].ravel().take(keep)
        y = _attend(w, inputs[i : i + batch])[3].reshape(-1, WIDTH).take(keep, axis=0)
        target = ids[at]
        kind, slot = layout.kind[target], layout.slot[target]
        p = _log_share(y, w.U, w.b, kind)
        for first, end, rows in _by_class(layout, kind):
            p[rows] += _log_share(y.take(rows, axis=0), w.V[first:end].T, w.c[first:end], slot.take(rows) - first)
        out[at] = p
    return out


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")
    sorted_ = rows.take(order)
    heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[heads], np.add.reduceat(values.take(order, axis=0), heads, axis=0)


def loss_and_gradients(w: Weights, layout: Layout, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict]:
    """Mean loss in nats over the targets that are not -1; gradients of P, A, W, U and b, of the
    rows of E as (rows, values), and of V and c as lists of (first, end, values)."""
    x, a, h, y = _attend(w, inputs)
    used = np.flatnonzero(targets.ravel() >= 0)
    n = max(len(used), 1)
    flat = y.reshape(-1, WIDTH)
    yu, target = flat.take(used, axis=0), targets.ravel().take(used)
    kind, slot = layout.kind[target], layout.slot[target]
    loss, z = _shares(yu, w.U, w.b, kind, n)
    dyu = z @ w.U.T
    g: dict = {"U": yu.T @ z, "b": np.ones(len(z), dtype=z.dtype) @ z, "V": [], "c": []}
    for first, end, rows in _by_class(layout, kind):
        ym = yu.take(rows, axis=0)
        more, m = _shares(ym, w.V[first:end].T, w.c[first:end], slot.take(rows) - first, n)
        loss[rows] += more
        dyu[rows] += m @ w.V[first:end]
        g["V"].append((first, end, m.T @ ym))
        g["c"].append((first, end, np.ones(len(m), dtype=m.dtype) @ m))
    dy = np.zeros_like(flat)
    dy[used] = dyu
    g["W"] = h.reshape(-1, WIDTH).T @ dy
    dh = (dy @ w.W.T).reshape(x.shape)
    da = np.matmul(dh, x.transpose(0, 2, 1))
    dx = dy.reshape(x.shape) + np.matmul(a.transpose(0, 2, 1), dh)
    da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
    da *= a
    da *= _SCALE
    dq = np.matmul(da, x).reshape(-1, WIDTH)  # of x A
    dx += np.matmul(da.transpose(0, 2, 1), (x.reshape(-1, WIDTH) @ w.A).reshape(x.shape))
    dx += (dq @ w.A.T).reshape(x.shape)
    g["A"] = x.reshape(-1, WIDTH).T @ dq
    g["P"] = dx.sum(axis=0)
    g["E"] = _row_sums(inputs.ravel(), dx.reshape(-1, WIDTH))
    return float(loss.sum() / n), g


class Trainer:
    """Adagrad steps on a copy of the weights: rows that a step does not touch cost nothing."""

    def __init__(self, start: Weights, layout: Layout, rate: float) -> None:
        self.w, self.layout, self.rate, self.steps = start.copy(), layout, rate, 0
        self.sums = {k: np.full_like(getattr(start, k), 1e-8) for k in ("P", "A", "W", "U", "b", "V", "c", "E")}

    def _move(self, name: str, at: object, g: np.ndarray) -> None:
        s = self.sums[name]
        s[at] += g * g
        getattr(self.w, name)[at] -= self.rate * g / np.sqrt(s[at])

    def step(self, inputs: np.ndarray, targets: np.ndarray) -> float:
        loss, g = loss_and_gradients(self.w, self.layout, inputs, targets)
        for name in ("P", "A", "W", "U", "b"):
            self._move(name, slice(None), g[name])
        for name in ("V", "c"):
            for first, end, values in g[name]:
                self._move(name, slice(first, end), values)
        self._move("E", *g["E"])
        self.steps += 1
        return loss
