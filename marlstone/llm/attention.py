"""A causal self-attention language model in numpy.

One head of attention over the last block and the present one. Token vectors come
from corpus counts and stay fixed. A query meets the key of a token by a learnt
matrix between their vectors (the product of a query and a key projection), plus a
learnt bias of the distance; what attention gathers reaches the classes by another
(the product of a value and an output projection). The next token is predicted by
class, then within the class by corpus counts: P(token) = P(class | context)
P(token | class, bucket of the token before).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Tokens scored by a window; it also sees as many before them.
STRIDE = 16
#: Consecutive windows that training draws together, so that they share what they see.
RUN = 8
#: Runs of a training step.
BATCH = 16
PAD = 65535
_GAP = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]
#: The distance of each pair in sight, else 2 STRIDE; and as a matrix that sums pairs by distance.
_FAR = np.where(_GAP >= 0, np.clip(_GAP, 0, 2 * STRIDE - 1), 2 * STRIDE)
_BY_FAR = (_FAR.ravel()[:, None] == np.arange(2 * STRIDE)).astype(np.float32)
#: Scores of attention and of classes are held within this, so that their powers and sums stay finite.
MOST = 60


@dataclass
class Attention:
    """vectors: tokens x dims; classes: class of each token; within: tokens x buckets, log probability of a token in its class after a token of the bucket; weights: what training changes; bucket: of each token."""

    vectors: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    weights: dict[str, np.ndarray]
    bucket: np.ndarray | None = None
    _tables: tuple | None = field(default=None, repr=False)

    @staticmethod
    def initial(dims: int, classes: int, seed: int = 1) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / dims).astype(np.float32)
        return {"match": make(dims, dims), "carry": make(dims, classes), "own": make(dims, classes), "bias": np.zeros(classes, np.float32), "far": np.zeros(2 * STRIDE, np.float32)}

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def with_weights(self, weights: dict[str, np.ndarray]) -> Attention:
        return Attention(self.vectors, self.classes, self.within, weights, self.bucket)

    def _seen(self) -> np.ndarray:
        """The vectors with a last column of ones, whose weighted sum is the sum of the weights."""
        return np.concatenate([self.vectors, np.ones_like(self.vectors[:, :1])], 1)

    def _stacked(self) -> np.ndarray:
        """The weights of the classes' scores on what a token gathers, its vector, and one."""
        w = self.weights
        return np.concatenate([w["carry"], w["own"], w["bias"][None]])

    @staticmethod
    def mask(far: np.ndarray) -> np.ndarray:
        """(STRIDE, 2 STRIDE): the bias of each distance; later tokens are out of sight."""
        return np.take(np.append(far, -1e9).astype(np.float32), _FAR)

    @staticmethod
    def _attend(queries: np.ndarray, seen: np.ndarray, mask: np.ndarray, alone: np.ndarray, out: np.ndarray, near: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(weights, windows): masked attention of runs of blocks; what it gathers goes to out. queries: runs x blocks x STRIDE x dims; seen: runs x (blocks + 1) STRIDE x (dims + 1), a block before the first; alone: whether a block begins a text and sees none before it; near: whether no product can exceed MOST."""
        runs, blocks, _, dims = queries.shape
        a, b, c = seen.strides
        windows_ = np.ndarray((runs, blocks, 2 * STRIDE, dims + 1), seen.dtype, seen, 0, (a, STRIDE * b, b, c))
        p = np.matmul(queries, windows_[..., :dims].swapaxes(2, 3))
        if not near:
            np.clip(p, -MOST, MOST, out=p)
        p += mask
        p[alone, :, :STRIDE] = -1e9
        np.exp(p, out=p)
        flat = p.reshape(-1, 2 * STRIDE)
        flat *= (1 / (flat @ np.ones(2 * STRIDE, p.dtype)))[:, None]
        np.matmul(p, windows_[..., :dims], out=out)
        return p, windows_

    def _ready(self) -> tuple:
        """What score takes from the weights: tables by token, the classes' weights, the mask, and whether no product of attention and no score of a class can exceed MOST, whatever the texts."""
        w = self.weights
        queries, own = self.vectors @ w["match"], self.vectors @ w["own"] + w["bias"]
        length = lambda x: float(np.sqrt((x * x).sum(1).max(initial=0)))
        # what is gathered is a mean of vectors, so its score of a class is within theirs
        most = np.abs(own).max(initial=0) + np.abs(self.vectors @ w["carry"]).max(initial=0)
        room = 0.999 * MOST
        return self._seen(), queries, self._stacked(), self.mask(w["far"]), self.within.ravel(), length(queries) * length(self.vectors) < room, most < room

    def score(self, given: np.ndarray, target: np.ndarray, alone: np.ndarray, run: int = 128) -> np.ndarray:
        """Natural log probabilities (blocks x STRIDE), 0 where target is PAD.

        given: inputs of consecutive blocks; target: what follows each input. A
        block also sees the one before it, unless alone says that a text begins.
        Where given is PAD, no target sees it, so any token may stand there.
        """
        dims = self.vectors.shape[1]
        if self._tables is None:
            self._tables = self._ready()
        seen, queries, stacked, mask, within, near, low = self._tables
        inputs = np.concatenate([np.zeros_like(given[:1]), given])
        classes = np.take(self.classes, target, mode="clip")
        number = stacked.shape[1]
        ones = np.ones(number, stacked.dtype)
        out = np.empty(target.shape)
        for a in range(0, len(given), run):
            b = min(len(given), a + run)
            ids = inputs[a : b + 1].ravel()
            x = np.take(seen, ids, 0, mode="clip")
            own = np.take(queries, ids[STRIDE:], 0, mode="clip")
            both = np.empty((len(own), 2 * dims + 1), x.dtype)
            both[:, dims:] = x[STRIDE:]
            self._attend(own.reshape(1, b - a, STRIDE, dims), x[None], mask, alone[None, a:b], both.reshape(1, b - a, STRIDE, -1)[..., :dims], near)
            logits = both @ stacked
            if not low:
                np.clip(logits, -MOST, MOST, out=logits)
            chosen = np.take(logits, np.arange(0, logits.size, number) + classes[a:b].ravel())
            np.exp(logits, out=logits)
            out[a:b] = (chosen - np.log(logits @ ones)).reshape(b - a, STRIDE)
        after = 0 if self.bucket is None else np.take(self.bucket, given, mode="clip")
        out += np.take(within, target * self.within.shape[1] + after, mode="clip")
        out[target == PAD] = 0
        return out

    def gradients(self, before: np.ndarray, given: np.ndarray, target: np.ndarray, alone: np.ndarray, seen: np.ndarray, losses: bool = True) -> tuple[dict[str, np.ndarray], float | None]:
        """Gradients of the mean class loss, and that loss if asked for. given, target: runs x blocks x STRIDE; before: the block before each run; seen: _seen()."""
        w, dims = self.weights, self.vectors.shape[1]
        runs, blocks, _ = given.shape
        x = np.take(seen, np.concatenate([before[:, None], given], 1).reshape(runs, -1), 0, mode="clip")
        # for each token what it gathers, its vector, and one for the bias
        both = np.empty((runs, blocks, STRIDE, 2 * dims + 1), x.dtype)
        both.reshape(runs, -1, 2 * dims + 1)[..., dims:] = x[:, STRIDE:]
        gathered = both[..., :dims]
        both = both.reshape(-1, 2 * dims + 1)
        own = both[:, dims:-1]
        p, windows_ = self._attend((own @ w["match"]).reshape(runs, blocks, STRIDE, dims), x, self.mask(w["far"]), alone, gathered)
        d = both @ self._stacked()
        np.clip(d, -MOST, MOST, out=d)
        real = (target != PAD).ravel()
        n = max(1, int(np.count_nonzero(real)))
        at = np.arange(0, d.size, d.shape[1]) + np.take(self.classes, target.ravel(), mode="clip")
        chosen = np.take(d, at) if losses else None
        np.exp(d, out=d)
        total = d @ np.ones(d.shape[1], d.dtype)
        loss = float((np.log(total) - chosen)[real].sum()) / n if losses else None
        share = real * np.float32(1 / n)
        d *= (share / total)[:, None]
        d.reshape(-1)[at] -= share
        outer = both.T @ d
        # the windows' last column of ones takes off the mean slope of each token's weights
        up = np.empty((len(d), dims + 1), d.dtype)
        np.matmul(d, w["carry"].T, out=up[:, :dims])
        np.einsum("ij,ij->i", up[:, :dims], both[:, :dims], out=up[:, dims])
        np.negative(up[:, dims], out=up[:, dims])
        ds = np.matmul(up.reshape(runs, blocks, STRIDE, dims + 1), windows_.swapaxes(2, 3))
        ds *= p
        met = np.matmul(ds, windows_[..., :dims]).reshape(-1, dims)
        by_gap = ds.reshape(-1, STRIDE * 2 * STRIDE)
        far = (np.ones(len(by_gap), d.dtype) @ by_gap @ _BY_FAR).astype(np.float32)
        return {"match": own.T @ met, "carry": outer[:dims], "own": outer[dims:-1], "bias": outer[-1], "far": far}, loss

    def train(self, given: np.ndarray, target: np.ndarray, alone: np.ndarray, *, rate: float, passes: int = 1, batch: int = BATCH, seed: int = 0) -> dict[str, np.ndarray]:
        """Weights after Adam over all windows of consecutive blocks, in batches of so many runs in a shuffled order."""
        rng = np.random.default_rng(seed)
        model = self.with_weights(self.weights)
        seen = self._seen()
        fill = -len(given) % RUN
        given, target = (np.concatenate([x, np.full((fill, STRIDE), PAD, x.dtype)]) for x in (given, target))
        alone = np.concatenate([alone, np.ones(fill, bool)])
        before = np.concatenate([np.full((1, STRIDE), PAD, given.dtype), given[RUN - 1 : -1 : RUN]])
        given, target, alone = given.reshape(-1, RUN, STRIDE), target.reshape(-1, RUN, STRIDE), alone.reshape(-1, RUN)
        if len(alone):
            alone[0, 0] = True
        # all weights in a row; the model's are parts of it
        flat = np.concatenate([v.ravel() for v in model.weights.values()])
        ends = np.cumsum([v.size for v in model.weights.values()])[:-1]
        model.weights = {k: part.reshape(v.shape) for (k, v), part in zip(model.weights.items(), np.split(flat, ends))}
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(given))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                slopes, _ = model.gradients(*(np.take(x, own, 0) for x in (before, given, target, alone)), seen, losses=False)
                step += 1
                g = np.concatenate([slopes[name].ravel() for name in model.weights])
                mean += np.float32(0.1) * (g - mean)
                square += np.float32(0.01) * (g * g - square)
                flat -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return model.weights


def from_counts(counts: np.ndarray, dims: int, classes: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, classes) from tokens x contexts counts.

    Vectors: leading singular directions of the log-ratios of counts to chance.
    Classes: k-means of the vectors, weighted by count.
    """
    total = counts.sum(1)
    column = counts.sum(0)
    floor = 0.05 * (column + 1) / (column.sum() + 1)
    chance = np.log((column + floor * len(counts)) / (column.sum() + floor.sum() * len(counts)))
    weight = np.sqrt(total + 1)

    def ratios(rows: slice) -> np.ndarray:
        seen = counts[rows] + floor
        return (np.log(seen / seen.sum(1, keepdims=True)) - chance) * (total[rows] / (total[rows] + 5))[:, None]

    step = 2048
    slices = [slice(k, k + step) for k in range(0, len(counts), step)]
    gram = sum((r * weight[s][:, None] ** 2).T @ r for s in slices for r in [ratios(s)])
    _, axes = np.linalg.eigh(gram)
    axes = axes[:, ::-1][:, : min(dims, len(axes))]
    dims = axes.shape[1]
    vectors = np.concatenate([ratios(s) @ axes for s in slices])
    spread = np.sqrt((vectors**2 * weight[:, None] ** 2).sum(0) / (weight**2).sum()) + 1e-9
    vectors = np.clip(vectors / spread * np.sqrt(spread / spread[0]), -4, 4)
    rng = np.random.default_rng(seed)
    start = rng.choice(len(vectors), classes, replace=False, p=weight / weight.sum())
    centres = vectors[start]
    for _ in range(12):
        label = (-2 * vectors @ centres.T + (centres**2).sum(1)).argmin(1)
        mass = np.bincount(label, weight, classes)
        for d in range(dims):
            centres[:, d] = np.where(mass > 0, np.bincount(label, weight * vectors[:, d], classes) / np.maximum(mass, 1e-9), centres[:, d])
    return vectors.astype(np.float32), label.astype(np.int64)


def within_classes(counts: np.ndarray, classes: np.ndarray, number: int, weight: float) -> np.ndarray:
    """Log probabilities (tokens x buckets) of tokens in their class after a token of each bucket, from counts of the same shape.

    Without regard to the bucket, a token has its count plus one over the class's
    total; that counts as weight tokens seen in each bucket.
    """
    total = counts.sum(1) + 1.0
    alone = (total / np.bincount(classes, total, number)[classes])[:, None]
    sums = np.zeros((number, counts.shape[1]))
    np.add.at(sums, classes, counts)
    return np.log((counts + weight * alone) / (sums[classes] + weight)).astype(np.float32)


def windows(ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(given, target, alone, text) of all texts' blocks: ids in a row, sizes[i] of text i, each text beginning from the token start; alone marks its first block. Every id is a target once."""
    blocks = -(-sizes // STRIDE)
    ends = np.cumsum(blocks)
    total = int(ends[-1]) if len(ends) else 0
    first = ends - blocks
    begin = np.cumsum(sizes) - sizes
    place = np.repeat(first * STRIDE - begin, sizes) + np.arange(len(ids))
    target = np.full(total * STRIDE, PAD, np.int32)
    given = np.full(total * STRIDE, PAD, np.int32)
    shifted = np.empty(len(ids), np.int32)
    shifted[1:] = ids[:-1]
    shifted[begin[sizes > 0]] = start
    target[place], given[place] = ids, shifted
    alone = np.zeros(total, bool)
    alone[first[sizes > 0]] = True
    return given.reshape(-1, STRIDE), target.reshape(-1, STRIDE), alone, np.repeat(np.arange(len(sizes)), blocks)
