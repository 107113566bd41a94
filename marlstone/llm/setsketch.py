"""Near-duplicate documents by SetSketch registers.

A register is the minimum over a document's shingles of an exponential variate,
on a logarithmic scale of base b, truncated to 0..q+1. Registers of a union are
maxima of registers, and equal registers are about as likely as the Jaccard
similarity. Bands of registers propose pairs; the likelihood of how registers
compare, given both set sizes, decides which pairs can reach the threshold; full
shingle sets confirm.

Documents of equal shingle sets are one class from the start. Every other class
is first compared with the best of the least members of its buckets. Where a bucket
then still holds two components or more, those outside its largest are compared
with the least member of that, once for each bucket. Buckets that are mixed even
then are searched in tiles: registers join what may be linked across components
into groups, and full sets are counted against each other within the groups. The
members of a bucket's largest component meet its other members only, not each
other, so a group of near copies, of which the rounds before leave few apart, costs
rows in proportion. Tiles are bounded, and return a row for each member instead of
each pair; no link between different components is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, compact, cut, if_small, packed, roots, small_batches, tiled, with_maybe
from .components import components
from .words import U64, Words, chunks, mix

U32 = np.uint32


@dataclass(frozen=True)
class Sketch:
    """bands of rows registers each; base, rate and most are b, a and q+1 of the sketch. At similarity 0.8, 45 bands of 6 miss a pair with probability 1.2e-6."""

    bands: int = 45
    rows: int = 6
    base: float = 1.02
    rate: float = 20.0
    most: int = 32766
    seed: int = 11
    #: Standard errors below the threshold at which the likelihood still lets a pair through.
    slack: float = 5.0

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def registers(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """int16 registers (sets x size) of the non-empty sets that first delimits in hashes."""
        rng = np.random.default_rng(self.seed)
        odd = lambda: rng.integers(0, 2**32, self.size, dtype=np.uint64).astype(U32) | U32(1)
        a, c, x0 = odd(), odd(), (hashes >> U64(32)).astype(U32)
        low = np.empty((len(first) - 1, self.size), U32)
        for i, j in self._blocks(first):
            x = x0[first[i] : first[j]]
            starts = first[i:j] - first[i]
            v, t = np.empty_like(x), np.empty_like(x)
            for k in range(self.size):
                np.multiply(x, a[k], out=v)
                np.right_shift(v, 16, out=t)
                np.bitwise_xor(v, t, out=v)
                np.multiply(v, c[k], out=v)
                np.right_shift(v, 15, out=t)
                np.bitwise_xor(v, t, out=v)
                low[i:j, k] = np.minimum.reduceat(v, starts)
        variate = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(variate) / math.log(self.base)), 0, self.most).astype(np.int16)

    @staticmethod
    def _blocks(first: np.ndarray, limit: int = 1 << 15) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(first, first[i] + limit, side="right")) - 1)
            out.append((i, j))
            i = j
        return out

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """64-bit keys (sets x bands) of the bands."""
        parts = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(self.rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return key

    def can_reach(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the maximum-likelihood similarity is threshold less slack or more.

        The likelihood of the counts of registers above, below and equal is
        concave in the similarity, so its derivative at that value tells.
        """
        at = threshold - self.slack * math.sqrt(threshold * (1 - threshold) / self.size)
        above, below = (x > y).sum(1), (x < y).sum(1)
        u, v = nx / (nx + ny), ny / (nx + ny)
        at = np.minimum(at, np.minimum(u / v, v / u) * (1 - 1e-9))
        f = (self.base - 1) / self.base
        p = lambda z: -np.log1p(-z * f) / math.log(self.base)
        d = lambda z: f / (math.log(self.base) * (1 - z * f))
        s, t = np.maximum(u - v * at, 1e-12), np.maximum(v - u * at, 1e-12)
        equal = self.size - above - below
        slope = -above * v * d(s) / p(s) - below * u * d(t) / p(t) + equal * (v * d(s) + u * d(t)) / np.maximum(1 - p(s) - p(t), 1e-12)
        return slope >= 0


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(x, y)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one; without words, none."""
    w = Words(texts, lower=True)
    h = w.word_hashes()
    parts, sizes = [], np.zeros(len(w.counts) + 1, np.int64)
    if len(h) >= n:
        rolled = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            rolled = mix(rolled * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if a == b:
            continue
        if b - a < n:
            whole = h[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + h[k : k + 1])
            own = mix(whole + U64(n))
        else:
            own = np.sort(rolled[a : b - n + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes[r + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)


def _lists(arrow: pa.DataType, values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64), arrow))


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def sketched(documents: DataFrame, n: int, sketch: Sketch) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and the registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                hashes, first = shingles(batch.column(1).slice(i, j - i), n)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                f1, f2 = np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)
                regs = np.zeros((len(sizes), sketch.size), np.int16)
                if len(full):
                    starts = first[full]
                    f1[full] = np.add.reduceat(mix(hashes + U64(1)), starts)
                    f2[full] = np.bitwise_xor.reduceat(mix(hashes + U64(2)), starts)
                    regs[full] = sketch.registers(hashes, np.append(starts, len(hashes)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _binary(regs)], names=["doc_id", "n_shingles", "f1", "f2", "registers"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, registers binary")


def _banded(classes: DataFrame, sketch: Sketch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sketch.keys(_registers(batch.column(1), sketch))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(pa.int64(), keys.ravel(), np.arange(len(keys) + 1) * sketch.bands)], names=["node", "keys"])

    return classes.select("node", "registers").mapInArrow(run, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _registers(column: pa.Array, sketch: Sketch) -> np.ndarray:
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8, start[-1] - start[0], start[0]).view(np.int16).reshape(len(column), sketch.size) if len(column) else np.zeros((0, sketch.size), np.int16)


def _likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch, threshold: float) -> DataFrame:
    """The pairs (a, b) that set sizes and registers let reach the threshold."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    close = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(close).select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            ok = sketch.can_reach(_registers(batch.column(4), sketch), _registers(batch.column(5), sketch), na, nb, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


def _sets_of(documents: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, hashes) for the documents whose ids are nodes."""
    texts = with_maybe(documents.select(F.col("doc_id").alias("node"), "text"), nodes, "node").filter("_maybe").drop("_maybe").join(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                hashes, first = shingles(batch.column(1).slice(i, j - i), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(pa.int64(), hashes, first)], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def _confirmed(pairs: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(documents, nodes, n)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


#: Rows, and shingles, of a tile's side.
SIDE_ROWS, SIDE_SHINGLES = 2048, 1_000_000


def _likely_groups(rows: DataFrame, classes: DataFrame, sketch: Sketch, threshold: float) -> DataFrame:
    """From rows (key, node, component, main): edges (node, root) that join, bucket by bucket, what registers let reach the threshold across components.

    Within a tile, a row is compared with one row of each other group so far, and
    only if that fails with the rest of it; what has no likely partner across
    components is left out.
    """
    tiles = tiled(rows.select("key", "node", "component", "main"), ["key"], SIDE_ROWS).join(classes.select("node", "n_shingles", "registers"), "node")

    def compare(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        col = {name: tile.column(k) for k, name in enumerate(tile.schema.names)}
        number = lambda c: col[c].to_numpy(zero_copy_only=False)
        same = number("i")[0] == number("j")[0]
        regs = _registers(col["registers"], sketch)
        n = number("n_shingles").astype(float)
        _, label = np.unique(number("component"), return_inverse=True)
        start = label.copy()
        left = np.flatnonzero(number("side") == 0)
        right = left if same else np.flatnonzero(number("side") == 1)
        if len(right) < len(left):
            left, right = right, left

        def passes(r: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(n[r], n[others]) >= threshold * np.maximum(n[r], n[others]) - 1e-9]
            if not len(others):
                return others
            ok = sketch.can_reach(regs[r][None, :], regs[others], n[r], n[others], threshold)
            return others[ok]

        for r in left.tolist():
            rest = right[label[right] != label[r]]
            if same:
                rest = rest[rest < r]
            if not len(rest):
                continue
            _, first = np.unique(label[rest], return_index=True)
            for o in passes(r, rest[first]).tolist():
                label[label == label[o]] = label[r]
            for o in passes(r, rest[label[rest] != label[r]]).tolist():
                label[label == label[o]] = label[r]
        grown = np.zeros(label.max() + 1, np.int64)
        for value in np.unique(label):
            grown[value] = len(np.unique(start[label == value])) > 1
        keep = grown[label] > 0
        if not keep.any():
            return None
        node = number("node")
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[label][keep])], names=["node", "root"])

    return by_group(tiles, ["key", "i", "j"], compare, "node long, root long").distinct()


#: Columns of shared shingles, and pairs of rows, that linked_rows holds at once as a matrix.
SLAB, BLOCK_PAIRS = 1024, 1 << 18


def linked_rows(hashes: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Least row reachable of each row, by links of a row in left with one in right: 100 * intersection >= percent * union of their sets. hashes: the sets one after another; size: theirs.

    Counts are exact. A pair takes four bytes; everything else is of a slab or block of pairs, or of the shingles.
    """
    order = np.argsort(hashes, kind="stable")
    same = hashes[order]
    same = same[1:] == same[:-1]
    # shingles of one row only count in no intersection
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    first = np.ones(len(order), bool)
    first[1:] = ~same
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[order[shared]]
    column = np.cumsum(first[shared], dtype=np.int32) - 1
    del order, same, shared, first
    block = max(1, BLOCK_PAIRS // max(1, len(right)))
    blocks = [slice(a, a + block) for a in range(0, len(left), block)]
    common = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + SLAB, SLAB))
    for a, b in zip(cuts[:-1], cuts[1:]):
        dense = np.zeros((len(size), SLAB), np.float32)
        dense[row[a:b], column[a:b] % SLAB] = 1
        across = dense[right].T
        for part in blocks:
            common[part] += dense[left[part]] @ across
    root = np.arange(len(size))
    for part in blocks:
        both = np.rint(common[part]).astype(np.int64)
        i, j = np.nonzero(100 * both >= percent * (size[left[part]][:, None] + size[right][None, :] - both))
        i, j = root[left[part][i]], root[right[j]]
        apart = i != j
        root = roots(len(size), i[apart], j[apart])[root]
    return root


def _linked_in_groups(groups: DataFrame, classes: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """From (node, coarse, component): edges (a, b) that span all exact links between nodes of a group but of different components, from tiles in which full sets are counted against each other."""
    sets = _sets_of(documents, groups.select("node"), n)
    sizes = classes.groupBy("node").agg(F.max("n_shingles").alias("weight"))
    groups = _with_main(groups, "coarse")
    rows = groups.join(sizes, "node").select("coarse", "node", "weight", "main")
    tiles = tiled(rows, ["coarse"], SIDE_ROWS, "weight", SIDE_SHINGLES).drop("weight").join(sets.select("node", "hashes", F.size("hashes").cast("long").alias("n")), "node")

    def compare(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        col = {name: tile.column(k) for k, name in enumerate(tile.schema.names)}
        number = lambda c: col[c].to_numpy(zero_copy_only=False)
        same = number("i")[0] == number("j")[0]
        left = np.flatnonzero(number("side") == 0)
        right = left if same else np.flatnonzero(number("side") == 1)
        node, size = number("node"), number("n")
        root = linked_rows(col["hashes"].flatten().to_numpy(), size, left, right, percent)
        # a root is a row of this tile, so (node, node of the root) is a chain of links
        moved = root != np.arange(len(size))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"]) if moved.any() else None

    return by_group(tiles, ["coarse", "i", "j"], compare, "a long, b long")


def _with_main(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, node, component) of the keys that hold several components, with main: whether the component is the key's largest, and low, the least node of that."""
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
    largest = sizes.groupBy(key).agg(F.max(F.struct("n", -F.col("component"), "low")).alias("m"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    # written first, so that a join reads two plain shuffles, of which a hot key's can be split
    largest = compact(largest.select(key, (-F.col("m")["col2"]).alias("_largest"), F.col("m")["low"].alias("low")))
    return rows.join(if_small(largest), key).withColumn("main", F.col("component") == F.col("_largest")).drop("_largest")


def near_duplicates(documents: DataFrame, *, n: int = 5, percent: int = 80, sketch: Sketch = Sketch()) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; shingles are
    n words. Texts are linked from percent similarity on. Null text and texts
    without words have no shingles and link with nothing. Rows of one doc_id are
    one document. A null doc_id links with nothing, has a null component and is
    kept. Other columns are ignored. An empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    threshold = percent / 100
    rows = cut(sketched(documents, n, sketch))
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(linked.groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "registers")).alias("least")).select("n_shingles", "f1", "f2", F.col("least.doc_id").alias("node"), F.col("least.registers").alias("registers")))
    with Scratch() as scratch:
        bands = _banded(classes, sketch)
        buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("held")).filter("low <> high")
        buckets = scratch.keep(buckets)
        members = bands.join(buckets.filter("held > 2"), "key").select("key", "node", "low")
        members = compact(members)

        # first round: each class and the least member it shares most buckets with
        votes = buckets.filter("held = 2").select(F.col("high").alias("a"), F.col("low").alias("b")).union(members.filter("node <> low").select("node", "low"))
        votes = votes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("a").agg(F.max(F.struct("votes", -F.col("b"))).alias("best")).select("a", (-F.col("best")["col2"]).alias("b"))
        best = compact(best)
        tried = compact(_likely(best, classes, sketch, threshold))
        several = linked.groupBy("doc_id").agg(F.min("f1").alias("p"), F.max("f1").alias("q")).filter("p <> q").select("doc_id")
        own = linked.join(several, "doc_id").join(classes.drop("registers"), ["n_shingles", "f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        found = components(_confirmed(tried, documents, n, percent).union(own))
        labelled = lambda: members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))

        # second round: what is outside the largest component of a bucket, and the least member of that
        again = _with_main(labelled(), "key").filter("not main").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
        again = compact(again.join(best, ["a", "b"], "left_anti"))
        if not again.isEmpty():
            more = _confirmed(compact(_likely(again, classes, sketch, threshold)), documents, n, percent)
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

        # third round: buckets that still hold two components or more
        near = _likely_groups(compact(_with_main(labelled(), "key").drop("low")), classes, sketch, threshold)
        label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        pairs = buckets.filter("held = 2").select(F.col("high").alias("a"), F.col("low").alias("b")).distinct()
        pairs = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        pairs = _likely(compact(pairs.join(tried, ["a", "b"], "left_anti")), classes, sketch, threshold)
        near = near.union(pairs).toDF("node", "root")
        groups = components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = groups.select("node", F.col("component").alias("coarse")).join(found, "node", "left").select("node", "coarse", F.coalesce("component", "node").alias("component"))
        more = _linked_in_groups(groups, classes, documents, n, percent)
        final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    named = classes.select("n_shingles", "f1", "f2", "node").join(final, "node", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "node").alias("component"))
    joined = rows.drop("registers").join(named, ["n_shingles", "f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One document of each group of near_duplicates, with all columns.

    Of rows that share a doc_id one stays, if its document does; which of them is
    not defined. Rows with a null doc_id all stay. Texts whose ids the bitmap
    rules out of what changes are not shuffled.
    """
    report = near_duplicates(documents, **options).filter("doc_id is not null")
    touched = report.groupBy("doc_id").agg(F.min("kept").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("not _keep or _n > 1")
    touched = compact(touched.select("doc_id", "_keep"))
    marked = with_maybe(packed(documents, "doc_id"), touched, "doc_id")
    met = marked.filter("_maybe").select("doc_id", "_row").join(touched, "doc_id", "left").filter("_keep is null or _keep")
    once = met.filter("_keep").dropDuplicates(["doc_id"]).select("_row.*")
    return marked.filter("not _maybe").select("_row.*").union(met.filter("_keep is null").select("_row.*")).union(once)
