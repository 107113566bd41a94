"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated to their principal axes, which are dealt to blocks of a few
dimensions, so that each block has one of the widest axes first. A pair whose squared
is within the budget 2 - 2 * cosine has at least one block whose squared
distance is within that block's share of it, shares going by dimensions.
So a range join of each block finds every pair: a vector goes to the grid cell of
its first coordinates in the block, and also, as a probe, to the later
neighbouring cells that its radius touches. Within a cell, block distances choose
the candidates, and the cosine of the whole vectors in double precision decides.
A pair counts only in the first block in which it is within its share, so the
union of all blocks holds each pair once.

Equal vectors of a label are one class, with a weight. A cell of any size is cut
into tiles of bounded sides. A tile returns, for each of its vectors, the weight
it links to and one root of its own components: rows grow with vectors, not with
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, roots
from .components import components


@dataclass(frozen=True)
class Pigeonhole:
    """block: dimensions of a block; axes: coordinates of a block that form its grid; cell: side of a cell in radii, 1 at least; tile: rows of a tile's side."""

    block: int = 16
    axes: int = 2
    cell: float = 2.0
    tile: int = 1024

    def blocks(self, size: int) -> list[tuple[int, int]]:
        return [(k, min(size, k + self.block)) for k in range(0, size, self.block)]

    def shares(self, size: int, least: float) -> np.ndarray:
        """Squared distance allowed in each block, with room for rounding."""
        return np.array([(2 - 2 * least) * (b - a) / size for a, b in self.blocks(size)]) + 1e-9


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def principal(moments: np.ndarray, how: Pigeonhole) -> np.ndarray:
    """Orthogonal columns from sums of products of coordinates: the principal axes, dealt to the blocks in turn from the widest on."""
    size = len(moments)
    _, axes = np.linalg.eigh(moments)
    axes = axes[:, ::-1]
    room = [b - a for a, b in how.blocks(size)]
    order: list[list[int]] = [[] for _ in room]
    turn = (k for _ in range(how.block) for k in range(len(room)))
    for axis in range(size):
        order[next(k for k in turn if len(order[k]) < room[k])].append(axis)
    return axes[:, [axis for block in order for axis in block]]


def rotations(classes: DataFrame, how: Pigeonhole) -> dict[int, np.ndarray]:
    """The rotation for each vector size, from the products of all unit vectors' coordinates: a size x size matrix for a task and size, summed before it is gathered."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                x = _units(_matrix(batch.column(0).filter(pa.array(sizes == size)), size))
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, size)), pa.array(np.arange(size * size)), pa.array(m.ravel())], names=["size", "at", "value"])

    summed = classes.select("v").mapInArrow(products, "size long, at long, value double").groupBy("size", "at").agg(F.sum("value").alias("value")).toPandas()
    return {int(size): principal(own.sort_values("at")["value"].to_numpy().reshape(size, size), how) for size, own in summed.groupby("size")}


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _cells(vectors: np.ndarray, rotation: np.ndarray, how: Pigeonhole, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, cell key, probe) of each vector's home cells and of the later cells it probes. vectors: rows x size, all finite and none zero."""
    size = vectors.shape[1]
    turned = _units(vectors) @ rotation
    rows, blocks, keys, probes = [], [], [], []
    for number, ((a, b), share) in enumerate(zip(how.blocks(size), how.shares(size, least))):
        axes = min(how.axes, b - a)
        radius = np.sqrt(share) * (1 + 1e-9)
        side = radius * max(1.0, how.cell)
        at = turned[:, a : a + axes]
        home = np.floor(at / side).astype(np.int64)
        for step in np.ndindex(*[3] * axes):
            move = np.array(step) - 1
            first = next((m for m in move if m), 0)
            if first < 0:
                continue
            to = home + move
            gap = np.where(move > 0, to * side - at, np.where(move < 0, at - (to + 1) * side, 0.0))
            near = np.flatnonzero((np.maximum(gap, 0) ** 2).sum(1) <= radius**2) if first else np.arange(len(at))
            key = np.zeros(len(near), np.int64)
            for k in range(axes):
                key = key * 2_000_003 + to[near, k]
            rows.append(near)
            blocks.append(np.full(len(near), number))
            keys.append(key)
            probes.append(np.full(len(near), bool(first)))
    return tuple(np.concatenate(x) for x in (rows, blocks, keys, probes))


def _tile(left: np.ndarray, right: np.ndarray, same: bool, block: int, turn: np.ndarray, how: Pigeonhole, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of left and right rows that link and count in this block; same: left is right, pairs once."""
    size = left.shape[1]
    spans, shares = how.blocks(size), how.shares(size, least)
    x, y = _units(left), _units(right)
    tx, ty = x @ turn, y @ turn
    a, b = spans[block]
    distance = (tx[:, a:b] ** 2).sum(1)[:, None] + (ty[:, a:b] ** 2).sum(1)[None, :] - 2 * tx[:, a:b] @ ty[:, a:b].T
    near = distance <= shares[block] + 1e-7
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    out_i, out_j = [], []
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        cosine = np.einsum("ij,ij->i", left[p], right[q]) / (np.linalg.norm(left, axis=1)[p] * np.linalg.norm(right, axis=1)[q])
        ok = cosine >= least
        p, q = p[ok], q[ok]
        within = np.stack([((tx[p, c:d] - ty[q, c:d]) ** 2).sum(1) <= s for (c, d), s in zip(spans, shares)], 1) if len(p) else np.zeros((0, len(spans)), bool)
        own = within.argmax(1) == block
        out_i.append(p[own])
        out_j.append(q[own])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def link_vectors(vectors: DataFrame, *, least: float = 0.93, how: Pigeonhole = Pigeonhole()) -> DataFrame:
    """One row per row of vectors (vec_id, embedding array<float or double>, label): vec_id, n_links, component_id, kept.

    Rows link when labels are equal and not null, sizes are equal, and the cosine
    is least or more. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing. Rows of equal vectors link with each
    other. n_links counts rows other than itself; rows of one vec_id with different
    vectors have links of their own there but one component. A null vec_id links with nothing and has a
    null component. Other columns are ignored; an empty table gives no rows.
    """
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), value.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine, F.lit(False))
    scale = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    unit = F.transform("v", lambda x: x / scale)
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64(F.lit(1), "label", "v")), "h2": F.when(usable, F.xxhash64(F.lit(2), "v", "label"))})
    rows = rows.withColumn("v", F.when(usable & ((scale > 1e100) | (scale < 1e-100)), unit).otherwise(F.col("v")))
    rows = cut(rows)
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "v")).alias("c"), F.count(F.lit(1)).alias("weight"))
    classes = cut(classes.select("h1", "h2", F.col("c.vec_id").alias("vec_id"), F.col("c.label").alias("label"), F.col("c.v").alias("v"), "weight"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    turns = vectors.sparkSession.sparkContext.broadcast(rotations(classes, how))

    def place(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == size))
                row, block, key, probe = _cells(_matrix(own.column(2), size), turns.value[size], how, least)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([own.column(0).take(taken), own.column(1).take(taken), own.column(2).take(taken), own.column(3).take(taken), pa.array(np.full(len(row), size)), pa.array(block), pa.array(key), pa.array(probe)], names=["node", "label", "v", "weight", "size", "block", "cell", "probe"])

    placed = classes.select("node", "label", "v", "weight").mapInArrow(place, "node long, label long, v array<double>, weight long, size long, block long, cell long, probe boolean")
    where = ["label", "size", "block", "cell"]
    counts = classes.select("node", "label", "v", "weight").mapInArrow(place, placed.schema).groupBy(*where).agg(F.count_if(~F.col("probe")).alias("homes"), F.count_if(F.col("probe")).alias("guests"))
    counts = counts.filter("homes > 0 and homes + guests > 1")
    chunks = lambda c: F.ceil(F.col(c) / how.tile).cast("int")
    counts = counts.select(*where, chunks("homes").alias("hs"), chunks("guests").alias("gs"))
    spread = placed.join(counts, where)
    own = F.pmod(F.xxhash64(F.lit(4), "node"), F.when(F.col("probe"), F.col("gs")).otherwise(F.col("hs"))).cast("int")
    spread = spread.withColumn("chunk", own)
    # tiles: (home chunk i, 0, home chunk j >= i) and (home chunk i, 1, guest chunk j); side 0 is the left
    ints = lambda a, b: F.when(F.lit(b) >= F.lit(a) if isinstance(b, int) else b >= a, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<int>)"))
    one, zero = F.lit(1), F.lit(0)
    tile = lambda i, kind, j, side: F.struct(i.alias("i"), kind.alias("kind"), j.alias("j"), side.alias("side"))
    home = F.concat(
        F.transform(ints(F.col("chunk"), F.col("hs") - 1), lambda j: tile(F.col("chunk"), zero, j, zero)),
        F.transform(ints(zero, F.col("chunk") - 1), lambda i: tile(i, zero, F.col("chunk"), one)),
        F.transform(ints(zero, F.col("gs") - 1), lambda j: tile(F.col("chunk"), one, j, zero)),
    )
    guest = F.transform(ints(zero, F.col("hs") - 1), lambda i: tile(i, one, F.col("chunk"), one))
    tiles = spread.select("node", "v", "weight", *where, F.explode(F.when(F.col("probe"), guest).otherwise(home)).alias("t")).select("node", "v", "weight", *where, "t.i", "t.kind", "t.j", "t.side")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["kind"].iloc[0] == 0 and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left = pdf[pdf["side"] == 0]
        right = left if same else pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        lv, rv = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        i, j = _tile(lv, rv, same, int(pdf["block"].iloc[0]), turns.value[lv.shape[1]], how, least)
        ln, rn = left["node"].to_numpy(), right["node"].to_numpy()
        nodes, place = np.unique(np.concatenate([ln[i], rn[j]]), return_inverse=True)
        p, q = place[: len(i)], place[len(i) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, p, right["weight"].to_numpy()[j])
        np.add.at(links, q, left["weight"].to_numpy()[i])
        return pd.DataFrame({"node": nodes, "links": links, "root": nodes[roots(len(nodes), p, q)] if len(nodes) else nodes})

    found = cut(tiles.groupBy(*where, "i", "kind", "j").applyInPandas(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")
    named = classes.select("h1", "h2", "node", "vec_id", "weight").join(links, "node", "left")
    ids = rows.filter("h1 is not null").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node")
    several = ids.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("vec_id", "a")
    shared = ids.join(several, "vec_id").select("a", F.col("node").alias("b")).distinct()
    found = components(edges.union(shared)).join(named.select("node", "vec_id"), "node")
    least_id = found.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(found.join(least_id, "component").select("node", "component_id"), "node", "left")
    named = named.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    joined = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))
