"""Language-model scoring of documents.

Two models learn from the training documents, and all of them count. The base
model has word counts. The attention model has counts of subword ids by the
buckets of their neighbours, from which its token vectors, classes and
probabilities within a class are made; its attention is trained on every window,
each partition's in a stream of its own, and the weights are averaged.

Words are counted by 64-bit hashes. Counts of frequent words, at most TOP of
them, go to all tasks; other words meet their counts in a join, so no vocabulary
is held whole by a task.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .attention import Attention
from .common import Scratch, cut, small_batches
from .words import Words, chunks

#: Most words whose counts are sent to all tasks: 16 bytes each.
TOP = 1 << 19
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Training:
    """shard: windows shuffled and trained on at a time; rounds of local training over all windows, each with an average of all partitions; least: steps that a partition with fewer than a shard's windows makes by going over them again."""

    dims: int = 16
    classes: int = 32
    buckets: int = 128
    #: Tokens that a class's own shares count for in each bucket.
    prior: float = 20.0
    shard: int = 16_000
    rounds: int = 1
    least: int = 100
    rate: float = 0.02
    seed: int = 7


class Subwords:
    """Subword ids of words by a public SentencePiece file; a worker keeps the words it has seen, up to a bound.

    A word has a slot, found from its hash by open addressing in arrays, so that all
    words of a chunk are looked up at once and a word held takes some 40 bytes.
    """

    KEEP = 800_000

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.processor.get_piece_size()
        self.start, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.turn = 0
        self._clear()

    def _clear(self) -> None:
        """Slot 0 is the end token; a slot's ids are length of them from begin in pool. The arrays have room to grow. place: the slot at each position, 0 where none is. turn: how often slots were given anew."""
        self.turn += 1
        self.place, self.bits = np.zeros(1 << 16, np.int32), 16
        self.keys = np.zeros(1 << 14, np.uint64)
        self.pool, self.used = np.full(1 << 16, self.end, np.uint16), 1
        self.begin, self.length, self.known = np.zeros(1 << 14, np.int32), np.ones(1 << 14, np.int32), 1

    @property
    def full(self) -> bool:
        """Whether the next call of slots gives slots anew."""
        return self.known > self.KEEP

    @staticmethod
    def _put(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(held):
            held = np.concatenate([held[:used], np.zeros(max(used, len(more)), held.dtype)])
        held[used : used + len(more)] = more
        return held

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, 0 for unknown ones."""
        at = self._home(hashes)
        slot = np.take(self.place, at)
        left = np.flatnonzero((np.take(self.keys, slot) != hashes) & (slot > 0))
        at, own = at[left], hashes[left]
        while len(left):
            at = (at + 1) & (len(self.place) - 1)
            got = self.place[at]
            slot[left] = got
            more = (self.keys[got] != own) & (got > 0)
            left, at, own = left[more], at[more], own[more]
        return slot

    def _place(self, slots: np.ndarray) -> None:
        """Enter slots, whose keys are set and not entered yet."""
        at = self._home(self.keys[slots])
        while len(slots):
            free = self.place[at] == 0
            self.place[at[free]] = slots[free]
            lost = self.place[at] != slots
            slots, at = slots[lost], (at[lost] + 1) & (len(self.place) - 1)

    def slots(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        """The slot of each word; hashes: the words'."""
        if self.full:
            self._clear()
        slot = self._find(hashes)
        missing = np.flatnonzero(slot == 0)
        if len(missing):
            kinds, at, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[at]
            data = w.data.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
            coded = self.processor.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            n = int(sizes.sum())
            new = np.arange(self.known, self.known + len(kinds), dtype=np.int32)
            slot[missing] = new[which]
            self.keys = self._put(self.keys, self.known, kinds)
            self.begin = self._put(self.begin, self.known, self.used + np.cumsum(sizes) - sizes)
            self.length = self._put(self.length, self.known, sizes)
            self.pool = self._put(self.pool, self.used, np.fromiter(itertools.chain.from_iterable(coded), np.uint16, n))
            self.known, self.used = self.known + len(new), self.used + n
            if 2 * self.known > len(self.place):
                # at most half of the positions are taken
                self.bits = (2 * self.known).bit_length() + 1
                self.place, new = np.zeros(1 << self.bits, np.int32), np.arange(1, self.known, dtype=np.int32)
            self._place(new)
        return slot

    def of(self, w: Words, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of each text's words, then the end token."""
        units = np.insert(slots, w.first[1:], 0)
        size = np.take(self.length, units).astype(np.int64)
        stop = np.cumsum(size)
        ids = np.take(self.pool, np.repeat(np.take(self.begin, units) - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)).astype(np.int32)
        last = np.cumsum(w.counts + 1) - 1
        upto = stop[last] if len(last) else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate(([0], upto)))


class Counts:
    """log10 of one more than the count of each slot's word in a table (hashes in order, counts), 0 where the table has none, and whether it has one; each slot is looked up once."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.turn = -1

    def of(self, sub: Subwords, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.turn != sub.turn:
            self.turn, self.done, self.logs, self.found = sub.turn, 0, np.zeros(0), np.zeros(0, bool)
        if self.done < sub.known:
            keys = sub.keys[self.done : sub.known].view(np.int64)
            place = np.minimum(np.searchsorted(self.hashes, keys), max(0, len(self.hashes) - 1))
            found = self.hashes[place] == keys if len(self.hashes) else np.zeros(len(keys), bool)
            logs = np.zeros(len(keys))
            logs[found] = np.log10(self.counts[place[found]] + 1.0)
            self.logs, self.found = Subwords._put(self.logs, self.done, logs), Subwords._put(self.found, self.done, found)
            self.done = sub.known
        return np.take(self.logs, slots), np.take(self.found, slots)


_CODERS: dict[int, Subwords] = {}
#: The counts of the call a worker last served.
_COUNTS: dict[str, Counts] = {}


def _coder(shared) -> Subwords:
    key = hash(shared.value)
    if key not in _CODERS:
        _CODERS[key] = Subwords(shared.value)
    return _CODERS[key]


def _counts(call: str, table) -> Counts:
    if call not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[call] = Counts(*table.value)
    return _COUNTS[call]


def is_held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 7 are not learnt from. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


WORD, CELL, TEXT, DOCS = range(4)
#: Text bytes whose words are looked up together: each distinct one once.
AT_ONCE = 1 << 19


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids.astype(np.int64) * 40503 >> 7) % buckets


def _gather(documents: DataFrame, coder, how: Training) -> DataFrame:
    """(kind, key, n, ids) of the training documents: counts by word hash, counts by cell (token, side, bucket of the neighbour), each text's ids, documents."""

    def batch_of(kind: int, keys: np.ndarray, counts: np.ndarray, ids: pa.Array | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64) if keys.dtype != np.uint64 else keys.view(np.int64)), pa.array(counts.astype(np.int64)), ids if ids is not None else pa.nulls(len(keys), pa.binary())], names=["kind", "key", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _coder(coder)
        # at most one count for each token of a partition's texts, so 32 bits are enough below 2**31 of them
        cells = np.zeros(sub.size * 2 * how.buckets, np.int32)
        bucket = bucket_of(np.arange(sub.size), how.buckets).astype(np.int32)
        words = np.zeros(sub.known, np.int64)  # by slot
        counted = docs = 0

        def counted_words() -> pa.RecordBatch:
            some = np.flatnonzero(words)
            return batch_of(WORD, sub.keys[some], words[some])

        for batch in batches:
            for i, j in chunks(batch.column(0), AT_ONCE):
                w = Words(batch.column(0).slice(i, j - i), lower=True)
                docs += j - i
                if sub.full:
                    yield counted_words()
                    words = words[:0]
                slots = sub.slots(w, w.word_hashes())
                if len(words) < sub.known:
                    words = np.concatenate([words, np.zeros(sub.known + len(sub.keys) - len(words), np.int64)])
                np.add.at(words, slots, 1)
                ids, sizes = sub.of(w, slots)
                ends = np.cumsum(sizes)
                before = np.concatenate(([sub.start], ids[:-1]))
                before[(ends - sizes)] = sub.start
                after = np.concatenate((ids[1:], [sub.start]))
                after[ends - 1] = sub.start
                for side, near in enumerate((before, after)):
                    np.add.at(cells, (ids * 2 + side) * how.buckets + np.take(bucket, near), np.int32(1))
                counted += len(ids)
                if counted > 1 << 30:
                    some = np.flatnonzero(cells)
                    yield batch_of(CELL, some, cells[some])
                    cells[:], counted = 0, 0
                upto = np.concatenate(([0], 2 * ends)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(upto), pa.py_buffer(ids.astype(np.uint16))])
                yield batch_of(TEXT, np.zeros(len(sizes), np.int64), sizes, packed)
        if docs:
            yield counted_words()
        some = np.flatnonzero(cells)
        if len(some):
            yield batch_of(CELL, some, cells[some])
        if docs:
            yield batch_of(DOCS, np.zeros(1, np.int64), np.array([docs]))

    return documents.filter(~is_held_out(F.col("doc_id"))).select("text").mapInArrow(run, "kind int, key long, n long, ids binary")


def _runs(batches: Iterator[pa.RecordBatch], start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(given, target, alone) of every window of the texts' ids in a stream, size windows at a time, of which the first sees none before it."""
    held: list[tuple] = []
    count = 0
    for batch in batches:
        for i, j in chunks(batch.column(0)):
            part = batch.column(0).slice(i, j - i)
            sizes = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            ids = np.frombuffer(b"".join(part.to_pylist()), np.uint16).astype(np.int32)
            held.append(attention.windows(ids, sizes, start)[:3])
            count += len(held[-1][0])
            if count >= size:
                whole = [np.concatenate(x) for x in zip(*held)]
                full = count // size * size
                for k in range(0, full, size):
                    yield tuple(x[k : k + size] for x in whole)
                held, count = [tuple(x[full:] for x in whole)], count - full
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held))


def train_attention(gathered: DataFrame, vocabulary: int, start_id: int, how: Training) -> Attention:
    """The attention model from what _gather counted. The cells are at most vocabulary x 2 x buckets rows, whatever the corpus; partitions train in parallel on all their windows and only the sum of their weights returns. Without any window the classes keep their frequencies."""
    cells = gathered.filter(F.col("kind") == CELL).groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary * 2 * how.buckets, np.float32)
    counts[cells["key"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(vocabulary, 2 * how.buckets)
    vectors, classes = attention.from_counts(counts, how.dims, how.classes, how.seed)
    within = attention.within_classes(counts[:, : how.buckets], classes, how.classes, how.prior)
    bucket = bucket_of(np.arange(vocabulary), how.buckets)
    model = Attention(vectors, classes, within, Attention.initial(vectors.shape[1], how.classes, how.seed), bucket)
    # start from the frequency of classes
    share = np.bincount(classes, counts[:, : how.buckets].sum(1) + 1, how.classes) + 1e-3
    model.weights["bias"] = np.log(share / share.sum()).astype(np.float32)
    texts = gathered.filter(F.col("kind") == TEXT).select("ids")
    if not how.rounds or texts.isEmpty():
        return model.with_weights(model.weights | {k: np.zeros_like(model.weights[k]) for k in ("carry", "own")})
    names = list(model.weights)
    shapes = {k: model.weights[k].shape for k in names}
    for turn in range(how.rounds):
        shared = gathered.sparkSession.sparkContext.broadcast(model)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seed, n = shared.value, TaskContext.get().partitionId() * 31 + turn, 0
            for given, target, alone in _runs(batches, start_id, how.shard):
                passes = 1 if n or len(given) == how.shard else max(1, how.least * attention.BATCH * attention.RUN // len(given))
                own = own.with_weights(own.train(given, target, alone, rate=how.rate / (1 + 2 * turn), passes=passes, seed=seed))
                n += len(given)
            if n:
                flat = np.concatenate([own.weights[k].ravel() for k in names]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], names=["at", "value", "n"])

        summed = texts.mapInArrow(local, "at long, value double, n double").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).orderBy("at").toPandas()
        flat, weights, start = summed["value"].to_numpy().astype(np.float32), {}, 0
        for k in names:
            size = int(np.prod(shapes[k]))
            weights[k] = flat[start : start + size].reshape(shapes[k])
            start += size
        model = model.with_weights(weights)
    return model


def score_documents(documents: DataFrame, *, how: Training = Training(), model_path: str = DEFAULT_MODEL, top: int = TOP) -> DataFrame:
    """One row per row of documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its only token is the end. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. score sums the attention model's
    log10 probabilities of the words' subwords and of the end. A text of any length
    is scored whole, each token once. Repeated rows each get a row; other columns
    are ignored; without training documents all counts are 0. An empty table gives
    no rows.
    """
    small_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    source = Path(model_path).read_bytes()
    coder = context.broadcast(source)
    subwords = Subwords(source)
    scratch = Scratch()
    gathered = scratch.keep(_gather(documents, coder, how))
    counts = cut(gathered.filter(F.col("kind") == WORD).groupBy(F.col("key").alias("hash")).agg(F.sum("n").alias("c")))
    sums = counts.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    docs = gathered.filter(F.col("kind") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, kinds = sums.tokens + docs, sums.kinds + (docs > 0)
    sizes = {r.size: r.n for r in counts.groupBy(F.log2(F.col("c")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, room = 1 << 62, top
    for size in sorted(sizes, reverse=True):
        if sizes[size] > room:
            break
        least, room = 1 << size, room - sizes[size]
    frequent = counts.filter(F.col("c") >= least).toPandas()
    order = np.argsort(frequent["hash"].to_numpy(), kind="stable")
    table = context.broadcast((frequent["hash"].to_numpy(np.int64)[order], frequent["c"].to_numpy(np.int64)[order]))
    model = context.broadcast(train_attention(gathered, subwords.size, subwords.start, how))
    scratch.free(gathered)
    end_log = math.log10(docs + 1)
    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, own = _coder(coder), model.value
        seen = _counts(call, table)
        for batch in batches:
            for i, j in chunks(batch.column(1), AT_ONCE):
                w = Words(batch.column(1).slice(i, j - i), lower=True)
                hashes = w.word_hashes()
                slots = sub.slots(w, hashes)
                logs, hit = seen.of(sub, slots)
                n = len(w.counts)
                base = np.bincount(w.row, logs, n) + end_log
                known = np.bincount(w.row[hit], minlength=n) + (docs > 0)
                rest = np.flatnonzero(~hit)
                first = np.concatenate(([0], np.cumsum(np.bincount(w.row[rest], minlength=n)))).astype(np.int32)
                ids, sizes = sub.of(w, slots)
                given, target, alone, text = attention.windows(ids, sizes, sub.start)
                score = np.bincount(text, own.score(given, target, alone).sum(1), n) / math.log(10)
                tail = pa.ListArray.from_arrays(pa.array(first), pa.array(hashes[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), tail], names=["doc_id", "n_tokens", "known", "logs", "score", "tail"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, known long, logs double, score double, tail array<long>")
    scored = cut(scored).withColumn("row", F.monotonically_increasing_id())
    rare = counts.filter(F.col("c") < least)
    found = scored.select("row", F.explode("tail").alias("hash")).join(rare, "hash").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    out = scored.drop("tail").join(found, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))
    return out.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
