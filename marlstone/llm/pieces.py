"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position its
output links give all pieces that end there, longest first, and each relaxes the
best score of that position; characters that no piece covers fall back to byte
tokens. The best path is then read backwards.

No piece of such a vocabulary holds a space mark after another character, so the
best path of a text is the best paths of its space-led parts, one after another.
Parts recur, so a worker keeps those it has solved, up to a bound; encode_documents
frees them when its task ends. Where a model does have such a piece, whole texts are
solved.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The space mark and its bytes (fixed values).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What an uncovered character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Characters from which on a text's parts are taken one by one, and not listed.
LONG_TEXT = 1 << 20
#: Score, start and piece of a position: 16 bytes a character, however long a part is.
_SCORE, _START, _PIECE = array("d", [-float("inf")]), array("i", [0]), array("i", [-1])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


@dataclass
class PieceModel:
    """Pieces (text, score, kind) by id. A model is small, so tasks get it whole; the automaton is built once a worker."""

    pieces: list[tuple[str, float, int]]
    prefix: bool = True
    #: Solved parts of a generation; a worker keeps two.
    keep: int = 400_000
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> PieceModel:
        pieces, prefix = [], True
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), float(own.get(2, 0.0)), own.get(3, NORMAL)))
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        return cls(pieces, prefix)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def ready(self) -> tuple:
        if self._ready is None:
            machine = ahocorasick.Automaton()
            worst, best = min((s for _, s, k in self.pieces if k == NORMAL), default=0.0), max((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
            crossing = False
            for number, (text, score, kind) in enumerate(self.pieces):
                if kind in (NORMAL, USER) and text:
                    score = len(text) * best - 0.1 if kind == USER else score
                    machine.add_word(text, (len(text), score, number))
                    crossing |= re.search(f"[^{MARK}]{MARK}", text) is not None
            machine.make_automaton()
            byte_ids = {int(text[1:-1], 16): number for number, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
            unknown = next((n for n, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
            parts = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+")
            byte = lambda b: chr(b if b < 128 else 0xDC00 + b)  # noqa: E731  what surrogateescape turns into that byte
            shown = [byte(int(t[1:-1], 16)) if k == BYTE else "" if k in (CONTROL, UNKNOWN) else t.replace(MARK, " ") for t, _, k in self.pieces]
            self._ready = (machine, worst - UNKNOWN_PENALTY, byte_ids, unknown, parts, _Solved(self), shown)
        return self._ready

    def best_path(self, text: str) -> array:
        """Ids (int32) of the best path over a normalised text."""
        machine, lost, byte_ids, unknown, *_ = self.ready()
        n = len(text)
        # lists are faster, and small for short parts
        score, starts, numbers = ([k[0]] * (n + 1) if n < 1024 else k * (n + 1) for k in (_SCORE, _START, _PIECE))
        score[0] = 0.0
        done = 0  # positions up to this one have their final score
        covered = False  # by a piece of one character

        def bare(upto: int) -> None:
            nonlocal done, covered
            while done < upto:
                done += 1
                if not covered and score[done - 1] + lost > score[done]:
                    score[done] = score[done - 1] + lost
                    starts[done], numbers[done] = done - 1, -1
                covered = False

        for end, (size, gain, number) in machine.iter(text):
            if end > done:
                bare(end)
            got = score[end + 1 - size] + gain
            covered |= size == 1
            if got > score[end + 1]:
                score[end + 1] = got
                starts[end + 1], numbers[end + 1] = end + 1 - size, number
        bare(n)
        out = array("i")
        at = n
        while at:
            start, number = starts[at], numbers[at]
            if number >= 0:
                out.append(number)
            else:
                out.extend(byte_ids.get(b, unknown) for b in reversed(text[start:at].encode()))
            at = start
        return out[::-1]

    def forget(self) -> None:
        """Frees the solved parts. They are solved again when met."""
        if self._ready is not None:
            self._ready[5].empty()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian int32."""
        if not text:
            return b""
        _, _, byte_ids, unknown, parts, solved, _ = self.ready()
        literal = np.array([byte_ids.get(b, unknown) for b in MARK.encode()], "<i4").tobytes()
        pieces = text.split(MARK)
        out = []
        for k, piece in enumerate(pieces):
            if k:
                out.append(literal)
            piece = piece.replace(" ", MARK)
            if k == 0 and self.prefix:
                piece = MARK + piece
            found = parts.findall(piece) if len(piece) < LONG_TEXT else (m[0] for m in parts.finditer(piece))
            out.extend(map(solved.__getitem__, found))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. Byte tokens are joined to characters; bytes that form none become U+FFFD."""
        shown = self.ready()[6]
        text = "".join(map(shown.__getitem__, ids))
        if self.prefix and text.startswith(" "):
            text = text[1:]
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class _Solved(dict):
    """Ids of parts. Once full, it becomes the old generation; parts met again come over from there, so frequent ones stay."""

    def __init__(self, model: PieceModel):
        self.model, self.old = model, {}

    def empty(self) -> None:
        self.old = {}
        self.clear()

    def __missing__(self, part: str) -> bytes:
        out = self.old.get(part)
        if out is None:
            out = np.array(self.model.best_path(part), "<i4").tobytes()
        if len(part) <= 64:
            if len(self) >= self.model.keep:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out


_MODELS: dict[str, PieceModel] = {}


def _here(shared) -> PieceModel:
    """The worker's own copy of a broadcast model, with what it has built and solved."""
    key = hashlib.sha256(repr(shared.value.pieces[:400]).encode()).hexdigest() + str(len(shared.value.pieces)) + str(shared.value.prefix)
    return _MODELS.setdefault(key, shared.value)


def encode_documents(documents: DataFrame, model: PieceModel) -> DataFrame:
    """The columns of documents with ids array<int> (replacing a column of that name) for the whole text.

    Null text: null. Empty text: an empty array. A literal space mark is encoded
    as bytes, so that decoding restores every text.
    """
    keep = [c for c in documents.columns if c != "ids"]
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(shared)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    texts = part.column(part.num_columns - 1).to_pylist()
                    rows = [None if t is None else own.encode_bytes(t) for t in texts]
                    first = np.zeros(len(rows) + 1, np.int32)
                    np.cumsum([len(r or b"") // 4 for r in rows], out=first[1:])
                    values = np.frombuffer(b"".join(r or b"" for r in rows), "<i4")
                    ids = pa.ListArray.from_arrays(pa.array(first), pa.array(values), mask=pa.array([r is None for r in rows]))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])
        finally:
            # Spark keeps idle workers, and other operators run in them
            own.forget()

    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """The columns of encoded, but ids, with text string (replacing a column of that name). Null ids: null. An id out of range is an error."""
    keep = [c for c in encoded.columns if c not in ("ids", "text")]
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(shared)
        for batch in batches:
            texts = [None if r is None else own.decode(r) for r in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("text", T.StringType())])
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def round_trip(documents: DataFrame, model: PieceModel) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian int32), exact (decoding the ids gives the text).

    Null text counts as empty: no tokens, exact. Repeated rows each get a row;
    other columns are ignored; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(shared)
        is_byte = np.array([kind == BYTE for _, _, kind in own.pieces])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                data = own.encode_bytes(text)
                ids = np.frombuffer(data, "<i4")
                rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(data).hexdigest(), own.decode(array("i", data)) == text))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "exact"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, exact boolean")
