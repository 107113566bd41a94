"""SentencePiece against the public library's Viterbi on the same pieces, and against brute force."""

import itertools
import random
import tracemalloc
from pathlib import Path

import sentencepiece

from marlstone.llm import pieces

MODEL = pieces.PieceModel.load()


def library():
    """The library with the same pieces and scores, switched to its Viterbi encoder."""
    data = bytearray(Path(pieces.DEFAULT_MODEL).read_bytes())
    at = data.index(b"\x12\x06tok_v0\x18\x02") if b"\x12\x06tok_v0\x18\x02" in data else None
    assert at is not None
    data[at + 9] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def texts(rng, n=300):
    words = "The quick brown fox thonononeinst Étion çouelle 中文 ﬁne ① \U0001d4d0 don't a . , 1234 ### \t \n é".split(" ")
    return [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(n)]


def test_same_as_library_viterbi():
    lib = library()
    for t in texts(random.Random(2)):
        assert MODEL.encode(t) == lib.encode(t), t


def test_round_trip_of_odd_texts():
    for t in ["", " ", "  ", " a", "a  b ", "▁", "x▁ y", "\x00\x7f�", "a" * 5000, "<s></s><unk><0x0A>", "▁" * 7, "é‍", "\n\n\t"]:
        assert MODEL.decode(MODEL.encode(t)) == t, repr(t)


def test_long_text_without_spaces():
    """A part of any length is solved whole, in memory of few bytes a character."""
    rng = random.Random(5)
    text = "".join(rng.choices("thonest中ing①\U0001d4d0", k=300_000))
    assert MODEL.encode(text) == library().encode(text)
    tracemalloc.start()
    data = MODEL.encode_bytes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert MODEL.decode(pieces.array("i", data)) == text and peak < 60 * len(text)
    for words in ("a bc ", "▁"):
        long = words * (pieces.LONG_TEXT // len(words) + 9)
        assert MODEL.decode(MODEL.encode(long)) == long


def test_best_path_is_optimal():
    own = pieces.PieceModel([("<unk>", 0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.2, 1), ("ba", -2.6, 1), ("aba", -3.0, 1), ("b▁a", -0.5, 1), ("▁", -1.0, 1), ("!", -0.3, 4), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]], prefix=False)
    gain = {t: s for t, s, k in own.pieces if k == 1} | {"!": 1 * -0.5 - 0.1}
    for size in range(1, 7):
        for chars in itertools.product("ab▁x", repeat=size):
            text = "".join(chars)
            got = own.best_path(text)
            best = [0.0] + [float("-inf")] * size
            for end in range(1, size + 1):
                for start in range(end):
                    part = text[start:end]
                    value = gain.get(part, -3.0 - pieces.UNKNOWN_PENALTY if end - start == 1 else float("-inf"))
                    best[end] = max(best[end], best[start] + value)
            total = sum(gain[own.pieces[i][0]] if own.pieces[i][2] == 1 else (-13.0 if own.pieces[i][0] == "<0x78>" else 0.0) for i in got)
            assert abs(total - best[-1]) < 1e-9 and own.decode(got) == text.replace("▁", " "), text


def test_tables(spark):
    rows = [(1, "The fox", 5, "q"), (1, "The fox", 5, "q"), (None, None, 6, "q"), (2, "", 7, "q"), (3, "x " * 50_000, 8, "q"), (4, "a▁b 中①", 9, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string")
    got = pieces.round_trip(docs, MODEL).collect()
    assert len(got) == 6 and all(r.exact for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(MODEL.encode(t or "")) for _, t, *_ in rows)
    encoded = pieces.encode_documents(docs, MODEL)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = pieces.decode_documents(encoded, MODEL)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0 and pieces.encode_documents(docs.limit(0), MODEL).count() == 0


def test_idle_workers_hold_no_solved_parts(spark):
    """Spark keeps a worker for the tasks of other operators, which then have less memory."""
    docs = spark.createDataFrame([(k, " ".join(f"word{k * 100 + i}" for i in range(100))) for k in range(50)], "doc_id long, text string").coalesce(1)

    def held(batches):
        import pyarrow as pa

        from marlstone.llm import pieces as own

        for _ in batches:
            pass
        solved = [m.ready()[5] for m in own._MODELS.values()]
        yield pa.RecordBatch.from_arrays([pa.array([len(solved)]), pa.array([sum(len(s) + len(s.old) for s in solved)])], names=["models", "parts"])

    for _ in range(3):
        encoded = pieces.encode_documents(docs, MODEL).collect()
        assert all(MODEL.decode(r.ids) == " ".join(f"word{r.doc_id * 100 + i}" for i in range(100)) for r in encoded)
        rows = spark.range(0, 1, 1, 1).mapInArrow(held, "models long, parts long").collect()
        assert all(r.parts == 0 for r in rows)
        if any(r.models for r in rows):
            return
    raise AssertionError("no worker was used again")
