"""Language-model scoring: counts against plain Python, windows and gradients, held-out accuracy."""

import itertools
import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from marlstone.llm import lm, registry
from marlstone.llm.attention import MOST, PAD, STRIDE, Attention, windows, within_classes
from marlstone.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def plain(rows):
    counts = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        own = tokens(text)
        out.append((doc, held(doc), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)))
    return out


def compare(got, rows):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for g, w in zip(got, sorted(plain(rows), key=key), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5])), (g, w)


def small_model(rng, tokens_=300):
    return Attention(rng.standard_normal((tokens_, 8)), rng.integers(0, 6, tokens_), np.full((tokens_, 1), -1.0), {k: v.astype(float) for k, v in Attention.initial(8, 6).items()})


def test_each_token_is_a_target_once():
    sizes = np.array([5, 0, 40, 16, 33])
    ids = np.arange(10, 10 + sizes.sum(), dtype=np.int32)
    given, target, alone, text = windows(ids, sizes, 1)
    before = np.where(alone[:, None], PAD, np.concatenate([given[:1], given[:-1]]))
    assert sorted(target[target != PAD].tolist()) == ids.tolist()
    assert (np.bincount(text, (target != PAD).sum(1), 5) == sizes).all()
    for b, g, t in zip(before, given, target):
        chain = [*b[b != PAD], *g[g != PAD]]
        assert list(t[t != PAD]) == [*chain[len(b[b != PAD]) + 1 :], t[t != PAD][-1]]


def test_scores_are_causal_and_match_the_slow_form():
    rng = np.random.default_rng(3)
    model = small_model(rng)
    sizes = np.array([50, 7])
    ids = rng.integers(2, 300, 57).astype(np.int32)
    given, target, alone, text = windows(ids, sizes, 1)
    got = model.score(given, target, alone, run=2)
    w, e = model.weights, model.vectors
    sequence = [1, *ids[:49].tolist()]
    for t in range(50):
        first = max(0, t // STRIDE * STRIDE - STRIDE)
        seen = sequence[first : t + 1]
        s = np.array([e[sequence[t]] @ w["match"] @ e[k] + w["far"][t - first - i] for i, k in enumerate(seen)])
        p = np.exp(s - s.max())
        logits = (p / p.sum()) @ (e[seen] @ w["carry"]) + e[sequence[t]] @ w["own"] + w["bias"]
        want = logits[model.classes[ids[t]]] - np.log(np.exp(logits).sum()) - 1.0
        assert abs(got[t // STRIDE, t % STRIDE] - want) < 1e-6
    changed = ids.copy()
    changed[30] = 299 if ids[30] != 299 else 298
    again = model.score(*windows(changed, sizes, 1)[:3])
    assert np.allclose(got.ravel()[:30], again.ravel()[:30]) and not np.allclose(got.ravel()[31:50], again.ravel()[31:50])


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    model = small_model(rng)
    given, target, alone, _ = windows(rng.integers(0, 300, 128).astype(np.int32), np.array([60, 0, 45, 23]), 1)
    before = np.stack([np.full(STRIDE, PAD, np.int32), given[2]])
    given, target, alone = given[:6].reshape(2, 3, STRIDE), target[:6].reshape(2, 3, STRIDE), alone[:6].reshape(2, 3)
    slopes, _ = model.gradients(before, given, target, alone, model._seen())
    for name, g in slopes.items():
        at = tuple(int(rng.integers(0, s)) for s in g.shape)
        weight = model.weights[name]
        old, step, losses = weight[at], 1e-5, []
        for d in (step, -step):
            weight[at] = old + d
            losses.append(model.gradients(before, given, target, alone, model._seen())[1])
        weight[at] = old
        assert abs(g[at] - (losses[0] - losses[1]) / 2 / step) < 1e-6


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    classes = rng.integers(0, 6, 300)
    within = within_classes(rng.integers(0, 9, (300, 4)).astype(float), classes, 6, 2.0)
    model = Attention(rng.standard_normal((300, 8)), classes, within, Attention.initial(8, 6), lm.bucket_of(np.arange(300), 4))
    total = 0.0
    for token in range(300):
        given, target, alone, _ = windows(np.array([5, 9, token], np.int32), np.array([3]), 1)
        total += math.exp(model.score(given, target, alone)[0, 2])
    assert abs(total - 1) < 1e-5


def test_counts_match_plain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(None, None), (None, "Zebra zebra"), (10**6, ""), (3, " \t"), rows[5], rows[5], (10**6 + 1, "long words here " * 20_000)]
    docs = spark.createDataFrame([(d, t, "s", 1.0) for d, t in rows + odd], "doc_id long, text string, hash string, score double")
    compare(lm.score_documents(docs).collect(), rows + odd)
    compare(lm.score_documents(docs, top=40).collect(), rows + odd)
    assert lm.score_documents(docs.limit(0)).count() == 0
    alone = next(d for d in range(100) if held(d))
    got = lm.score_documents(spark.createDataFrame([(alone, "a b", "", 0.0)], docs.schema)).first()
    assert got.held_out and got.train_tokens == got.n_known == 0 and got.n_tokens == 3 and math.isfinite(got.score)


def test_held_out_accuracy(spark):
    """On held-out texts the attention model beats its own classes without context, by what it gave when last measured."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in registry.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    no_context = [r for r in lm.score_documents(docs, how=lm.Training(rounds=0)).collect() if r.held_out]
    total = lambda rows, c: sum(r[c] for r in rows) / sum(r.n_tokens for r in rows)
    print("log10 per word:", total(got, "score"), "untrained:", total(no_context, "score"), "words:", total(got, "base_score"))
    assert total(got, "score") > total(no_context, "score") + 0.1 and total(got, "score") > -4.6
    again = [r for r in registry.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert abs(total(got, "score") - total(again, "score")) < 1e-6


def test_every_window_is_trained_on():
    rng = np.random.default_rng(8)
    sizes = np.array([5, 1, 400, 16, 33, 70])
    ids = rng.integers(2, 300, sizes.sum()).astype(np.uint16)
    texts = [a.tobytes() for a in np.split(ids, np.cumsum(sizes)[:-1])]
    batches = [pa.record_batch([pa.array(part, pa.binary())], ["ids"]) for part in (texts[:2], texts[2:])]
    runs = list(lm._runs(iter(batches), 1, 7))
    assert [len(r[0]) for r in runs[:-1]] == [7] * (len(runs) - 1)
    want = windows(ids.astype(np.int32), sizes, 1)[:3]
    assert all((np.concatenate(got) == whole).all() for got, whole in zip(zip(*runs), want))


def test_small_tables_are_trained_on(spark):
    free = [d for d in range(60) if not held(d)][:3]
    docs = spark.createDataFrame([(d, f"one two three {d} four five six") for d in free], "doc_id long, text string")
    score = lambda **how: sum(r.score for r in lm.score_documents(docs, how=lm.Training(**how)).collect())
    assert score() > score(rounds=0) + 0.1


def test_untrained_classes_keep_their_frequencies(spark):
    """Without training and neighbours' buckets, the order of words changes nothing."""
    docs = spark.createDataFrame([(d, t) for d in range(20) for t in ("one two three four", "four three one two")], "doc_id long, text string")
    got = {r.score for r in lm.score_documents(docs, how=lm.Training(rounds=0, prior=1e12)).collect()}
    assert max(got) - min(got) < 1e-4


def subwords():
    return lm.Subwords(Path(lm.DEFAULT_MODEL).read_bytes())


def test_words_are_found_whatever_their_hashes():
    """Equal leading bits, the hash 0, arrays that grow, slots given anew: ids stay those of the library."""
    rng = np.random.default_rng(9)
    sub = subwords()
    for kinds, make in ((50_000, None), (2000, lambda k: k), (20_000, lambda k: k % np.uint64(3000) << np.uint64(52) | k)):
        number = rng.integers(0, kinds, 60_000).astype(np.uint64)
        some = [f"w{k}x{k % 7}" for k in number.tolist()]
        w = Words(pa.array([" ".join(some), None, "", some[0]]))
        hashes = make(np.append(number, number[0])) if make else w.word_hashes()
        sub._clear()
        want = [[*itertools.chain.from_iterable(sub.processor.encode(text.split())), sub.end] for text in (" ".join(some), "", "", some[0])]
        for _ in range(2):
            slots = sub.slots(w, hashes)
            ids, sizes = sub.of(w, slots)
            assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [*itertools.chain.from_iterable(want)]
            assert len(np.unique(slots)) == len(set(some)) == sub.known - 1 and 2 * sub.known <= len(sub.place)


def test_known_words_cost_less_than_sorting_them():
    rng = np.random.default_rng(10)
    words = np.array([f"w{k}" for k in range(40_000)])
    w = Words(pa.array([" ".join(words[(40_000 * rng.random(80_000) ** 2).astype(int)])]))
    hashes, sub = w.word_hashes(), subwords()
    sub.slots(w, hashes)

    def best(f):
        times = []
        for _ in range(7):
            start = time.perf_counter()
            f()
            times.append(time.perf_counter() - start)
        return min(times)

    assert best(lambda: sub.slots(w, hashes)) < best(lambda: np.unique(hashes, return_index=True, return_inverse=True))


def test_counts_survive_slots_given_anew(spark, monkeypatch):
    """Word counts of a partition and of the scores, with room for few words."""
    monkeypatch.setattr(lm.Subwords, "KEEP", 300)
    monkeypatch.setattr(lm, "AT_ONCE", 2000)
    monkeypatch.setattr(lm, "_CODERS", {})
    rng = np.random.default_rng(11)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 900, 120)) for _ in range(60)] + ["", None]
    frame = SimpleNamespace(mapInArrow=lambda run, _: run)
    frame.filter = frame.select = lambda *_: frame
    run = lm._gather(frame, SimpleNamespace(value=Path(lm.DEFAULT_MODEL).read_bytes()), lm.Training(buckets=4))
    got, docs = Counter(), 0
    for batch in run(iter([pa.record_batch([pa.array(texts)], ["text"])])):
        for kind, key, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind == lm.WORD:
                got[key] += n
            docs += n if kind == lm.DOCS else 0
    all_words = " ".join(t or "" for t in texts)
    hashes = Words(pa.array([all_words])).word_hashes().view(np.int64).tolist()
    assert got == Counter(hashes) and docs == len(texts)
    kept = sorted(got)[::2]
    counts = lm.Counts(np.array(kept), np.array([got[k] for k in kept]))
    (sub,) = lm._CODERS.values()
    for text in texts[:60]:
        w = Words(pa.array([text]))
        own = w.word_hashes()
        logs, found = counts.of(sub, sub.slots(w, own))
        want = [math.log10(got[k] + 1) if k in set(kept) else 0.0 for k in own.view(np.int64).tolist()]
        assert np.allclose(logs, want) and found.tolist() == [x > 0 for x in want]


def test_each_known_word_is_counted_up_once(monkeypatch):
    sub, looked = subwords(), []
    w = Words(pa.array(["one two three one"]))
    counts = lm.Counts(np.sort(w.word_hashes().view(np.int64))[:2], np.array([1, 2]))
    search = np.searchsorted
    monkeypatch.setattr(lm.np, "searchsorted", lambda a, v, *rest: looked.append(len(v)) or search(a, v, *rest))
    for _ in range(3):
        counts.of(sub, sub.slots(w, w.word_hashes()))
    assert sum(looked) == 4  # three words and the end


def test_scores_are_held_within_bounds_only_where_they_may_pass_them():
    rng = np.random.default_rng(12)
    ids, sizes = rng.integers(2, 300, 400).astype(np.int32), np.array([250, 0, 150])
    for scale, free in ((1, True), (300, False)):
        model = small_model(rng)
        model.weights = {k: v * scale for k, v in model.weights.items()}
        given, target, alone, _ = windows(ids, sizes, 1)
        got = model.score(given, target, alone)
        assert model._tables[-2:] == (free, free) and np.isfinite(got).all() and (got >= -2 * MOST - 1 - math.log(6)).all()
        model._tables = (*model._tables[:-2], False, False)
        assert np.allclose(got, model.score(given, target, alone), atol=1e-9)
