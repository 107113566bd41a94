"""Word hashing and quality rules against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import quality, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _kept string"


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def random_texts(rng, n=200):
    parts = ["a", "b", "a b c", "\n", "\n", " ", "\t", "\x0b", "\x0c", "\r", "é", "𝒳y", "#$", "\x1c", " ", "\x85", "x"]
    return [None, "", "\n", " \n a", "a\n\na\n a", *["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]]


def test_measure_matches_plain():
    texts = random_texts(random.Random(1))
    got = quality.measure(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert {f: int(got[f][k]) for f in quality.FEATURES} == plain(t), repr(t)
    sliced = quality.measure(pa.array(["zz", *texts], pa.string()).slice(3, 50))
    assert [int(x) for x in sliced["n_words"]] == [plain(t)["n_words"] for t in texts[2:52]]


def test_word_hashes_tell_words_apart():
    w = words.Words(pa.array(["Ab aB ab", "ab AB É é"]), lower=True)
    h = w.word_hashes()
    assert len(set(h.tolist())) == 3 and h[0] == h[1] == h[2] == h[3] == h[4]
    assert list(words.chunks(pa.array(["x" * 9, None, "y" * 30, "z"]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_exact_bounds():
    assert abs(quality.binomial_below(2, 10, 0.3) - sum([0.7**10, 10 * 0.3 * 0.7**9, 45 * 0.09 * 0.7**8])) < 1e-12
    exact = lambda k, n, p: float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
    for n in (1, 2, 7, 30, 99, 400):
        for k in {0, 1, n // 20, n // 10, n // 2, n - 1, n}:
            for p in (0.001, 0.01, 0.05, 0.3, 0.9):
                assert abs(quality.binomial_below(k, n, p) - exact(k, n, p)) <= 1e-11 * max(exact(k, n, p), 1e-3)
    assert quality.binomial_below(49_000_000, 10**9, 0.05) < 1e-300 and abs(quality.binomial_below(50_000_000, 10**9, 0.05) - 0.50004) < 1e-4
    assert abs(quality.upper_bound(0, 50, 0.05) - (1 - 0.05 ** (1 / 50))) < 1e-9
    good, bad = np.array([2000, 300, 1, 0]), np.array([5, 1, 20, 60])
    assert quality.choose(good, bad, 0.01, 0.01) == 2
    assert quality.choose(np.array([40, 0]), np.array([0, 9]), 0.01, 0.01) == 0


def test_certified_rules_limit_false_rejections(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        text = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randint(0, 99999)) + ("###" if bad else "") for _ in range(60))
        rows.append((i, text, "en" if i % 3 else None, "s", 1, "clash"))
        labels.append((i, int(not bad), 0))
    rows += [(None, "x", "en", "s", 1, "c"), (99999, None, "zz", "s", 1, "c"), (6, rows[6][1], None, "s", 1, "c")]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (None, 99999):
            assert r.base_failed and not r.kept
        else:
            assert r.kept == (r.doc_id % 5 != 0)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert {r._kept for r in kept.collect()} == {"clash", "c"}
    assert quality.quality_report(docs, marks.limit(0)).filter("kept").count() == 6001
    assert quality.quality_report(docs.limit(0), marks).count() == 0


def test_small_strata_get_cutoffs(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(f"word{rng.randint(0, 99999)}" + ("###" if bad else "") for _ in range(60)), ("en", "de", "fr", "es")[i % 4], "s", 1, ""))
        labels.append((i, int(not bad)))
    got = quality.quality_report(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.doc_id for r in got.collect() if r.kept} == {i for i in range(600) if i % 5}


def test_joint_cutoffs_stop_at_the_allowed_rate(spark):
    """Good documents that the strict cutoffs reject too: no more than max_false of them is lost."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad, odd = i % 5 == 0, i % 5 == 1
        rows.append((i, " ".join(f"word{rng.randint(0, 99999)}" + ("###" if bad or odd and rng.random() < 0.4 else "") for _ in range(60)), "en", "s", 1, ""))
        labels.append((i, int(not bad)))
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(got[i] for i in got if i % 5 == 0) and sum(not got[i] for i in got if i % 5) <= 0.05 * 480


def test_report_matches_plain_on_documents(spark):
    from marlstone.llm import registry

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.op4_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        want, r = plain(text), got[doc]
        assert {f: r[f] for f in quality.FEATURES} == want
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.kept and r.base_failed)


def plain_kept(docs, labels, max_false=0.05, level=0.05):
    """{doc_id: kept} from (doc_id, text, lang) and {doc_id: quality}, stratum by stratum and cutoff by cutoff."""
    below = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    found = {d: plain(t) for d, t, _ in docs}
    ratio = lambda a, b: a / b if b else -math.inf
    values = lambda f: [ratio(f["n_symbols"], f["n_words"]), ratio(f["n_dup_lines"], f["n_lines"]), ratio(f["n_repeat_words"], f["n_words"]), ratio(f["word_chars"], f["n_words"]), ratio(-f["word_chars"], f["n_words"])]
    failed = {d: f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for d, f in found.items()}
    grids = [grid for _, grid in quality.RULES.values()]
    strata = defaultdict(list)
    for d, _, lang in docs:
        if d in labels and not failed[d]:
            strata[lang].append((values(found[d]), labels[d] > 0))
    cutoffs = {}
    for lang, rows in strata.items():
        good, bad = [v for v, ok in rows if ok], [v for v, ok in rows if not ok]
        own = level / (2 * len(strata))

        def passes(lost, rate, at):
            return lost < len(good) and below(lost, len(good), rate) <= at

        def best(rule, most):
            net = [0] + [sum(v[rule] > c for v in bad) - sum(v[rule] > c for v in good) for c in grids[rule][:most]]
            return net.index(max(net)), max(net)

        step = 0
        while step < quality.STEPS:
            cuts = [g[-(-(step + 1) * len(g) // quality.STEPS) - 1] for g in grids]
            if not passes(sum(any(x > c for x, c in zip(v, cuts)) for v in good), max_false, own):
                break
            step += 1
        together = [best(r, -(-step * len(g) // quality.STEPS)) for r, g in enumerate(grids)]
        apart = []
        for r, grid in enumerate(grids):
            k = 0
            while k < len(grid) and passes(sum(v[r] > grid[k] for v in good), max_false / 5, own / 5):
                k += 1
            apart.append(best(r, k))
        taken = apart if sum(n for _, n in apart) > sum(n for _, n in together) else together
        cutoffs[lang] = [g[k - 1] if k else math.inf for (k, _), g in zip(taken, grids)]
    return {d: not failed[d] and not any(x > c for x, c in zip(values(found[d]), cutoffs.get(lang, [math.inf] * 5))) for d, _, lang in docs}


def test_verdicts_match_plain_cutoffs(spark):
    from marlstone.llm import registry

    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    got = registry.op4_quality_rules(spark, sf).collect()
    want = plain_kept(docs, labels)
    assert {r.doc_id: r.kept for r in got} == want
    assert any(not r.kept and not r.base_failed for r in got)


def test_very_long_texts():
    text = "one two three four " * 400_000
    got = quality.measure(pa.array([text, None, "x" * 3_000_000]))
    assert got["n_words"].tolist() == [1_600_000, 0, 1] and got["n_repeat_words"].tolist() == [1_600_000, 0, 0] and got["word_chars"][2] == 3_000_000
