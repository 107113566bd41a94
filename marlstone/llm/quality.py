"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic exceeds a cutoff. The cutoffs of a
stratum come from labelled documents, in two ways. Together: all rules go along
their grids, from lenient to strict, in STEPS fixed steps, certified while the
exact binomial test shows that they reject fewer good documents, by any rule, than
the allowed rate; cutoffs no stricter than certified ones need no test. Apart:
each rule goes along its grid alone at its share of the allowed rate. Testing
along a fixed sequence needs no correction within it; the level is divided by the
strata, half of it for each way, and for the second by the rules. Of a rule's
certified cutoffs, the one that rejects most bad documents, net of good ones, is
taken; none is taken if none does. The way with the greater net is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, if_small, packed, small_batches
from .words import U64, Words, chunks, mix, repeated, sum_by

#: Symbols of markup and junk (fixed values).
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules: the statistic and its grid of cutoffs from lenient to strict. More than the cutoff rejects.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols per word": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "share of repeated lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "share of repeated words": ("n_repeat_words / n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "long words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    "short words": ("-word_chars / n_words", (-1.0, -1.25, -1.5, -1.75, -2.0, -2.5, -3.0, -3.5, -4.0)),
}

#: Steps of all rules together; a rule's cutoff at step k is the one at that share of its grid.
STEPS = max(len(grid) for _, grid in RULES.values())


def at_step(k: int, size: int) -> int:
    """Number, from 1, of the cutoff at step k, from 1, in a grid of the size."""
    return -(-k * size // STEPS)


@dataclass(frozen=True)
class Risk:
    """max_false: share of good documents of a stratum that may be rejected; level: chance that any stratum exceeds it."""

    max_false: float = 0.05
    level: float = 0.05


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of a chunk of texts."""
    w = Words(texts)
    h = w.word_hashes()
    out = {"n_words": w.counts.astype(np.int64), "word_chars": w.per_row(~w.white & ((w.data & 0xC0) != 0x80)), "n_symbols": w.per_row(_IS_SYMBOL[w.data])}

    breaks = np.flatnonzero(w.data == 10)
    begin = np.concatenate((w.rows[:-1], breaks + 1))
    row = np.concatenate((np.arange(len(w.counts)), np.searchsorted(w.rows, breaks, side="right") - 1))
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    stop = np.where(np.append(row[1:] == row[:-1], False), np.append(begin[1:], 0) - 1, w.rows[row + 1])
    solid = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(~w.white, out=solid[1:])
    worded = solid[stop] > solid[begin]
    begin, stop, row = begin[worded], stop[worded], row[worded]
    keys = np.stack([row.astype(U64), w.hashes(begin, stop)])
    distinct = np.unique(keys, axis=1)[0].astype(np.int64) if keys.size else np.zeros(0, np.int64)
    lines = np.bincount(row, minlength=len(w.counts))
    out["n_lines"] = lines.astype(np.int64)
    out["n_dup_lines"] = (lines - np.bincount(distinct, minlength=len(w.counts))).astype(np.int64)

    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = w.row[2:] == w.row[:-2]
        at = np.flatnonzero(inside)
        windows = mix(h[at] * U64(3) + mix(h[at + 1] * U64(5) + mix(h[at + 2] + mix(w.row[at].astype(U64)))))
        hit = at[repeated(windows)]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = sum_by(w.first, covered)
    return out


def with_features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep plus FEATURES of text, which may also be a field of the struct _row in keep."""
    small_batches(documents.sparkSession)
    inside = "_row" in keep
    needed = documents.select(*keep) if inside else documents.select(*keep, "text")
    schema = T.StructType([*documents.select(*keep).schema.fields, *[T.StructField(f, T.LongType()) for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep.index("_row")).field("text") if inside else batch.column(len(keep))
            for a, b in chunks(texts):
                got = measure(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(keep)], *[pa.array(got[f], pa.int64()) for f in FEATURES]], names=[*keep, *FEATURES])

    return needed.mapInArrow(run, schema)


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _statistic(name: str) -> Column:
    top, below = RULES[name][0].split(" / ")
    value = F.col(top.removeprefix("-")).cast("double") / F.nullif(F.col(below), F.lit(0))
    return F.coalesce(-value if top.startswith("-") else value, F.lit(float("-inf")))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(at most k of n) at rate p: the incomplete beta function of 1 - p at (n - k, k + 1), by its continued fraction."""
    if k >= n:
        return 1.0
    return _incomplete_beta(n - k, k + 1.0, 1 - p)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's evaluation of its continued fraction, which takes some sqrt(max(a, b)) terms at most."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d or tiny), 1 + term / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000 + 10 * math.sqrt(a + b):
            break
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return min(1.0, math.exp(front) * value / a)


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate of which k of n were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_below(k, n, mid) > level else (low, mid)
    return high


def certified(good: np.ndarray, max_false: float, level: float) -> int:
    """Number of cutoffs, from lenient to strict, that are certified. good: counts of good documents by how many cutoffs they exceed."""
    n, lost = int(good.sum()), np.cumsum(good[::-1])
    for k in range(1, len(good)):
        if lost[k - 1] >= n or binomial_below(int(lost[k - 1]), n, max_false) > level:
            return k - 1
    return len(good) - 1


def best_of(good: np.ndarray, bad: np.ndarray, most: int) -> tuple[int, int]:
    """(number, net) of the first of the most cutoffs that rejects most bad documents, net of good ones; (0, 0) if none does."""
    net = np.concatenate(([0], (np.cumsum(bad[::-1]) - np.cumsum(good[::-1]))[:most]))
    return int(net.argmax()), int(net.max())


def choose(good: np.ndarray, bad: np.ndarray, max_false: float, level: float) -> int:
    """Number, from 1, of the cutoff to take (0: none). good, bad: counts of documents by how many cutoffs they exceed; the k-th rejects those that exceed all but k - 1."""
    return best_of(good, bad, certified(good, max_false, level))[0]


def calibrate(features: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """From features (doc_id, stratum, FEATURES) and labels (doc_id, quality): one row (stratum, cutoffs array<double>, bounds array<double>) per stratum, in the order of RULES.

    A null cutoff means that the rule rejects nothing there. A bound is of the
    good documents that the rule rejects, or all rules if they are certified
    together. With no good document lost, the latter needs ln(level / 2 strata) /
    ln(1 - max_false) good ones: 99 of each of four strata at the default. Documents that the
    base rules reject take no part. Of several labels of a document, the highest
    counts. All labelled documents are counted; only the counts are gathered.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    rows = features.filter(~base_failed()).join(marks, "doc_id")
    exceeded = [F.struct(F.lit(k).alias("rule"), sum(((_statistic(name) > c).cast("int") for c in grid), F.lit(0)).alias("passed")) for k, (name, (_, grid)) in enumerate(RULES.items())]
    steps = (reduce(or_, (_statistic(name) > grid[at_step(k, len(grid)) - 1] for name, (_, grid) in RULES.items())) for k in range(1, STEPS + 1))
    exceeded.append(F.struct(F.lit(len(RULES)).alias("rule"), sum((any_.cast("int") for any_ in steps), F.lit(0)).alias("passed")))
    counts = rows.select(F.col(stratum).alias("stratum"), "_quality", F.explode(F.array(*exceeded)).alias("e"))
    counts = cut(counts.groupBy("stratum", "e.rule", "e.passed").agg(F.sum((F.col("_quality") > 0).cast("long")).alias("good"), F.sum((F.col("_quality") <= 0).cast("long")).alias("bad")))
    strata = counts.select("stratum").distinct().count()
    level = risk.level / max(1, 2 * strata)
    own_level, share = level / len(RULES), risk.max_false / len(RULES)
    grids = [grid for _, grid in RULES.values()]

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        def counted(rule: int, size: int) -> list[np.ndarray]:
            own = pdf[pdf.rule == rule]
            return [np.bincount(own.passed, own[c], size + 1).astype(np.int64) for c in ("good", "bad")]

        joint, _ = counted(len(grids), STEPS)
        step = certified(joint, risk.max_false, level)
        each = [counted(rule, len(grid)) for rule, grid in enumerate(grids)]
        together = [best_of(*c, at_step(step, len(grid)) if step else 0) for c, grid in zip(each, grids)]
        apart = [best_of(*c, certified(c[0], share, own_level)) for c in each]
        alone = sum(net for _, net in apart) > sum(net for _, net in together)
        taken = [k for k, _ in (apart if alone else together)]
        of_all = upper_bound(int(joint[STEPS - step + 1 :].sum()), int(joint.sum()), level)
        cutoffs = [grid[k - 1] if k else None for k, grid in zip(taken, grids)]
        bounds = [(upper_bound(int(good[len(grid) - k + 1 :].sum()), int(good.sum()), own_level) if alone else of_all) if k else None for k, grid, (good, _) in zip(taken, grids, each)]
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "cutoffs": [cutoffs], "bounds": [bounds]})

    return cut(counts.groupBy("stratum").applyInPandas(certify, f"stratum {dict(features.dtypes)[stratum]}, cutoffs array<double>, bounds array<double>"))


def judged(features: DataFrame, thresholds: DataFrame, stratum: str = "lang") -> DataFrame:
    """features with _failed (base rules) and _kept. A stratum without labelled documents has no cutoffs, so base rules alone decide there."""
    table = thresholds.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"))
    joined = features.join(if_small(table), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for k, name in enumerate(RULES):
        rejected |= F.coalesce(_statistic(name) > F.get("_cutoffs", F.lit(k)), F.lit(False))
    return joined.withColumns({"_failed": base_failed(), "_kept": ~base_failed() & ~rejected}).drop("_stratum", "_cutoffs")


def quality_report(documents: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per row of documents (doc_id, text, lang): doc_id, FEATURES, base_failed, kept.

    Null or empty text: all counts 0, so the base rules reject it. Null lang: a
    stratum of its own. Null doc_id: judged, never labelled. Repeated rows are
    judged alike. Other columns are ignored. Empty tables: no rows, or no cutoffs.
    """
    features = cut(with_features(documents, ["doc_id", "lang"]))
    out = judged(features, calibrate(features, labels, risk))
    return out.select("doc_id", *FEATURES, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of documents that quality_report keeps, with all their columns."""
    thresholds = calibrate(cut(with_features(documents, ["doc_id", "lang"])), labels, risk)
    marked = judged(with_features(packed(documents), ["_row"]), thresholds, "_row.lang")
    return marked.filter("_kept").select("_row.*")
