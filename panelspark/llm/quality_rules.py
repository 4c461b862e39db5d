"""Quality rules: minimum-covariance-determinant estimates per language and source.

Five statistics of every text are transformed to a vector.  For each (language, source)
the mean and covariance of the most concentrated half of its documents are found by
concentration steps from two starts (median with absolute deviations; classical moments),
the start of smaller determinant is kept, and documents far from it by Mahalanobis distance
are rejected.  One step is one aggregation: distances are binned finely, moments are summed
by (group, bin) with partial aggregation, and a group's few hundred bins give the moments of
its closest half.  So a group with a third of all rows costs no task more than another, and
no row of a group is ever gathered.

Defined results: null, empty or blank texts have no words and fail the base rule; null
languages and sources are values of their own; a group of fewer than ``min_group``
documents is judged with the other small groups of its language, those languages' small
groups together if they too are few, and kept if even these are few.  ``floor`` is the
least standard deviation of each component: what is constant in clean text (no symbols, no
repeats) would make the covariance singular otherwise, and the smallest deviation reject.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import HASH, ID, keyed_whole
from panelspark.llm.textbytes import PLAIN, Slice, frames, gram_hash, span_hash
from panelspark.scratch import materialise

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
P = 5
#: Least standard deviations: log words, log word length, and log(1 + percent) of symbols, repeated lines and words.
FLOOR = (1.0, 0.1, 0.4, 1.2, 1.2)
BINS_PER_OCTAVE = 32


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in a window that it holds twice or more."""
    count = np.diff(first)
    out = np.zeros(len(count), np.int64)
    windows = gram_hash(words, WINDOW)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(windows):
        return out
    at = np.flatnonzero(doc[:len(windows)] == doc[WINDOW - 1:])
    if not len(at):
        return out
    key = windows[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(cover[:-1]) > 0, minlength=len(count)).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(part: Slice) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, first = part.words(PLAIN)
    words = span_hash(part.prefix(fold=False), starts, ends)
    edges = part.offsets[:-1]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[part.offsets[1:]] - total[edges]

    chars = per_text(PLAIN[part.data] & ((part.data & 0xC0) != 0x80))
    lines = np.array([repeated_lines(part.text(i)) for i in range(len(part))], np.int64)
    return [np.diff(first).astype(np.int64), chars.astype(np.int64), per_text(_SYMBOL[part.data]).astype(np.int64), lines,
            repeated_words(words, first)]


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the pair that names the row, lang, source and the five counts of every row of docs."""
    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], *map(pa.array, measure(part))],
                                             names=["doc_id", ID, HASH, "lang", "source", *STATS])

    schema = f"doc_id BIGINT, {ID} BIGINT, {HASH} BIGINT, lang STRING, source STRING, " + ", ".join(f"{c} BIGINT" for c in STATS)
    rows = keyed_whole(docs).select("doc_id", ID, HASH, F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return rows.mapInArrow(scan, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, rounded to 1/4096 so that sums of squares come out alike in any order."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    raw = [F.log(words), F.log(chars / words), F.log1p(100.0 * F.col("n_symbols") / chars),
           F.log1p(1000.0 * F.col("n_dup_lines") / words), F.log1p(100.0 * F.col("n_repeat_words") / words)]
    return [(F.round(x * 4096) / 4096).alias(f"x{i}") for i, x in enumerate(raw)]


def chi2_quantile(p: int, upper: float) -> float:
    """Value that a chi-squared variable of p degrees exceeds with probability ``upper`` (Wilson-Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - upper)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


_EST = f"grp STRING, start INT, centre ARRAY<DOUBLE>, inverse ARRAY<DOUBLE>, logdet DOUBLE, scale DOUBLE"
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _estimate(centre: np.ndarray, cov: np.ndarray, floor: np.ndarray) -> tuple[list, list, float]:
    cov = cov + np.diag(floor**2)
    return list(map(float, centre)), list(map(float, np.linalg.inv(cov).ravel())), float(np.linalg.slogdet(cov)[1])


def _distance2() -> Column:
    d = [F.col(f"x{i}") - F.element_at("centre", i + 1) for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.element_at("inverse", i * P + j + 1) * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def _bin() -> Column:
    return F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE).cast("int")


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def concentrate(bins: pd.DataFrame, floor: np.ndarray) -> tuple[list, list, float, float]:
    """Estimate from the closest half of a group, given its moments by bin of distance; and the median distance squared."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(np.float64)
    total = n.cumsum()
    need = (total[-1] + P + 1) // 2
    m = int(np.searchsorted(total, min(need, total[-1]))) + 1
    half = bins.iloc[:m]
    count = n[:m].sum()
    mean = np.array([half[f"s{i}"].sum() for i in range(P)]) / count
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = half[f"q{i}{j}"].sum() / count - mean[i] * mean[j]
    median = 2 ** ((float(bins["bin"].iloc[m - 1]) + 0.5) / BINS_PER_OCTAVE)
    return *_estimate(mean, cov, floor), median


def _step(rows: DataFrame, estimates: DataFrame, floor: np.ndarray) -> DataFrame:
    """One concentration step of every group and start."""
    def one(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        centre, inverse, logdet, median = concentrate(bins, floor)
        return pd.DataFrame({"grp": [key[0]], "start": [key[1]], "centre": [centre], "inverse": [inverse], "logdet": [logdet], "scale": [median]})

    binned = (rows.join(estimates.select("grp", "start", "centre", "inverse"), "grp").withColumn("d2", _distance2())
              .groupBy("grp", "start", _bin().alias("bin")).agg(*_moments()))
    return binned.groupBy("grp", "start").applyInPandas(one, _EST)


def grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """rows with ``grp``, the group whose estimate judges them: null where there are too few even together."""
    own = F.to_json(F.struct("lang", "source"))
    counts = rows.groupBy("lang", "source").count().withColumn("own", F.col("count") >= min_group)
    small = counts.where(~F.col("own")).groupBy("lang").agg(F.sum("count").alias("in_lang"))
    rest = small.where(F.col("in_lang") < min_group).agg(F.sum("in_lang").alias("in_all")).scalar()
    keys = (counts.alias("c").join(small.alias("s"), F.col("c.lang").eqNullSafe(F.col("s.lang")), "left")
            .select("c.lang", "c.source", F.when(F.col("own"), own_name("c", True))
                    .when(F.col("in_lang") >= min_group, own_name("c", False))
                    .when(rest >= min_group, F.lit("all")).alias("grp")))
    return (rows.alias("r").join(keys.alias("k"), F.col("r.lang").eqNullSafe(F.col("k.lang")) & F.col("r.source").eqNullSafe(F.col("k.source")), "left")
            .select("r.*", "k.grp"))


def own_name(table: str, with_source: bool) -> Column:
    fields = [F.col(f"{table}.lang").alias("lang")] + [F.col(f"{table}.source").alias("source")] * with_source
    return F.to_json(F.struct(*fields))


def robust_estimates(rows: DataFrame, floor=FLOOR, steps: int = 5) -> DataFrame:
    """One row per group: centre, inverse covariance and median distance of the better of the two starts."""
    low = np.array(floor)

    def start(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        r, out = table.iloc[0], []
        mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
        cov = np.zeros((P, P))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / r["n"] - mean[i] * mean[j]
        quartiles = np.array([list(r[f"p{i}"]) for i in range(P)], float)
        spread = (quartiles[:, 2] - quartiles[:, 0]) / 1.349
        for k, (centre, c) in enumerate(((quartiles[:, 1], np.diag(spread**2)), (mean, cov))):
            out.append((key[0], k, *_estimate(centre, c, low), 1.0))
        return pd.DataFrame(out, columns=["grp", "start", "centre", "inverse", "logdet", "scale"])

    quart = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(P)]
    estimates = rows.groupBy("grp").agg(*_moments(), *quart).groupBy("grp").applyInPandas(start, _EST)
    for _ in range(steps):
        estimates = materialise(_step(rows, materialise(estimates, "mcd-in") if _ == 0 else estimates, low), "mcd")
    best = F.min_by(F.struct("centre", "inverse", "scale"), F.struct("logdet", "start")).alias("e")
    return estimates.groupBy("grp").agg(best).select("grp", "e.*")


def verdicts(docs: DataFrame, min_group: int = 100, upper: float = 1e-9, floor=FLOOR, steps: int = 5) -> DataFrame:
    """doc_id, the pair that names the row, the counts, base_failed, distance2 and kept of every row of docs.

    ``upper``: share of clean documents that a normal model would reject.  Distances are divided by their median's
    ratio to a chi-squared one, which makes the concentrated half's covariance consistent."""
    stats = materialise(statistics(docs), "statistics").withColumn("base_failed", base_failed())
    judged = grouped(stats.where(~F.col("base_failed")).select(ID, HASH, "lang", "source", *vector()), min_group)
    judged = materialise(judged, "vectors")
    estimates = robust_estimates(judged.where(F.col("grp").isNotNull()), floor, steps)
    distance = (judged.join(estimates, "grp").withColumn("d2", _distance2() / F.greatest(F.col("scale") / chi2_quantile(P, 0.5), F.lit(0.25)))
                .groupBy(ID, HASH).agg(F.min("d2").alias("distance2")))
    cut = chi2_quantile(P, upper)
    kept = ~F.col("base_failed") & ~(F.coalesce("distance2", F.lit(0.0)) > cut)
    return stats.join(distance, [ID, HASH], "left").withColumn("kept", kept)


def quality_digest(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", *STATS, "base_failed", "kept", "distance2")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep; columns as they are."""
    bad = verdicts(docs).where(~F.col("kept")).select(ID, HASH).distinct()
    return keyed_whole(docs).join(bad, [ID, HASH], "left_anti").select(docs.columns)
