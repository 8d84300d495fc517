"""Quality rules: robust multivariate outliers (operator 5).

*Base rules* count words, symbols, repeated lines and words in repeated
five-word windows of each whole text. *Method*: a vector of transformed
statistics per document, and for each (language, source) a minimum covariance
determinant (MCD) estimate: mean and covariance of the ``coverage`` share of
vectors that lie closest, found by concentration steps from a median/MAD start
that go on until the covariance's determinant falls no more (each group by
itself; a step never raises it, so this ends). A document is rejected where its squared Mahalanobis distance passes ``cut``
times the group's median distance. Estimate and median are over the distinct
vectors of the group, and the median is ``LEAST_MEDIAN`` at least, so that
copies and near copies of one text, however many, neither shrink the scale nor
push the other documents over the cut.

Every concentration step is one join with the group estimates and one
aggregate over all rows, with map-side combine; a group is never gathered in
one task. Statistics are fixed-point integers (1/1000), so sums are exact and
reruns agree whatever the order of rows. Distance quantiles come from counts
per logarithmic bin, 64 to an octave, again exact and mergeable.

A covariance that is singular (a statistic that is constant in the group, say
no symbols at all) is widened by ``floor`` on its diagonal, the least spread
that counts as a difference in that statistic. Every group has its own estimate,
however small. One of n < ``fill_rows`` distinct vectors is filled up to so many
with its language's estimate, that with the estimate of all rows: mean,
covariance and logarithm of the median are averaged with weights n and
``fill_rows`` - n. So no verdict flips when a group passes some size.

Defined results: null text is empty (no words: base_failed); null language and
null source are groups of their own; repeated rows count as rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kind_of, map_batches, stage, text_of, to_bytes

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SCALE = 1000  # fixed point of the statistics
#: Least spread (in transformed units) that counts as a difference, by statistic.
FLOOR = {"words": 0.5, "word_len": 0.15, "symbols": 0.5, "dup_lines": 3.0, "repeats": 3.0, "upper": 0.4, "other": 0.4}
STATS = list(FLOOR)
BINS_PER_OCTAVE = 64
#: Least median distance; groups of ordinary texts have 1.2 or so.
LEAST_MEDIAN = 1.0


def text_stats(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_other)"""
    text = text or ""
    words = to_bytes(text).split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeats += i + WINDOW - max(i, end)
                    end = i + WINDOW
    data = np.frombuffer(to_bytes(text), np.uint8)
    kind = np.bincount(data, minlength=256)
    upper = int(kind[65:91].sum())
    other = int(kind[33:65].sum() + kind[91:97].sum() + kind[123:127].sum())
    return n, word_chars, symbols, dup_lines, repeats, upper, other


def vector(s: tuple[int, ...]) -> list[int]:
    """Transformed statistics in fixed point: logarithms of counts, and of rates
    per thousand, so that a rate's spread does not grow with its size."""
    n, chars, symbols, dups, repeats, upper, other = s
    per = 1000.0 / max(1, chars)
    x = (math.log(max(1, n)), math.log(max(1, chars) / max(1, n)), math.log1p(symbols * per),
         math.log1p(1000.0 * dups / max(1, n)), math.log1p(1000.0 * repeats / max(1, n)),
         math.log1p(upper * per), math.log1p(other * per))
    return [round(v * SCALE) for v in x]


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics and the vector (columns x0, x1, ...) of every document."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_stats(t.as_py()) for t in b.column("text")]
            x = np.array([vector(s) for s in got], np.int64).reshape(-1, len(STATS))
            s = np.array(got, np.int64).reshape(len(got), -1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("grp"), b.column("lang")]
                + [pa.array(s[:, i]) for i in range(len(base))]
                + [pa.array(x[:, i]) for i in range(len(STATS))],
                ["id", "grp", "lang", *base, *(f"x{i}" for i in range(len(STATS)))])

    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"),
        # to_json drops nulls: the level in front keeps a null source apart from the language.
        F.concat(F.lit("group "), F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"),
                                                     F.col(source_col).cast("string").alias("s")))).alias("grp"),
        F.concat(F.lit("lang "), F.to_json(F.struct(F.col(lang_col).cast("string").alias("l")))).alias("lang"))
    cols = ", ".join(f"{c} long" for c in (*base, *(f"x{i}" for i in range(len(STATS)))))
    out = map_batches(rows, run, f"id {kind_of(rows, 'id')}, grp string, lang string, {cols}")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * BINS_PER_OCTAVE).cast("int")


def _quantile_bins(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per group the bin up to which each share of its rows lies. Counts per
    (group, bin) first; the window then has one row per bin, a few thousand."""
    counts = rows.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("key")
    counts = counts.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return counts.groupBy("key").agg(*[
        F.min(F.when(F.col("cum") >= F.ceil(F.col("all") * s), F.col("bin"))).alias(name)
        for name, s in shares.items()])


P = len(STATS)
WIDENING = np.diag([FLOOR[s] ** 2 for s in STATS])
DOUBLES = pa.list_(pa.float64())


def _estimates(sums: DataFrame) -> DataFrame:
    """Group sums -> mean, covariance, precision matrix (inverse of the widened
    covariance) and the logarithm of the widened covariance's determinant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, cov, prec, det = [], [], [], []
            for r in b.to_pylist():
                m = np.array([r[f"s{i}"] for i in range(P)], float) / r["n"] / SCALE
                c = np.array([[float(r[f"s{min(i, j)}_{max(i, j)}"]) for j in range(P)] for i in range(P)])
                c = c / r["n"] / SCALE / SCALE - np.outer(m, m)
                mean.append(m.tolist())
                cov.append(c.ravel().tolist())
                prec.append(np.linalg.inv(c + WIDENING).ravel().tolist())
                det.append(float(np.linalg.slogdet(c + WIDENING)[1]))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(mean, DOUBLES), pa.array(cov, DOUBLES), pa.array(prec, DOUBLES),
                 pa.array(det, pa.float64())], ["key", "mean", "cov", "prec", "det"])

    return map_batches(sums, run, "key string, mean array<double>, cov array<double>, prec array<double>, det double")


def _filled(fits: DataFrame, lineage: DataFrame, fill_rows: int) -> DataFrame:
    """key, mean, prec of every group, filled up with the estimates above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, prec = [], []
            for r in b.to_pylist():
                top, *below = [f for f in (r["top_fit"], r["up_fit"], r["fit"]) if f is not None]
                m, c = np.array(top["mean"]), np.array(top["cov"])
                for f in below:
                    w = min(1.0, f["n"] / fill_rows)
                    m = w * np.array(f["mean"]) + (1 - w) * m
                    c = w * np.array(f["cov"]) + (1 - w) * c
                mean.append(m.tolist())
                prec.append(np.linalg.inv(c.reshape(P, P) + WIDENING).ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(mean, DOUBLES), pa.array(prec, DOUBLES)], ["key", "mean", "prec"])

    return map_batches(_above(lineage, fits, F.struct("n", "mean", "cov"), "fit"), run,
                       "key string, mean array<double>, prec array<double>")


def _above(lineage: DataFrame, table: DataFrame, value: Column, name: str) -> DataFrame:
    """key and the values of its own row, of the one above it and of the topmost (null: none)."""
    out = lineage.join(table.select("key", value.alias(name)), "key")
    for level in ("up", "top"):
        out = out.join(table.select(F.col("key").alias(level), value.alias(f"{level}_{name}")), level, "left")
    return out.select("key", name, f"up_{name}", f"top_{name}")


def _sums() -> list[Column]:
    p = range(P)
    x = [F.col(f"x{i}") for i in p]
    # Decimal products: exact for any number of rows.
    wide = [F.sum((x[i] * x[j]).cast("decimal(28,0)")).alias(f"s{i}_{j}") for i in p for j in p if i <= j]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in p], *wide]


def _distance() -> Column:
    """Squared Mahalanobis distance to the joined estimate, as plain arithmetic."""
    p = range(len(STATS))
    d = [F.col(f"x{i}") / SCALE - F.col("mean")[i] for i in p]
    rows = [sum((F.col("prec")[i * len(STATS) + j] * d[j] for j in p), F.lit(0.0)) for i in p]
    return sum((d[i] * rows[i] for i in p), F.lit(0.0))


def mcd_estimates(rows: DataFrame, coverage: float) -> DataFrame:
    """key, n (its rows), mean, cov and what the steps need, for rows (key, x0...)."""
    p = range(P)
    # Start: medians and MADs per statistic, from exact counts per value (a statistic is a
    # logarithm in thousandths, so it has some ten thousand values whatever the rows).
    start = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in p])
    start = stage(start, "mcd-medians")
    joined = rows.join(start, "key")
    spread = stage(joined.groupBy("key").agg(
        *[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i in p]),
        "mcd-spreads")
    eye = [F.lit(0.0)] * (P * P)
    for i in p:
        sd = F.greatest(F.lit(FLOOR[STATS[i]]), 1.4826 * F.col(f"a{i}") / SCALE)
        eye[i * P + i] = 1 / (sd * sd)
    found = ("mean", "cov", "prec", "det")
    now = stage(start.join(spread, "key").select(
        "key", "n", F.array(*[F.col(f"m{i}") / SCALE for i in p]).alias("mean"),
        F.array(*[F.lit(0.0)] * (P * P)).alias("cov"), F.array(*eye).alias("prec"),
        F.lit(float("inf")).alias("det"), F.lit(True).alias("moves")), "mcd-start")
    moving = True
    while moving:
        placed = rows.join(now.where("moves").select("key", "mean", "prec"), "key").withColumn("bin", _bin(_distance()))
        h = stage(_quantile_bins(placed, {"h": coverage}), "mcd-h")
        next_ = _estimates(placed.join(h, "key").where("bin <= h").groupBy("key").agg(*_sums()))
        next_ = next_.select("key", F.struct(*found).alias("next"))
        lower = F.coalesce(F.col("next.det") < F.col("det"), F.lit(False))
        now = stage(now.join(next_, "key", "left").select(
            "key", "n", *[F.when(lower, F.col(f"next.{c}")).otherwise(F.col(c)).alias(c) for c in found],
            lower.alias("moves")), "mcd-step")
        moving = not now.where("moves").isEmpty()
    return now


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", coverage: float = 0.75, fill_rows: int = 100,
                  cut: float = 64.0) -> DataFrame:
    """Base statistics, base_failed, distance (squared, over the group's median
    or LEAST_MEDIAN) and kept, one row per input row."""
    stats = stage(document_stats(docs, id_col, text_col, lang_col, source_col), "quality-stats")
    good = stats.where("NOT base_failed")
    everything = F.lit("all")
    xs = [f"x{i}" for i in range(len(STATS))]
    # A vector feeds every estimate above it, once however many rows have it: its
    # group's, its language's, that of all.
    feed = good.select("grp", "lang", *xs).distinct().select(
        F.explode(F.array("grp", "lang", everything)).alias("key"), *xs).distinct()
    feed = stage(feed, "quality-rows")
    groups = good.select("grp", "lang").distinct()
    none = F.lit(None).cast("string")
    lineage = stage(groups.select(F.col("grp").alias("key"), F.col("lang").alias("up"), everything.alias("top")).union(
        groups.select("lang", everything, none).distinct()).union(
        groups.select(everything, none, none).distinct()), "quality-keys")
    own = mcd_estimates(feed, coverage)
    fits = stage(_filled(own, lineage, fill_rows), "quality-fits")
    placed = feed.join(fits, "key").withColumn("bin", _bin(_distance()))
    medians = stage(_quantile_bins(placed, {"median": 0.5}).join(own.select("key", "n"), "key"), "quality-medians")
    scales = _above(lineage, medians, F.struct("n", "median"), "of")
    scale = F.lit(None).cast("double")
    for c in ("top_of", "up_of", "of"):
        w, median = F.least(F.lit(1.0), F.col(f"{c}.n") / fill_rows), F.col(f"{c}.median")
        scale = F.coalesce(w * median + (1 - w) * scale, median, scale)
    scales = scales.select("key", F.pow(F.lit(2.0), (scale + 0.5) / BINS_PER_OCTAVE).alias("scale"))
    per_group = stage(fits.join(scales, "key").withColumnRenamed("key", "grp"), "quality-groups")
    d2 = _distance() / F.greatest(F.col("scale"), F.lit(LEAST_MEDIAN))
    out = good.join(per_group, "grp").withColumn("distance", d2)
    out = out.unionByName(stats.where("base_failed"), allowMissingColumns=True)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"))
