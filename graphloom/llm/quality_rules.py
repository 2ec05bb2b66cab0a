"""Operator 7: quality rules by robust multivariate outliers.

Each whole text gives a few counts. Six transformed statistics of them form a
vector; for every language and source a minimum-covariance-determinant
estimate is made from all rows. Of two starts, medians with median deviations
and the plain mean and covariance, the one that ends with the least determinant
is taken. From each go concentration steps that keep the half of the rows, (n + p + 1) / 2 of n, with
the smallest Mahalanobis distances and re-estimate mean and covariance from
these. The covariance of the half is then scaled so that the half ends at the
median of chi-square, and estimated once more from all rows within its 0.975
quantile, so nearly half of a group may be outliers of one kind. All sums
are grouped aggregates with map-side combining, so a source that holds a third
of the rows is no more than one row a task in a shuffle. The half is found from
a histogram of distances, so no group is sorted or collected.

Estimates are broadcast as long as the groups are few, so rows of a hot group
stay where they are. A group with fewer than ``MIN_ROWS`` rows uses its language's estimate, and a
language with fewer uses that of all rows. Null or empty texts have no words
and fail the base rules. Null languages and sources are groups of their own.
Repeated rows count as often as they occur. Very long texts are counted whole,
one at a time. Extra columns are kept, whatever their names, but for those named
like a column that is added, which it replaces. An empty table gives no rows. Rows that tie at the end of the half are all in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textvec as tv
from graphloom.llm.store import Scratch, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines", "n_distinct"]
FEATURES = 6
#: Rows that a group needs for an estimate of its own, and concentration steps.
MIN_ROWS, STEPS = 200, 4
#: Groups up to which estimates (about 700 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 10_000
#: Medians of chi-square by degrees of freedom, to scale the covariance of the half.
MEDIANS = [0.0, 0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481]
#: Squared distance within which rows are estimated from at last (chi-square with 6 degrees of freedom at 0.975), and its consistency factor.
NEAR, NEAR_FACTOR = 14.449, 1.0493
#: Least variance of each statistic, so that one that is mostly zero doesn't reject every other value.
#: Those of the symbol and repeat shares are noise: the root of a share of n words has variance 1 / (4 n), n being the group's usual number of words.
FLOOR = [0.25, 0.02, None, 0.01, None, 0.02]
#: Squared distance beyond which a row is rejected (chi-square with 6 degrees of freedom at 0.999).
CUTOFF = 22.458
BINS, BIN_TOP = 4096, 1e6
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each whole text."""
    data, off = tv.flat(column)
    n = len(column)
    starts, ends, doc = tv.words(data, off)
    out = {"n_words": np.bincount(doc, minlength=n)}
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    out["n_chars_all"] = points[off[1:]] - points[off[:-1]]
    word_points = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(points[ends] - points[starts], out=word_points[1:])
    cut = np.searchsorted(doc, np.arange(n + 1))
    out["word_chars"] = word_points[cut[1:]] - word_points[cut[:-1]]
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=signs[1:])
    out["n_symbols"] = signs[off[1:]] - signs[off[:-1]]
    hashes = tv.word_hashes(data, starts, ends)
    out["n_repeat_words"] = _repeats(hashes, doc, cut, n)
    out["n_distinct"] = np.array([len(np.unique(hashes[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text:
            seen: set[str] = set()
            parts = text.split("\n")
            lines[i] = len(parts)
            for line in parts:
                if line.strip(" \t\n\v\f\r"):
                    if line in seen:
                        dup[i] += 1
                    else:
                        seen.add(line)
    out["n_dup_lines"], out["n_lines"] = dup, lines
    return out


def _repeats(hashes: np.ndarray, doc: np.ndarray, cut: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of 8 that the text has twice or more."""
    total = len(hashes)
    if total < WINDOW:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
    h, d = tv.shingles(hashes, doc, WINDOW)
    long_docs = (cut[1:] - cut[:-1]) >= WINDOW
    h = h[long_docs[d]] if len(d) else h
    d = d[long_docs[d]] if len(d) else d
    order = np.lexsort((h, d))
    same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.zeros(total + 1, np.int64)
    np.cumsum(np.cumsum(edge[:-1]) > 0, out=covered[1:])
    return covered[cut[1:]] - covered[cut[:-1]]


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The other columns of ``docs`` and the counts of ``text``."""
    tv.arrow_limits(docs.sparkSession)
    kept = [c for c in docs.columns if (keep_text or c != text) and c not in COUNTS]
    schema = docs.select(*kept, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema
    read = docs.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, text):
                got = text_counts(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(got[c], pa.int64()) for c in COUNTS)], [*kept, *COUNTS])

    return read.mapInArrow(run, schema)


def _statistics() -> list:
    """Transformed statistics of a text with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def share(a, b):
        return F.sqrt(F.col(a) / F.greatest(b, F.lit(1.0)))

    return [
        F.log1p(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        share("n_symbols", F.col("n_chars_all").cast("double")),
        share("n_dup_lines", F.col("n_lines").cast("double")),
        share("n_repeat_words", n),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / n) / F.log1p(n),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(FEATURES) for j in range(i + 1)]


def _floor(mean: np.ndarray) -> np.ndarray:
    """The least variances in a group, whose first mean is that of log1p of the words."""
    noise = 1 / (4 * max(np.expm1(mean[0]), 1.0))
    return np.array([noise if least is None else least for least in FLOOR])


def _inverse(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    short = np.maximum(_floor(mean) - np.diag(cov), 0.0)
    return np.linalg.inv(cov + np.diag(short + 1e-6)).ravel().tolist()


def _estimate(moments: DataFrame, factor: float = 1.0) -> DataFrame:
    """From count, sums and products of each group: mean, covariance times ``factor``, its inverse and log-determinant. One row a group."""
    schema = "g string, mean array<double>, cov array<double>, inv array<double>, spread double"

    def run(batches):
        for pdf in batches:
            means, covs, inverses = [], [], []
            for row in pdf.itertuples(index=False):
                n = max(float(row.n), 1.0)
                mean = np.array([getattr(row, f"s{i}") for i in range(FEATURES)]) / n
                cov = np.zeros((FEATURES, FEATURES))
                for i, j in _pairs():
                    cov[i, j] = cov[j, i] = factor * (getattr(row, f"p{i}_{j}") / n - mean[i] * mean[j])
                means.append(mean.tolist())
                covs.append(cov.ravel().tolist())
                inverses.append(_inverse(mean, cov))
            spreads = [-float(np.linalg.slogdet(np.array(x).reshape(FEATURES, FEATURES))[1]) for x in inverses]
            yield pdf[["g"]].assign(mean=means, cov=covs, inv=inverses, spread=spreads)

    return moments.mapInPandas(run, schema)


def _scaled(fit: DataFrame, tops: DataFrame) -> DataFrame:
    """``fit`` with covariances scaled so that the half of each group ends at the median of chi-square.

    Its degrees of freedom are the statistics that vary by more than their least variance.
    """

    def run(batches):
        for pdf in batches:
            inverses = []
            for mean, cov, top in zip(pdf["mean"], pdf["cov"], pdf["top"], strict=True):
                cov = np.array(cov).reshape(FEATURES, FEATURES)
                free = max(int((np.diag(cov) > _floor(mean)).sum()), 1)
                end = np.expm1((top + 1) / (BINS - 1) * np.log1p(BIN_TOP))
                inverses.append(_inverse(mean, cov * end / MEDIANS[free]))
            yield pdf[["g", "mean"]].assign(inv=inverses)

    return fit.join(tops, "g").mapInPandas(run, "g string, mean array<double>, inv array<double>")


def _small(groups: DataFrame, few: bool) -> DataFrame:
    """A table of one row a group, to be broadcast if the groups are few."""
    return F.broadcast(groups) if few else groups


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(FEATURES)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _pairs()]
    return rows.groupBy("g").agg(F.count("*").alias("n"), *sums, *products)


def _distance(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """Rows with their squared Mahalanobis distance ``d2`` from their group's estimate."""
    joined = rows.join(_small(fit, few), "g")
    terms = F.lit(0.0)
    for i, j in _pairs():
        gap = (F.col(f"x{i}") - F.col("mean")[i]) * (F.col(f"x{j}") - F.col("mean")[j])
        terms = terms + gap * F.col("inv")[i * FEATURES + j] * (1.0 if i == j else 2.0)
    return joined.withColumn("d2", F.greatest(terms, F.lit(0.0))).drop("mean", "cov", "inv", "spread")


def _bin(d2):
    """Logarithmic bins of a squared distance."""
    scaled = F.log1p(F.least(d2, F.lit(BIN_TOP))) / float(np.log1p(BIN_TOP)) * (BINS - 1)
    return F.floor(scaled).cast("int")


def _tops(rows: DataFrame) -> DataFrame:
    """(g, top) the bin of distances in which the half of each group ends."""
    from pyspark.sql import Window

    counts = rows.groupBy("g", _bin(F.col("d2")).alias("b")).count()
    run = Window.partitionBy("g").orderBy("b")
    whole = Window.partitionBy("g")
    below = counts.withColumns({"before": F.sum("count").over(run) - F.col("count"), "all": F.sum("count").over(whole)})
    return below.where(F.col("before") < (F.col("all") + FEATURES + 1) / 2).groupBy("g").agg(F.max("b").alias("top"))


def _nearest(rows: DataFrame, few: bool) -> DataFrame:
    """The nearer half of each group's rows."""
    return rows.join(_small(_tops(rows), few), "g").where(_bin(F.col("d2")) <= F.col("top")).drop("top")


def _medians(rows: DataFrame, columns: list) -> DataFrame:
    return rows.groupBy("g").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(columns)))


def _first_fit(rows: DataFrame, few: bool) -> DataFrame:
    """Medians and median-deviation variances, without covariances."""
    centre = written(_medians(rows, [F.col(f"x{i}") for i in range(FEATURES)]).select("g", F.array(*(f"m{i}" for i in range(FEATURES))).alias("mean")), "mcd")
    deviations = _medians(rows.join(_small(centre, few), "g"), [F.abs(F.col(f"x{i}") - F.col("mean")[i]) for i in range(FEATURES)])
    noise = 1 / (4 * F.greatest(F.expm1(F.col("mean")[0]), F.lit(1.0)))
    spread = [F.greatest(F.pow(1.4826 * F.col(f"m{i}"), 2), noise if least is None else F.lit(least)) for i, least in enumerate(FLOOR)]
    inverse = [1 / spread[i] if i == j else F.lit(0.0) for i in range(FEATURES) for j in range(FEATURES)]
    return centre.join(deviations, "g").select("g", "mean", F.array(*inverse).alias("inv"))


def fit(rows: DataFrame, few: bool) -> DataFrame:
    """(g, mean, inv) of each group of ``rows`` (g, x0 .. x5); each step's estimates are written."""
    with Scratch(rows.sparkSession) as tables:
        names = F.explode(F.array(F.lit("a"), F.lit("b")))
        both = rows.select("*", names.alias("start")).withColumn("g", F.concat("start", "g")).drop("start")
        classical = _estimate(_moments(both.where(F.col("g").startswith("b"))))
        estimate = tables.write(_first_fit(both.where(F.col("g").startswith("a")), few).unionByName(classical.select("g", "mean", "inv")), "mcd")
        for _ in range(STEPS):
            estimate = tables.write(_estimate(_moments(_nearest(_distance(both, estimate, few), few))), "mcd")
        ended = F.min(F.struct("spread", F.substring("g", 1, 1).alias("start"), "mean", "cov", "inv")).alias("e")
        best = estimate.groupBy(F.expr("substring(g, 2)").alias("g")).agg(ended).select("g", "e.mean", "e.cov", "e.inv", "e.spread")
        best = tables.write(best, "best")
        scaled = tables.write(_scaled(best, _tops(_distance(rows, best, few))), "scaled")
        return written(_estimate(_moments(_distance(rows, scaled, few).where(F.col("d2") <= NEAR)), NEAR_FACTOR).select("g", "mean", "inv"), "mcd")


def judge(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (``text`` only if asked for), counts, base_failed, kept and distance.

    Needs columns lang and source. The counts are written once; every step reads these alone.
    """
    made = [*COUNTS, "base_failed", "kept", "distance"]
    others = [c for c in docs.columns if c != text and c not in made]
    # The columns of ``docs`` travel in a struct, so none is taken for one that is made here.
    row = F.struct(*(F.col(c) for c in others)).alias("row_of_")
    counted = with_counts(docs.select(row, F.col(text).alias("text_of_"), F.col("lang").alias("lang_of_"), F.col("source").alias("source_of_")), "text_of_", keep_text)
    counted = written(counted.withColumns({f"x{i}": x for i, x in enumerate(_statistics())}), "counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lang = F.coalesce(F.concat(F.lit("="), "lang_of_"), F.lit("null"))
    source = F.coalesce(F.concat(F.lit("="), "source_of_"), F.lit("null"))
    fine = F.concat(F.lit("2"), F.length(lang).cast("string"), lang, source)
    coarse = F.concat(F.lit("1"), lang)
    xs = [f"x{i}" for i in range(FEATURES)]
    fitted = counted.where(~failed).select(fine.alias("fine"), coarse.alias("coarse"), *xs)
    enough = lambda key: fitted.groupBy(key).count().where(F.col("count") >= MIN_ROWS).select(key)
    sizes = written(enough("fine").select(F.col("fine").alias("g")).union(enough("coarse")).union(counted.sparkSession.range(1).select(F.lit("0").alias("g"))), "groups")
    few = sizes.count() < MOST_BROADCAST
    levels = [fitted.select(g.alias("g"), *xs) for g in (F.col("fine"), F.col("coarse"), F.lit("0"))]
    pool = levels[0].unionByName(levels[1]).unionByName(levels[2]).join(_small(sizes, few), "g", "left_semi")
    estimate = fit(pool, few)
    own = sizes.select(F.col("g").alias("fine"), F.lit(True).alias("has_fine"))
    wide = sizes.select(F.col("g").alias("coarse"), F.lit(True).alias("has_coarse"))
    rows = counted.withColumns({"fine": fine, "coarse": coarse}).join(_small(own, few), "fine", "left").join(_small(wide, few), "coarse", "left")
    rows = rows.withColumn("g", F.when(F.col("has_fine"), F.col("fine")).when(F.col("has_coarse"), F.col("coarse")).otherwise(F.lit("0")))
    # Without any fitted row there is no estimate: then nothing is an outlier.
    ready = rows.join(_small(estimate.select("g"), few), "g", "left_anti").withColumn("d2", F.lit(0.0))
    scored = _distance(rows, estimate, few).unionByName(ready)
    return scored.select(
        *([F.col("text_of_").alias(text)] if keep_text else []), *(F.col("row_of_")[c].alias(c) for c in others), *COUNTS,
        failed.alias("base_failed"), (~failed & (F.col("d2") <= CUTOFF)).alias("kept"), F.col("d2").alias("distance"),
    )
