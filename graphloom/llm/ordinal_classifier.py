"""Operator 8: quality classifier by ordinal cumulative-link regression on graded ratings.

Grades are 0 .. K-1. One weight vector over hashed text features is shared by
all grades, and ordered thresholds cut its score: P(grade <= k) is the logistic
function of threshold k less the score. A text gets its expected grade and the
probability of each upper tail, and is selected by one of these tails.

Features are marks of presence, hashed into 2**BITS places: lower-cased words,
their first six bytes, each level that an ASCII sign's density reaches, and the
text's length alone and with its share of distinct words. They are made from whole texts.

The model is fitted on at most ``MOST_RATED`` rated texts, those with the
smallest hashes of their ids, and on fewer where their features together would
pass ``MOST_FEATURES``; these bounds on rated texts are the only sample. Every
document is scored. Null and empty texts have only the level features. A
document that is rated more than once counts once, with the least of its grades;
null ratings don't count. Without any rated text the score is 0 with thresholds
at even odds. Other columns are kept, whatever their names, unless they are
named like an output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textvec as tv
from graphloom.llm.store import Scratch

BITS = 18
#: Rated texts used for fitting, and rated texts that must have a feature for it to count.
MOST_RATED, LEAST_TEXTS = 6000, 3
#: Features of all rated texts together that the fit takes (4 bytes each on the driver); one text has at most 2**BITS.
MOST_FEATURES = 16_000_000
EPOCHS, RATE, SHRINK = 400, 0.05, 4e-4
SALT = tv.U64(0xA24BAED4963EE407)

#: For words: A-Z lowered, other ASCII but letters and digits separates.
PLAIN = tv.LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct feature numbers of each whole text."""
    data, off = tv.flat(column)
    plain = PLAIN[data]
    starts, ends, doc = tv.words(plain, off)
    whole = tv.word_hashes(plain, starts, ends)
    front = tv.word_hashes(plain, starts, np.minimum(starts + 6, ends)) ^ SALT
    n = len(column)
    cut = np.searchsorted(doc, np.arange(n + 1))
    size = np.maximum(np.diff(off), 1)
    signs = np.zeros((len(SIGNS), n), np.int64)
    for i, b in enumerate(SIGNS):
        at = np.searchsorted(np.flatnonzero(data == b), off)
        signs[i] = np.diff(at)
    level = np.floor(np.log2(1 + 2000 * signs / size)).astype(np.int64)
    out = []
    shift = tv.U64(64 - BITS)
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        own = np.unique(np.concatenate([whole[a:b] >> shift, front[a:b] >> shift]))
        count = int(b - a)
        distinct = len(np.unique(whole[a:b])) / max(count, 1)
        extra = [(1000 + s) * 64 + v for s in np.flatnonzero(level[:, i]) for v in range(1, level[s, i] + 1)]
        extra += [100 + int(np.log2(1 + count)), 200 + 32 * int(np.log2(1 + count)) + int(distinct * 20)]
        marks = tv.mix(np.array(extra, tv.U64) * tv.BASE + SALT) >> shift
        out.append(np.union1d(own, marks).astype(np.int32))
    return out


@dataclass
class Ordinal:
    """Weights by feature number and K - 1 increasing thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, feature_lists: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, a row a text."""
        score = np.array([self.weights[f].sum() for f in feature_lists], float)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit_ordinal(feature_lists: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Ordinal:
    """Full-batch Adam on the likelihood, with a soft threshold after each step so that few features get a weight."""
    size = 1 << BITS
    model = Ordinal(np.zeros(size, np.float32), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(1))
    if not len(grades):
        return model
    lengths = np.array([len(f) for f in feature_lists])
    flat = np.concatenate(feature_lists)
    row = np.repeat(np.arange(len(grades)), lengths)
    common = np.bincount(flat, minlength=size) >= min(LEAST_TEXTS, len(grades))
    flat, row = flat[common[flat]], row[common[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    n, m = len(grades), n_grades - 1
    share = np.clip([(grades <= k).mean() for k in range(m)], 0.01, 0.99)
    theta = np.log(share / (1 - share))
    # Thresholds are the first and positive gaps, kept as logarithms.
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    w = np.zeros(len(used))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(raw), np.zeros_like(raw)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, EPOCHS + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(row, w[flat], minlength=n)
        edges = np.concatenate([np.full((n, 1), -60.0), theta[None, :] - score[:, None], np.full((n, 1), 60.0)], axis=1)
        cdf = sig(edges)
        density = cdf * (1 - cdf)
        density[:, [0, -1]] = 0
        at = np.arange(n)
        p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-12)
        up, down = density[at, grades + 1] / p, density[at, grades] / p
        g_score = (up - down) / n
        g_w = np.bincount(flat, g_score[row], minlength=len(used))
        g_theta = np.zeros(m)
        for k in range(m):
            g_theta[k] = (-(up * (grades == k)) + down * (grades == k + 1)).sum() / n
        g_raw = np.cumsum(g_theta[::-1])[::-1].copy()
        g_raw[1:] *= np.exp(raw[1:])
        for value, grad, s in ((w, g_w, 0), (raw, g_raw, 2)):
            state[s] *= 0.9
            state[s] += 0.1 * grad
            state[s + 1] *= 0.999
            state[s + 1] += 0.001 * grad**2
            value -= RATE * (state[s] / (1 - 0.9**step)) / (np.sqrt(state[s + 1] / (1 - 0.999**step)) + 1e-8)
        size_of_step = RATE * SHRINK / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - size_of_step, 0)
    model.thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    model.weights[used] = w
    return model


def fit(rated: DataFrame, n_grades: int, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """Fit on the bounded sample of ``rated`` (id, text, grade); features are made on the executors.

    One row an id counts, the least of its grades and texts. Texts are taken
    whole, in the order of their ids' hashes, as long as their features together
    stay within MOST_FEATURES.
    """
    tv.arrow_limits(rated.sparkSession)
    one = F.min(F.struct(F.col(grade).cast("int").alias("grade_"), F.col(text).alias("text_"))).alias("one")
    order = F.xxhash64(F.lit("rated"), F.col(doc_id)).alias("order_")
    chosen = rated.where(F.col(grade).isNotNull()).groupBy(doc_id).agg(one).select(order, "one.text_", "one.grade_").orderBy("order_", "grade_", "text_").limit(MOST_RATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                found = features(part.column("text_"))
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("order_"), lists, part.column("grade_")], ["order_", "features", "grade_"])

    with Scratch(rated.sparkSession) as tables:
        made = tables.write(chosen.mapInArrow(run, "order_ bigint, features array<int>, grade_ int"), "features")
        # At most MOST_RATED rows, so one task adds up their sizes.
        up_to = Window.orderBy("order_").rowsBetween(Window.unboundedPreceding, 0)
        within = made.withColumn("sum_", F.sum(F.size("features").cast("long")).over(up_to)).where(F.col("sum_") <= MOST_FEATURES)
        got = within.select("features", "grade_").toArrow()
    column = got.column("features").combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy()) if len(column) else np.zeros(0, np.int64)
    lists = np.split(flat, ends[:-1]) if len(column) else []
    return fit_ordinal(lists, np.array(got.column("grade_").to_pylist(), np.int64).clip(0, n_grades - 1), n_grades)


def bounded_sample(ratings: DataFrame, doc_id: str = "doc_id", most: int = MOST_RATED) -> DataFrame:
    """At most ``most`` ratings, those with the smallest hashes of their ids."""
    return ratings.orderBy(F.xxhash64(F.lit("rated"), F.col(doc_id)), *ratings.columns).limit(most)


def score(docs: DataFrame, model: Ordinal, text: str = "text", least_tail: float = 0.5, tail: int | None = None) -> DataFrame:
    """``docs`` with expected_grade, tail_1 .. tail_(K-1) and kept: tail ``tail`` (the last) is at least ``least_tail``."""
    tv.arrow_limits(docs.sparkSession)
    m = len(model.thresholds)
    tail = tail or m
    made = ["expected_grade", *(f"tail_{k}" for k in range(1, m + 1)), "kept"]
    kept = [c for c in docs.columns if c not in made]
    zero = F.lit(0.0)
    schema = docs.select(*kept, *(zero.alias(c) for c in made[:-1]), F.lit(True).alias("kept")).schema
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            for part in tv.rounds(batch, text):
                tails = own.tails(features(part.column(text)))
                columns = [pa.array(tails.sum(axis=1)), *(pa.array(tails[:, k]) for k in range(m)), pa.array(tails[:, tail - 1] >= least_tail)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, *made])

    return docs.select(*kept).mapInArrow(run, schema)
