"""Document quality from graded ratings: ordinal regression with cumulative links on hashed text.

A document's features are the distinct 32-bit hashes of its words, of the first bytes of longer words,
of its runs of ASCII signs, and of two coarse measures of the whole text (how often words repeat, how much of it is signs). One weight per
feature is shared by all grades; ordered thresholds cut the summed weight into grades:
P(grade <= k) = sigmoid(threshold_k - score). Expected grade and the probability of reaching a grade
select documents.

The model is fitted on the driver over a sample of at most ``SAMPLE`` ratings of documents that are there,
taken by hash of the id; it keeps at most ``FEATURES`` features, chosen by Spark from counts by grade, so only these
come to the driver. All documents are scored.

Defined cases: a missing text counts as empty and is scored by the thresholds alone; ratings that are
missing are not used; repeated ratings of a document all count; without any rating every document
is kept with the middle grade; ties in the sample's hash order are broken by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import fields_of, keep_ids, map_batches, materialize, utf8_of
from billspark.llm.shingles import blocks, mix, word_hashes

#: Most rated documents that the model is fitted on, and most features it keeps.
SAMPLE, FEATURES = 10_000, 1 << 15
#: Documents of the sample that a feature must be in, and standard deviations that it must pull the grade.
LEAST_DOCS, LEAST_PULL = 5, 4.0
STEPS, RATE, RIDGE = 150, 0.06, 3e-4

#: Lengths in bytes of the word beginnings that are features.
HEADS = (4, 5, 6, 7)

_WORDS = np.zeros(256, bool)
_WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature hashes of each text."""
    out = []
    for _, some, at in blocks(data, offsets):
        words, begins, *heads = word_hashes(some, at, _WORDS, HEADS)
        heads = [mix(h + np.uint64(k)) for k, h in zip(HEADS, heads)]
        signs, sign_begins = word_hashes(some, at, _SIGNS)
        signs = mix(signs)
        for d in range(len(at) - 1):
            low, high = begins[d], begins[d + 1]
            own, marks = words[low:high], signs[sign_begins[d] : sign_begins[d + 1]]
            distinct = np.unique(own)
            repeats = int(2 * np.log2((len(own) + 1) / (len(distinct) + 1)))
            signed = int(8 * len(marks) / (len(own) + 1))
            whole = mix(np.array([1000 + repeats, 2000 + min(signed, 16)], np.uint64))
            every = np.concatenate([distinct, marks, whole, *(h[low:high] for h in heads)])
            out.append(np.unique((every >> np.uint64(32)).astype(np.uint32)))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature hashes, the weight of each, and the thresholds between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Summed weight of each row's known features."""
        if not len(self.features) or not rows:
            return np.zeros(len(rows))
        flat = np.concatenate(rows)
        at = np.minimum(np.searchsorted(self.features, flat), len(self.features) - 1)
        values = np.where(self.features[at] == flat, self.weights[at], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(values)])
        ends = np.cumsum([len(r) for r in rows])
        return sums[ends] - sums[ends - np.array([len(r) for r in rows])]

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and threshold (columns)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _pulls(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For documents by grade: shares up to each grade but the last, the centred pull of each grade, its variance."""
    parts = counts / counts.sum()
    share = np.cumsum(parts)[:-1].clip(0.01, 0.99)
    # With all weights at zero: how far a document of each grade pulls the weights of its features.
    edges = np.concatenate([[0.0], share, [1.0]])
    pull = 1 - edges[1:] - edges[:-1]
    pull = pull - (parts * pull).sum()
    return share, pull, max(float((parts * pull**2).sum()), 1e-9)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by Adam over all rows."""
    if not rows:
        return OrdinalModel(np.zeros(0, np.uint32), np.zeros(0), np.linspace(-0.8, 0.8, n_grades - 1))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    features = np.unique(flat)
    place = np.searchsorted(features, flat).astype(np.int32)
    del flat
    counts = np.bincount(place)
    share, pull, variance = _pulls(np.bincount(grades, minlength=n_grades))
    thresholds = np.log(share / (1 - share))
    # How far each feature's documents pull its weight, in standard deviations.
    strength = np.abs(np.bincount(place, pull[grades][owner])) / np.sqrt(counts * variance)
    strength[counts < LEAST_DOCS] = 0
    kept = np.sort(np.argsort(-strength, kind="stable")[: min(FEATURES, int((strength >= LEAST_PULL).sum()))])
    number = np.full(len(features), -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    place = number[place]
    owner, place = owner[place >= 0], place[place >= 0]
    # gaps between thresholds stay positive through their logarithms
    theta = np.concatenate([np.zeros(len(kept)), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gaps = len(theta) - len(kept)
    n = len(rows)

    def cut_points(theta: np.ndarray) -> np.ndarray:
        tail = theta[len(kept) :]
        return tail[0] + np.concatenate([[0.0], np.cumsum(np.exp(tail[1:]))])

    for step in range(1, STEPS + 1):
        cuts = cut_points(theta)
        scores = np.bincount(owner, theta[place], n)
        low = np.concatenate([[-np.inf], cuts])[grades]
        high = np.concatenate([cuts, [np.inf]])[grades]
        at_low, at_high = _sigmoid(low - scores), _sigmoid(high - scores)
        chance = np.maximum(at_high - at_low, 1e-9)
        d_low, d_high = at_low * (1 - at_low), at_high * (1 - at_high)
        d_score = (d_high - d_low) / chance / n  # of the negative log likelihood
        d_cuts = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_cuts[k] = ((grades == k + 1) * d_low / chance).sum() / n - ((grades == k) * d_high / chance).sum() / n
        tail = np.empty(gaps)
        tail[0] = d_cuts.sum()
        for k in range(1, gaps):
            tail[k] = d_cuts[k:].sum() * np.exp(theta[len(kept) + k])
        weights = theta[: len(kept)]
        gradient = np.concatenate([np.bincount(place, d_score[owner], len(kept)) + RIDGE * weights, tail])
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta - RATE / (1 + 3 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(features[kept], theta[: len(kept)], cut_points(theta))


def fit_documents(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` of the rows of ``ratings`` (``doc_id``, ``grade`` from 0)."""
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade"))
    rated = rated.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    chosen = materialize(chosen, "rated")  # at most ``sample`` pairs of numbers
    texts = keep_ids(docs.select("doc_id", "text"), chosen.select("doc_id").distinct())

    def cut(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [f.tobytes() for f in text_features(*utf8_of(batch.column(1)))]]

    features = map_batches(texts, ["doc_id", "text"], cut, "doc_id long, features binary")
    known = materialize(features.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "features"), "rated-features")
    shared = docs.sparkSession.sparkContext.broadcast(_strong_features(known, n_grades))

    def thin(batch: pa.RecordBatch) -> list:
        some = (np.frombuffer(f, np.uint32) for f in batch.column(2).to_pylist())
        return [batch.column(0), batch.column(1), [f[np.isin(f, shared.value, assume_unique=True)].tobytes() for f in some]]

    thinned = map_batches(known, known.columns, thin, "doc_id long, grade int, features binary")
    rows = sorted(thinned.collect())
    grades = np.array([r.grade for r in rows], np.int64)
    return fit([np.frombuffer(r.features, np.uint32) for r in rows], grades, n_grades)


def _strong_features(known: DataFrame, n_grades: int) -> np.ndarray:
    """The features that ``fit`` keeps for rows of ``grade`` and ``features``, at most ``FEATURES``, sorted."""
    by_grade = dict(known.groupBy("grade").count().collect())
    if not by_grade:
        return np.zeros(0, np.uint32)
    _, pull, variance = _pulls(np.array([by_grade.get(k, 0) for k in range(n_grades)]))

    def spread(batch: pa.RecordBatch) -> list:
        some = [np.frombuffer(f, np.uint32) for f in batch.column(1).to_pylist()]
        lengths = [len(f) for f in some]
        flat = np.concatenate(some).astype(np.int64) if some else np.zeros(0, np.int64)
        return [flat, np.repeat(np.array(batch.column(0).to_pylist(), np.int32), lengths)]

    counts = map_batches(known, ["grade", "features"], spread, "feature long, grade int").groupBy("feature").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("grade") == k, 1)).alias(f"n{k}") for k in range(n_grades)]
    )
    total = sum((F.col(f"n{k}") * float(pull[k]) for k in range(n_grades)), F.lit(0.0))
    strength = F.abs(total) / F.sqrt(F.col("n") * variance)
    # the margin leaves features at the very limit to ``fit``, whose sums may round in another way
    strong = counts.filter(F.col("n") >= LEAST_DOCS).select("feature", strength.alias("strength")).filter(F.col("strength") >= LEAST_PULL - 1e-9)
    best = strong.orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()
    return np.sort(np.array([r.feature for r in best], np.uint32))


def score_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, expected_grade, above_0, above_1 ...``: mean grade, and chance of more than each grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(model.thresholds)

    def score(batch: pa.RecordBatch) -> list:
        above = shared.value.above(shared.value.scores(text_features(*utf8_of(batch.column(1)))))
        return [batch.column(0), pa.array(above.sum(1)), *(pa.array(above[:, k]) for k in range(n))]

    schema = "doc_id long, expected_grade double" + "".join(f", above_{k} double" for k in range(n))
    return map_batches(docs, ["doc_id", "text"], score, schema)


#: Grades of the rated documents: toxic, poor, good.
TOXIC, POOR, GOOD = 0, 1, 2
#: Least probability of the grade GOOD that a kept document has.
LEAST_CHANCE = 0.3


def grades_of(labels: DataFrame) -> DataFrame:
    """One rating per label row; rows without a quality or toxicity are left out."""
    grade = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, POOR).when(F.col("quality") == 1, GOOD)
    return labels.filter("toxic IS NOT NULL").select("doc_id", grade.alias("grade"))


def good_enough(above_poor: Column) -> Column:
    return above_poor >= LEAST_CHANCE


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep`` for every document."""
    model = fit_documents(docs, grades_of(labels), 3)
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id", "expected_grade", F.col("above_1").alias("tail_probability"), good_enough(F.col("above_1")).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are good enough, all columns kept; texts are scored where they are."""
    model = fit_documents(docs, grades_of(labels), 3)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def select(batch: pa.RecordBatch) -> list:
        above = shared.value.above(shared.value.scores(text_features(*utf8_of(batch.column(where)))))
        keep = pa.array(np.flatnonzero(above[:, GOOD - 1] >= LEAST_CHANCE))
        return [batch.column(k).take(keep) for k in range(batch.num_columns)]

    return map_batches(docs, docs.columns, select, fields_of(docs, docs.columns))
