"""Toxicity by cumulative-link ordinal regression.

Severity grades 0, 1, ... share one weight vector over sparse features: the words a text has, and the beginnings of
its words with the number of words (one, two, more) that share them, as insults are inflected.  Ordered thresholds cut
the score: P(grade <= k) = logistic(threshold_k - score).  The result is the expected grade.

The model is fitted on at most ``ROWS_PER_GRADE`` labelled documents of each label, weighted so that labels keep their
true shares, and on at most ``FEATURES`` features.  Both bounds are parameters; every text is scored as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from mementa.llm.common import stored, text_of

ROWS_PER_GRADE = 4000
FEATURES = 5000
LEAST_DOCUMENTS = 3
LEAST_EVIDENCE = 6.0
TELLING_CLEAN_SHARE = 0.05
STEM_LETTERS = (4, 5, 6)
STEPS = 100
PENALTY = 1e-4
_WORD = re.compile(r"\w+").findall


def features_of(text: str) -> set[str]:
    """Words; beginnings of longer words, marked by a hyphen; by -2 and -3, those of two and of three words or more."""
    words = set(_WORD(text.lower()))
    stems = Counter([w[:n] for n in STEM_LETTERS for w in words if len(w) > n])
    found = words | {f"{s}-" for s in stems}
    for stem, n in stems.items():
        if n > 1:
            found.add(f"{stem}-2")
            if n > 2:
                found.add(f"{stem}-3")
    return found


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from ``labels(doc_id, toxic)``: 0 clean, 1 toxic.

    Labels without doc_id or toxic do not count; of several labels of a document the gravest does.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade"))


@dataclass(frozen=True)
class Model:
    """Weights by feature and ordered thresholds.  Without labelled texts of two grades it finds nothing toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (math.inf,)

    def above(self, text: str) -> list[float]:
        """P(grade > k) for every threshold k."""
        score = math.fsum(self.weights[w] for w in features_of(text) & self.weights.keys()) if self.weights else 0.0
        return [1 / (1 + math.exp(max(-700.0, min(700.0, t - score)))) if t < math.inf else 0.0 for t in self.thresholds]


def objective(parameters: np.ndarray, rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, weight: np.ndarray,
              n_grades: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with an L2 penalty on the weights, and its gradient.

    ``parameters`` are the weights, the first threshold and the logarithms of the distances to the next ones.
    """
    width = len(parameters) - n_grades + 1
    w, first, gaps = parameters[:width], parameters[width], np.exp(np.clip(parameters[width + 1 :], -10, 10))
    cuts = np.concatenate(([-np.inf, first], first + np.cumsum(gaps), [np.inf]))
    score = np.bincount(rows, w[columns], len(grade))
    high, low = (1 / (1 + np.exp(-np.clip(z - score, -500, 500))) for z in (cuts[grade + 1], cuts[grade]))
    chance = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / chance * weight, low * (1 - low) / chance * weight
    by_cut = (np.bincount(grade, d_low, n_grades + 1) - np.bincount(grade + 1, d_high, n_grades + 1))[1:n_grades]
    later = np.cumsum(by_cut[::-1])[::-1]
    slope = np.bincount(columns, (d_high - d_low)[rows], width) + penalty * w
    return -(np.log(chance) * weight).sum() + penalty / 2 * (w @ w), np.concatenate((slope, later[:1], later[1:] * gaps))


def minimise(f: Callable, x: np.ndarray, steps: int = STEPS, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            kept.append((s @ way) / (s @ y))
            way -= kept[-1] * y
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            way += (a - (y @ way) / (s @ y)) * s
        descent, size = -(slope @ way), 1.0 if past else 1 / max(1e-9, np.abs(slope).sum())
        if descent >= 0:
            break
        for _ in range(30):
            new_value, new_slope = f(x - size * way)
            if new_value <= value + 1e-4 * size * descent:
                break
            size /= 2
        moved, turned = -size * way, new_slope - slope
        if moved @ turned > 1e-12:
            past = [*past, (moved, turned)][-memory:]
        done = value - new_value < 1e-9
        x, value, slope = x + moved, new_value, new_slope
        if done:
            break
    return x


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int, n_grades: int,
                steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for binary features given as coordinates."""
    start = np.zeros(width + n_grades - 1)
    start[width] = 1.0
    weight = weight / weight.sum()
    x = minimise(lambda p: objective(p, rows, columns, grade, weight, n_grades, penalty), start, steps)
    return x[:width], x[width] + np.concatenate(([0.0], np.cumsum(np.exp(x[width + 1 :]))))


def severity(grade: np.ndarray, picks: list[np.ndarray], telling: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 where labels know toxic or not only: toxic documents with more than the median number of
    ``telling`` features are severe."""
    count = np.array([telling[p].sum() for p in picks])
    return np.where(grade == 0, 0, 1 + (count > np.median(count[grade > 0])))


def fit(docs: DataFrame, graded: DataFrame, text: str = "text", rows_per_grade: int = ROWS_PER_GRADE, features: int = FEATURES) -> Model:
    """A model from ``docs(doc_id, text)`` and ``graded(doc_id, grade)``, where the grade is 0, or 1 for toxic.

    The rows of a label are those with the least hash of their id; labels without a document do not count, of several
    documents with one id each is used.  Features are those whose documents differ most from the others in their
    labels, by likelihood ratio.  ``severity`` splits the toxic ones.
    """
    spark = docs.sparkSession
    totals = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    chosen = [graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_grade) for g in (0, 1)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(features_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["grade", "features"])

    # at most 2 * rows_per_grade ids
    sample = docs.select("doc_id", text_of(text).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sample = stored(sample.select("grade", "text").mapInArrow(run, "grade int, features array<string>"), "toxicity-sample")
    found = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return Model()
    counted = sample.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").cast("double").alias("n"), F.sum((F.col("grade") == 0).cast("double")).alias("clean")
    )
    share = found[0] / (found[0] + found[1])
    toxic = F.col("n") - F.col("clean")
    surprise = lambda part, usual: part * F.log(F.greatest(part, F.lit(0.1)) / (F.col("n") * usual))
    evidence = surprise(F.col("clean"), F.lit(share)) + surprise(toxic, F.lit(1 - share))
    best = counted.filter(F.col("n") >= LEAST_DOCUMENTS).withColumn("evidence", F.round(evidence, 6)).filter(F.col("evidence") >= LEAST_EVIDENCE)
    best = best.orderBy(F.desc("evidence"), "feature").limit(features).select("feature", F.col("clean") / F.col("n")).collect()
    if not best:
        return Model()
    vocabulary = {r[0]: i for i, r in enumerate(best)}
    telling = np.array([r[1] <= TELLING_CLEAN_SHARE for r in best])
    held = spark.sparkContext.broadcast(vocabulary)

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            picks = [sorted(held.value[w] for w in row if w in held.value) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picks, pa.list_(pa.int32()))], ["grade", "picks"])

    # bounded by the sample and the vocabulary; ordered, so that a model does not depend on the order of tasks
    data = sorted((r["grade"], r["picks"]) for r in sample.mapInArrow(index, "grade int, picks array<int>").collect())
    label = np.array([g for g, _ in data])
    picks = [np.asarray(p, np.int64) for _, p in data]
    rows, columns = np.repeat(np.arange(len(picks)), [len(p) for p in picks]), np.concatenate(picks)
    weight = np.array([totals[g] / found[g] for g in label])
    weights, thresholds = fit_ordinal(rows, columns, severity(label, picks, telling), weight, len(vocabulary), 3)
    return Model({w: float(weights[i]) for w, i in vocabulary.items()}, tuple(map(float, thresholds)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_severity, p_toxic, grade, toxic) per row of ``docs``.

    ``grade`` is the most probable one, ``toxic`` says that grades above 0 are the more probable.  Null and empty
    texts have no features and score the base rate; repeated rows and null keys stay; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [held.value.above(t) for t in batch.column(1).to_pylist()]
            expected = [math.fsum(a) for a in found]
            grade = [_likeliest(a) for a in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected, pa.float64()), pa.array([a[0] for a in found], pa.float64()),
                 pa.array(grade, pa.int32()), pa.array([a[0] >= 0.5 for a in found], pa.bool_())],
                ["key", "expected_severity", "p_toxic", "grade", "toxic"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    schema = f"key {kind}, expected_severity double, p_toxic double, grade int, toxic boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _likeliest(above: list[float]) -> int:
    chances = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return chances.index(max(chances))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            clean = [held.value.above(t or "")[0] < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
