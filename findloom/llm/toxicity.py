"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are the distinct words in it (letters only, lower case), hashed to a fixed number
of slots. One weight vector is shared by all ordered thresholds: P(grade <= k) is the logistic
function of threshold k minus the score. An L1 penalty chooses the few words
that matter, so long clean texts don't gather a score. The model is fitted in numpy on a bounded sample of the labelled
rows; scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.arrays import UNLETTERED, Words, as_bytes, lowered, slices
from findloom.llm.scratch import bounded_batches

SLOTS = 1 << 20
#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
MAX_SHARE = 0.25
#: The L1 penalty in rows: a word whose excess of severe rows is below it keeps weight zero.
L1_ROWS, L2_ROWS, EPOCHS, STEP = 3.0, 0.02, (120, 400), 0.05
#: Features that a step of the fit works on at a time, which bounds what it holds besides them.
PART = 1 << 19
#: Distinct words of one labelled row that the fit takes at most, the first by their hash, and texts of
#: one labelled id: bounds on the sample, next to ``TRAIN_ROWS``. Scoring has no such bounds.
TRAIN_WORDS, TRAIN_TEXTS = 4096, 8


def _slots(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs."""
    words = Words(lowered(texts), UNLETTERED)
    key = np.unique(words.doc * SLOTS + (words.hashes() >> np.uint64(40)).astype(np.int64) % SLOTS)
    return key // SLOTS, key % SLOTS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _descend(doc: np.ndarray, at: np.ndarray, m: int, grade: np.ndarray, levels: int, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal Adam on the mean log-likelihood of grades; weights and thresholds."""
    n = len(grade)
    w, mean, var = np.zeros(m), np.zeros(m), np.zeros(m)
    above = np.array([(grade > k).mean() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(above / (1 - above))
    t_mean, t_var, rows = np.zeros(levels - 1), np.zeros(levels - 1), np.arange(n)
    for t in range(1, epochs + 1):
        score = np.zeros(n)
        for lo in range(0, len(at), PART):
            score += np.bincount(doc[lo : lo + PART], w[at[lo : lo + PART]], n)
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50))), np.ones((n, 1))], 1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-9)
        up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        g_theta = np.array([(-(up * (grade == k)).sum() + (low * (grade == k + 1)).sum()) / n for k in range(levels - 1)])
        g, push = l2 * w + l1, (up - low) / n
        for lo in range(0, len(at), PART):
            g += np.bincount(at[lo : lo + PART], push[doc[lo : lo + PART]], m)
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        t_mean, t_var = 0.9 * t_mean + 0.1 * g_theta, 0.99 * t_var + 0.01 * g_theta * g_theta
        unbias, scale = 1 - 0.9**t, 1 - 0.99**t
        w = np.maximum(w - STEP * (mean / unbias) / (np.sqrt(var / scale) + 1e-7), 0)
        theta = np.maximum.accumulate(theta - STEP * (t_mean / unbias) / (np.sqrt(t_var / scale) + 1e-7) + 1e-6 * np.arange(levels - 1))
    return w, theta


def _usable(share: np.ndarray, rows: int) -> np.ndarray:
    return (share >= 3) & (share <= MAX_SHARE * rows)


def fit(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, l1_rows: float = L1_ROWS, l2_rows: float = L2_ROWS, epochs: tuple[int, int] = EPOCHS) -> Model:
    """Choose slots with the L1 penalty, then fit those again with a slight L2 penalty alone.

    Slots in fewer than 3 or too many rows are left out. Weights are not negative: words are evidence
    of severity, and a long text can't outweigh it by its clean words. With fewer than two grades in
    the sample nothing is toxic.
    """
    n, levels = len(grade), int(grade.max()) + 1 if len(grade) else 1
    if levels < 2 or len(np.unique(grade)) < 2:
        return Model(np.zeros(SLOTS, np.float32), np.full(max(levels - 1, 1), 50.0))
    share = np.bincount(slot, minlength=SLOTS)
    use = _usable(share, n)
    for l1, ridge, rounds in ((l1_rows / n, 0.0, epochs[0]), (0.0, l2_rows / n, epochs[1])):
        col, keep = (np.cumsum(use) - 1).astype(np.int32), use[slot]
        w, theta = _descend(doc[keep], col[slot[keep]], int(use.sum()), grade, levels, l1, ridge, rounds)
        weights = np.zeros(SLOTS, np.float32)
        weights[np.flatnonzero(use)] = w
        use = weights > 0
    return Model(weights, theta)


def train(docs: DataFrame, grades: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` rows of ``grades(doc_id, grade)``; null ids and grades take no part.

    Texts that share a labelled doc_id are one row with the words of all of them.
    """
    bounded_batches(docs.sparkSession)
    chosen = grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in slices(texts):
                doc, slot = _slots(texts[lo:hi])
                parts = np.split(slot.astype("<i4"), np.searchsorted(doc, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("grade").slice(lo, hi - lo), pa.array([x[:TRAIN_WORDS].tobytes() for x in parts], pa.binary())], names=["doc_id", "grade", "slots"])

    slots = F.sort_array(F.collect_set("slots"))
    got = sample.mapInArrow(run, "doc_id long, grade int, slots binary").groupBy("doc_id", "grade").agg(F.slice(slots, 1, TRAIN_TEXTS).alias("slots")).toArrow().sort_by("doc_id")
    grade = got.column("grade").to_numpy().astype(np.int64)
    parts = [np.unique(np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in each]))[:TRAIN_WORDS] for each in got.column("slots")]
    del got
    share = np.zeros(SLOTS, np.int32)
    for x in parts:  # slots are distinct within a text
        share[x] += 1
    use = _usable(share, len(grade))
    for i, x in enumerate(parts):  # what fit() leaves out isn't gathered
        parts[i] = x[use[x]]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    return fit(doc, np.concatenate(parts or [np.zeros(0, np.int32)]), grade)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, p_toxic (of the top grade) and toxic (p_toxic > 0.5) of each row.

    Null and empty texts have no features and get the base rate. Repeated rows get equal answers; an
    empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    nonzero = model.weights != 0

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in slices(texts):
                doc, slot = _slots(texts[lo:hi])
                has = nonzero[slot]
                p = model.at_least(np.bincount(doc[has], model.weights[slot[has]].astype(float), hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] > 0.5)], names=["doc_id", "expected_severity", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, with all their columns, that the model does not call toxic.

    The text is scored in the same pass that reads the row, so nothing is shuffled or joined.
    """
    nonzero = model.weights != 0

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            keep = []
            for lo, hi in slices(texts):
                doc, slot = _slots(texts[lo:hi])
                has = nonzero[slot]
                keep.append(model.at_least(np.bincount(doc[has], model.weights[slot[has]].astype(float), hi - lo))[:, -1] <= 0.5)
            yield batch.filter(pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ordered grades of labelled rows: 0 fit for use, 1 of low quality, 2 toxic.

    Toxic texts are the top grade: more toxic words never make a worse fit, as they would if a grade
    above it had to be told from it. Rows whose toxic label is null take no part.
    """
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return labels.filter("toxic IS NOT NULL").select("doc_id", grade.alias("grade"))
