"""Toxicity grades by cumulative-link (proportional odds) ordinal regression on sparse words.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, thresholds in rising order. x holds
the presence of words. The score is the expected grade, the sum of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(doc: np.ndarray, word: np.ndarray, grade: np.ndarray, n_words: int, l2: float = 1e-5, steps: int = 600):
    """Weights and thresholds from presence pairs (doc, word), by Adam on the mean log-likelihood."""
    top = int(grade.max())
    w, first, gaps = np.zeros(n_words), 1.0, np.zeros(max(top - 1, 0))
    params = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(grade)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, first, gaps = params[:n_words], params[n_words], params[n_words + 1 :]
        theta = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, w[word], n)
        cdf = sigmoid(theta[None, :] - score[:, None])
        low = np.where(grade > 0, np.take_along_axis(cdf, np.maximum(grade - 1, 0)[:, None], 1)[:, 0], 0.0)
        high = np.where(grade < top, np.take_along_axis(cdf, np.minimum(grade, top - 1)[:, None], 1)[:, 0], 1.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p / n, low * (1 - low) / p / n
        d_theta = np.bincount(np.maximum(grade - 1, 0), d_low * (grade > 0), top)
        d_theta -= np.bincount(np.minimum(grade, top - 1), d_high * (grade < top), top)
        d_score = d_high - d_low
        gradient = np.concatenate(
            (
                np.bincount(word, d_score[doc], n_words) + l2 * w,
                [d_theta.sum()],
                [d_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))],
            )
        )
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_words], params[n_words] + np.concatenate(([0], np.cumsum(np.exp(params[n_words + 1 :]))))


def _presence(chosen) -> Callable:
    """Rows of (id, label, hashes of distinct words); only those of ``chosen``, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.parts(batch, "text"):
                words = K.Words(texts, K.ALNUM, True)
                hashes, doc = words.hashes(), words.doc
                if chosen is not None:
                    keep = _find(chosen.value, hashes)[1]
                    hashes, doc = hashes[keep], doc[keep]
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                of = np.searchsorted(doc[new], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(of), pa.array(hashes[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "words"])

    return run


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = 20_000,
    most_words: int = 4_096,
    severe_words: int = 3,
    least_chi: float = 15.0,
) -> Model:
    """Fit on at most about ``most_rows`` labelled documents, chosen by a hash of their id.

    The label says whether a text is flagged. Flagged texts are graded 1, or 2 where they hold at
    least ``severe_words`` of the words that flagged texts have and others (nearly) never do; unflagged
    texts are grade 0. The ``most_words`` words that tell flagged texts best (chi-squared of ``least_chi`` or
    more, in 5 texts at least) are the features. Null labels, ids and texts are left out; without both flagged and
    unflagged texts, the model grades everything by the share of flagged ones. An id's repeated labels count by the largest, its
    repeated texts by the first in order. Other columns of either table are not looked at.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = F.lit(int(min(1.0, most_rows / max(n, 1)) * 1_000_000))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share)  # at most about most_rows small rows
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).dropna()
    texts = texts.join(F.broadcast(known), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    schema = "label int, words array<long>"
    counted = texts.mapInArrow(_presence(None), schema)
    flagged = (F.col("label") > 0).cast("long")
    totals = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(flagged), F.lit(0)).alias("k")).first()
    if not 0 < totals.k < totals.n:
        odds = (totals.k + 0.5) / (totals.n + 1)
        none = np.zeros(0, np.uint64)
        return Model(none, np.zeros(0), np.array([-np.log(odds / (1 - odds)), 50.0]))
    per_word = counted.select("label", F.explode("words").alias("word")).groupBy("word")
    per_word = per_word.agg(F.count("*").alias("n"), F.sum(flagged).alias("k")).filter("n >= 5")
    share_k = totals.k / totals.n
    expected = F.col("n") * share_k
    chi = (F.col("k") - expected) ** 2 / (expected * (1 - share_k))
    chosen = per_word.filter(chi >= least_chi).orderBy(chi.desc(), "word").limit(most_words).collect()
    table = np.array([r.word for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(table)
    table = table[order]
    telling = np.array([r.k >= 0.9 * r.n and r.n * (1 - share_k) >= 4 for r in chosen], bool)[order]
    rows = texts.mapInArrow(_presence(spark.sparkContext.broadcast(table)), schema).collect()
    grade = np.array([min(r.label, 1) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r.words) for r in rows])
    word = np.searchsorted(table, np.concatenate([np.zeros(0, np.int64), *[np.array(r.words, np.int64) for r in rows]]).view(np.uint64))
    severe = np.bincount(doc, telling[word], len(rows)) >= severe_words
    grade = np.where(grade > 0, 1 + severe, 0)
    if grade.max() < 2:
        weights, thresholds = fit(doc, word, grade, len(table))
        return Model(table, weights, np.append(thresholds, thresholds[-1] + 50))
    return Model(table, *fit(doc, word, grade, len(table)))


def grade(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc`` (a struct of all columns), ``severity`` (expected grade, from 0 to 2), ``p_toxic`` and ``toxic``.

    Only the texts go to Python, and three numbers come back; no shuffle; the model is a bounded table. Null and wordless texts get
    what the thresholds alone say. Repeated rows are graded alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            above = [np.zeros((0, len(model.thresholds)))]
            for at, to in K.slices(batch):
                words = K.Words(K.Texts(batch.slice(at, to - at)), K.ALNUM, True)
                place, found = _find(model.words, words.hashes())
                pairs = np.unique(np.stack([words.doc[found], place[found]]), axis=1)
                above.append(model.above(np.bincount(pairs[0], model.weights[pairs[1]] if len(model.weights) else None, to - at)))
            above = np.concatenate(above)
            yield pa.StructArray.from_arrays(
                [pa.array(np.round(above.sum(axis=1), 6)), pa.array(np.round(above[:, 0], 6)), pa.array(above[:, 0] >= threshold)],
                names=["severity", "p_toxic", "toxic"],
            )

    # declared nondeterministic so that it isn't run once more for a filter on its result
    graded = F.arrow_udf(run, "severity double, p_toxic double, toxic boolean").asNondeterministic()
    return docs.select(F.struct("*").alias("doc"), graded(F.col(text)).alias("_grade")).select("doc", "_grade.*")
