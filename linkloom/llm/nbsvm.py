"""Quality classifier: n-gram indicators scaled by Naive Bayes log-count ratios, under a linear hinge-loss model fitted by dual
coordinate descent.

The ratios come from counts over every training document. The model is fitted on shards of a bounded sample of them, each by itself,
and the shards' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_contain, stage, text_or_empty
from .quality import BUCKETS, features
from .textvec import Tokenizer, Words

#: The model is fitted on about this many labelled documents at most; counts and scores cover all.
FIT_ROWS = 16384
SHARD_ROWS = 2048


def distinct_buckets(w: Words, buckets: int) -> Iterator[np.ndarray]:
    """For each document of a run, the buckets of its n-grams, once each."""
    of, bucket = features(w, buckets)
    order = np.argsort(of, kind="stable")
    bucket = bucket[order]
    ends = np.cumsum(np.bincount(of, minlength=w.hi - w.lo))
    last = np.zeros(buckets, np.int32)
    start = 0
    for end in ends:
        mine = bucket[start:end]
        place = np.arange(len(mine), dtype=np.int32)
        last[mine] = place
        yield mine[last[mine] == place]
        start = end


def fit_dual(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (and, last, the bias) of the hinge-loss model over unit-length rows of ``ratio`` at their buckets: dual coordinate descent."""
    values = []
    for at in rows:
        x = ratio[at]
        norm = np.sqrt(x @ x)
        values.append(x / norm if norm > 0 else x)
    square = np.array([x @ x + 1.0 for x in values])
    w, alpha, rng = np.zeros(len(ratio) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                w[-1] += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = 1.0, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(ratio, weights) from the documents that ``labels`` (doc_id, label 0 or 1) marks. A doc_id labelled more than once counts with
    its highest label; other labels are left out. Without documents of both labels, all weights are 0."""
    wanted = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    marked = may_contain(docs.select("doc_id", text_or_empty().alias("text")), wanted, "doc_id").join(wanted, "doc_id")
    marked = stage(marked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokenizer(), np.zeros((2, buckets + 1), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for w in tokens.chunks(batch.column(0)):
                for i, at in enumerate(distinct_buckets(w, buckets), w.lo):
                    total[label[i], at] += 1
                    total[label[i], buckets] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "n0", "n1"])

    sums = marked.select("text", "label").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    n = np.zeros((2, buckets + 1))
    n[0, sums["bucket"].to_numpy(np.int64)], n[1, sums["bucket"].to_numpy(np.int64)] = sums["n0"], sums["n1"]
    docs0, docs1 = n[:, buckets]
    if not docs0 or not docs1:
        return np.zeros(buckets), np.zeros(buckets + 1)
    n = n[:, :buckets] + alpha
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    share = min(1.0, fit_rows / (docs0 + docs1))
    shards = max(1, round(min(fit_rows, docs0 + docs1) / SHARD_ROWS))
    sent = marked.sparkSession.sparkContext.broadcast(ratio)
    sample = marked.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], kind="stable")
        found = [at.astype(np.int32) for w in Tokenizer().chunks(pa.array(rows["text"], pa.large_string())) for at in distinct_buckets(w, buckets)]
        weights = fit_dual(found, 2.0 * rows["label"].to_numpy() - 1, sent.value)
        some = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": some, "weight": weights[some]})

    fitted = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(shards))).groupBy("shard").applyInPandas(fit, "bucket long, weight double")
    mean = fitted.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    weights = np.zeros(buckets + 1)
    weights[mean["bucket"].to_numpy(np.int64)] = mean["weight"]
    return ratio, weights


def classify(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, slope: float = 2.0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and label.

    The score is the logistic of ``slope`` times the margin, and depends on the text alone. A null or empty text has no n-grams and gets
    the model's bias. A long text counts whole. With an empty label table every score is 0.5. Repeated rows are scored one by one.
    """
    ratio, weights = train(docs, labels, buckets, fit_rows=fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast((ratio, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer()
        ratio, weights = sent.value
        pull, square, bias = weights[:-1] * ratio, ratio * ratio, weights[-1]
        for batch in batches:
            score = []
            for w in tokens.chunks(batch.column(1)):
                for at in distinct_buckets(w, buckets):
                    norm = np.sqrt(square[at].sum())
                    score.append(bias + (pull[at].sum() / norm if norm > 0 else 0.0))
            score = 1 / (1 + np.exp(-np.clip(slope * np.array(score, float), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
