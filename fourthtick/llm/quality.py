"""Quality scores by logistic regression on hashed word n-grams, fitted with FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourthtick.llm.common import crc_bucket

BITS = 18
THRESHOLD = 0.3
#: Bounds of the fit: labelled rows read, the tasks among which they are dealt, passes over them.
#: One leader sees all rows: the mean of several that see a part each has smaller margins, and
#: where labels are few its scores bunch around the share of good ones.
SAMPLE_ROWS = 20_000
SHARDS = 1
EPOCHS = 10

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO = 200_000
_ROWS = -1
_REPEATED = np.uint64(zlib.crc32(b"repeated word") << 16)


@cache
def _memo() -> dict[str, tuple[int, int]]:
    return {}


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: hashed words and word pairs, log counts, unit length.

    Words keep their case, and runs of signs are words. Pairs that repeat a word,
    in whatever case, share one place. The last place is the constant 1, all that
    an empty text has.
    """
    bias = 1 << bits
    memo = _memo()
    hashes = []
    for token in _TOKEN.findall(text or ""):
        if (h := memo.get(token)) is None:
            if len(memo) >= _MEMO:
                memo.clear()
            h = memo[token] = (
                zlib.crc32(token.encode()),
                zlib.crc32(token.lower().encode()),
            )
        hashes.append(h)
    if not hashes:
        return np.array([bias]), np.array([1.0])
    words, folded = np.array(hashes, dtype=np.uint64).T
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:]) * np.uint64(0x85EBCA6B)
    pairs[folded[:-1] == folded[1:]] = _REPEATED
    places = np.concatenate([words * np.uint64(0xC2B2AE35), pairs])
    places = (places >> np.uint64(8)) & np.uint64((1 << bits) - 1)
    index, counts = np.unique(places.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values**2).sum())
    return np.append(index, bias), np.append(values, 1.0)


def follow_the_leader(
    examples: list[tuple[np.ndarray, np.ndarray, float]],
    bits: int = BITS,
    epochs: int = EPOCHS,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.0,
) -> np.ndarray:
    """Weights after FTRL-proximal updates, one example at a time in the given order.

    For every feature z sums the gradients, corrected for the weights at which they
    were taken, and n their squares; the weight is the minimiser of both with l1
    and l2, so a feature with little evidence stays exactly 0.
    """
    z = np.zeros((1 << bits) + 1)
    n = np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        over = np.maximum(np.abs(z[at]) - l1, 0) * -np.sign(z[at])
        return over / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for index, values, label in examples:
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            grown = n[index] + g * g
            z[index] += g - (np.sqrt(grown) - np.sqrt(n[index])) / alpha * w
            n[index] = grown
    return weights(slice(None))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    shards: int = SHARDS,
    bits: int = BITS,
) -> np.ndarray:
    """Weights of the places 0 to 2**bits (the last is the constant).

    At most ``sample_rows`` labelled rows are read (the smallest hashes of the id),
    which is also what bounds the broadcast of their ids. ``shards`` tasks each
    follow the regularised leader over their rows; the mean of their weights, by rows,
    is the model. No labelled row: all weights 0, every score 0.5.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id", "label"), "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label", "text"], na_position="first")
        order = np.random.default_rng(len(group)).permutation(len(group))
        texts, label = group["text"].to_list(), group["label"].to_list()
        examples = [(*features(texts[i], bits), label[i]) for i in order]
        w = follow_the_leader(examples, bits)
        # The number of rows goes along under a place of its own.
        place = np.append(np.flatnonzero(w), _ROWS)
        return pd.DataFrame(
            {"place": place, "weight": np.append(w[place[:-1]] * len(group), len(group))}
        )

    fitted = rows.groupBy("_shard").applyInPandas(fit, "place long, weight double")
    # Dense in the worst case: 2**bits + 1 numbers.
    total = fitted.groupBy("place").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros((1 << bits) + 1)
    place, weight = total["place"].to_numpy(np.int64), total["weight"].to_numpy()
    weights[place[place >= 0]] = weight[place >= 0] / weight[place == _ROWS].sum() if len(place) else 0
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list[str], bits: int = BITS) -> DataFrame:
    """``keep`` columns with the score of every whole text, a sparse dot product."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = sent.value
        margins = np.empty(len(texts))
        for i, text in enumerate(texts):
            index, values = features(text, bits)
            margins[i] = w[index] @ values
        return pd.Series(1 / (1 + np.exp(-np.clip(margins, -35, 35))))

    return docs.select(*keep, score("text").alias("score"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels of held-out documents (crc32 of the id modulo 5 is 0) are never read.
    Null and empty texts get the score of the constant alone. Repeated documents
    are each scored; repeated labels count once; contradicting ones both count.
    """
    docs = docs.select("doc_id", "text")
    held_out = crc_bucket() == 0
    weights = fit_quality(docs, labels.select("doc_id", "quality").where(~held_out))
    scored = score_quality(
        docs.withColumn("held_out", held_out), weights, ["doc_id", "held_out"]
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
