"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of punctuation.  Features: one and two tokens (lower case) and one to
three token shapes (upper, capitalised, lower, digits, or the punctuation itself) and a token followed by itself, hashed to 2**BITS places; value
log(1 + count), scaled to length 1.  The training rows are dealt to SHARDS groups, each runs FTRL-proximal over
its rows, and the weights are averaged by the rows seen.  `train_rows` bounds the labelled rows used (about so many, chosen
by a hash of doc_id); SHARDS bounds what one group holds.  A score is the logistic function of a sparse dot product.

Null and empty texts score by the bias alone.  Rows of labels with a null quality are not used; of several labels of one
doc_id the larger counts.  Without labelled rows every score is 0.5.  Of several texts
of one labelled doc_id the smallest is learned from.  Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CACHE_WORDS, ODD, mixed, sample_rows, table

BITS = 18
SHARDS = 8
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape_of(token: str) -> str:
    if token[0].isalnum() or token[0] == "_":
        return "9" if token.isdigit() else "A" if token.isupper() and len(token) > 1 else "C" if token[:1].isupper() else "a"
    return token[:3]


class TokenHashes(dict):
    def __missing__(self, token: str) -> tuple[int, int]:
        value = xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(shape_of(token), 7)
        if len(self) < CACHE_WORDS:
            self[token] = value
        return value


def features(text: str | None, cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.array([cache[t] for t in tokens], np.uint64)
    w, s = both[:, 0], both[:, 1]
    grams = [w, mixed(w[:-1] * ODD[0] + w[1:] * ODD[1]), s, mixed(s[:-1] * ODD[2] + s[1:] * ODD[3]), mixed(s[:-2] * ODD[4] + s[1:-1] * ODD[5] + s[2:] * ODD[6])]
    grams.append(np.full(int((w[1:] == w[:-1]).sum()), ODD[7]))  # a token and itself again
    at, count = np.unique(np.concatenate(grams) >> np.uint64(64 - BITS), return_counts=True)
    value = np.log1p(count)
    return at.astype(np.int64), value / np.sqrt((value * value).sum())


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; place 2**BITS is the bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, 2**BITS), np.append(value, 1.0)
        w = self.weights(at)
        g = (logistic(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 12_000, epochs: int = 4) -> np.ndarray:
    """Weights from labelled rows outside the held-out third."""
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = sample_rows(named, "doc_id", train_rows)
    # One text for each labelled doc_id, so that the groups are as bounded as the labelled rows are.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SHARDS)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        cache, model = TokenHashes(), Ftrl()
        own = own.sort_values("doc_id")
        cases = [(*features(t, cache), int(y)) for t, y in zip(own["text"], own["y"], strict=True)]
        for e in range(epochs):
            for k in np.random.default_rng(e).permutation(len(cases)):
                model.update(*cases[k])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at] * len(own), 0.0), "rows": np.append(np.zeros(len(at), np.int64), len(own))})

    parts = rows.groupBy("shard").applyInPandas(run, "at long, w double, rows long").groupBy("at").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows")).toPandas()
    out = np.zeros(2**BITS + 1, np.float32)
    if seen := int(parts["rows"].sum()):
        parts = parts[parts["at"] >= 0]
        out[parts["at"].to_numpy(int)] = parts["w"].to_numpy() / seen
    return out


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache, w = TokenHashes(), weights.astype(np.float64)
        for b in batches:
            yield pd.Series([logistic(w[at] @ value + w[-1]) for at, value in (features(t, cache) for t in b)])

    out = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
