"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, aggregated by extreme-value calibration.

1. Log-odds.  Tokens are runs of word characters.  A token's nodes are its lower-case prefixes of `SHORTEST` to `LONGEST`
   letters and the whole token.  Of the labelled documents a node stands in, a are toxic and b are not; its toxic share is
   (a + PRIOR * s) / (a + b + PRIOR), a Dirichlet posterior whose prior mean s is the share of the next shorter prefix (above
   all: of all documents).  A token scores the log-odds of its longest known node against those of all documents, less `DRIFT`; whatever is not
   above 0, and a token that the document has had before, scores -DRIFT.
2. Segments.  One pass with a stack finds all maximal scoring segments (Ruzzo and Tompa); only tokens above 0 are visited.
3. Calibration.  The best segments of n random tokens are extreme-value distributed: E = n * exp(-rate * (S - place)) of them
   reach S.  rate solves mean(exp(rate * score)) = 1 over the tokens of the documents that are not toxic, place is fitted on
   their best segments.  A segment is a passage when E < 1; a document's evidence is the sum of -ln E over its
   passages, and its score a logistic function of ln(1 + evidence).  Both fits take each labelled document out of the counts first.

Learning reads about `train_rows` labelled documents, chosen by a hash of doc_id, outside the held-out fifth; so the model is bounded at any
input.  Everything else reads all documents whole, row by row, without a shuffle.

Null and empty texts have no evidence and the lowest score.  Labels that are null are not used; of several labels of one doc_id the larger
counts, of several texts the smallest.  Without labelled documents nothing is found and every score is 0.  Repeated rows score alike; a
null doc_id is never held out.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CACHE_WORDS, discard, sample_rows, stored, table

TOKEN = re.compile(r"\w+")
SHORTEST, LONGEST = 2, 8
PRIOR, DRIFT = 8.0, 1.5
#: A node counts when so many labelled documents hold it.
LEAST_DOCS = 2
EULER = 0.5772156649


def nodes(token: str) -> list[str]:
    """From the shortest prefix to the whole token, which ends in a space."""
    w = token.lower()
    return [*(w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)), w + " "]


@dataclass
class Model:
    counts: dict[str, tuple[int, int]]
    toxic: int = 0
    other: int = 0
    rate: float = 1.0
    place: float = 0.0
    bias: float = 0.0
    slope: float = 0.0

    @property
    def share(self) -> float:
        return (self.toxic + 0.5) / (self.toxic + self.other + 1)


def odds(p: float) -> float:
    return math.log(p / (1 - p))


class Scores(dict):
    """token -> its score, cached; own is the label of a learned document, whose own count is taken out."""

    def __init__(self, model: Model, own: int | None = None):
        self.model, self.own = model, own
        a, b = model.toxic - (own == 1), model.other - (own == 0)
        self.share = (a + 0.5) / (a + b + 1)

    def __missing__(self, token: str) -> float:
        s = self.share
        for x in nodes(token):
            a, b = self.model.counts.get(x, (0, 0))
            a, b = a - (self.own == 1), b - (self.own == 0)
            if a < 0 or b < 0 or a + b < LEAST_DOCS:
                break
            s = (a + PRIOR * s) / (a + b + PRIOR)
        value = odds(s) - odds(self.share) - DRIFT
        value = value if value > 0 else -DRIFT
        if len(self) < CACHE_WORDS:
            self[token] = value
        return value


def token_scores(tokens: list[str], scores: Scores) -> np.ndarray:
    """Each token's score, the first time it stands there; -DRIFT else."""
    out = np.fromiter(map(scores.__getitem__, tokens), float, len(tokens))
    seen = set()
    for k in np.flatnonzero(out > 0).tolist():
        w = tokens[k].lower()
        if w in seen:
            out[k] = -DRIFT
        seen.add(w)
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) of scores that are above 0 or -DRIFT, in order."""
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum with, first, end, place of the nearest with a smaller sum before
    at, value = np.flatnonzero(scores > 0), scores[scores > 0]
    total = np.cumsum(value)
    for n, (k, v) in enumerate(zip(at.tolist(), total.tolist(), strict=True)):
        right = v - DRIFT * (k - n)
        left, first = right - float(value[n]), k
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, k + 1, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(first, end, right - left) for left, right, first, end, _ in stack]


def surprise(score: float, n: int, model: Model) -> float:
    """-ln E: of n tokens, E segments are expected to score so high by chance."""
    return model.rate * (score - model.place) - math.log(n)


def evidence(scores: list[float], n: int, model: Model) -> tuple[float, int]:
    """(the sum of -ln E, the number of passages)."""
    found = [x for s in scores if (x := surprise(s, n, model)) > 0]
    return sum(found), len(found)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _learned(docs: DataFrame, labels: DataFrame, label: str, train_rows: int) -> DataFrame:
    """(text, y) of about so many labelled documents."""
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = sample_rows(named, "doc_id", train_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, other = Counter(), Counter()
    for b in batches:
        for text, y in zip(b["text"], b["y"], strict=True):
            (toxic if y else other).update({"", *(x for w in set(TOKEN.findall(text or "")) for x in nodes(w))})
    names = list(toxic | other)
    if names:
        yield pd.DataFrame({"node": names, "a": [toxic[x] for x in names], "b": [other[x] for x in names]})


def _above(x: str) -> str:
    """The node that a node's prior comes from; "" above the shortest."""
    short = x[:-1][: min(LONGEST, len(x) - 2)] if x[-1] == " " else x[:-1]
    return short if len(short) >= SHORTEST else ""


def _pruned(counts: dict[str, tuple[int, int]], model: Model) -> dict[str, tuple[int, int]]:
    """The nodes that decide whether a token scores above 0: those with a share as large (a document's own count aside), what leads to them and what is below."""
    share, kept = {"": model.share}, set()
    least = odds(model.share) + DRIFT
    for x in sorted(counts, key=len):  # a prefix comes before what it begins
        a, b = counts[x]
        up = _above(x)
        if up not in share:
            continue
        share[x] = (a + PRIOR * share[up]) / (a + b + PRIOR)
        if up in kept:
            kept.add(x)
        elif odds((a + PRIOR * share[up]) / (a + max(0, b - 1) + PRIOR)) > least - 0.3:
            while x and x not in kept:
                kept.add(x)
                x = _above(x)
    return {x: counts[x] for x in kept}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = 12_000) -> Model:
    rows = stored(_learned(docs, labels, label, train_rows), "toxic-rows")
    table_ = rows.mapInPandas(_counted, "node string, a long, b long").groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(f"a + b >= {LEAST_DOCS}").toPandas()
    counts = {x: (int(a), int(b)) for x, a, b in zip(table_["node"], table_["a"], table_["b"], strict=True)}
    model = Model({}, *counts.pop("", (0, 0)))
    model.counts = _pruned(counts, model)
    if not model.toxic or not model.other:
        discard(rows)
        return Model({})

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = Scores(model, 0), Scores(model, 1)
        for b in batches:
            out = []
            for text, y in zip(b["text"], b["y"], strict=True):
                s = token_scores(TOKEN.findall(text or ""), each[int(y)])
                out.append((int(y), len(s), [x for _, _, x in segments(s)], s[s > 0].tolist()))
            yield pd.DataFrame(out, columns=["y", "n", "segments", "above"])

    seen = rows.mapInPandas(found, "y int, n long, segments array<double>, above array<double>").toPandas()
    discard(rows)
    clean = seen[(seen["y"] == 0) & (seen["n"] > 0)]
    above = np.concatenate([np.zeros(0), *clean["above"]])
    model.rate = _rate(above, int(clean["n"].sum()))
    best = [max(s) - math.log(n) / model.rate for s, n in zip(clean["segments"], clean["n"], strict=True) if len(s)]
    model.place = float(np.mean(best)) - EULER / model.rate if best else 0.0
    x = np.log1p([evidence(s, n, model)[0] if n else 0.0 for s, n in zip(seen["segments"], seen["n"], strict=True)])
    model.bias, model.slope = _logistic_fit(x, seen["y"].to_numpy(float))
    return model


def _rate(above: np.ndarray, n: int) -> float:
    """The positive solution of mean(exp(rate * score)) = 1 over n tokens, those not listed scoring -DRIFT."""
    low, high = 1e-3, 8.0
    for _ in range(60):
        rate = (low + high) / 2
        low, high = (low, rate) if np.exp(rate * above).sum() + (n - len(above)) * math.exp(-rate * DRIFT) > n else (rate, high)
    return low


def _logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(bias, slope) by Newton's steps; the slope never falls below 0."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, n_passages and evidence."""

    @F.pandas_udf("score double, n_passages long, evidence double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = Scores(model)
        for b in batches:
            out = []
            for text in b:
                s = token_scores(TOKEN.findall(text or ""), scores)
                x, n = evidence([v for _, _, v in segments(s)], len(s), model) if len(s) else (0.0, 0)
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * math.log1p(x))))) if model.toxic else 0.0, n, x))
            yield pd.DataFrame(out, columns=["score", "n_passages", "evidence"])

    out = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("text").alias("r"))
    return out.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_passages", "r.evidence")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Per passage of a row of docs: doc_id, start and end (code points of the text), score and surprise (-ln E)."""

    @F.pandas_udf("array<struct<start: long, end: long, score: double, surprise: double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = Scores(model)
        for b in batches:
            out = []
            for text in b:
                at = list(TOKEN.finditer(text or ""))
                own = segments(token_scores([m[0] for m in at], scores)) if at else []
                out.append([(at[i].start(), at[j - 1].end(), s, x) for i, j, s in own if (x := surprise(s, len(at), model)) > 0])
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", F.explode(find("text")).alias("p")).select("doc_id", "p.*")


def op12_toxic_passages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
