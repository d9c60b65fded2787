"""Quality classifier: evidence from a document's words, and hierarchical empirical Bayes over where it comes from.

Two logistic models (good quality, toxic) over hashed words and word shapes are fitted on a bounded sample of labelled
documents. Then grouped sums over all documents give each host (source) a posterior that shrinks to the corpus, and
each path in it (source and language) one that shrinks to its host; how hard follows from the spread between groups.
A document's probability adds the log-odds of its path's posterior, against those of the corpus, to its evidence.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import stored

#: Labelled documents that the classifier is fitted on at most, those of the least hash of their id.
SAMPLE = 20_000
FEATURES = 1 << 16
#: Documents of the sample that must hold a feature.
LEAST = 3
#: Standard errors by which a feature's share among the documents of a kind must differ from chance; 65,536 features
#: that mean nothing pass this less than once in two.
DISTINCT = 4.5
STEPS = 80
RIDGE = 1e-3
#: Weight of the place's log-odds, and the least and most pseudo-documents that a group is shrunk by.
PLACE = 0.5
PRIOR = (1.0, 1e6)

_SHAPE = bytes(ord("A") if 65 <= c < 91 else ord("a") if 97 <= c < 123 or c > 127 else ord("0") if 48 <= c < 58 else c for c in range(256))
_REPEAT = re.compile(rb"(.)\1+", re.S)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features: lower-case words without stops around them, and shapes of words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    crc = zlib.crc32
    found = {crc(w.lower().strip(b".,;:!?'\"()")) % FEATURES for w in ws}
    found |= {crc(b"\0" + _REPEAT.sub(rb"\1\1", w.translate(_SHAPE))) % FEATURES for w in set(ws)}
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class Classifier:
    weights: np.ndarray  # (2, FEATURES): good quality, toxic
    bias: np.ndarray

    def evidence(self, text: str | None) -> np.ndarray:
        return self.bias + self.weights[:, features(text)].sum(1)


def fitted(rows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Classifier:
    """Logistic regression under a ridge by Adam with full gradients; features that are rare or no evidence keep weight 0."""
    if not rows:
        return Classifier(np.zeros((2, FEATURES)), np.zeros(2))
    n, index = len(rows), np.concatenate(rows)
    df = np.bincount(index, minlength=FEATURES)
    every_owner = np.repeat(np.arange(n), [len(r) for r in rows])
    every = index
    weights, bias = np.zeros((2, FEATURES)), np.zeros(2)
    for k in range(2):
        y = labels[:, k].astype(float)
        rate = y.mean()
        error = np.sqrt(np.maximum(df * rate * (1 - rate) * (1 - df / n), 1e-9))
        held = (df >= LEAST) & (np.abs(np.bincount(every, y[every_owner], FEATURES) - df * rate) > DISTINCT * error)
        index, owner = every[held[every]], every_owner[held[every]]
        w, b = np.zeros(FEATURES), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
        for step in range(1, steps + 1):
            miss = 1 / (1 + np.exp(-(b + np.bincount(owner, w[index], n)))) - y
            g = np.append(np.bincount(index, miss[owner], FEATURES) / n + RIDGE * w, miss.mean())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1] * held, b - move[-1]
        weights[k], bias[k] = w, b
    return Classifier(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from the whole texts of at most ``sample`` labelled documents, FEATURES numbers each at most. Rows of labels with a null have no say."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            rows = [features(x.as_py()) for x in b.column(0)]
            ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int32))), b.column(1), b.column(2)], ["f", "quality", "toxic"])

    # The labelled side has ``sample`` rows at most, so it goes to the texts and no text is moved.
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality", "toxic").mapInArrow(run, "f array<int>, quality int, toxic int").toArrow()
    rows = [x.values.to_numpy().astype(np.int64) for x in found.column("f")]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # sums don't depend on the order rows came in
    y = np.stack([found.column("quality").to_numpy(), found.column("toxic").to_numpy()], 1) if rows else np.empty((0, 2))
    return fitted([rows[i] for i in order], y[order] if rows else y)


def _shrinkage(groups: DataFrame, mean: float, by: str, n: str) -> float:
    """Pseudo-documents towards which means of groups shrink: what a beta prior with their spread would hold."""
    within = max(mean * (1 - mean), 1e-9)
    spread = groups.agg(F.sum(F.col(n) * (F.col(by) - mean) ** 2) / F.sum(n), F.count("*") / F.sum(n)).first()
    between = (spread[0] or 0.0) - within * (spread[1] or 0.0)
    return float(np.clip(within / between - 1, *PRIOR)) if between > 0 else PRIOR[1]


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def reports(docs: DataFrame, labels: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Of every document its evidence, host and path posteriors, probabilities of both kinds, and whether it is kept.

    Null text counts as empty: only its place and the base rate speak. Null source or lang is a place like any other.
    Repeated rows count and return as often as they came; an empty table gives none; without labels the evidence is 0.
    A document is kept if it is rather good than not and rather not toxic. docs may have further columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier or fit(docs, labels))  # 2 * FEATURES weights
    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def run(batches):
        own = shared.value
        for b in batches:
            e = np.array([own.evidence(x.as_py()) for x in b.column(3)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(e[:, 0]), pa.array(e[:, 1])], ["doc_id", "host", "path", "eq", "et"])

    host = F.coalesce(F.concat(F.lit("h"), "source"), F.lit("n"))
    path = F.coalesce(F.concat(F.lit("p"), "lang"), F.lit("n"))
    scored = docs.select("doc_id", host.alias("host"), path.alias("path"), "text").mapInArrow(run, f"doc_id {kind}, host string, path string, eq double, et double")
    sigmoid = lambda c: 1 / (1 + F.exp(-F.col(c)))
    scored = stored(scored.withColumn("q", sigmoid("eq")).withColumn("t", sigmoid("et")))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("sq"), F.sum("t").alias("st")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("sq").alias("hq"), F.sum("st").alias("ht"))
    n, sq, st = paths.agg(F.sum("n"), F.sum("sq"), F.sum("st")).first()
    means = {"q": (sq or 0.0) / (n or 1), "t": (st or 0.0) / (n or 1)}
    by_host = hosts
    for c, mean in means.items():
        k = _shrinkage(hosts.withColumn("m", F.col(f"h{c}") / F.col("hn")), mean, "m", "hn")
        by_host = by_host.withColumn(f"host_{c}", (F.col(f"h{c}") + k * mean) / (F.col("hn") + k))
    places = paths.join(by_host, "host")
    for c, mean in means.items():
        k = _shrinkage(places.withColumn("m", mean + F.col(f"s{c}") / F.col("n") - F.col(f"host_{c}")), mean, "m", "n")
        places = places.withColumn(f"path_{c}", (F.col(f"s{c}") + k * F.col(f"host_{c}")) / (F.col("n") + k))
    out = scored.join(places.select("host", "path", "host_q", "host_t", "path_q", "path_t"), ["host", "path"])
    for c, mean in means.items():
        odds = F.col(f"e{c}") + PLACE * (_log_odds(F.col(f"path_{c}")) - _log_odds(F.lit(float(mean))))
        out = out.withColumn(f"p_{c}", 1 / (1 + F.exp(-odds)))
    return out.select(
        "doc_id", F.col("eq").alias("quality_evidence"), F.col("et").alias("toxic_evidence"), F.col("host_q").alias("host_quality"), F.col("path_q").alias("path_quality"), F.col("host_t").alias("host_toxic"),
        F.col("path_t").alias("path_toxic"), F.col("p_q").alias("p_quality"), F.col("p_t").alias("p_toxic"), ((F.col("p_q") >= 0.5) & (F.col("p_t") < 0.5)).alias("kept"))
