"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - score), with one weight per feature shared by all ordered thresholds. Features
are presence flags: lower-case letter runs, and their first 4, 5 and 6 letters, so that inflected forms of one stem
share a weight. The result is the expected severity, sum over k of P(grade > k), and the probability of grade >= 1.

Fitted on a bounded sample: about `per_class` labelled documents of either kind, chosen by hash, weighted back to
their true shares (parameter). Features: the `max_features` with the strongest association among those that at
least `min_texts` of the sample have and whose log odds ratio is `min_z` standard errors from zero. Every document is scored whole.

Tables that only say toxic or not get grades from the sample (`graded`): 0 is not toxic; a toxic text is grade 2 if it
has more distinct strongly associated words than the median toxic text of the sample, else 1.

Defined cases: a null or empty text has no feature and gets the base rate; labels with a null id or class are left
out; a document with conflicting labels counts as toxic; without both classes in the labels nothing is learned and all
scores are 0; repeated rows and null ids are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, packed, table

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Characters of a text that are cut into words at a time.
STEP = 1 << 20
REMEMBERED = 300_000


def words_of(text: str) -> set[str]:
    """Distinct lower-case letter runs; a long text is cut at white space into steps."""
    found, at = set(), 0
    while at < len(text):
        end = min(len(text), at + STEP)
        while end < len(text) and not text[end].isspace() and end - at < 2 * STEP:
            end += 1
        found.update(LETTERS.findall(text[at:end].lower()))
        at = end
    return found


def word_features(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in STEMS if len(word) >= n]


def text_features(text: str | None) -> set[str]:
    return {f for w in words_of(text or "") for f in word_features(w)}


class OrdinalModel:
    """Weights by feature and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[str, ...]] = {}

    def features(self, text: str | None) -> set[str]:
        """Those features of a text that have a weight."""
        found: set[str] = set()
        known = self.known
        for w in words_of(text or ""):
            own = known.get(w)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[w] = tuple(f for f in word_features(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        score = sum(sorted(self.weights[f] for f in self.features(text)))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -700, 700)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, weight: np.ndarray, n_features: int, *,
                ridge: float = 0.3, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps with per-coordinate scaling. Thresholds are kept ordered by
    steps on the first one and the logarithms of the gaps."""
    k = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    weight = weight / weight.sum()
    share = np.array([max(1e-6, (weight * (grades > i)).sum()) for i in range(k)])
    start = -np.log(share / np.maximum(1e-6, 1 - share))
    p = np.concatenate((np.zeros(n_features), [start[0]], np.log(np.maximum(1e-2, np.diff(start)))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        theta = np.concatenate(([-np.inf], p[n_features] + np.concatenate(([0], np.cumsum(np.exp(p[n_features + 1:])))), [np.inf]))
        score = np.bincount(at, p[col], len(rows))
        with np.errstate(over="ignore"):
            high, low = (1 / (1 + np.exp(score - theta[grades + i])) for i in (1, 0))
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        g = np.empty_like(p)
        g[:n_features] = np.bincount(col, (weight * (d_high - d_low))[at], n_features) + ridge * p[:n_features] / max(1, len(rows))
        by_threshold = np.array([-(weight * d_high)[grades == i].sum() + (weight * d_low)[grades == i + 1].sum() for i in range(k)])
        tail = np.cumsum(by_threshold[::-1])[::-1]
        g[n_features] = tail[0]
        g[n_features + 1:] = tail[1:] * np.exp(p[n_features + 1:])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    return p[:n_features], p[n_features] + np.concatenate(([0], np.cumsum(np.exp(p[n_features + 1:]))))


def learn(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, min_texts: int = 4, min_z: float = 4.0, max_features: int = 16_384) -> OrdinalModel:
    """labels: doc_id, toxic (0 or 1)."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return OrdinalModel({}, np.array([np.inf]))
    rate = {c: min(1.0, per_class / n[c]) for c in n}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]) * (1 << 30)
    # about 2 * per_class ids of a few bytes: a broadcast of bounded size
    sample = docs.select("doc_id", "text").join(F.broadcast(marks.where(drawn)), "doc_id")

    def features(batches):
        for batch in batches:
            for doc, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sorted(text_features(text)) or [""]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), pa.int64()), pa.array([toxic] * len(own), pa.int32()),
                                                  pa.array(own, pa.string())], ["doc_id", "toxic", "feature"])

    found = keep(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(features, "doc_id long, toxic int, feature string"))
    a, b = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    size = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if len(size) < 2:
        return OrdinalModel({}, np.array([np.inf]))
    pa_, pb = (F.col("a") + 0.5) / (size[1] + 1), (F.col("b") + 0.5) / (size[0] + 1)
    odds = F.log(pa_ / (1 - pa_)) - F.log(pb / (1 - pb))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = (found.groupBy("feature").agg(a.alias("a"), b.alias("b")).where(f"a + b >= {min_texts} AND feature <> ''")
            .withColumn("z", odds / spread).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "feature").limit(max_features).select("feature", "z"))
    z = {r["feature"]: r["z"] for r in best.collect()}
    index = {f: i for i, f in enumerate(sorted(z))}
    chosen = best.sparkSession.createDataFrame(list(index.items()), "feature string, i int") if index else None
    per_doc = {}
    if chosen is not None:
        per_doc = {r["doc_id"]: r["f"] for r in found.join(F.broadcast(chosen), "feature").groupBy("doc_id")
                   .agg(F.array_sort(F.collect_list("i")).alias("f")).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in found.select("doc_id", "toxic").distinct().collect()}
    ids = sorted(truth)
    toxic = np.array([truth[i] for i in ids])
    rows = [per_doc.get(i, []) for i in ids]
    grades = graded(rows, toxic, {index[f] for f in z if z[f] >= 4 and not f.endswith("*")})
    share = np.where(toxic == 1, n[1] / size[1], n[0] / size[0])
    weights, thresholds = fit_ordinal(rows, grades, share, len(index))
    return OrdinalModel({f: float(weights[i]) for f, i in index.items()}, thresholds)


def graded(rows: list[list[int]], toxic: np.ndarray, strong: set[int]) -> np.ndarray:
    """Severity grades from toxic flags; see the module's text."""
    hits = np.array([len(strong.intersection(r)) for r in rows])
    middle = np.median(hits[toxic == 1])
    return np.where(toxic == 0, 0, np.where(hits > middle, 2, 1))


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(row, expected_severity, p_toxic, grade): grade counts the thresholds that are passed more likely than not."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs.drop("text")).alias("row"), "text")
    schema = rows.select("row").schema.add("expected_severity", "double").add("p_toxic", "double").add("grade", "integer")

    def judge(batches):
        for batch in batches:
            above = [sent.value.above(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(x.sum()) for x in above], pa.float64()), pa.array([float(x[0]) for x in above], pa.float64()),
                 pa.array([int((x >= 0.5).sum()) for x in above], pa.int32())], schema.names)

    return rows.mapInArrow(judge, schema)


def op10_ordinal_toxicity(spark, folder):
    """Every document with its expected severity; toxic is grade 1 or more."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, folder, "labels"))
    return severity(docs, model).select("row.doc_id", "expected_severity", "p_toxic", "grade", (F.col("grade") >= 1).alias("toxic"))
