"""Operator 6: a counterfactually regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings in a whole text. It is fitted on a bounded sample of
labelled rows: at most FIT_TOXIC and FIT_CLEAN ids by their hash, and of their different rows again so many by the hash of
id and text, however many rows an id has. For every labelled text of the sample that names
a group of people, versions are made in which the identity terms are swapped for others of the same kind; the fit adds
the squared difference of the scores' logits to its loss, so a mention by itself moves no score. Scoring runs over all
documents in one pass without a shuffle; the model is broadcast and holds at most MAX_FEATURES features.

Features enter by evidence: at least MIN_DOCS toxic texts have them, at LEAST_RATIO times the rate of other texts, best
likelihood ratio first. So a long clean text does not add up many weak hints.

Defined cases: a null or wordless text gets the score of no evidence; rows without a label, or with a null one, are not
fitted on; several labels of one id count as toxic if one is, and equal rows count once in the fit; without labels of both
kinds, or where no feature tells them apart, every score is the share of toxic labels, but one half at most, so that nothing
is held to be toxic without evidence (0 without any label); null ids are scored and count as not held out; equal rows get
equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityweave.llm.common import columns_of, hash_sample, numbered, staged

#: The bound of the fit's sample.
FIT_TOXIC, FIT_CLEAN = 2_000, 4_000
MAX_FEATURES, MIN_DOCS, LEAST_RATIO = 1_024, 2, 4.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
RIDGE, SWAP_WEIGHT, SWAPS = 0.02, 5.0, 2
CACHE_WORDS = 100_000

#: Identity terms by kind; terms of a kind are swapped for each other. A parameter of fit().
IDENTITY_TERMS = {
    "faith": "muslim christian jewish hindu buddhist atheist musulmán cristiano judío musulman chrétien juif christlich jüdisch muslimisch",
    "faith plural": "muslims christians jews hindus buddhists atheists musulmanes cristianos judíos musulmans chrétiens juifs christen juden muslime",
    "gender": "woman man girl boy mujer hombre femme homme frau mann transgender",
    "gender plural": "women men girls boys mujeres hombres femmes hommes frauen männer",
    "orientation": "gay lesbian straight bisexual homosexual heterosexual queer lesbiana lesbienne lesbisch schwul",
    "origin": "black white asian african latino arab european american negro blanco noir blanc schwarz weiß",
    "status": "immigrant immigrants refugee refugees foreigner foreigners citizen citizens disabled elderly young",
}
WORD = re.compile(r"\w+").findall


def swaps(text: str, terms: dict[str, str], n: int = SWAPS) -> list[str]:
    """Versions of a lower-case text whose identity terms are each replaced by another of their kind; none without any."""
    kinds = {w: k.split() for k in terms.values() for w in k.split()}
    if not any(w in kinds for w in WORD(text)):
        return []
    out = []
    for step in range(1, n + 1):

        def other(m: re.Match, step: int = step) -> str:
            kind = kinds.get(m[0])
            return m[0] if kind is None else kind[(kind.index(m[0]) + step) % len(kind)]

        out.append(re.sub(r"\w+", other, text))
    return out


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]


def features(text: str) -> set[str]:
    words = set(WORD(text))
    return words.union(*(beginnings(w) for w in words))


def held_out(key: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, n_toxic: int, n_clean: int) -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows that are not held out: n_toxic and n_clean rows at most."""
    known = columns_of(labels, key, label).toDF("key", "toxic").where("key is not null and toxic is not null")
    known = known.where(~held_out("key")).groupBy("key").agg(F.max("toxic").alias("toxic"))
    pick = lambda on, n: known.where(F.col("toxic") == on).orderBy(F.xxhash64("key"), "key").limit(n)
    some = staged(pick(1, n_toxic).unionAll(pick(0, n_clean)), "labels")
    rows = columns_of(docs, key, text).toDF("key", "text").select("key", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", "text")})
    names = staged(rows.join(F.broadcast(some), "key").select("key", "toxic", "h1", "h2").distinct(), "fit-names")
    size = {r.toxic: r["count"] for r in names.groupBy("toxic").count().collect()}
    least = lambda on, n: hash_sample(names.where(F.col("toxic") == on), n, size.get(on, 0), "key", "h1", "h2")
    chosen = staged(least(1, n_toxic).unionAll(least(0, n_clean)), "fit-chosen")
    rows = rows.join(F.broadcast(chosen), ["key", "h1", "h2"]).dropDuplicates(["key", "h1", "h2"])
    return staged(rows.select("text", "toxic"), "fit-rows")


def selected(sample: DataFrame) -> tuple[list[str], int, int]:
    """Features by evidence, and how many toxic and other texts there are."""
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return [], n1, n0

    def count(frames):
        for frame in frames:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"]):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[int(toxic)] += 1
            yield pd.DataFrame([(f, c[1], c[0]) for f, c in counts.items()], columns=["f", "n1", "n0"])

    per = sample.mapInPandas(count, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p1, p0 = F.col("n1") / n1, (F.col("n0") + 0.5) / n0
    gain = F.col("n1") * F.log(p1 / p0)
    best = per.where((F.col("n1") >= MIN_DOCS) & (p1 >= LEAST_RATIO * p0)).orderBy(F.desc(gain), "f").limit(MAX_FEATURES)
    return [r.f for r in best.select("f").collect()], n1, n0


class Model:
    """Features with weights; scores whole texts."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.at = {f: i for i, f in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, text: str) -> set[int]:
        out: set[int] = set()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(WORD(text)):
            got = known.get(w)
            if got is None:
                got = known[w] = tuple(self.at[f] for f in (w, *beginnings(w)) if f in self.at)
            if got:
                out.update(got)
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[sorted(self.hits((text or "").lower()))].tolist())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def solve(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, ridge: float = RIDGE, swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float]:
    """Newton steps on the class-balanced logistic loss, ridge, and the mean squared difference over swapped pairs."""
    n, m = x.shape
    x1 = np.c_[x, np.ones(n)]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    penalty = np.diag(np.r_[np.full(m, ridge / max(1, m) ** 0.5), 1e-6])
    if len(pairs):
        d = np.c_[pairs, np.zeros(len(pairs))]
        penalty += 2 * swap_weight * d.T @ d / len(d)
    w = np.zeros(m + 1)
    loss = lambda w: float((share * np.logaddexp(0, np.where(y == 1, -1, 1) * (x1 @ w))).sum() + w @ penalty @ w / 2)
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -60, 60)))
        gradient = x1.T @ (share * (p - y)) + penalty @ w
        hessian = (x1 * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x1 + penalty
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while rate > 1e-6 and (new := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - rate * step, new
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    terms: dict[str, str] = IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN,
) -> Model:
    sample = sample_of(docs, labels, key, text, label, n_toxic, n_clean)
    names, n1, n0 = selected(sample)
    if not names:
        share = min(n1 / max(1, n1 + n0), 0.5)
        return Model([], np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    blank = Model(names, np.zeros(len(names)), 0.0)

    def rows(frames):
        for frame in frames:
            out = []
            for t, toxic in zip(frame["text"], frame["toxic"]):
                out.append((int(toxic), sorted(blank.hits(t)), [sorted(blank.hits(s)) for s in swaps(t, terms)]))
            yield pd.DataFrame(out, columns=["toxic", "hits", "swapped"])

    made = sample.mapInPandas(rows, "toxic int, hits array<int>, swapped array<array<int>>").collect()  # bounded sample
    x, y, pairs = np.zeros((len(made), len(names))), np.array([r.toxic for r in made], dtype=float), []
    for i, r in enumerate(made):
        x[i, r.hits] = 1
        for s in r.swapped:
            d = x[i].copy()
            d[s] -= 1
            if d.any():
                pairs.append(d)
    return Model(names, *solve(x, y, np.array(pairs), swap_weight=swap_weight))


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with one more column, the score of the whole text from 0 to 1."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    plain, _ = numbered(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        own = held.value
        for batch in batches:
            made = [own.score(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, column)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
