"""Operator 9: exact top-k by inner product with MaxScore over sharded postings.

Every component becomes an integer. A posting is one dimension with one sign: the vectors that have weight there, in
order of weight. A query's term is a dimension with the query's sign, and its bound in a shard is the query's weight times
the posting's largest weight.

Bounds split a query's terms by the k-th best score so far (theta). The tails of postings, weights that give no more than a
share of each term's bound, are non-essential: all of them together give less than SLACK * theta, so a vector that stands in
none of the heads cannot enter the result. The heads are essential and are traversed: their scores are added up by vector.
A vector goes on only if its sum and the bounds of what it was not met in reach theta; then the other terms are probed,
the heaviest first, while it stays competitive. theta rises as vectors are scored.

Shards are clusters of vectors, so that their bounds are tight; large ones are dealt out to pieces. A query goes to its own
piece first, which gives theta, and then only to pieces whose bound reaches it. Pieces give at most k rows a query, and a
window merges them. Vectors are copied only where a piece has more than one block of queries.

Bounded and broadcast: codewords and bounds of at most MOST_SHARDS shards, and how many pieces each has. The codewords are fitted
on FIT_ROWS vectors; every vector is placed and searched, so they change no result.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate; of vectors of different lengths the components in common count; equal (id, vector) rows count once, and no
row with a query's own id is its candidate; null ids take no part; ties go to the smaller id; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, hash_sample, staged
from cityweave.llm.embedding_dedup import codebook

#: Vectors of a piece; queries that meet a piece in one task; shards at most.
SHARD_ROWS, BLOCK_QUERIES, MOST_SHARDS = 16_384, 2_048, 1_024
FIT_ROWS = 8_192
#: Vectors of a piece that give the first k-th best score where a query has none.
SEEDS = 512
#: Share of the k-th best score that all non-essential tails together stay below.
SLACK = 0.1
#: Terms that are probed between two looks at the bound.
STEP = 16
RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): floor(scale * component) of the vectors that take part."""
    v = columns_of(vectors, key, vector).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    return v.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("x")).dropDuplicates()


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    lengths = {len(r) for r in rows}
    if lengths == {width}:
        return np.stack(rows.to_numpy()).astype(np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Postings:
    """The postings of a piece: ids (ascending) and their vectors."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray):
        self.ids, self.docs = ids, docs
        by_dim = np.ascontiguousarray(docs.T)
        self.order = np.argsort(by_dim, axis=1, kind="stable").astype(np.int32)
        self.weight = np.take_along_axis(by_dim, self.order, axis=1)
        self.high, self.low = np.maximum(docs.max(axis=0), 0), np.maximum(-docs.min(axis=0), 0)
        self.negative = np.array([np.searchsorted(w, 0, "left") for w in self.weight])
        self.positive = np.array([np.searchsorted(w, 0, "right") for w in self.weight])
        self.touched = self.probed = 0

    def heads(self, q: np.ndarray, tail: np.ndarray):
        """Of each term's posting the vectors whose score there is more than the tail's, and that score."""
        for d in np.flatnonzero(q):
            if q[d] > 0:
                own = slice(max(self.positive[d], np.searchsorted(self.weight[d], tail[d] / q[d], "right")), None)
            else:
                own = slice(0, min(self.negative[d], np.searchsorted(self.weight[d], tail[d] / q[d], "left")))
            yield self.order[d, own], q[d] * self.weight[d, own] - tail[d]

    def best(self, own: int, q: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors that score theta or more and are not the query's own."""
        nothing = np.empty(0, dtype=np.int64)
        other = self.ids != own
        term = np.where(q > 0, q * self.high, -q * self.low).astype(np.float64)
        if theta == -np.inf:
            seeds = np.flatnonzero(other[:SEEDS])
            if len(seeds) >= k:
                theta = float(np.sort(self.docs[seeds] @ q)[-k])
        total = term.sum()
        if total < theta:
            return nothing, nothing
        tail = term * (SLACK * theta / total) if theta > 0 else np.zeros(len(q))
        places, scores = zip(*self.heads(q, tail)) if q.any() else ((nothing,), (nothing,))
        places = np.concatenate(places)
        self.touched += len(places)
        bound = np.bincount(places, np.concatenate(scores), len(self.ids)) + tail.sum()
        slack = 1e-9 * (1 + total)
        found = np.flatnonzero((bound >= theta - slack) & other)
        found = found[np.argsort(-bound[found], kind="stable")]
        out, result = nothing, nothing
        dims = np.argsort(-np.abs(q), kind="stable")
        for lo, hi in ((0, 4 * k), (4 * k, len(found))):
            some = found[lo:hi]
            left = bound[some]
            for at in range(0, len(q), STEP):  # what the bound took for too high is taken back, the heaviest terms first
                some, left = some[left >= theta - slack], left[left >= theta - slack]
                step = dims[at : at + STEP]
                self.probed += len(some) * len(step)
                left = left + np.minimum(self.docs[np.ix_(some, step)] * q[step] - tail[step], 0).sum(axis=1)
            some = some[left >= theta - slack]
            out, result = np.r_[out, some], np.r_[result, self.docs[some] @ q]
            first = np.lexsort((self.ids[out], -result))[:k]
            out, result = out[first], result[first]
            if len(out) == k:
                theta = max(theta, float(result[-1]))
        return out, result


def searched(placed: DataFrame, asked: DataFrame, k: int, block_queries: int) -> DataFrame:
    """RESULT rows, at most k for each query and piece, for vectors (id, x, shard, piece) and queries (id, x, theta, shard,
    piece)."""
    load = asked.groupBy("shard", "piece").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int").alias("block")
    right = asked.join(load, ["shard", "piece"]).select("id", "x", "theta", "shard", "piece", block)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = placed.join(load, ["shard", "piece"]).select("id", "x", "shard", "piece", every)

    def search(docs: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if len(docs) and len(some):
            docs = docs.sort_values("id", kind="stable")
            width = max(docs["x"].map(len).max(), some["x"].map(len).max())
            postings = Postings(docs["id"].to_numpy(), matrix(docs["x"], width))
            for own, q, theta in zip(some["id"].to_numpy(), matrix(some["x"], width), some["theta"].to_numpy()):
                at, score = postings.best(own, q, k, -np.inf if np.isnan(theta) else theta)
                found.append(pd.DataFrame({"query_id": own, "vec_id": postings.ids[at], "score": score}))
        return pd.concat(found)

    keys = ["shard", "piece", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, RESULT)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounds_of(placed: DataFrame) -> dict[int, np.ndarray]:
    """(2 x width) largest and least component, zero included, of each shard in every dimension."""

    def run(frames):
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for shard, rows in frame.groupby("shard")["x"]:
                x = matrix(rows, max(1, rows.map(len).max()))
                made = np.stack([np.maximum(x.max(axis=0), 0), np.minimum(x.min(axis=0), 0)])
                held[shard] = wider(held.get(shard), made)
        for shard, b in held.items():
            yield pd.DataFrame({"shard": shard, "d": np.arange(b.shape[1]), "high": b[0], "low": b[1]})

    rows = placed.select("shard", "x").mapInPandas(run, "shard int, d int, high long, low long")
    rows = rows.groupBy("shard", "d").agg(F.max("high").alias("high"), F.min("low").alias("low")).toPandas()
    out = {}
    for shard, own in rows.groupby("shard"):
        out[int(shard)] = own.sort_values("d")[["high", "low"]].to_numpy().T
    return out


def wider(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    out = np.zeros((2, max(a.shape[1], b.shape[1])), dtype=np.int64)
    out[:, : a.shape[1]] = a
    out[0, : b.shape[1]] = np.maximum(out[0, : b.shape[1]], b[0])
    out[1, : b.shape[1]] = np.minimum(out[1, : b.shape[1]], b[1])
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (id, x) of queries its k best among vectors (id, x) of other ids."""
    spark, total = vectors.sparkSession, vectors.count()
    sample = hash_sample(vectors, FIT_ROWS, total, "id").select("x").toPandas()["x"] if total else pd.Series([[0]])
    width = max(1, sample.map(len).max())
    sample = matrix(sample, width).astype(np.float64)
    words = codebook(sample, min(MOST_SHARDS, len(sample), max(1, -(-total // shard_rows))))
    book = spark.sparkContext.broadcast(words)

    def place(frames):
        at = book.value
        for frame in frames:
            x = matrix(frame["x"].map(lambda r: r[: at.shape[1]]), at.shape[1]).astype(np.float64)
            near = np.argmin((at**2).sum(axis=1) - 2 * x @ at.T, axis=1)
            yield frame.assign(shard=near.astype(np.int32))

    placed = staged(vectors.mapInPandas(place, "id long, x array<long>, shard int"), "sharded-vectors")
    sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # MOST_SHARDS rows at most
    pieces = spark.createDataFrame([(s, -(-n // shard_rows)) for s, n in sizes.items()], "shard int, pieces int")
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")
    placed = placed.join(F.broadcast(pieces), "shard").select("id", "x", "shard", piece)
    home = queries.mapInPandas(place, "id long, x array<long>, shard int").join(F.broadcast(pieces), "shard", "left")
    home = staged(home.select("id", "x", F.lit(None).cast("double").alias("theta"), "shard", piece), "queries")
    first = staged(searched(placed, home, k, block_queries), "own-pieces")
    theta = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("theta"))
    asked = home.drop("theta").join(theta, "id", "left")
    held = spark.sparkContext.broadcast((bounds_of(placed), {s: -(-n // shard_rows) for s, n in sizes.items()}))

    def visits(frames):
        bounds, many = held.value
        for frame in frames:
            for lo in range(0, len(frame), 256):
                some = frame.iloc[lo : lo + 256]
                least = np.nan_to_num(some["theta"].to_numpy(dtype=float), nan=-np.inf)
                for shard, (high, low) in bounds.items():
                    q = matrix(some["x"].map(lambda r, n=len(high): r[:n]), len(high))
                    reach = np.where(q > 0, q * high, q * low).sum(axis=1) >= least
                    for p in range(many[shard]):
                        to = reach & ~((some["shard"] == shard) & (some["piece"] == p)).to_numpy()
                        yield some[to].assign(shard=np.int32(shard), piece=np.int32(p))

    asked = asked.select("id", "x", "theta", "shard", "piece").mapInPandas(visits, "id long, x array<long>, theta double, shard int, piece int")
    return ranked(first.unionAll(searched(placed, staged(asked, "visits"), k, block_queries)), k)


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "integer-vectors")
    return top_k(vectors, vectors.where("id % 50 = 0"))


QUERIES = {"op9_maxscore": op9_maxscore}
ORACLES = {
    "op9_maxscore": """
with c as (
  select vec_id, i, cast(floor(256 * cast(x as double)) as bigint) as x
  from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings)
),
s as (
  select q.vec_id as query_id, d.vec_id, cast(sum(q.x * d.x) as bigint) as score
  from c q join c d on q.i = d.i and q.vec_id <> d.vec_id where q.vec_id % 50 = 0 group by 1, 2
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
}
