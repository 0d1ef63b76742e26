"""Operator 7: near-duplicate embeddings through an inverted multi-index.

Vectors are brought to length one and split in halves; each half has a codebook of its own, fitted on a bounded sample.
The pairs of codewords form a grid of cells, and every vector stands in the cell of its nearest pair. A search visits
cells in multi-sequence order, nearest pair first. How many cells are visited is set by measurement: a bounded sample of
vectors that did not fit the codebooks is compared with all rows, and the number is the least at which the mean vector
finds `recall` of its true partners, so a large group counts no more than a small one. Where too few of them have
partners, each also gets a made one, turned away at random to a cosine just at the threshold.
Every candidate is then verified by cosine in double precision, so no link lies below the threshold.

Equal vectors collapse first and count with their number. A pair is found if either vector visits the other's cell;
links are counted on both sides without listing pairs, and each task gives a spanning forest of its links, which
distributed connected components join. Cells with many vectors are split, and their visitors too.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and are components of
their own; of vectors of different lengths the shorter counts as filled with zeros; a null id takes no part, has no
links and a null component; rows with one id count as one node, each with its vector; equal rows link with each other;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, components, hash_sample, partitions_for, staged
from cityweave.llm.simhash import forest

COSINE, RECALL = 0.95, 0.995
#: Vectors that fit the codebooks; vectors that set the number of cells visited.
FIT_ROWS, TRIAL_ROWS = 8_192, 1_024
#: Trial vectors with partners that make a measurement.
ENOUGH = 64
#: Vectors a cell holds on average; members and visitors of a cell that meet in one block.
CELL_ROWS, BLOCK_ROWS = 8, 2_048
#: Visitors of a block that are compared with its members at once.
CHUNK = 256
MOST_WORDS = 1_024


def unit(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, "<f4")
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # keeps squares of tiny components from vanishing
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def packed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): all rows, v the components as float32 bytes, null for those that link with nothing."""
    src = columns_of(vectors, key, vector).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def run(frames):
        for frame in frames:
            out = []
            for v in frame["v"]:
                a = None if v is None or any(x is None for x in v) else np.asarray(v, dtype="<f4")
                out.append(a.tobytes() if a is not None and np.isfinite(a).all() and a.any() else None)
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "v": out})

    return src.mapInPandas(run, "id long, v binary")


def codebook(rows: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spread rows; empty words stay where they are."""
    at = rows[np.linspace(0, len(rows) - 1, words).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((at**2).sum(axis=1) - 2 * rows @ at.T, axis=1)
        total = np.zeros_like(at)
        np.add.at(total, near, rows)
        count = np.bincount(near, minlength=words)
        at[count > 0] = total[count > 0] / count[count > 0][:, None]
    return at


class Index:
    """Two codebooks; cells in multi-sequence order."""

    def __init__(self, rows: np.ndarray, words: int):
        self.half = rows.shape[1] // 2
        self.books = [codebook(rows[:, : self.half], words), codebook(rows[:, self.half :], words)]
        self.words = words

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [(p**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * p @ b.T for p, b in zip(parts, self.books)]

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest `visits` cells of each row, nearest first: the two sorted lists of codewords are traversed by a
        heap that holds the border of what has been visited."""
        first, second = self.distances(x)
        if visits == 1:
            return (first.argmin(axis=1) * self.words + second.argmin(axis=1))[:, None]
        a, b = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        da, db = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
        out = np.empty((len(x), visits), dtype=np.int64)
        for r, (p, q, ia, ib) in enumerate(zip(da.tolist(), db.tolist(), a.tolist(), b.tolist())):
            border, depth = [(p[0] + q[0], 0, 0)], [0] * (self.words + 1)
            for n in range(visits):
                _, i, j = heapq.heappop(border)
                out[r, n] = ia[i] * self.words + ib[j]
                depth[i] = j + 1
                if i + 1 < self.words and depth[i + 1] == j:  # its other neighbour is out already
                    heapq.heappush(border, (p[i + 1] + q[j], i + 1, j))
                if j + 1 < self.words and (i == 0 or depth[i - 1] > j + 1):
                    heapq.heappush(border, (p[i] + q[j + 1], i, j + 1))
        return out

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells are visited before the given one, for each row."""
        first, second = self.distances(x)
        out = np.empty(len(x), dtype=np.int64)
        for r, c in enumerate(cell.tolist()):
            mine = first[r, c // self.words] + second[r, c % self.words]
            s = np.sort(second[r])
            out[r] = np.searchsorted(s, mine - first[r], side="left").sum()
        return out


def visits_for(index: Index, own: DataFrame, trial: np.ndarray, width: int, cosine: float, recall: float) -> int:
    """The least number of cells at which the trial vectors, compared with all rows, find on average `recall` of their
    partners."""
    spark = own.sparkSession
    held = spark.sparkContext.broadcast((index, trial))

    def run(frames):
        idx, q = held.value
        cells = idx.cells(q, 1)[:, 0]
        for frame in frames:
            for lo in range(0, len(frame), 4096):
                x = unit(frame["v"].tolist()[lo : lo + 4096], width)
                cos = q @ x.T
                a, b = np.nonzero((cos >= cosine) & (cos < 1 - 1e-12))
                if len(a):
                    theirs = idx.rank(q[a], idx.cells(x[b], 1)[:, 0])
                    ranks = np.minimum(theirs, idx.rank(x[b], cells[a]))
                    yield pd.DataFrame({"a": a, "rank": ranks}).value_counts().rename("n").reset_index()

    pairs = own.select("v").mapInPandas(run, "a long, rank long, n long").groupBy("a", "rank").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("a"))
    pairs = staged(pairs.select("a", "rank", share.alias("share")), "trial-ranks")
    seen = pairs.select("a").distinct().count()
    got = {r["rank"]: r["share"] for r in pairs.groupBy("rank").agg(F.sum("share").alias("share")).collect()}  # ranks are cells at most
    if seen < ENOUGH:
        away = np.random.default_rng(31).normal(size=trial.shape)
        away -= (away * trial).sum(axis=1)[:, None] * trial
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        made = cosine * trial + (1 - cosine**2) ** 0.5 * away
        theirs = index.rank(trial, index.cells(made, 1)[:, 0])
        for r in np.minimum(theirs, index.rank(made, index.cells(trial, 1)[:, 0])).tolist():
            got[r] = got.get(r, 0.0) + 1.0
    total, so_far = sum(got.values()), 0.0
    for r in sorted(got):
        so_far += got[r]
        if so_far >= recall * total - 1e-9:
            break
    return min(index.words**2, max(4, r + 1))


def linked(own: DataFrame, index: Index, visits: int, width: int, cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """From distinct vectors (id, v, n): rows (a, b, links) where links of a are to be summed up, or, with links null,
    an edge of a spanning forest."""
    spark = own.sparkSession
    held = spark.sparkContext.broadcast(index)

    def assign(frames):
        for frame in frames:
            for lo in range(0, len(frame), 2048):
                some = frame.iloc[lo : lo + 2048]
                cells = held.value.cells(unit(some["v"].tolist(), width), visits)
                yield some.assign(cell=cells[:, 0], visits=list(cells))

    placed = staged(own.mapInPandas(assign, "id long, v binary, n long, cell long, visits array<long>"), "cells")
    near = placed.select(F.explode("visits").alias("cell"), "id", "v", "n", F.col("cell").alias("home"))
    splits = lambda rows: F.ceil(F.count("*") / block_rows).cast("int")  # noqa: E731, ARG005
    members = placed.groupBy("cell").agg(splits(placed).alias("ms"))
    visitors = near.groupBy("cell").agg(splits(near).alias("vs"))
    sizes = staged(members.join(visitors, "cell"), "cell-sizes")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    role = lambda d, r, m, v, home: d.join(sizes, "cell").select(
        "cell", m.alias("m"), "vs", "ms", "id", "v", "n", home.alias("home"), F.lit(r).alias("role"),
        (F.col("visits") if r == 0 else F.lit(None).cast("array<long>")).alias("visits"),
    ).withColumn("w", v)
    left = role(placed, 0, mine("ms"), every("vs"), F.col("cell"))
    right = role(near.withColumn("visits", F.lit(None).cast("array<long>")), 1, every("ms"), mine("vs"), F.col("home"))
    both = left.unionByName(right).select("cell", "m", "w", "role", "id", "v", "n", "home", "visits")

    def search(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame])
            key = rest[["cell", "m", "w"]].to_numpy()
            last = (key == key[-1]).all(axis=1)
            if len(rest) > 4 * block_rows and not last.all():
                yield from found(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield from found(rest)

    def found(frame):
        x = unit(frame["v"].tolist(), width)
        ids, n, home, role = (frame[c].to_numpy() for c in ("id", "n", "home", "role"))
        seen = frame["visits"].to_list()
        key = frame[["cell", "m", "w"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        out, edges = [], []
        for lo, hi in zip(starts, np.r_[starts[1:], len(frame)]):
            mid = lo + int((role[lo:hi] == 0).sum())  # members come first
            if mid in (lo, hi):
                continue
            members, own = slice(lo, mid), np.zeros(hi - lo, dtype=np.int64)
            cells = np.unique(home[mid:hi])
            # which members visit which of the visitors' cells: such a pair is counted there for the member's side
            visited = np.zeros((len(cells), mid - lo), dtype=bool)
            flat, row = np.concatenate(seen[lo:mid]), np.repeat(np.arange(mid - lo), [len(s) for s in seen[lo:mid]])
            place = np.searchsorted(cells, flat)
            hit = cells[np.minimum(place, len(cells) - 1)] == flat
            visited[place[hit], row[hit]] = True
            label = np.arange(mid - lo)
            for at in range(mid, hi, CHUNK):
                some = slice(at, min(at + CHUNK, hi))
                cos = x[some] @ x[members].T
                near = cos >= cosine + 1e-9
                a, b = np.nonzero((cos >= cosine - 1e-9) & ~near)
                near[a, b] = np.einsum("ij,ij->i", x[some][a], x[members][b]) >= cosine
                near &= ids[some, None] != ids[None, members]
                alone = near & ~visited[np.searchsorted(cells, home[some])]
                own[some.start - lo : some.stop - lo] += near @ n[members]
                own[: mid - lo] += n[some] @ alone
                for r in np.flatnonzero(near.any(axis=1)).tolist():  # an edge for each tree of members that meets here
                    names, first = np.unique(np.where(near[r], label, len(label)), return_index=True)
                    first = first[names < len(label)]
                    edges += [(ids[at + r], ids[lo + j]) for j in first.tolist()]
                    if len(first) > 1:
                        label[np.isin(label, names[names < len(label)])] = names[0]
            linked_here = np.flatnonzero(own)
            out.append(pd.DataFrame({"a": ids[lo:hi][linked_here], "links": own[linked_here]}))
        if edges:
            names, at = np.unique(np.array(edges, dtype=np.int64), return_inverse=True)
            at = at.reshape(-1, 2)
            place, root = forest(len(names), [(at[:, 0], at[:, 1])])
            counts = pd.concat(out).groupby("a", as_index=False)["links"].sum().assign(b=pd.NA)
            joined = pd.DataFrame({"a": names[place], "b": names[root], "links": pd.NA})
            both = pd.concat([counts[["a", "b", "links"]], joined])
            yield both.astype({"a": "Int64", "b": "Int64", "links": "Int64"})

    parts = partitions_for(spark, placed.count() * (visits + 1), 100_000)
    dealt = both.repartition(parts, "cell", "m", "w").sortWithinPartitions("cell", "m", "w", "role")
    return staged(dealt.mapInPandas(search, "a long, b long, links long"), "links")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors."""
    rows = staged(packed(vectors, key, vector), "vectors")
    good = rows.where("id is not null and v is not null").select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", "v").alias("h2"))
    own = good.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("one"), F.count("*").alias("n"))
    own = staged(own.select("one.id", "one.v", "n", "h1", "h2"), "distinct-vectors")
    total = own.count()
    alone = rows.where("id is null or v is null").select(
        F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
    )
    if not total:
        return alone
    width = own.agg(F.max(F.octet_length("v"))).first()[0] // 4
    width += width % 2
    sample = hash_sample(own, FIT_ROWS + TRIAL_ROWS, total, "h1", "h2").select("v").toPandas()["v"].tolist()
    held_out = min(TRIAL_ROWS, -(-len(sample) // 4))
    trial, sample = sample[:held_out], sample[held_out:] or sample
    words = 1 << max(0, min(MOST_WORDS, len(sample), int((total / CELL_ROWS) ** 0.5)).bit_length() - 1)
    index = Index(unit(sample, width), words)
    visits = visits_for(index, own, unit(trial, width), width, cosine, recall)
    links = linked(own.select("id", "v", "n"), index, min(visits, words**2), width, cosine, block_rows)
    counts = links.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    comp = components(links.where("links is null").select("a", "b"))
    classes = own.join(counts.withColumnRenamed("a", "id"), "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("h1", "h2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    out = good.select("id", "h1", "h2").join(classes, ["h1", "h2"])
    linked_rows = out.select(
        F.col("id").alias(key), (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
    return linked_rows.unionByName(alone)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES: dict[str, str] = {}
