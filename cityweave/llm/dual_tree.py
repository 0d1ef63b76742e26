"""Operator 11: exact ranked lexical search by a dual-tree walk over items and documents.

Items are taken in blocks of a bounded number of bytes. For a block, one pass over all documents counts the block's terms in
each (a narrow table, staged); numbers of documents per term, which weigh the terms, come from an aggregate of it. Documents
that share their most telling terms are then laid side by side, and a task builds a hierarchy over each PIECE of them: a node
holds, for each term, the largest impact below it. A hierarchy over the block's items holds the largest weights in the same
way, so the inner product of two nodes bounds the score of every pair below them. A pair of nodes whose bound is less than
the weakest k-th score so far among the node's items is dropped with all its pairs; else both are split, down to single
items and leaves of documents, which are scored exactly, the best bounds first. First scores to prune by come from the same
walk over a hash sample of documents; they are k-th best of a part and so never over the final ones, which keeps the result
exact. A task hands on at most k rows for each item; a window merges them.

Broadcast: the vocabulary, weights and hierarchy of one block of items (BLOCK_BYTES of text) and one score for each item.

Defined cases: a null text has no terms; a document without terms counts for nothing; null document ids rank as the least id
and stay null; equal rows of documents are documents of their own, so an id may come twice; equal rows of items count once,
and different texts of one item id are ranked each by itself; an item without terms, or whose terms no document holds,
has no rows; empty tables give an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, dropped, partitions_for, staged

K = 10
#: Documents of a hierarchy, of a leaf, and nodes of a node; items' nodes of a node.
PIECE, LEAF, FAN, ITEM_FAN = 4_096, 16, 8, 4
#: Text of items that is held at once, in bytes.
BLOCK_BYTES = 16_000_000
#: One document in so many gives the first scores to prune by.
SEED_SHARE = 32
LEAST = -(1 << 63)
TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall
FOUND = "doc long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Letters and digits of ASCII and all other characters, in runs; only A-Z are lower-cased."""
    return TERMS(text.lower()) if text else []


class Rows:
    """Sparse rows: for row i the terms and values from start[i] to start[i + 1]."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int):
        """From entries in any order; of entries of one row and term the largest counts."""
        order = np.lexsort((term, row))
        row, term, value = row[order], term[order], value[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
        self.row, self.term = row[first], term[first]
        self.value = np.maximum.reduceat(value, first) if len(first) else value
        self.start = np.searchsorted(self.row, np.arange(n + 1))
        self.n = n

    def grouped(self, fan: int) -> Rows:
        """Rows of nodes: the largest values of so many neighbouring rows each."""
        return Rows(self.row // fan, self.term, self.value, -(-self.n // fan))

    def dot(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products of some rows with a dense vector."""
        begin = self.start[rows]
        size = self.start[rows + 1] - begin
        end = np.cumsum(size)
        at = np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)
        total = np.r_[0, np.cumsum(q[self.term[at]] * self.value[at])]
        return total[end] - total[end - size]


def levels(rows: Rows, first: int, fan: int) -> list[Rows]:
    """A hierarchy over rows, from the rows themselves to its top."""
    out = [rows, rows.grouped(first)]
    while out[-1].n > fan:
        out.append(out[-1].grouped(fan))
    return out


class Walk:
    """Best documents of each item of a block, over any number of pieces."""

    def __init__(self, items: list[Rows], width: int, least: np.ndarray, k: int):
        self.items, self.k, self.least = items, k, least.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * items[0].n
        self.q = np.zeros(width, dtype=np.int64)
        self.pairs = self.scored = 0

    def piece(self, ids: np.ndarray, rows: Rows) -> None:
        self.ids, self.docs = ids, levels(rows, LEAF, FAN)
        top, nodes = len(self.items) - 1, np.arange(self.docs[-1].n)
        for node in range(self.items[top].n):
            self.visit(top, node, len(self.docs) - 1, nodes)

    def visit(self, level: int, node: int, depth: int, nodes: np.ndarray) -> None:
        """Pairs of a node of items with nodes of documents, which lie at level and depth of their hierarchies."""
        own, docs = self.items[level], self.docs[depth]
        span = slice(own.start[node], own.start[node + 1])
        self.q[own.term[span]] = own.value[span]
        bound = docs.dot(nodes, self.q)
        self.q[own.term[span]] = 0
        self.pairs += len(nodes)
        width = ITEM_FAN**level
        weakest = self.least[node * width : (node + 1) * width].min()
        close = bound >= max(weakest, 1)
        nodes = nodes[close]
        if not len(nodes):
            return
        if level == 0 and depth == 1:
            self.score(node, nodes, bound[close])
            return
        if depth > 1:
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            depth, nodes = depth - 1, nodes[nodes < self.docs[depth - 1].n]
        if level == 0:
            self.visit(0, node, depth, nodes)
        else:
            for child in range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, self.items[level - 1].n)):
                self.visit(level - 1, child, depth, nodes)

    def score(self, item: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Exact scores of an item with the documents of leaves, the best bounds first."""
        order = np.argsort(-bound, kind="stable")
        leaves, bound = leaves[order], bound[order]
        own = self.items[0]
        span = slice(own.start[item], own.start[item + 1])
        at, step = 0, 4
        while at < len(leaves) and bound[at] >= self.least[item]:
            some = (leaves[at : at + step, None] * LEAF + np.arange(LEAF)).ravel()
            some = some[some < self.docs[0].n]
            self.q[own.term[span]] = own.value[span]
            got = self.docs[0].dot(some, self.q)
            self.q[own.term[span]] = 0
            self.scored += len(some)
            good = got >= max(self.least[item], 1)
            ids, scores = np.r_[self.best[item][0], self.ids[some[good]]], np.r_[self.best[item][1], got[good]]
            first = np.lexsort((ids, -scores))[: self.k]
            self.best[item] = ids[first], scores[first]
            if len(first) == self.k:
                self.least[item] = max(self.least[item], scores[first[-1]])
            at, step = at + step, step * 4

    def rows(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.best]
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        columns = [item, *(np.concatenate([b[i] for b in self.best]) if sizes else np.empty(0, np.int64) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "doc", "score"])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts) of each document with a term: all its terms' number, and those of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = held.value
        names = known.keys()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                every = terms_of(text.as_py())
                if every:
                    counts = Counter(every)
                    own = sorted((known[t], counts[t]) for t in counts.keys() & names)
                    out.append((doc, len(every), [t for t, _ in own], [c for _, c in own]))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "n", "terms", "counts"])

    return docs.mapInArrow(run, FOUND)


def impacts(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, term, impact) of the entries of a batch of FOUND rows."""
    rows = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
    n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    m = 100 - 75 + (75 * n * n_docs) // max(1, n_terms)
    tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows, batch.column(2).flatten().to_numpy(zero_copy_only=False), (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])


def neighbours(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """found with (t1, t2), the two terms that give each document its largest scores, ordered by them in ranges."""
    held = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value
        for batch in batches:
            rows, term, value = impacts(batch, n_docs, n_terms)
            order = np.lexsort((-w[term] * value, rows))
            rows, term = rows[order], term[order]
            start = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            size = np.diff(start)
            padded = np.r_[term, -1, -1]
            top = [np.where(size > i, padded[np.minimum(start[:-1] + i, len(term))], -1).astype(np.int32) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(t) for t in top)], ["doc", "n", "terms", "counts", "t1", "t2"])

    keyed = found.where("size(terms) > 0").mapInArrow(run, f"{FOUND}, t1 int, t2 int")
    keys = ["t1", "t2", "doc"]
    ranges = partitions_for(found.sparkSession, n_docs, 8 * PIECE)
    return keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc", "n", "terms", "counts")


def walked(found: DataFrame, held, n_docs: int, n_terms: int, least, k: int) -> DataFrame:
    """HITS rows: at most k documents for each task and item. held: broadcast (hierarchy of items, number of terms)."""

    def run(batches):
        items, width = held.value
        walk = Walk(items, width, least.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                walk.piece(part.column(0).to_numpy(zero_copy_only=False), Rows(*impacts(part, n_docs, n_terms), part.num_rows))
        yield walk.rows()

    return found.mapInArrow(run, HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """(item, doc, rank, score) of a block of items (rows with a text), items by their place in the block."""
    spark = docs.sparkSession
    own = [Counter(terms_of(r.text.encode())) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*own)))}
    if not vocabulary:
        return None
    found = staged(counted(docs, vocabulary), "counts")
    size = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    entry = [(i, vocabulary[t], c) for i, terms in enumerate(own) for t, c in terms.items()]
    row, term, count = (np.array(x, dtype=np.int64) for x in zip(*entry))
    # items whose heaviest terms are alike stand side by side
    rows = Rows(row, term, count * weights[term], len(own))
    heavy = [tuple(rows.term[s][np.argsort(-rows.value[s], kind="stable")[:2]]) for s in (slice(a, b) for a, b in zip(rows.start, rows.start[1:]))]
    place = np.array(sorted(range(len(own)), key=lambda i: (heavy[i], i)))
    back = np.argsort(place)
    tree = [Rows(back[row], term, count * weights[term], len(own))]
    while tree[-1].n > ITEM_FAN:
        tree.append(tree[-1].grouped(ITEM_FAN))
    held = spark.sparkContext.broadcast((tree, len(vocabulary)))
    near = staged(neighbours(found, weights, size.docs, size.terms), "neighbours")
    nothing = spark.sparkContext.broadcast(np.zeros(len(own), dtype=np.int64))
    seeds = near.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SEED_SHARE)) == 0)
    least = np.zeros(len(own), dtype=np.int64)
    for r in ranked(walked(seeds, held, size.docs, size.terms, nothing, k), k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
        least[r["item"]] = r["score"]
    hits = staged(ranked(walked(near, held, size.docs, size.terms, spark.sparkContext.broadcast(least), k), k), "hits")
    dropped(spark, found)
    dropped(spark, near)
    names = spark.createDataFrame([(int(back[i]), i) for i in range(len(own))], "item int, place int")
    return hits.join(F.broadcast(names), "item").select("place", "doc", "rank", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_key, rank, key, score): for each item the k documents of the highest scores over 0."""
    spark = docs.sparkSession
    rows = columns_of(docs, key, text).toDF("doc", "text").where("text is not null")
    rows = rows.select(F.coalesce("doc", F.lit(LEAST)).cast("long").alias("doc"), "text")
    kind = items.schema[item_key].dataType
    asked = staged(columns_of(items, item_key, item_text).toDF("id", "text").where("text is not null").distinct(), "items")
    total = asked.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # about block_bytes
        found = searched(rows, block, k)
        if found is not None:
            ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(block)], f"place int, id {kind.simpleString()}")
            found = found.join(F.broadcast(ids), "place").select("id", "rank", "doc", "score")
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], f"id {kind.simpleString()}, rank int, doc long, score long")
    doc = F.when(F.col("doc") != LEAST, F.col("doc"))
    return out.select(F.col("id").alias(item_key), "rank", doc.alias(key), "score")


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_dual_tree": op11_dual_tree}
ORACLES = {
    "op11_dual_tree": r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null
),
size as (select count(*) as n_docs, sum(len(w)) as n_terms from d where len(w) > 0),
tf as (select r, doc_id, t, count(*) as tf, any_value(n) as n from (select r, doc_id, len(w) as n, unnest(w) as t from d) group by r, doc_id, t),
weight as (
  select t, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, size group by t
),
q as (
  select item_id, t, count(*) as c
  from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from benchmark
  ) group by item_id, t
),
s as (
  select q.item_id, tf.r, tf.doc_id,
         cast(sum(q.c * weight.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * tf.n * n_docs) // n_terms))))) as bigint) as score
  from q join tf using (t) join weight using (t), size group by q.item_id, tf.r, tf.doc_id
),
o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 10
"""
}
