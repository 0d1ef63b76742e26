"""Dual-tree search against plain scoring of every pair, and the defined cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cityweave.llm import dual_tree as m

AT = "/root/testdata/sf0.01"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        q, scores = Counter(terms(text)), []
        for doc, c in own:
            mm = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * mm)) for t, x in q.items() if t in c)
            if s > 0:
                scores.append((-s, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    got = sorted(tuple(r) for r in m.op11_dual_tree(spark, AT).collect())
    assert got == sorted(con.execute(m.ORACLES["op11_dual_tree"]).fetchall())


@pytest.mark.parametrize("seed, block_bytes", [(0, 1 << 20), (1, 600)])
def test_random_documents_in_one_and_several_blocks(spark, seed, block_bytes):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.6)), 400)}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, " ".join(word() for _ in range(r.randrange(12)))) for i in range(90)]
    got = m.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert sorted(tuple(x) for x in got.collect()) == brute(docs, items)


def test_pairs_are_pruned():
    """Documents of topics of their own: most pairs fall with their nodes."""
    r = np.random.default_rng(0)
    topic = np.repeat(np.arange(64), 64)
    entry = [(i, 20 * topic[i] + t, int(r.integers(1, 9)) * 1000) for i in range(4096) for t in r.choice(20, 8, replace=False)]
    rows = m.Rows(*(np.array(x) for x in zip(*entry)), 4096)
    items = [m.Rows(np.repeat(np.arange(16), 5), np.concatenate([20 * t + r.choice(20, 5, replace=False) for t in range(16)]), np.full(80, 7), 16)]
    while items[-1].n > m.ITEM_FAN:
        items.append(items[-1].grouped(m.ITEM_FAN))
    walk = m.Walk(items, 1280, np.zeros(16, dtype=np.int64), 10)
    walk.piece(np.arange(4096), rows)
    assert walk.scored <= 16 * 64 and walk.pairs < 16 * 256
    for i in range(16):
        q = np.zeros(1280, dtype=np.int64)
        span = slice(items[0].start[i], items[0].start[i + 1])
        q[items[0].term[span]] = items[0].value[span]
        every = rows.dot(np.arange(4096), q)
        want = np.lexsort((np.arange(4096), -every))[:10]
        assert walk.best[i][0].tolist() == want.tolist() and walk.best[i][1].tolist() == every[want].tolist()


def test_odd_rows(spark):
    docs = [(1, "Älter ÄLTER the cat"), (2, None), (3, ""), (4, "!!! ..."), (5, "the cat " * 20000), (None, "cat"), (6, "the dog"), (6, "the dog"), (7, "日本語 cat2")]
    items = [(1, "the CAT"), (1, "the CAT"), (2, None), (3, ""), (4, "unseen"), (5, "ÄLTER 日本語 dog dog"), (None, "cat")]
    got = m.search(
        spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as DOC_ID", "2 as `a.b`", "3 as n"), spark.createDataFrame(items, ITEMS).selectExpr("*", "4 as terms")
    )
    low = lambda rows: sorted(tuple(-1 if x is None else x for x in r) for r in rows)
    want = brute([(i if i is not None else -(1 << 63), t) for i, t in docs], sorted(set(items), key=str))
    assert low(got.collect()) == low((i, r, None if d == -(1 << 63) else d, s) for i, r, d, s in sorted(want, key=str))


def test_empty_tables(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_d, some_i = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert m.search(none_d, some_i).collect() == [] and m.search(some_d, none_i).collect() == []
    assert [tuple(r)[:3] for r in m.search(some_d, some_i).collect()] == [(1, 1, 1)]
