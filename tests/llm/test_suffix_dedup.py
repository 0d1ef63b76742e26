import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cityweave.llm import suffix_dedup as sd


def brute(rows, window=200):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        count.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[1 + s : 1 + s + window] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(60) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(40)
            parts += [p if rng.random() < 0.5 else p[a : a + 220 + rng.randrange(40)], text(rng.randrange(30))]
        docs.append(rng.choice([" ", ""]).join(parts))
    docs += docs[:3] + [docs[4][:-1] + "!", "x" + docs[5], None, "", "short", "z" * 450, "ab" * 180, docs[6] + docs[6]]
    return [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (3, docs[3])]


def run(df, **options):
    out = sd.remove_repeats(df, outputs=("kept_sha256",), **options)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed,large", [(0, 1000), (0, 1), (1, 2)])
def test_against_brute_force(spark, seed, large):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, K1 string")
    assert run(df, large=large) == brute(rows)


def test_query_and_long_texts(spark, tmp_path, monkeypatch):
    rows = corpus(3, 12)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(sd.CHUNK + 3000))
    rows += [(100, long), (101, "q" + long[1000:])]
    spark.createDataFrame(rows[:-2], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, sd.op5_suffix_dedup(spark, str(tmp_path)).collect()), key=str) == brute(rows[:-2])
    got = {r[0]: r[1:4] for r in run(spark.createDataFrame(rows[-2:], "doc_id long, text string"))}
    assert got == {100: (len(long), len(long) - 1000, 1), 101: (len(long) - 999, len(long) - 1000, 1)}


def test_runs_cover_every_start_once_with_its_least_gram():
    data = "".join(random.Random(1).choice("abc ") for _ in range(3000)).encode()
    h = sd.gram_hashes(np.frombuffer(data, np.uint8), sd.GRAM)
    width, at = sd.WINDOW - sd.GRAM + 1, 0
    for hashes, lo, hi, place in sd.runs_of(data):
        for a, x, y, p in zip(hashes, lo, hi, place):
            assert x == at and a.view(np.uint64) == h[p]
            for s in range(x, y + 1):
                assert p == s + int(np.argmin(h[s : s + width] >> np.uint64(21)))
            at = y + 1
    assert at == len(data) - sd.WINDOW + 1


def test_empty_table_and_real_outputs(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "".join(random.Random(2).choice("abcdef") for _ in range(300))
    out = sd.remove_repeats(spark.createDataFrame([(1, t + "1"), (2, "2" + t)], "doc_id long, text string"), outputs=("kept", "spans"))
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in out.collect()}
    assert got == {1: (b"1", [(0, 300)]), 2: (b"2", [(1, 301)])}
