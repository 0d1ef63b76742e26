"""Weighted sampling against a plain evaluation, generalised Jaccard similarity and the defined cases."""

import hashlib
import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cityweave.llm import weighted_sampling as w

AT = "/root/testdata/sf0.01"


def words(text):
    return Counter(x for x in text.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x)


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return 1.0 if not keys else sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def samples(counts, n):
    """The (term, t) that each sample takes, evaluated word by word."""
    out = []
    for k in range(n):
        least = (math.inf, None)
        for word, count in counts.items():
            seed = xxhash.xxh64_intdigest(word.encode(), 42)
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42))
            u = [((h >> (12 * i)) & 4095) / 4096 + 0.5 / 4096 for i in range(4)]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[2] * u[3]), ((h >> 48) + 0.5) / 65536
            t = math.floor(math.log(count) / r + b)
            y = math.exp(r * (t - b))
            least = min(least, (c / (y * math.exp(r)), (word, t)))
        out.append(least[1])
    return out


def test_samples_are_those_of_the_plain_method(spark):
    texts = ["a b a c d e f a b", "b c d x y z z z z", "q", "a b c d e f g h i j k a a a a b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in w.fingerprints(df).collect()}
    mine = {i: samples(words(t), w.SAMPLES) for i, t in enumerate(texts)}
    for i in mine:
        for j in mine:
            assert [x == y for x, y in zip(mine[i], mine[j])] == [x == y for x, y in zip(got[i], got[j])]


def test_collision_rate_is_generalised_jaccard(spark):
    rows = [(d, f"t{t}", float(1 + (t * (d + 3)) % 5) * (0.3 if d == 2 else 1.0)) for d in range(3) for t in range(d * 10, 60 + d * 5)]
    df = spark.createDataFrame(rows, "d int, term string, weight double")
    got = {r.d: r.f for r in w.weighted_signatures(df, ["d"], {"f": "weight"}, samples=512).collect()}
    of = {d: Counter({t: x for e, t, x in rows if e == d}) for d in range(3)}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        rate = sum(x == y for x, y in zip(got[a], got[b])) / 512
        assert abs(rate - jaccard(of[a], of[b])) < 0.08


def brute(docs):
    """{row: (doc_id, n_chars, edited sha, likeness to edited, to next)} by plain Jaccard, rows in order."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(words(t), words(edited)), jaccard(words(t), words(after))))
    return out


def test_query_against_plain_jaccard(spark):
    got = {r.doc_id: r for r in w.op12_weighted_sampling(spark, AT).collect()}
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{AT}/documents.parquet").collect()]
    want = brute(table)
    assert len(got) == len(want)
    off = []
    for i, n, sha, edited, after in want:
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        off += [r.near_edited - edited, r.near_next - after]
        assert max(abs(off[-1]), abs(off[-2])) < 0.45
    assert abs(sum(off) / len(off)) < 0.04  # common words make the errors of documents go together
    texts = dict(table)
    by = {}
    for i, t in texts.items():
        assert by.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by.values())) > 0.99 * len(by)  # texts that differ in white space or case alone have equal words


def test_odd_rows(spark):
    rows = [(1, "a b c d")] * 3 + [(2, "é\U0001F600ü"), (None, "q r s"), (None, None), (3, None), (3, ""), (4, "one " * 3000), (5, " \n\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("a.b"), F.lit(3).alias("n"))
    got = w.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    ones = [r for r in got if r.doc_id == 1]
    assert sorted(r.near_next for r in ones)[1:] == [1.0, 1.0] and len({r.fingerprint for r in ones}) == 1
    assert sorted(key(r)[:3] for r in got if r.doc_id in (2, 4, 5)) == sorted(key(r)[:3] for r in brute(rows) if r[0] in (2, 4, 5))
    blank = {r.fingerprint for r in got if r.doc_id in (3, 5)}
    assert len(blank) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


@pytest.mark.parametrize("rows", [[], [(7, "only one here")]])
def test_empty_and_single(spark, rows):
    got = w.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.near_next == 1.0 for r in got)
