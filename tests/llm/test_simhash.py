import random
import re

import numpy as np
import pytest
import xxhash

from cityweave.llm import simhash
from cityweave.llm.common import components


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two words", "A b C d e f", "é É\x85x\x1cy z q", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def clustered(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(n // 20 + 1)]
    out = set()
    while len(out) < n:
        c = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_close_pairs_are_all_pairs(n):
    rng = random.Random(n)
    codes = np.array(clustered(rng, n), dtype=np.uint64)
    group = np.array([rng.randrange(1 + n // 60) for _ in codes])
    order = simhash.gray_order(group, codes[:, None])
    codes, group = codes[order], group[order]
    pairs = simhash.close_pairs(group, codes[:, None], 3, most=500)
    got = {(i, j) for a, b in pairs for i, j in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 3
    }
    assert got == want


@pytest.mark.parametrize("large", [3, 10_000])
def test_components_of_fingerprints(spark, large):
    codes = clustered(random.Random(5), 500)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    fps = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {r.node: r.component for r in components(simhash.links(fps, 3, large)).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(60)) for _ in range(12)]
    texts = [None, "", "x", "x", "The end"]
    for b in base:
        words = b.split()
        texts += [b, b.upper(), " ".join([*words[:-1], "zz"]), " ".join(words[1:])]
    rows = [(i, t, "A") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, FP string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, str(tmp_path)).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    comp = plain_components(list(range(len(texts))), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in range(len(texts))}


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(-1, None), (7, 7), (7, 7)]


@pytest.mark.parametrize("large", [4, 2000])
def test_similar_groups(spark, large):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, kind = [], []
    for k in range(30):
        base = [word() for _ in range(120)]
        for v in range(4):
            words = base.copy()
            if v:
                words[rng.randrange(120)] = "edit"
            rows.append((len(rows), " ".join(words)))
            kind.append(4 * k)
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "a c"])]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), large=large).collect()}
    assert [got[i] for i in range(120)] == kind
    assert [got[i] for i in range(120, 124)] == [120, 120, 122, 123]


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def family(rng, count, most, words=300):
    """Variants of one random text, each with up to `most` words replaced."""
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words)]
    out = []
    for v in range(count):
        own = base.copy()
        for at in rng.sample(range(words), rng.randrange(most + 1)):
            own[at] = f"edit{v}x{at}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("large", "limit"), [(5, 10**6), (2000, 2_000), (2000, 10**6)])
def test_families_of_one_candidate_group_at_every_size(spark, large, limit, monkeypatch):
    """All texts share a band; the links are those of all pairs, however the group is cut."""
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [1])
    rng = random.Random(11)
    texts = [t for k in range(6) for t in family(rng, 8, 9, 200)] + family(rng, 1, 0, 200)
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = plain_components(list(range(len(texts))), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, large=large, large_shingles=limit).collect()}
    assert got == want and len(set(want.values())) >= 7


def test_pairs_at_the_threshold_against_brute_force(spark):
    """Pairs of similarity 0.75 to 0.85: all of at least 0.8 are found and none below."""
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(400):
        a, words = family(rng, 1, 0)[0], None
        words = a.split()
        for n, at in enumerate(rng.sample(range(len(words)), rng.randrange(5, 9))):
            words[at] = f"edit{n}"
        b = " ".join(words)
        rows += [(2 * k, a), (2 * k + 1, b)]
        want[k] = jaccard(shingles(a), shingles(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    at_least = [k for k, s in want.items() if 0.8 <= s <= 0.85]
    below = [k for k, s in want.items() if s < 0.8]
    assert len(at_least) > 80 and len(below) > 80
    assert [k for k in at_least if got[2 * k + 1] != 2 * k] == []
    assert [k for k in below if got[2 * k + 1] == 2 * k] == []
