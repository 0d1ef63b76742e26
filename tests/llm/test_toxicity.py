import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cityweave.llm import toxicity as tx


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in tx.op6_toxicity(spark, at).collect()}
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [r for r in spark.read.parquet(f"{at}/labels.parquet").collect() if got[r.doc_id].held_out]
    pos = [got[r.doc_id].score for r in labels if r.toxic == 1]
    neg = [got[r.doc_id].score for r in labels if r.toxic == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    right = sum(got[r.doc_id].predicted == r.toxic for r in labels) / len(labels)
    assert auc >= 0.95 and right >= 0.95, (auc, right)


def biased(spark, n=600):
    """Toxic texts often name one group; clean ones seldom do."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(12)]
        toxic = i % 2
        if toxic:
            words += rng.sample(["rotten", "filthy", "vermin", "scumbag"], rng.randrange(0, 3))
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("muslim")
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swaps_lower_scores_of_neutral_mentions(spark):
    rows = biased(spark)
    scores = {}
    for weight in (0.0, 20.0):
        model = tx.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), swap_weight=weight)
        scores[weight] = [model.score(t) for t in ("my muslim neighbour baked bread", "my christian neighbour baked bread", "you filthy rotten vermin")]
    plain, fair = scores[0.0], scores[20.0]
    assert abs(fair[0] - fair[1]) < 0.25 * abs(plain[0] - plain[1])
    assert fair[0] < 0.7 <= plain[0] and fair[2] > 0.7


def test_swaps():
    assert tx.swaps("no one here", tx.IDENTITY_TERMS) == []
    got = tx.swaps("the muslim and the women", tx.IDENTITY_TERMS)
    assert got[0] == "the christian and the men" and len(got) == 2


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, None), (None, 1)]])
def test_defined_cases(spark, labels):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "stupid", "x")], "doc_id long, text string, SCORE string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = tx.scored(docs.drop("SCORE"), model).collect()
    want = 0.5 if labels == [(1, 1)] else 0.0
    assert len(out) == 3 and all(abs(r.score - want) < 1e-6 for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert tx.scored(docs, model).collect() == []


def test_sample_is_bounded_in_rows(spark):
    """A third of all rows share one labelled id, and another part is one repeated row."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 2L, id) as doc_id", "if(id % 3 = 1, 'same', concat('text ', id)) as text")
    docs = docs.unionAll(spark.range(900).selectExpr("4L as doc_id", "'one text' as text"))
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    for n_toxic, n_clean in ((20, 30), (5000, 5000)):
        rows = tx.sample_of(docs, labels, "doc_id", "text", "toxic", n_toxic, n_clean)
        size = Counter(r.toxic for r in rows.select("toxic").collect())
        assert size[1] <= n_toxic and size[0] <= n_clean
        assert sum(r.text == "one text" for r in rows.collect()) <= 1
    held = {i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 == 1}
    want = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in held}
    assert sum(size.values()) == len(want)


def test_toxic_labels_alone_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([(i, 1) for i in range(7)], "doc_id long, toxic int"))
    assert all(r.score < tx.THRESHOLD for r in tx.scored(docs, model).collect())


def test_features_equal_a_plain_count(spark):
    rows = biased(spark, 200)
    sample = rows.select("text", "toxic")
    names, n1, n0 = tx.selected(sample)
    seen = {1: Counter(), 0: Counter()}
    for r in sample.collect():
        seen[r.toxic].update(tx.features(r.text))
    ratio = lambda f: (seen[1][f] / n1) / ((seen[0][f] + 0.5) / n0)
    want = {f for f, n in seen[1].items() if n >= tx.MIN_DOCS and ratio(f) >= tx.LEAST_RATIO}
    assert set(names) == want and (n1, n0) == (100, 100)
    gains = [seen[1][f] * np.log(ratio(f)) for f in names]
    assert gains == sorted(gains, reverse=True)


def test_solution_equals_plain_gradient_steps():
    r = np.random.default_rng(0)
    x, y = r.integers(0, 2, (60, 5)).astype(float), r.integers(0, 2, 60).astype(float)
    pairs = r.integers(-1, 2, (9, 5)).astype(float)
    w, bias = tx.solve(x, y, pairs)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    v, b = np.zeros(5), 0.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ v + b)))
        v = v - 0.05 * (x.T @ (share * (p - y)) + tx.RIDGE / 5**0.5 * v + 2 * tx.SWAP_WEIGHT * pairs.T @ (pairs @ v) / len(pairs))
        b = b - 0.05 * ((share * (p - y)).sum() + 1e-6 * b)
    assert np.allclose(w, v, atol=1e-4) and abs(b - bias) < 1e-4


def test_clashing_columns(spark):
    rows = [(1, "a", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT int, `a.b` int, score int")
    model = tx.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert tx.scored(docs, model, column="points").columns == [*docs.columns, "points"]
    assert len(tx.scored(docs, model, column="points").collect()) == 1
