import random

import pytest

from cityweave.llm import mixing


def docs(spark, sizes, extra=()):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame([*rows, *extra], "doc_id long, source string")


def check(out, slots, sizes, weights, block):
    rows = sorted((r._slot, r._in_block, r.source, r._block, r.doc_id) for r in out.collect())
    assert len(rows) == sum(sizes.values()) and len({r[4] for r in rows}) == len(rows)
    order = [s for s, b in sorted({(r[0], (r[2], r[3])) for r in rows}, key=lambda x: x[0])]
    assert order == list(range(slots))
    sources = sorted(sizes, key=lambda s: (s is not None, s))
    seq = [src for _, src in sorted({(r[0], r[2]) for r in rows}, key=lambda x: x[0])]
    for s in sources:  # blocks of a source stay in order and are full but for the last
        own = sorted({(r[0], r[3]) for r in rows if r[2] == s})
        assert [b for _, b in own] == list(range(-(-sizes[s] // block)))
    for p in mixing.plan_phases([-(-sizes[s] // block) for s in sources], [weights[s] for s in sources]):
        done = dict.fromkeys(p["quota"], 0)
        for t in range(p["length"] * p["periods"]):
            done[sources.index(seq[p["slot"] + t])] += 1
            for i, q in p["quota"].items():
                assert abs(done[i] - (t + 1) * q / p["length"]) < 1
    return seq


@pytest.mark.parametrize("seed", [0, 1])
def test_less_than_one_block_from_the_share(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.randrange(1, 90) for i in range(5)} | {"hot": 300}
    weights = {s: rng.randrange(1, 8) for s in sizes}
    out, slots = mixing.mixed(docs(spark, sizes), weights, block_rows=3, bucket_rows=50)
    check(out, slots, sizes, weights, 3)


def earliest_deadline_first(blocks, weights):
    """Source of every slot, slot by slot: of the released blocks the one of least deadline, then least source."""
    out = []
    for p in mixing.plan_phases(blocks, weights):
        for _ in range(p["periods"]):
            done = dict.fromkeys(p["quota"], 0)
            for t in range(p["length"]):
                released = [
                    (-(-(done[i] + 1) * p["length"] // q), i)
                    for i, q in p["quota"].items()
                    if done[i] < q and done[i] * p["length"] // q <= t
                ]
                due, i = min(released)
                assert due > t  # no deadline is missed
                done[i] += 1
                out.append(i)
    return out


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_every_slot_against_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.randrange(1, 60) for i in range(rng.randrange(2, 7))} | {"t": 200}
    weights = {s: rng.randrange(1, 12) for s in sizes}
    out, slots = mixing.mixed(docs(spark, sizes), weights, block_rows=4, bucket_rows=30)
    names = sorted(sizes)
    got = [names.index(s) for _, s in sorted({(r._slot, r.source) for r in out.collect()})]
    assert got == earliest_deadline_first([-(-sizes[s] // 4) for s in names], [weights[s] for s in names])
    assert len(got) == slots


def test_long_periods_are_mixed_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PERIOD", 10)
    sizes, weights = {f"s{i}": 40 for i in range(30)}, {f"s{i}": 1 + i % 3 for i in range(30)}
    out, slots = mixing.mixed(docs(spark, sizes), weights, block_rows=2)
    rows = out.collect()
    assert len({(r._slot, r._in_block) for r in rows}) == len({r.doc_id for r in rows}) == 1200 and slots == 600
    early = [r.source for r in rows if r._slot < 300]  # half of the mix
    for s, w in weights.items():
        assert abs(early.count(s) / 2 - 300 * w / 60) <= 3


def test_null_source_default_weight_and_repeated_rows(spark):
    sizes = {None: 7, "a": 20}
    out, slots = mixing.mixed(docs(spark, sizes), {"a": 3}, block_rows=2)
    check(out, slots, sizes, {None: 1, "a": 3}, 2)
    twice = spark.createDataFrame([(1, "x")] * 5 + [(None, "y")], "doc_id long, source string")
    assert mixing.mixed_order(twice, block_rows=2).count() == 6


def test_order_keeps_rows_and_columns(spark):
    d = docs(spark, {"a": 40, "b": 10}).selectExpr("doc_id", "source", "'t' as text", "1 as k")
    out = mixing.mixed_order(d, weights={"a": 1, "b": 1}, block_rows=1)
    assert out.columns == d.columns
    first = [r.source for r in out.collect()][:20]
    assert first.count("a") == 10


def test_empty_table(spark):
    out, slots = mixing.mixed(spark.createDataFrame([], "doc_id long, source string"))
    assert slots == 0 and out.collect() == []


def test_more_sources_than_one_schedule_takes(spark):
    rng = random.Random(4)
    sizes = {f"s{i}": rng.randrange(1, 6) for i in range(600)} | {"hot": 400, None: 3}
    weights = {s: 40 if s == "hot" else 1 for s in sizes}
    out, slots = mixing.mixed(docs(spark, sizes), weights, block_rows=2, bucket_rows=50)
    rows = sorted((r._slot, r._in_block, r.source, r._block, r.doc_id) for r in out.collect())
    assert len(rows) == sum(sizes.values()) == len({r[4] for r in rows})
    placed = {(r[2], r[3]) for r in rows}
    assert placed == {(s, b) for s, n in sizes.items() for b in range(-(-n // 2))}
    taken = {r[0]: (r[2], r[3]) for r in rows}
    assert sorted(taken) == list(range(slots)) and len(set(taken.values())) == slots
    for s in sizes:
        own = [slot for slot, (name, _) in sorted(taken.items()) if name == s]
        assert [taken[slot][1] for slot in own] == list(range(len(own)))
    # while no source has run out, each is less than a block a level (603, 31, 2 members: three levels) from its share
    total, first = sum(weights.values()), 300
    hot = 0
    for t in range(first):
        hot += taken[t][0] == "hot"
        assert abs(hot - (t + 1) * 40 / total) < 3
    assert mixing.mixed_order(docs(spark, sizes), weights=weights).count() == sum(sizes.values())


@pytest.mark.parametrize(("limit", "leaf", "stretch"), [(10, 4, 7), (10, 64, 50_000), (20_000, 64, 50_000)])
def test_one_schedule_at_every_size(spark, monkeypatch, limit, leaf, stretch):
    """Folded or dealt, in short stretches or long ones, every slot is that of brute force."""
    monkeypatch.setattr(mixing, "MAX_PERIOD", limit)
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    rng = random.Random(9)
    blocks = [rng.randrange(1, 30) for _ in range(25)] + [3] * 5
    weights = [rng.randrange(1, 9) for _ in range(25)] + [2] * 5
    got = sorted((r._slot, r._src, r._block) for r in mixing.slots_of(spark, blocks, weights).collect())
    assert [s for s, _, _ in got] == list(range(sum(blocks)))
    assert [src for _, src, _ in got] == earliest_deadline_first(blocks, weights)
    for i, n in enumerate(blocks):
        assert [b for _, src, b in got if src == i] == list(range(n))


def test_more_sources_than_a_fold_takes_against_brute_force(spark):
    blocks, weights = [2 + i % 3 for i in range(520)] + [90], [1 + i % 2 for i in range(520)] + [40]
    got = sorted((r._slot, r._src) for r in mixing.slots_of(spark, blocks, weights).collect())
    assert [src for _, src in got] == earliest_deadline_first(blocks, weights)


def test_order_within_a_source_does_not_depend_on_buckets(spark):
    d = docs(spark, {"a": 300, "b": 50})
    place = lambda rows: {r.doc_id: (r._slot, r._in_block) for r in mixing.mixed(d, bucket_rows=rows)[0].collect()}
    assert place(10) == place(1000)
