"""Whole-graph components, detours, paired rollouts and sight lines against plain serial forms."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from cityweave.operators import components as co
from cityweave.operators import forecast, impact, network, sight


def reach(edges, a):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for u, v in edges:
            if u == x and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


@pytest.mark.parametrize("seed, n, m", [(0, 12, 18), (1, 25, 40), (2, 6, 3)])
def test_components_equal_mutual_reach(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    got = {x.node: x.component for x in co.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges for x in e}
    to = {a: reach(edges, a) for a in nodes}
    want = {a: min(b for b in nodes if b in to[a] and a in to[b]) for a in nodes}
    assert got == want
    size = {c: sum(v == c for v in want.values()) for c in want.values()}
    best = min(size, key=lambda c: (-size[c], c))
    big = co.largest(spark.createDataFrame(list(want.items()), "node long, component long"))
    assert {x.node for x in big.collect()} == {a for a, c in want.items() if c == best}


def test_components_of_nothing(spark):
    assert co.strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def dijkstra(edges, origin):
    dist, todo = {}, [(0.0, origin)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in dist:
            dist[x] = d
            for (u, v), c in edges.items():
                if u == x:
                    heapq.heappush(todo, (d + c, v))
    return dist


def graph(seed, n=14, m=45):
    r = random.Random(seed)
    return {(u, v): float(r.randrange(1, 9)) for u, v in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if u != v}


def frame(spark, edges):
    return spark.createDataFrame([(u, v, c) for (u, v), c in edges.items()], "src long, dst long, cost double")


def test_refreshed_trees_equal_new_ones(spark):
    old, r = graph(3), random.Random(4)
    new = {e: c * r.choice([0.5, 1, 1, 1, 3]) for e, c in old.items() if r.random() > 0.1} | {(0, 9): 1.0}
    origins = spark.createDataFrame([(o,) for o in range(6)], "origin long")
    before = network.shortest(frame(spark, old), origins)
    after = impact.refreshed(before, frame(spark, old), frame(spark, new))
    got = {(x.origin, x.node): x.dist for x in after.collect()}
    assert got == {(o, v): d for o in range(6) for v, d in dijkstra(new, o).items()}
    for x in after.where("prev is not null").collect():
        assert got[x.origin, x.prev] + new[x.prev, x.node] == x.dist


def test_shortest_from_all_nodes(spark):
    """Origins that an edge enters, that none enters, and that have no edges at all; edges without a cost."""
    edges = graph(5) | {(50 + i, i): 1.0 + i for i in range(4)} | {(50, 3): 0.5, (60, 50): 2.0}
    e = frame(spark, edges | {(61, 0): None})
    every = sorted({u for u, _ in edges} | {61, 70})
    got = network.shortest_from_all(e, spark.createDataFrame([(o,) for o in [*every, 70]], "origin long")).collect()
    want = {(o, v): d for o in every for v, d in dijkstra(edges, o).items()}
    assert len(got) == len(want) and {(x.origin, x.node): x.dist for x in got} == want


def test_shortest_times_start_from_every_node(spark):
    from cityweave.plans import network as plans

    at = "/root/testdata/sf0.001"
    nodes = {r[0] for r in plans.edges(spark, at).select("src").distinct().collect()} | {r[0] for r in plans.origins(spark, at).collect()}
    assert {r[0] for r in plans.times(spark, at).select("origin").distinct().collect()} == nodes


def test_exits_with_every_turn_of_a_remainder_banned(spark):
    rng = random.Random(6)
    roads = {n: (rng.randrange(8), rng.randrange(9)) for n in rng.sample(range(-40, 200), 90)}
    frame_ = spark.createDataFrame([(n, u, v) for n, (u, v) in roads.items()], "road long, u long, v long")
    want = {}
    for a, (_, v) in roads.items():
        if to := [b for b, (u, _) in roads.items() if u == v and (a + b) % 3]:
            want[a] = (len(to), min(to))
    got = network.exits_modulo(frame_, 3).collect()
    assert len(got) == len(want) and {r.from_road: (r.exits, r.first_exit) for r in got} == want


def bpr(v, c):
    return 1 + 0.15 * (v / c) ** 4


def test_detours_without_and_with_congestion(spark):
    edges = {(0, 1): 1.0, (1, 3): 1.0, (0, 2): 2.0, (2, 3): 2.0, (4, 2): 1.0, (3, 5): 1.0}
    rows = [(u, v, c, 10.0, 5.0) for (u, v), c in edges.items()]
    e = spark.createDataFrame(rows, "src long, dst long, cost double, capacity double, flow double")
    trips = spark.createDataFrame([(0, 3, 20), (4, 3, 3), (4, 5, 1), (0, 1, 2), (1, 0, 1)], "origin long, dest long, n long")
    shut = spark.createDataFrame([(1, 3, True, 1.0)], "src long, dst long, closed boolean, factor double")
    plain = {(x.origin, x.dest): x for x in impact.detours(e, trips, shut).collect()}
    assert (plain[0, 3].before, plain[0, 3].after, plain[0, 3].direct, plain[0, 3].closed) == (2.0, 4.0, True, True)
    assert (plain[4, 3].before, plain[4, 3].after, plain[4, 3].direct) == (3.0, 3.0, False) and plain[1, 0].before is None
    full = impact.detours(e, trips, shut, rounds=2)
    got = {(x.origin, x.dest): x for x in full.collect()}
    slow = bpr(25.0, 10.0) / bpr(5.0, 10.0)  # the 20 diverted trips share both edges of the only other way
    assert math.isclose(got[0, 3].after, 4.0 * slow) and math.isclose(got[4, 3].after, 1.0 + 2.0 * slow)
    assert got[0, 1].after <= got[0, 1].before
    s = impact.detour_summary(full).first()
    assert (s.trips, s.affected, s.cut_off, s.held_up) == (26, 20, 0, 4)
    assert math.isclose(s.held_up_p50, 2 * slow - 2) and math.isclose(s.delay_mean, 4 * slow - 2)


def test_lines_hit(spark):
    lines = spark.createDataFrame([("a", 0, 1), ("a", 1, 3), ("b", 0, 2)], "line string, src long, dst long")
    shut = spark.createDataFrame([(1, 3, True, 1.0), (0, 2, False, 0.5)], "src long, dst long, closed boolean, factor double")
    assert [tuple(x) for x in impact.lines_hit(lines, shut).collect()] == [("a", 2, 1)]


def test_paired_rollout_equals_two_runs(spark):
    labels = ["a", "b", "c"]
    matrix = spark.createDataFrame([(x, y, p) for x in labels for y, p in zip(labels, (0.5, 0.3, 0.2))], "current_state string, target_state string, p double")
    objects = spark.createDataFrame([(i, labels[i % 3]) for i in range(40)], "object_id long, state string")
    levers = spark.createDataFrame([(i, 1 + i % 2, "b", 2.0) for i in range(0, 40, 4)], "object_id long, step int, target_state string, delta double")
    key = ["draw", "step", "object_id"]
    both = forecast.paired_rollout(objects, matrix, labels, 3, 6, levers)
    got = {tuple(x[c] for c in key): (x.state, x.usual) for x in both.collect()}
    one = {tuple(x[c] for c in key): x.state for x in forecast.rollout(objects, matrix, labels, 3, 6, levers=levers).collect()}
    none = {tuple(x[c] for c in key): x.state for x in forecast.rollout(objects, matrix, labels, 3, 6).collect()}
    assert got == {k: (one[k], none[k]) for k in one} and len(got) == 3 * 6 * 40
    assert all(a == b for (_, _, i), (a, b) in got.items() if i % 4) and any(a != b for a, b in got.values())
    still = forecast.paired_bands(both.where("object_id % 4 > 0"), ["step"], {"b": lambda c: F.count_if(c == "b")})
    assert {(x.p05, x.p50, x.p95, x.higher) for x in still.collect()} == {(0.0, 0.0, 0.0, 0.0)}


def test_crossed_cells_hold_every_point_of_the_line(spark):
    r = random.Random(5)
    rows = [(i, *(r.uniform(-3, 3) for _ in range(4))) for i in range(40)] + [(40, 1.0, -2.0, 1.0, 2.0), (41, -2.0, 1.0, 2.0, 1.0), (42, 0.5, 0.5, 0.5, 0.5)]
    got = {}
    for x in sight.crossed_cells(spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double"), 0.5).collect():
        got.setdefault(x.i, set()).add((x._cx, x._cy))
    for i, x1, y1, x2, y2 in rows:
        on = {(math.floor((x1 + t / 999 * (x2 - x1)) / 0.5), math.floor((y1 + t / 999 * (y2 - y1)) / 0.5)) for t in range(1000)}
        assert on <= got[i] and len(got[i]) <= len(on) + 6


def test_sight_lines_stop_at_the_first_blocker(spark):
    wall = lambda b, x: [(b, k, *e) for k, e in enumerate([(x, -1.0, x + 0.5, -1.0), (x + 0.5, -1.0, x + 0.5, 1.0), (x + 0.5, 1.0, x, 1.0), (x, 1.0, x, -1.0)])]
    walls = spark.createDataFrame(wall(1, 5.0) + wall(2, 9.0), "building long, edge int, x1 double, y1 double, x2 double, y2 double")
    photos = spark.createDataFrame([(7, 0.0, 0.0, 90.0), (8, 0.0, 0.0, 270.0)], "id long, x double, y double, heading double")
    inside = spark.createDataFrame([], "id long, polygon long")
    got = {(x.photo, x.building): x for x in sight.seen_walls(photos, walls, inside, least=1.0, most=20.0, size=1.0).collect()}
    assert {k[0] for k in got} == {7}
    assert got[7, 1].clear == 3 and got[7, 1].candidates == 6 and got[7, 1].dist == 5.0  # the front, not the back
    assert got[7, 2].clear == 0 and got[7, 2].dist is None
    hits = sight.first_hits(spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0)], "ray int, x1 double, y1 double, x2 double, y2 double"), walls, 1.0).collect()
    assert [(x.at, x.building) for x in hits] == [(0.25, 1)]


def test_previous_value_across_spans(spark):
    from cityweave.operators.windows import with_previous

    rows = [(k, v) for k in (0, 1) for v in (1, 2, 9, 10, 11, 40, 95)] + [(2, 50)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {(x.k, x.v): x.p for x in with_previous(df, ["k"], "v", F.floor(F.col("v") / 10), "p").collect()}
    want = {}
    for k, v in rows:
        want[k, v] = max((b for a, b in rows if a == k and b < v), default=None)
    assert got == want


def test_rays_stop_at_the_same_walls_by_angle_as_by_trying_all():
    import numpy as np

    rng = random.Random(31)
    eye = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(6)] + [(0.5, 0.0)]
    rays = np.array([(*p, p[0] + rng.uniform(-1, 1), p[1] + rng.uniform(-1, 1)) for p in eye for _ in range(60)])
    walls = [(x, y, x + rng.uniform(-0.4, 0.4), y + rng.uniform(-0.4, 0.4)) for x, y in ((rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(40))]
    walls = np.array(walls + [(0.0, 0.0, 1.0, 0.0), (*eye[0], eye[0][0] + 0.1, eye[0][1]), (-3.0, -0.1, 3.0, 0.1), (0.2, 0.2, 0.2, 0.2)])
    want = []
    for ax, ay, bx, by in rays:
        with np.errstate(all="ignore"):
            rx, ry, ex, ey = bx - ax, by - ay, walls[:, 2] - walls[:, 0], walls[:, 3] - walls[:, 1]
            turn = rx * ey - ry * ex
            t, s = ((walls[:, 0] - ax) * ey - (walls[:, 1] - ay) * ex) / turn, ((walls[:, 0] - ax) * ry - (walls[:, 1] - ay) * rx) / turn
            want.append(bool(((turn != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)).any()))
    got = sight.stopped(*rays.T, walls)
    assert got.tolist() == want and 0 < sum(want) < len(want)
    assert sight.stopped(*rays.T, walls[:0]).sum() == 0
