"""Operator 2: mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

Rows of a source are put in a stable pseudo-random order and cut into blocks. With integer weights w and period
Q = sum(w), block k of a source has release floor(k * Q / w) and deadline ceil((k + 1) * Q / w); in each slot the released
block with the earliest deadline goes next, the one of the least source of several. As the weights of one processor add
up to one, every block meets its deadline, so at any time each source is less than one block from its share. The schedule
repeats after Q slots, so it is made once and every block finds its slot by arithmetic and a join.

Sources run out at different times: a phase runs whole periods while every source can fill them; then one shorter period
takes the rest of those that cannot, and the others go on with their weights. No row is dropped or repeated.

A hot source is ranked in ranges of the hash whose counts are summed up first, so no task holds a whole source, and the
order does not depend on how many there are; the counts are joined by bucket. Broadcast is what has BROADCAST_ROWS rows
at most: numbers of sources, phases, blocks with their slots.

The slots of a phase of few sources and slots come from a fold, those of any other from earliest_first(): the very same
schedule, made by shuffles. So the result is one and the same whatever the number of sources and slots.

Defined cases: null is a source of its own; a source without a given weight has weight default_weight; equal rows are
ranked next to each other in any order; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.common import BROADCAST_ROWS, columns_of, dropped, numbered, staged

BLOCK_ROWS = 64
MAX_WEIGHT = 1000
#: Sources and slots of a phase that is made in one fold, whose time grows with the slots' square.
MAX_SOURCES, MAX_PERIOD = 500, 20_000
#: Blocks that one row of earliest_first() places at last, and slots of a stretch that one task runs through.
LEAF, STRETCH = 64, 50_000
#: Rows of a source that one bucket holds, about.
BUCKET_ROWS = 2_000
SEED = 17


def plan_phases(blocks: list[int], weights: list[int], times: list[int] | None = None) -> list[dict]:
    """Phases in order: for each source still active its quota a period and first block; periods, period length, first slot.

    With times, each entry stands for so many sources of equal blocks and weights."""
    times = times or [1] * len(blocks)
    left, done, slot, phases = dict(enumerate(blocks)), [0] * len(blocks), 0, []
    left = {i: n for i, n in left.items() if n}
    while left:
        periods = min(n // weights[i] for i, n in left.items())
        if periods:
            g = math.gcd(*(weights[i] for i in left))
            quota, periods = {i: weights[i] // g for i in left}, periods * g
        else:
            quota, periods = {i: min(n, weights[i]) for i, n in left.items()}, 1
        length = sum(q * times[i] for i, q in quota.items())
        phases.append({"quota": quota, "first": {i: done[i] for i in left}, "periods": periods, "length": length, "slot": slot})
        slot += length * periods
        for i, q in quota.items():
            done[i] += q * periods
            left[i] -= q * periods
        left = {i: n for i, n in left.items() if n}
    return phases


def schedule(spark: SparkSession, phases: list[dict]) -> DataFrame:
    """(phase, src, k, at): slot in the period of each source's k-th block, by earliest deadline among those released."""
    rows = [(p["phase"], p["length"], [int(i) for i in p["quota"]], [int(q) for q in p["quota"].values()]) for p in phases]
    made = spark.createDataFrame(rows, "phase int, length long, srcs array<int>, quota array<long>")
    made = made.withColumn(
        "picks",
        F.expr("""
        aggregate(
          sequence(0L, length - 1),
          struct(transform(quota, q -> 0L) as used, cast(array() as array<int>) as picks),
          (s, t) -> transform(
            array(array_min(transform(quota, (q, i) ->
              if(s.used[i] < q and s.used[i] * length div q <= t,
                 struct(-((-(s.used[i] + 1) * length) div q) + if((s.used[i] + 1) * length % q = 0, 0L, 1L) as due, i as i),
                 null)))),
            best -> struct(
              transform(s.used, (u, i) -> if(i = best.i, u + 1, u)) as used,
              concat(s.picks, array(best.i)) as picks))[0],
          s -> s.picks)
        """),
    )
    slots = made.select("phase", "srcs", F.posexplode("picks").alias("at", "i"))
    w = Window.partitionBy("phase", "i").orderBy("at")
    return slots.select(
        "phase", F.expr("srcs[i]").alias("src"), (F.row_number().over(w) - 1).cast("long").alias("k"), F.col("at").cast("long")
    )


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver, to be broadcast where they are few."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def earliest_first(spark: SparkSession, jobs: DataFrame, total: int) -> DataFrame:
    """(phase, src, k, time) of jobs (phase, src, k, release, due), as many as the slots 0 .. total - 1, that all meet their
    deadlines: in every slot the released job of least (due, src).

    The jobs up to any place in that order take the same slots whatever follows them: they are served as a queue is, which
    idles only where it is empty. So the slots of each half of the jobs are known from running sums of what the first half
    brings and what is served, then those of each quarter within its half's slots, and so on down to LEAF jobs, which take
    the first free slots after their releases one by one."""
    ordered = jobs.orderBy("due", "src", "phase", "k").withColumn("id", F.monotonically_increasing_id())
    ordered = staged(ordered.drop("due"), "jobs-in-order")
    part, base, bases = F.shiftrightunsigned("id", 33).cast("int"), 0, []
    for p, n in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        bases.append((p, base))
        base += n
    rank = F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumn("part", part).join(local(spark, bases, "part int, base long"), "part")
    ranked = staged(ranked.withColumn("rank", rank).drop("part", "base", "id"), "ranked-jobs")
    dropped(spark, ordered)
    slots = spark.range(total).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("time"))
    # of one time the jobs come before the slot
    within = Window.partitionBy("node", "stretch").orderBy("time", F.desc("step"))
    ahead = Window.partitionBy("node").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    leaf = LEAF.bit_length() - 1
    for s in range(max(leaf, (total - 1).bit_length()) - 1, leaf - 1, -1):
        first = ranked.where(F.shiftright("rank", s).bitwiseAND(F.lit(1)) == 0)
        first = first.select(F.shiftright("rank", s + 1).alias("node"), F.col("release").alias("time"), F.lit(1).alias("step"))
        events = slots.select("node", "time", F.lit(-1).alias("step")).unionAll(first).withColumn("stretch", F.expr(f"time div {STRETCH}"))
        events = events.withColumn("sum", F.sum("step").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        events = events.withColumn("least", F.min("sum").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        events = staged(events, "queue")
        whole = events.groupBy("node", "stretch").agg(F.sum("step").alias("net"), F.min("sum").alias("low"))
        whole = whole.withColumn("base", F.coalesce(F.sum("net").over(ahead), F.lit(0)))
        whole = whole.withColumn("low", F.min(F.col("base") + F.col("low")).over(ahead)).drop("net")
        served = events.where("step < 0").join(whole, ["node", "stretch"])
        waiting = F.col("base") + F.col("sum") + 1 - F.least(F.lit(0), F.col("low"), F.col("base") + F.col("least"))
        old, slots = slots, staged(served.select((F.col("node") * 2 + F.when(waiting > 0, 0).otherwise(1)).alias("node"), "time"), "slots")
        for gone in (events, old):
            dropped(spark, gone)
    own = ranked.groupBy(F.shiftright("rank", leaf).alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "release", "phase", "src", "k"))).alias("jobs"))
    free = slots.groupBy("node").agg(F.sort_array(F.collect_list("time")).alias("free"))
    placed = own.join(free, "node").withColumn(
        "times",
        F.expr("""
        aggregate(jobs, struct(free as free, cast(array() as array<long>) as times),
          (s, j) -> transform(
            array(array_min(filter(s.free, t -> t >= j.release))),
            best -> struct(array_remove(s.free, best) as free, concat(s.times, array(best)) as times))[0],
          s -> s.times)
        """),
    )
    return placed.select(F.explode(F.arrays_zip("jobs", "times")).alias("z")).select("z.jobs.phase", "z.jobs.src", "z.jobs.k", F.col("z.times").alias("time"))


def slots_of(spark: SparkSession, blocks: list[int], weights: list[int]) -> DataFrame:
    """(_src, _block, _slot) of every block; sources of equal blocks and weights are planned as one."""
    alike = Counter(zip(blocks, weights))
    kinds = {kind: n for n, kind in enumerate(alike)}
    of = [kinds[kind] for kind in zip(blocks, weights)]
    phases = plan_phases([n for n, _ in alike], [w for _, w in alike], list(alike.values()))
    members: dict[int, list[int]] = {}
    for i, kind in enumerate(of):
        members.setdefault(kind, []).append(i)
    folded, long, offset, offsets = [], [], 0, []
    for n, p in enumerate(phases):
        if p["length"] <= MAX_PERIOD and sum(len(members[kind]) for kind in p["quota"]) <= MAX_SOURCES:
            quota = dict(sorted((i, q) for kind, q in p["quota"].items() for i in members[kind]))
            folded.append({"phase": n, "length": p["length"], "quota": quota})
        else:
            long += [(n, kind, q, p["length"], offset) for kind, q in p["quota"].items()]
            offsets.append((n, offset))
            offset += p["length"]
    member = local(spark, list(enumerate(of)), "src int, kind int")
    at = schedule(spark, folded)
    if long:
        jobs = local(spark, long, "phase int, kind int, quota long, length long, start long").join(member, "kind")
        jobs = jobs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
        release, due = F.expr("start + k * length div quota"), F.expr("start + ((k + 1) * length + quota - 1) div quota")
        found = earliest_first(spark, jobs.select("phase", "src", "k", release.alias("release"), due.alias("due")), offset)
        found = found.join(local(spark, offsets, "phase int, start long"), "phase")
        at = at.unionByName(found.select("phase", "src", "k", (F.col("time") - F.col("start")).alias("at")))
    spans = [(n, kind, p["first"][kind], q, p["length"], p["periods"], p["slot"]) for n, p in enumerate(phases) for kind, q in p["quota"].items()]
    spans = local(spark, spans, "phase int, kind int, first long, quota long, length long, periods long, slot0 long")
    out = at.join(member, "src").join(spans, ["phase", "kind"])
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("periods") - 1)).alias("turn"))
    return out.select(F.col("src").alias("_src"), F.expr("first + turn * quota + k").alias("_block"), F.expr("slot0 + turn * length + at").alias("_slot"))


def root_weights(counts: dict) -> dict:
    """Weights in proportion to the square root of a source's rows, 1 to 100."""
    top = max(counts.values(), default=1)
    return {s: max(1, round(100 * math.sqrt(n / top))) for s, n in counts.items()}


def mixed(
    docs: DataFrame,
    weights: dict | None = None,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    default_weight: int = 1,
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, int]:
    """docs with _block (of its source), _slot (of the block in the mix) and _in_block; and the number of slots.

    weights: positive integers by source; None takes root_weights. Ordering by (_slot, _in_block) gives the mix."""
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in columns_of(docs, source).groupBy(source).count().collect()}
    given = root_weights(counts) if weights is None else weights
    names = sorted(counts, key=lambda s: (s is not None, s))
    weight = [int(given.get(s, default_weight)) for s in names]
    if any(not 0 < w <= MAX_WEIGHT for w in weight):
        raise ValueError(f"weights are integers from 1 to {MAX_WEIGHT}")
    blocks = [-(-counts[s] // block_rows) for s in names]
    total = sum(blocks)
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    col = lambda name: F.col(f"_c{docs.columns.index(name)}")
    bits = max(0, math.ceil(math.log2(max(1, max(counts.values(), default=1) / bucket_rows))))
    number = local(spark, [(s, i) for i, s in enumerate(names)], "_name string, _src int")
    named = plain.join(number, col(source).cast("string").eqNullSafe(F.col("_name"))).drop("_name")
    ranked = named.withColumn("_h", F.xxhash64(F.lit(SEED), *(F.col(c) for c in plain.columns)))
    ranked = ranked.withColumn("_bucket", F.shiftright("_h", 64 - bits).cast("int") if bits else F.lit(0))
    per = ranked.groupBy("_src", "_bucket").count()
    base = per.select(
        "_src",
        "_bucket",
        F.coalesce(
            F.sum("count").over(Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_base"),
    )
    within = Window.partitionBy("_src", "_bucket").orderBy("_h", col(key))
    ranked = ranked.withColumn("_rn", F.row_number().over(within)).join(base, ["_src", "_bucket"])
    ordinal = F.col("_base") + F.col("_rn") - 1
    ranked = ranked.withColumn("_block", F.floor(ordinal / block_rows)).withColumn("_in_block", (ordinal % block_rows).cast("int"))
    slots = slots_of(spark, blocks, weight)
    out = ranked.join(F.broadcast(slots) if total <= BROADCAST_ROWS else slots, ["_src", "_block"])
    columns = [F.col(f"_c{i}") for i in range(len(docs.columns))]
    out = out.select(*columns, F.col("_block"), F.col("_slot"), F.col("_in_block"))
    return out.toDF(*docs.columns, "_block", "_slot", "_in_block"), total


def mixed_order(docs: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """All rows and columns of docs, in the order of the mix: partition after partition, sorted within each."""
    plain, at = numbered(docs)
    out, slots = mixed(plain, source=at[source], key=at[key], **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.expr(f"cast(_slot * {n} div {max(1, slots)} as int)")
    out = out.withColumn("_part", place).repartitionById(n, "_part").sortWithinPartitions("_slot", "_in_block")
    return out.drop("_part", "_block", "_slot", "_in_block").toDF(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source")
    out, _ = mixed(docs)
    return out.select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_in_block").alias("in_block")
    )


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
