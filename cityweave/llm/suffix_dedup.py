"""Operator 5: bytes covered by strings of `window` bytes that occur elsewhere, by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first `window` bytes only, most significant digit first, and a suffix leaves as soon as it
is alone in its group; those that stay in a group at full depth are exactly the repeated windows. Which bytes make up
the first digit is free as long as equal windows have equal digits, so the digits are chosen to keep passes narrow:

1. The first digit of a window is its anchor: the GRAM bytes of least hash in it, leftmost first. Neighbouring windows
   share anchors, so one row stands for a run of suffixes (about 80): anchor hash, digest of the run's bytes, place.
   Runs whose anchor occurs once leave.
2. Runs left are grouped by the digest of all their bytes: equal runs are repeated at every start. Of those that differ
   only one of each kind goes on, with its bytes.
3. Kinds of one anchor are compared window by window in a task. Anchors with more than LARGE kinds, such as those of a
   passage that a third of all documents hold, are spread out instead: a kind's windows are cut into blocks of STEP
   starts counted from the anchor, blocks are grouped by the bytes that all windows of the block share (alone: they
   leave), then by all bytes of the block (equal: repeated), and only one of each such group is written out into windows.

Counts are pre-aggregated before every shuffle. Repeated runs become byte intervals, which meet their documents in one
join. Digests are 128 bits. Matches never cross documents. Texts over CHUNK bytes are cut into overlapping pieces; a
run that is cut there differs from its equals as a whole and meets them in the third pass.

Defined cases: a null text counts as empty; texts shorter than the window lose nothing; equal rows repeat each other;
null and equal ids are kept as they are, one result for each row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, dropped, hot_keys, partitions_for, release, spread_join, staged

WINDOW, GRAM = 200, 32
#: Kinds of one anchor that a task compares in memory; starts in a block where there are more.
LARGE, STEP = 1_000, 16
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes at every place, gram a power of two: halves are combined in doubling steps."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(29)
    step, factor = 1, int(MIX)
    while step < gram:
        h = h[:-step] * np.uint64(factor | 1) + h[step:]
        h ^= h >> np.uint64(31)
        step, factor = step * 2, factor * 0xBF58476D1CE4E5B9 % (1 << 64)
    return h * MIX


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash, leftmost first, of each width consecutive places: minima from block ends meet."""
    n = len(h)
    place = np.uint64((1 << 21) - 1)
    packed = (h & ~place) | np.arange(n, dtype=np.uint64)
    full = -(-n // width) * width
    grid = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = packed
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & place).astype(np.int64)


def runs_of(data: bytes, window: int = WINDOW, gram: int = GRAM):
    """Runs of window starts with a common anchor, for one text: (anchor hash, first start, last start, anchor place)."""
    step = CHUNK
    for lo in range(0, max(1, len(data) - window + 1), step):
        raw = np.frombuffer(data, dtype=np.uint8)[lo : lo + step + window - 1]
        if len(raw) < window:
            return
        h = gram_hashes(raw, gram)
        anchor = least_in_windows(h, window - gram + 1)
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        yield h[anchor[cut]].view(np.int64), cut + lo, np.r_[cut[1:], len(anchor)] - 1 + lo, anchor[cut] + lo


def of(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def pairs_of(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """Every run: hash of the anchor, digest of the bytes (d1, d2), text (k1, k2), first and last start, place of the
    anchor after the first start."""
    names = ["anchor", "d1", "d2", "k1", "k2", "lo", "hi", "off"]

    def run(batches):
        for batch in batches:
            rows, digests, have = [], [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for a, lo, hi, place in runs_of(data, window):
                    digests += [of(data[x:y]) for x, y in zip(lo.tolist(), (hi + window).tolist())]
                    rows.append((a, np.full(len(a), k1), np.full(len(a), k2), lo, hi, place - lo))
                    have += len(a)
                if have > 50_000:
                    yield made(rows, digests)
                    rows, digests, have = [], [], 0
            if have:
                yield made(rows, digests)

    def made(rows, digests):
        a, k1, k2, lo, hi, off = (np.concatenate(c) for c in zip(*rows))
        small = [pa.array(c.astype(np.int32)) for c in (lo, hi, off)]
        return pa.RecordBatch.from_arrays([pa.array(a), *pairs_of(digests), pa.array(k1), pa.array(k2), *small], names)

    long_enough = texts.where(F.octet_length("text") >= window).select("k1", "k2", "text")
    return long_enough.mapInArrow(run, "anchor long, d1 long, d2 long, k1 long, k2 long, lo int, hi int, off int")


def compared(kinds: DataFrame, window: int, parts: int) -> DataFrame:
    """(d1, d2, lo, hi): ranges lo .. hi - 1 of starts (counted from the run's) at which kinds (anchor, d1, d2, bytes)
    repeat another of their anchor. All kinds of an anchor meet in one task."""

    def run(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame])
            last = rest["anchor"].to_numpy() == rest["anchor"].iloc[-1]
            if len(rest) > 2_000 and not last.all():
                yield found(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield found(rest)

    def found(frame):
        out = []
        for _, group in frame.groupby("anchor", sort=False):
            first: dict[bytes, tuple[int, int]] = {}
            hits: set[tuple[int, int]] = set()
            for i, data in enumerate(group["bytes"]):
                for at in range(len(data) - window + 1):
                    other = first.setdefault(of(data[at : at + window]), (i, at))
                    if other[0] != i:
                        hits |= {other, (i, at)}
            d1, d2 = group["d1"].to_numpy(), group["d2"].to_numpy()
            own = sorted(hits)
            firsts = [h for h, g in zip(own, [(-1, -1), *own]) if h != (g[0], g[1] + 1)]
            lasts = [h for h, g in zip(own, [*own[1:], (-1, -1)]) if g != (h[0], h[1] + 1)]
            out += [(d1[i], d2[i], lo, hi + 1) for (i, lo), (_, hi) in zip(firsts, lasts)]
        return pd.DataFrame(out, columns=["d1", "d2", "lo", "hi"])

    dealt = kinds.select("anchor", "d1", "d2", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, "d1 long, d2 long, lo int, hi int")


def spread_out(kinds: DataFrame, window: int, step: int = STEP) -> DataFrame:
    """The same for kinds (d1, d2, off, bytes) of anchors that have very many, without bringing those together."""

    def blocks(off: int, data: bytes):
        """Of each block of starts: first start, past the last start, the bytes that all windows of the full block share."""
        starts = len(data) - window + 1
        for b in range((off - starts + 1) // step, off // step + 1):  # starts off - b*step - step + 1 .. off - b*step
            lo, hi = max(0, off - b * step - step + 1), min(starts, off - b * step + 1)
            if lo < hi:
                yield lo, hi, data[off - b * step : off - b * step - step + 1 + window]

    def cut(batches):
        for batch in batches:
            for base in range(0, batch.num_rows, 2000):
                rows, core, union = [], [], []
                for d1, d2, off, data in zip(*(c.to_pylist() for c in batch.slice(base, 2000).columns)):
                    for lo, hi, shared in blocks(off, data):
                        rows.append((d1, d2, lo, hi))
                        core.append(of(shared))
                        union.append(of(data[lo : hi - 1 + window]))
                d1, d2, lo, hi = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1), pa.array(d2), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), *pairs_of(core), *pairs_of(union)],
                    ["d1", "d2", "lo", "hi", "c1", "c2", "u1", "u2"],
                )

    def write(batches):
        for batch in batches:
            for base in range(0, batch.num_rows, 1000):
                rows, digests = [], []
                for u1, u2, lo, hi, data in zip(*(c.to_pylist() for c in batch.slice(base, 1000).columns)):
                    rows += [(u1, u2, at) for at in range(hi - lo)]
                    digests += [of(data[lo + at : lo + at + window]) for at in range(hi - lo)]
                u1, u2, at = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u1), pa.array(u2), pa.array(at, pa.int32()), *pairs_of(digests)], ["u1", "u2", "at", "w1", "w2"]
                )

    parts = kinds.select("d1", "d2", "off", "bytes").mapInArrow(
        cut, "d1 long, d2 long, lo int, hi int, c1 long, c2 long, u1 long, u2 long"
    )
    parts = staged(parts, "blocks")
    unlike = lambda a, b: F.min(F.struct(a, b)) != F.max(F.struct(a, b))
    cores = parts.groupBy("c1", "c2").agg(unlike("d1", "d2").alias("met"), unlike("u1", "u2").alias("vary")).where("met")
    left = staged(parts.join(cores.select("c1", "c2", "vary"), ["c1", "c2"]), "blocks-met")
    unions = left.groupBy("u1", "u2").agg(
        unlike("d1", "d2").alias("twice"), F.max("vary").alias("vary"), F.min(F.struct("d1", "d2", "lo", "hi")).alias("one")
    )
    unions = staged(unions, "unions")
    again = unions.where("vary").select("u1", "u2", "one.*").join(kinds.select("d1", "d2", "bytes"), ["d1", "d2"])
    windows = staged(
        again.select("u1", "u2", "lo", "hi", "bytes").mapInArrow(write, "u1 long, u2 long, at int, w1 long, w2 long"), "windows"
    )
    same = windows.groupBy("w1", "w2").agg(unlike("u1", "u2").alias("met")).where("met").select("w1", "w2")
    # of each kind of block the starts that repeat, in one row, so that its blocks stay one row each
    partly = windows.join(same, ["w1", "w2"], "left_semi").groupBy("u1", "u2").agg(F.collect_set("at").alias("at"))
    hits = unions.join(partly, ["u1", "u2"], "left").where("twice or at is not null")
    hits = hits.select("u1", "u2", F.when(~F.col("twice"), F.col("at")).alias("at"))
    lo = F.col("lo")
    every = F.array(F.struct(lo.alias("lo"), F.col("hi").alias("hi")))
    some = F.transform("at", lambda x: F.struct((lo + x).alias("lo"), (lo + x + 1).alias("hi")))
    return left.join(hits, ["u1", "u2"]).select("d1", "d2", F.when(F.col("at").isNull(), every).otherwise(some).alias("at"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, large: int = LARGE) -> DataFrame:
    """(k1, k2, spans): for each text of texts (k1, k2, text) its byte intervals [a, b) under repeated windows, unmerged."""
    spark = texts.sparkSession
    every = staged(anchors(texts, window), "anchors")
    several = staged(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    hot = hot_keys(several, ["anchor"], "n", every.count())
    runs = staged(spread_join(every, several.select("anchor"), ["anchor"], hot, "left_semi"), "runs")
    dropped(spark, every)
    release(spark)
    kinds = runs.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi", "off")).alias("one"))
    kinds = staged(kinds, "kinds")
    mixed = staged(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    hot = hot_keys(mixed, ["anchor"], "m", kinds.count())
    odd = spread_join(kinds, mixed, ["anchor"], hot).select("anchor", "d1", "d2", "m", "one.*")
    held = odd.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "d1", "d2", "m", "lo", "hi", "off")).alias("runs"))
    cut = texts.join(held, ["k1", "k2"]).select(F.encode("text", "UTF-8").alias("raw"), F.explode("runs").alias("r"))
    cut = cut.select("r.anchor", "r.d1", "r.d2", "r.m", "r.off", F.expr(f"substring(raw, r.lo + 1, r.hi - r.lo + {window})").alias("bytes"))
    cut = cut.groupBy("anchor", "d1", "d2", "m", "off").agg(F.first("bytes").alias("bytes"))  # equal texts give the same
    cut = staged(cut, "odd-runs")
    release(spark)
    parts = partitions_for(spark, cut.count(), 20_000)
    found = compared(cut.where(F.col("m") <= large), window, parts).select("d1", "d2", F.array(F.struct("lo", "hi")).alias("at"))
    found = found.unionAll(spread_out(cut.where(F.col("m") > large), window))
    # kinds that occur more than once are repeated as a whole, whatever was found for them besides
    starts = found.groupBy("d1", "d2").agg(F.flatten(F.collect_list("at")).alias("at"))
    twice = kinds.where("n > 1").select("d1", "d2")
    once = starts.join(twice, ["d1", "d2"], "left_anti")
    state = staged(twice.withColumn("at", F.lit(None).cast(starts.schema["at"].dataType)).unionAll(once), "repeated")
    span = lambda lo, hi: F.struct((F.col("lo") + lo).alias("a"), (F.col("lo") + hi + (window - 1)).alias("b"))
    whole = F.array(span(F.lit(0), F.col("hi") - F.col("lo") + 1))
    spans = F.when(F.col("at").isNull(), whole).otherwise(F.transform("at", lambda x: span(x["lo"], x["hi"])))
    hot = staged(hot_keys(kinds, ["d1", "d2"], "n", runs.count()).distinct(), "hot-kinds")
    hit = spread_join(runs, state, ["d1", "d2"], hot).select("k1", "k2", F.explode(spans).alias("s"))
    return staged(hit.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", outputs: tuple = ("kept",), large: int = LARGE
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans) and of outputs kept (the bytes left, binary), spans and kept_sha256."""
    docs = columns_of(docs, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("k1"), F.xxhash64(body, body).alias("k2"))
    spans = repeated_spans(docs, window, large)
    release(docs.sparkSession)
    joined = docs.join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    kinds = {"kept": "binary", "spans": "array<struct<a:int,b:int>>", "kept_sha256": "string"}
    kind = docs.schema["id"].dataType.simpleString()
    types = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), "kept_sha256": pa.string()}

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", *outputs)}
            for value, own in zip(batch.column(1), batch.column(2).to_pylist()):
                data = value.as_py().encode("utf-8", "surrogatepass")
                gone = merged(own or [])
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])) if gone else data
                made = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(gone)}
                made |= {"kept": kept, "spans": [{"a": a, "b": b} for a, b in gone], "kept_sha256": ""}
                if "kept_sha256" in outputs:
                    made["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                for n in out:
                    out[n].append(made[n])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, types.get(n, pa.int64())) for n, v in out.items())], [key, *out]
            )

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long" + "".join(f", {o} {kinds[o]}" for o in outputs)
    return joined.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, outputs=("kept_sha256",))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
