"""Operator 8: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in one pass over the texts and equal ones collapse. Two fingerprints at most `radius` bits apart
agree on at least one of radius + 1 blocks of bits, so each fingerprint goes to the group of each of its blocks, and
groups that are still large are dealt again by blocks of the bits left, which loses no pair. Within a group the
fingerprints are sorted by Gray rank and stand below a tree: each node holds the bits that all below it share (mask and
pattern), with what its parent holds taken out. A search adds up the differences from the root down and drops a whole
node once they exceed the radius. A group yields a spanning forest of its links, never all pairs; the forests are
joined by distributed connected components.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; fewer words than a shingle
give the whole sequence as one shingle; equal rows share a component; null ids are kept as null and never are a
component's smallest id (a component of null ids only has component null); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.common import broadcast_if_small, columns_of, components, dropped, partitions_for, release, staged

FANOUT = 8
#: A group of more fingerprints than this is dealt again by further blocks.
LARGE_GROUP = 2_000
#: Fingerprints that a task takes at least before it searches their groups together.
CHUNK = 50_000
BITS = 64
#: Bands of least hashes that bring together the candidates of similar_groups(), and hashes of a band.
BANDS, BAND_ROWS = 48, 7
#: Shingles of a candidate group that are compared in one task; first sets whose distances to all others are kept.
LARGE_SHINGLES, PIVOTS = 2_000_000, 4


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(length) - 1
    starts = ends - length + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())]
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 19):
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)[lo : lo + (1 << 19)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    docs = columns_of(docs, key, text).select(F.col(key), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fp = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], [key, "fp"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[0].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in reflected Gray order."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def gray_order(group: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Order by group, then Gray rank, the first word of a code (n x words) counting most."""
    return np.lexsort((*(gray_rank(codes[:, w]) for w in range(codes.shape[1] - 1, -1, -1)), group))


def close_pairs(group: np.ndarray, codes: np.ndarray, radius: int, most: int = 1 << 19):
    """Pairs (i, j) of places of one group whose codes (n x words) differ in at most radius bits, in chunks.

    group and codes must be in gray_order(). A chunk looks at no more than about `most` places at once."""
    n = len(codes)
    new = np.r_[True, group[1:] != group[:-1]]
    levels = []  # from the leaves up: first child of each node, how many children there are, mask, pattern
    low, high, start = codes, codes, new
    while True:
        at = np.arange(len(start))
        begin = np.maximum.accumulate(np.where(start, at, 0))
        first = np.flatnonzero((at - begin) % FANOUT == 0)
        low, high = np.bitwise_and.reduceat(low, first, axis=0), np.bitwise_or.reduceat(high, first, axis=0)
        start = start[first]
        levels.append((first, len(at), ~(low ^ high), low))
        if start.all():
            break
    # what a parent holds already is taken out of its children
    below = [np.repeat(np.arange(len(first)), np.diff(np.r_[first, count])) for first, count, *_ in levels]
    held = [mask & ~levels[k + 1][2][below[k + 1]] if k + 1 < len(levels) else mask for k, (*_, mask, _) in enumerate(levels)]
    leaf_mask = ~levels[0][2][below[0]]
    root_of = np.cumsum(new) - 1
    size = np.bincount(root_of)[root_of]
    part = np.cumsum(size) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, n]
    for lo, hi in zip(cuts, cuts[1:]):
        q = np.arange(lo, hi)[size[lo:hi] > 1]
        node, far = root_of[q], np.zeros(len(q), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            first, count, _, pattern = levels[k]
            far = far + popcount((codes[q] ^ pattern[node]) & held[k][node])
            keep = far <= radius
            q, node, far = q[keep], node[keep], far[keep]
            many = np.diff(np.r_[first, count])[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            q, far, node = np.repeat(q, many), np.repeat(far, many), child
        keep = q < node
        q, node, far = q[keep], node[keep], far[keep]
        keep = far + popcount((codes[q] ^ codes[node]) & leaf_mask[node]) <= radius
        yield q[keep], node[keep]


def forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs over n places: each place that is not its tree's first, and that first place."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(n)], dtype=np.int64)
    places = np.flatnonzero(roots != np.arange(n))
    return places, roots[places]


def blocks(first: int, width: int, parts: int) -> list[tuple[int, int]]:
    """Start and width of so many parts of the bits first .. first + width - 1."""
    cuts = [first + width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def deal(fps: DataFrame, radius: int, large: int = LARGE_GROUP) -> DataFrame:
    """(group, fp): each fingerprint in the group of each block; large groups dealt again by blocks of the bits left.

    The bits that a group agrees on need no order, so a second split takes, of the bits outside the first block, again
    radius + 1 parts. Groups that stay large after that hold codes that agree on both blocks."""
    parts = radius + 1
    value = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1))
    first = fps.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("i"), value(a, w).alias("v")) for i, (a, w) in enumerate(blocks(0, BITS, parts))))
        ).alias("k"),
    ).select("fp", "k.i", "k.v")
    first = staged(first, "simhash-blocks")
    heavy = first.groupBy("i", "v").count().where(F.col("count") > large).select("i", "v", F.lit(True).alias("heavy"))
    marked = first.join(heavy, ["i", "v"], "left")
    turned = []
    for i, (a, w) in enumerate(blocks(0, BITS, parts)):
        # rotate the block to the top, so that the bits left are 0 .. BITS - w - 1
        rest = F.shiftrightunsigned("fp", a + w).bitwiseOR(F.shiftleft("fp", BITS - a - w)) if a + w < BITS else F.col("fp")
        cut = blocks(0, BITS - w, parts)
        turned.append(
            F.when(
                F.col("i") == i,
                F.array(
                    *(
                        F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(rest, b).bitwiseAND(F.lit((1 << c) - 1)).alias("u"))
                        for j, (b, c) in enumerate(cut)
                    )
                ),
            )
        )
    again = marked.where("heavy").select("fp", "i", "v", F.explode(F.coalesce(*turned)).alias("k"))
    return marked.where("heavy is null").select(F.xxhash64("i", "v").alias("group"), "fp").unionAll(
        again.select(F.xxhash64("i", "v", "k.j", "k.u").alias("group"), "fp")
    )


def whole_groups(frames, column: str = "group", rows: int = CHUNK):
    """Frames sorted by a column, put together so that no group is cut and each has about so many rows."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame])
        if len(rest) >= rows:
            last = rest[column].to_numpy() == rest[column].iloc[-1]
            if not last.all():
                yield rest[~last]
                rest = rest[last]
    if rest is not None and len(rest):
        yield rest


def links(fps: DataFrame, radius: int, large: int = LARGE_GROUP) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): a spanning forest of all links at most radius bits apart."""
    spark = fps.sparkSession
    dealt = staged(deal(fps, radius, large), "simhash-groups")
    n = partitions_for(spark, dealt.count(), 200_000)

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        group, code = frame["group"].to_numpy(), frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
        order = gray_order(group, code[:, None])
        group, code = group[order], code[order]
        place, root = forest(len(code), close_pairs(group, code[:, None], radius))
        return pd.DataFrame({"a": code[root].view(np.int64), "b": code[place].view(np.int64)})

    dealt = dealt.repartition(n, "group").sortWithinPartitions("group")
    return dealt.mapInPandas(lambda frames: map(found, whole_groups(frames)), "a long, b long").where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text", large: int = LARGE_GROUP
) -> DataFrame:
    """key, fp and component_id (the smallest key reachable by links of at most radius differing bits)."""
    made = staged(fingerprints(docs, shingle, key, text), "simhash-fp")
    own = staged(made.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    comp = components(links(own.select("fp"), radius, large))
    classes = own.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("fp", "component_id")
    return made.join(classes, "fp").select(key, "fp", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH3 hashes of the word shingles; ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        return np.array([xxhash.xxh3_64_intdigest(joined)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh3_64_intdigest
    made = (digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist()))
    return np.unique(np.fromiter(made, dtype=np.uint64, count=n))


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """A key for each band of so many least hashes, as signed longs."""
    rng = np.random.default_rng(29)
    factor, add = rng.integers(0, 1 << 64, (2, bands * rows, 1), dtype=np.uint64)
    factor |= np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), 256):
        np.minimum(least, (hashes[None, lo : lo + 256] * factor + add).min(axis=1), out=least)
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(least.reshape(bands, rows))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(sets: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) that join the same sets as all pairs of Jaccard similarity >= similarity do, and the similarity of
    each set to the first.

    A pair is left out only where it cannot matter: its sets are joined already, their sizes forbid the similarity, or
    their distances to one of the first sets differ by more than a link allows (Jaccard distance is a metric)."""
    m, size = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    ids = [x[times[x] > 1] for x in ids]  # what one set alone holds is in no intersection
    flat, held = np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64)
    ends = np.cumsum(held)
    mark = np.zeros(len(times), dtype=bool)
    label, links, seen = np.arange(m), [], []
    to_first = np.ones(m)
    for i in range(m):
        mark[ids[i]] = True
        some = np.arange(m) if i < PIVOTS else np.flatnonzero(
            (label != label[i]) & (np.arange(m) > i) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9)
        )
        for d in seen if i >= PIVOTS else ():
            some = some[np.abs(d[some] - d[i]) <= 1 - similarity + 1e-9]
        if len(some):
            if held[some].sum() * 4 > len(flat):
                count = np.r_[0, np.cumsum(mark[flat])]
                common = (count[ends] - count[ends - held])[some]
            else:
                common = np.array([np.count_nonzero(mark[ids[j]]) for j in some.tolist()], dtype=np.int64)
            near = common / (size[some] + size[i] - common)
            near[some == i] = 1
            if i < PIVOTS:
                seen.append(1 - near)
            if i == 0:
                to_first = near
            hit = some[near >= similarity - 1e-12]
            names, first = np.unique(label[hit], return_index=True)
            links += [(i, int(j)) for j, name in zip(hit[first], names) if name != label[i]]
            label[np.isin(label, names)] = label[i]
        mark[ids[i]] = False
    return links, to_first


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", large: int = LARGE_GROUP,
    large_shingles: int = LARGE_SHINGLES,
) -> DataFrame:
    """key and component_id of documents joined by word shingle sets of Jaccard similarity >= similarity.

    Every link is decided on the sets themselves. Candidates come from BANDS bands of BAND_ROWS least hashes: a pair of
    similarity s shares a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS, 0.99999 at 0.8. Equal sets collapse
    first. Documents joined by bands make a candidate group, to which each text goes once, and all pairs of the group
    count.

    A group of more than `large` documents or `large_shingles` shingles is cut into parts, each with the group's first
    document. Pairs of two parts that are both near the first one are joined through it; the others hold a document that
    is not, so those documents then meet every part. So the same pairs decide at every size."""
    spark = docs.sparkSession
    plain = columns_of(docs, key, text).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    name, key = key, "_key"
    plain = plain.withColumn("row", F.xxhash64(key, "_text"))
    kind = plain.schema[0].dataType.simpleString()

    def make(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            digest, n = pa.array(map(set_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int32())
            bands = pa.array(map(band_keys, sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), digest, n, bands], [key, "row", "digest", "n", "bands"])

    every = staged(plain.mapInArrow(make, f"`{key}` {kind}, row long, digest binary, n int, bands array<long>"), "shingle-sets")
    own = every.groupBy("digest").agg(
        F.min(F.struct(F.col(key).isNull(), key, "row")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    banded = staged(own.select("digest", "n", "bands", "one.row", F.monotonically_increasing_id().alias("node")), "banded-sets")
    made = staged(every.select(key, "digest"), "row-sets")
    dropped(spark, every)
    release(spark)
    bands = banded.select("node", F.posexplode("bands").alias("i", "band"))
    shared = bands.groupBy("i", "band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("i", "band", "a")
    pairs = staged(bands.join(shared, ["i", "band"]).select("a", F.col("node").alias("b")).where("a < b").distinct(), "band-pairs")
    own = staged(banded.drop("bands"), "distinct-sets")
    dropped(spark, banded)
    release(spark)
    joined = components(pairs)
    dropped(spark, pairs)
    asked = staged(own.join(joined, "node").withColumnRenamed("component", "group"), "candidates")
    dropped(spark, joined)
    parts = F.greatest(F.ceil(F.count("*") / large), F.ceil(F.sum("n") / large_shingles)).cast("int")
    cut = asked.groupBy("group").agg(parts.alias("parts"))
    texts = staged(plain.select("row", "_text").join(broadcast_if_small(asked.join(cut, "group"), asked), "row").drop("row", "n"), "candidate-texts")
    release(spark)
    total = asked.count()

    def compared(dealt: DataFrame, rows: int) -> DataFrame:
        """Links (a, b) of each bucket; and b null for each a that is not near the bucket's first document."""

        def run(frames):
            for frame in whole_groups(frames, "bucket", 1_000):
                for _, some in frame.groupby("bucket", sort=False):
                    some = some.sort_values(["first", "node"], ascending=[False, True]).drop_duplicates(["node", "_text"])
                    sets = [shingle_set(t, shingle) for t in some["_text"]]
                    right = np.array([set_digest(x) == d for x, d in zip(sets, some["digest"])])
                    some, sets = some[right], [x for x, ok in zip(sets, right) if ok]
                    node, lead = some["node"].to_numpy(), some["first"].to_numpy()
                    if not len(node):
                        continue
                    links, near = alike(sets, similarity)
                    out = [(some["group"].iloc[0], node[i], node[j]) for i, j in links]
                    far = node[near < similarity - 1e-12] if lead[0] else node[:0]
                    group = [x[0] for x in out] + [some["group"].iloc[0]] * len(far)
                    a, b = [x[1] for x in out] + far.tolist(), [x[2] for x in out] + [None] * len(far)
                    yield pd.DataFrame({"group": group, "a": a, "b": pd.array(b, dtype="Int64")})

        n = partitions_for(spark, rows, 2_000)
        return staged(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "group long, a long, b long"), "set-links")

    share = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    take = ["group", "node", "digest", "_text"]
    lead = F.col("node") == F.col("group")
    placed = texts.where(~(lead & (F.col("parts") > 1))).select(*take, F.lit(False).alias("first"), share.alias("part"))
    placed = placed.unionAll(texts.where(lead & (F.col("parts") > 1)).select(*take, F.lit(True).alias("first"), each("parts").alias("part")))
    edges = compared(placed.select(*take, "first", F.xxhash64("group", "part").alias("bucket")), total)
    rest = edges.where("b is null").select("group", F.col("a").alias("node")).distinct()
    if not rest.isEmpty():
        rests = rest.groupBy("group").agg(F.ceil(F.count("*") / large).cast("int").alias("turns"))
        far = texts.join(rest, ["group", "node"], "left_semi").join(rests, "group")
        turn = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("turns")).cast("int").alias("turn")
        members = texts.join(rests, "group").select(*take, share.alias("part"), each("turns").alias("turn"))
        far = far.select(*take, turn, each("parts").alias("part")).select(*take, "part", "turn")
        both = members.unionAll(far).select(*take, F.lit(False).alias("first"), F.xxhash64("group", "part", "turn").alias("bucket"))
        edges = edges.unionAll(compared(both, both.select("bucket").count()))
    for old in (texts, asked):
        dropped(spark, old)
    release(spark)
    found = components(edges.where("b is not null").select("a", "b"))
    classes = own.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    least = made.join(classes, "digest").select(key, "component")
    firsts = least.groupBy("component").agg(F.min(key).alias("component_id"))
    return least.join(firsts, "component").select(F.col(key).alias(name), "component_id")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """key (each once, not null, of one text) and component_id: documents joined by near_duplicates(), or by similar_groups()
    where 64 bits tell too little: near copies that differ in more than a few words. The smallest keys of the groups stand
    for them; where a document's two groups have different ones, these are joined."""
    prints = near_duplicates(docs, radius=radius, key=key, text=text).select(F.col(key).alias("key"), F.col("component_id").alias("a"))
    sets = similar_groups(docs, similarity=similarity, key=key, text=text).select(F.col(key).alias("key"), F.col("component_id").alias("b"))
    both = staged(prints.distinct().join(sets.distinct(), "key"), "two-groups")
    release(docs.sparkSession)
    ends = both.where("a <> b").select("a", "b").distinct()
    names = ends.select("a").union(ends.select("b")).distinct().select(F.col("a").alias("name"), F.monotonically_increasing_id().alias("node"))
    names = staged(names, "group-names")
    edges = ends.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    found = components(edges.select("x", "y"), "x", "y").join(names, "node")
    least = found.groupBy("component").agg(F.min("name").alias("component_id"))
    renamed = staged(found.join(least, "component").select(F.col("name").alias("a"), "component_id"), "joined-groups")
    dropped(docs.sparkSession, names)
    out = both.join(broadcast_if_small(renamed), "a", "left")
    return out.select(F.col("key").alias(key), F.coalesce("component_id", "a").alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
