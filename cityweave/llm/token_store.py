"""Operator 1: token ids in a binary format coded by a static range asymmetric numeral system (rANS).

1. Texts are ranged by id, tokenized and staged once; each row knows its place among its partition's tokens.
2. Token counts are summed over all rows and scaled to one shared frequency table.
3. Runs of tokens are cut into independent blocks. A block interleaves many rANS lanes, and holds checkpoints (word
   offset, all lane states and a CRC-32 of the ids up to the next one), so a reader can start at any of them.
4. Files go to the shared folder by the store's own client; a Spark-written index lists, for every block of a task that
   succeeded, file, offset and length, so a lost executor costs a retry and leaves at most files that no index names.
5. Blocks are read and decoded in parallel, checksums first.

Only the frequency table is broadcast; it is bounded by the vocabulary. Documents may span blocks.

Defined cases: a null text counts as empty and holds the end id alone; null ids come first; equal ids follow each other
in order of the text's hash; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityweave.llm.common import columns_of, dropped, new_path, partitions_for, release, staged

BLOCK_TOKENS, CHECKPOINT_TOKENS, MAX_LANES = 1 << 18, 1 << 17, 1 << 10
PROB_BITS = 18
#: Parts whose sizes one task adds up.
PART_GROUP = 4_096
LOW = 1 << 31
MAGIC = b"RANSBLK1"
HEAD = struct.Struct("<8sIIIII")  # magic, tokens, lanes, checkpoints, words, bytes of the document index
CHECK = struct.Struct("<III")  # step, word offset, CRC-32 of the ids up to the next checkpoint
#: Units with their ids that a worker keeps. It only saves work.
CACHE_UNITS = 1_500_000
#: Letters of words that are one piece for the tokenizer; punctuation that may follow and is then one piece as well.
LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class Table:
    """Symbols and their scaled frequencies, which sum to 1 << bits."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        self.bits = max(PROB_BITS, int(len(symbols)).bit_length() + 1)
        total = 1 << self.bits
        freq = np.maximum(1, np.floor(counts * (total / max(1.0, counts.sum())))).astype(np.int64)
        while len(freq) and (rest := total - int(freq.sum())):
            if rest > 0:
                freq[np.argmax(freq)] += rest
            else:
                most = np.argsort(-freq, kind="stable")[: int((freq > 1).sum())][:-rest]
                freq[most] -= 1
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.place = np.zeros(int(self.symbols[-1]) + 1 if len(freq) else 0, dtype=np.uint32)
        self.place[self.symbols] = np.arange(len(freq), dtype=np.uint32)


def lanes_for(n: int) -> int:
    return 1 << max(0, min(MAX_LANES, n // 64).bit_length() - 1)


def encode_block(ids: np.ndarray, table: Table, index: bytes = b"") -> bytes:
    n, lanes = len(ids), lanes_for(len(ids))
    at = table.place[ids]
    freq, start = table.freq[at], table.start[at]
    steps, bits = -(-n // lanes), np.uint64(table.bits)
    limit = freq << np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list = [None] * steps
    states, every = {}, max(1, CHECKPOINT_TOKENS // lanes)
    half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    for i in range(steps - 1, -1, -1):
        lo, hi = i * lanes, min(n, (i + 1) * lanes)
        x = state[: hi - lo]
        out = x >= limit[lo:hi]
        words[i] = (x[out] & mask).astype(np.uint32)
        x = np.where(out, x >> half, x)
        q, r = np.divmod(x, freq[lo:hi])
        state[: hi - lo] = (q << bits) + r + start[lo:hi]
        if i % every == 0:
            states[i] = state.copy()
    offset = np.cumsum([0, *map(len, words)]).tolist()
    marks = sorted(states)
    body = []
    for i, nxt in zip(marks, [*marks[1:], steps]):
        crc = zlib.crc32(ids[i * lanes : min(n, nxt * lanes)].astype("<u4").tobytes())
        body += [CHECK.pack(i, offset[i], crc), states[i].astype("<u8").tobytes()]
    body += [np.concatenate(words).astype("<u4").tobytes() if words else b"", index]
    raw = HEAD.pack(MAGIC, n, lanes, len(marks), offset[-1], len(index)) + b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


def read_block(raw: bytes) -> tuple[int, int, list, np.ndarray, bytes]:
    """Tokens, lanes, checkpoints (step, word offset, crc, states), words and document index, after checks."""
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block's checksum is wrong")
    magic, n, lanes, marks, words, size = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("this is no block")
    at, checks = HEAD.size, []
    for _ in range(marks):
        states = np.frombuffer(raw, "<u8", lanes, at + CHECK.size)
        checks.append((*CHECK.unpack_from(raw, at), states))
        at += CHECK.size + 8 * lanes
    return n, lanes, checks, np.frombuffer(raw, "<u4", words, at), raw[at + 4 * words : at + 4 * words + size]


def decode_block(raw: bytes, table: Table, first: int = 0) -> np.ndarray:
    """Ids from checkpoint `first` on (0: the whole block), each part checked by its CRC-32."""
    n, lanes, checks, words, _ = read_block(raw)
    out, steps = np.empty(n, dtype=np.uint32), -(-n // lanes)
    bits, mask, half, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32), np.uint64(LOW)
    for c, (begin, pos, crc, states) in enumerate(checks):
        if c < first:
            continue
        state = states.copy()
        end = checks[c + 1][0] if c + 1 < len(checks) else steps
        for i in range(begin, end):
            lo, hi = i * lanes, min(n, (i + 1) * lanes)
            x = state[: hi - lo]
            slot = x & mask
            sym = table.slot[slot]
            out[lo:hi] = sym
            x = table.freq[sym] * (x >> bits) + slot - table.start[sym]
            need = np.flatnonzero(x < low)
            x[need] = (x[need] << half) | words[pos : pos + len(need)]
            pos += len(need)
            state[: hi - lo] = x
        lo, hi = begin * lanes, min(n, end * lanes)
        out[lo:hi] = table.symbols[out[lo:hi]]
        if zlib.crc32(out[lo:hi].astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids fail their checksum")
    return out[checks[first][0] * lanes :] if checks else out


def crc32_join(a: int, b: int, size: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the length of the second."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    square = lambda m: [times(m, row) for row in m]
    power = square(square([0xEDB88320, *(1 << i for i in range(31))]))  # four zero bits
    while size:
        power = square(power)
        if size & 1:
            a = times(power, a)
        size >>= 1
    return a ^ b


@cache
def encoder_for(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


class WordEncoder:
    """Whole texts to ids by the tokenizers library, which is asked once for each unit a worker meets.

    White space never enters a token of this tokenizer and its normalizer never acts across it, so a text's ids are the
    ids of the parts between ASCII white space, in order. ASCII letters are put in lower case first, as the tokenizer
    does, unless a combining mark (which may join a letter of one case only) or the opening of a special token is in the
    text. A word of letters followed by punctuation is two pieces for the tokenizer, so both are units of their own; any
    other word is one unit. New units of letters go to the library many at a time, with a space between them: each is one
    piece for it, and the last id of a piece is one of a word's end.

    Texts, words and ids stay in Arrow arrays; only new units become Python objects. Past CACHE_UNITS units only those
    of the texts at hand are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.units, self.ids = pa.array([""]), pa.array([b""])

    def learn(self, units: pa.Array) -> None:
        """Ask the library for units that are not known."""
        letters = pc.equal(pc.utf8_ltrim(units, characters=LETTERS), "")
        plain, other = units.filter(letters), units.filter(pc.invert(letters))
        raw, ends = [], [np.zeros(1, dtype=np.int64)]
        for lo in range(0, len(plain), 1000):
            some = plain.slice(lo, 1000).to_pylist()
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise RuntimeError("a word of letters is more than one piece for this tokenizer")
            raw.append(ids.tobytes())
            ends.append(ends[-1][-1] + cuts * self.kind.itemsize)
        offsets = pa.py_buffer(np.concatenate(ends).astype(np.int32))
        asked = self.library.encode_batch_fast(other.to_pylist(), add_special_tokens=False)
        asked = pa.array([np.array(x.ids, dtype=self.kind).tobytes() for x in asked], pa.binary())
        made = pa.Array.from_buffers(pa.binary(), len(plain), [None, offsets, pa.py_buffer(b"".join(raw))])
        self.units, self.ids = pa.concat_arrays([self.units, plain, other]), pa.concat_arrays([self.ids, made, asked])

    def ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as bytes."""
        tail = pc.utf8_ltrim(words, characters=LETTERS)
        plain = pc.and_(
            pc.equal(pc.ascii_ltrim(tail, characters=TAIL), ""), pc.less(pc.binary_length(tail), pc.binary_length(words))
        )
        parts = [pc.if_else(plain, pc.ascii_rtrim(words, characters=TAIL), words), pc.if_else(plain, tail, "")]
        units = pa.concat_arrays(parts)
        at = pc.index_in(units, value_set=self.units)
        if at.null_count:
            self.learn(units.filter(at.is_null()).unique())
            at = pc.index_in(units, value_set=self.units)
        ids = self.ids.take(at)
        if len(self.units) > CACHE_UNITS:
            used = pa.array(np.union1d([0], at.to_numpy()))
            self.units, self.ids = self.units.take(used), self.ids.take(used)
        return pc.binary_join_element_wise(ids.slice(0, len(words)), ids.slice(len(words)), b"")

    def encoded(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text as little-endian unsigned integers of type `kind`, with `end` after them."""
        texts = pc.fill_null(texts, "")
        exact = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
        words = pc.ascii_split_whitespace(pc.if_else(exact, texts, pc.ascii_lower(texts)))
        numbered = words.flatten().dictionary_encode()
        known = pa.concat_arrays([self.ids_of(numbered.dictionary), pa.array([end], pa.binary())])
        stops = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        code = np.insert(numbered.indices.to_numpy(), stops, len(known) - 1)
        made = known.take(pa.array(code))
        ends = np.frombuffer(made.buffers()[1], np.int32, len(made) + 1, 4 * made.offset)
        ends = ends[np.r_[0, stops + np.arange(1, len(stops) + 1)]]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), made.buffers()[2]])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, at, n, key, ids): ids as bytes of one width, at the token's place in its part; parts are ranges of key."""
    spark = docs.sparkSession
    docs = columns_of(docs, key, text).select(F.col(key), F.col(text).alias("_text"))
    n = partitions_for(spark, docs.count(), 20_000)
    tie = F.xxhash64("_text")
    ranged = docs.repartitionByRange(n, F.asc_nulls_first(key), tie).sortWithinPartitions(F.asc_nulls_first(key), tie)

    def run(batches):
        encoder, part, at = encoder_for(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            for some in portions(batch):
                ids = encoder.encoded(some.column(1), end)
                sizes = pc.binary_length(ids).to_numpy().astype(np.int64) // encoder.kind.itemsize
                places = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(places), pa.array(sizes), some.column(0), ids],
                    ["part", "at", "n", key, "ids"],
                )

    return ranged.mapInArrow(run, f"part int, at long, n long, `{key}` {docs.schema[0].dataType.simpleString()}, ids binary")


def portions(batch: pa.RecordBatch, most: int = 8 << 20):
    """The batch in slices of about so many bytes of text, and of at least one row."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def widen(raw: bytes, n: int) -> np.ndarray:
    """The n ids of a value of tokenize()."""
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def token_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows, pre-aggregated in each task."""

    def run(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                n = pc.sum(some.column(1)).as_py()
                made = np.bincount(widen(b"".join(some.column(0).to_pylist()), n))
                if len(made) > len(total):
                    total = np.r_[total, np.zeros(len(made) - len(total), dtype=np.int64)]
                total[: len(made)] += made
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], ["id", "n"])

    return tokens.select("ids", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(
    tokens: DataFrame, table: Table, folder: str, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Write the blocks of tokenize()'s rows; the index: (path, offset, size, part, at, n)."""
    held = tokens.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, sink, offset = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.rans", None, 0
        ids, docs, have, begin, part, rows = [], [], 0, 0, None, []

        def flush():
            nonlocal sink, offset, ids, docs, have, begin
            if have:
                sink = sink or fs.open_output_stream(path)
                index = zlib.compress(np.array(docs, dtype="<i8").tobytes(), 1)
                raw = encode_block(np.concatenate(ids), held.value, index)
                sink.write(raw)
                rows.append((path, offset, len(raw), part, begin, have))
                offset += len(raw)
            begin, ids, docs, have = begin + have, [], [], 0

        for batch in batches:
            for p, at, n, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part or at != begin + have:
                    flush()
                    part, begin = p, at
                left, done = widen(raw, n), 0
                while done < n:
                    some = min(n - done, block_tokens - have)
                    ids.append(left[done : done + some])
                    docs.append((name is not None, name or 0, at, done, n, some))
                    done, have = done + some, have + some
                    if have == block_tokens:
                        flush()
        flush()
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "offset", "size", "part", "at", "n"), r)) for r in rows],
            pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64())]),
        )

    ordered = tokens.select("part", "at", "n", key, "ids")
    return ordered.mapInArrow(run, "path string, offset long, size long, part int, at long, n long")


def read_store(index: DataFrame, table: Table, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of documents, decoded block by block: (part, key, at, done, n, size, crc[, ids]).

    at: the document's place in its part; done: tokens before the piece; n: tokens of the document; size: of the piece."""
    spark = index.sparkSession
    held = spark.sparkContext.broadcast(table)
    fields = [("part", pa.int32()), (key, pa.int64()), ("at", pa.int64()), ("done", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())]
    kinds = "part int, `{}` long, at long, done long, n long, size long, crc long".format(key)
    if with_ids:
        fields, kinds = [*fields, ("ids", pa.list_(pa.int64()))], f"{kinds}, ids array<long>"

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    f.seek(row["offset"])
                    raw = f.read(row["size"])
                ids = decode_block(raw, held.value)
                docs = np.frombuffer(zlib.decompress(read_block(raw)[4]), "<i8").reshape(-1, 6)
                out, lo = [], 0
                for has, name, at, done, n, size in docs.tolist():
                    own = ids[lo : lo + size]
                    lo += size
                    piece = (row["part"], name if has else None, at, done, n, size, zlib.crc32(own.tobytes()))
                    out.append((*piece, own.tolist()) if with_ids else piece)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])

    n = partitions_for(spark, index.count(), 16)
    return index.select("path", "offset", "size", "part").repartition(n).mapInArrow(run, kinds)


def document_sums(pieces: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from pieces; those of a document in several blocks are joined in order."""
    # tokens before each part: sums of groups of parts first, so that no task sees a row for every part
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = parts.withColumn("grp", F.floor(F.col("part") / PART_GROUP))
    groups = grouped.groupBy("grp").agg(F.sum("n").alias("n"))
    groups = groups.select("grp", before(Window.orderBy("grp")).alias("g"))
    base = grouped.withColumn("base", before(Window.partitionBy("grp").orderBy("part"))).join(groups, "grp")
    base = base.select("part", (F.col("base") + F.col("g")).alias("base"))
    whole = pieces.where("size = n").select("part", key, "at", "n", "crc")

    def join(frames):
        import pandas as pd

        for frame in frames:
            made = []
            for some in frame["pieces"]:
                crc = 0
                for piece in some:
                    crc = crc32_join(crc, piece["crc"], 4 * piece["size"])
                made.append(crc)
            yield pd.DataFrame(
                {"part": frame["part"], key: frame[key], "at": frame["at"], "n": frame["n"], "crc": pd.Series(made, dtype="int64")}
            )

    several = pieces.where("size < n").groupBy("part", key, "at", "n").agg(
        F.sort_array(F.collect_list(F.struct("done", "size", "crc"))).alias("pieces")
    )
    several = several.mapInPandas(join, T.StructType(whole.schema.fields))
    every = whole.unionByName(several).join(base, "part")
    return every.select(key, (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def write_and_read(
    docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Write docs' ids to a new folder of the shared store and return document_sums() of what the files hold."""
    spark = docs.sparkSession
    tokens = staged(tokenize(docs, tokenizer, end_id, key, text), "tokens")
    release(spark)
    counts = token_counts(tokens).toPandas()  # as many rows as the vocabulary has ids at most
    table = Table(counts["id"].to_numpy(), counts["n"].to_numpy())
    folder = new_path(spark, "rans")
    parts = staged(tokens.groupBy("part").agg(F.sum("n").alias("n")), "parts")
    index = staged(write_store(tokens, table, folder, key, block_tokens), "rans-index")
    dropped(spark, tokens)
    return document_sums(staged(read_store(index, table, folder, key), "pieces"), parts, key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), end_id=1)


QUERIES = {"op1_token_store": op1_token_store}
ORACLES: dict[str, str] = {}
