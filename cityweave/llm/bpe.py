"""Operator 10: byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every pre-token is a row of symbols. The leaves of a segment tree hold, for each symbol, the rank of the pair it forms
with its right neighbour and its position; the root is the least of them, which is the leftmost pair of lowest rank.
A merge changes at most three leaves, each a point update of logarithmic cost, until the root holds no pair.

Pre-tokens met before come from a bounded cache in the worker; new ones are merged many at a time, one tree per row of
a numpy matrix, and those over 64 bytes in a scalar tree. Documents never leave their partition: no shuffle.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated rows give
repeated results; an empty table gives an empty result; only the needed columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of

#: How byte-level BPE cuts a text before merging (a fixed value of this kind of vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 30
#: Pre-tokens that a worker keeps; beyond that it starts anew. It only saves work.
CACHE_ENTRIES = 800_000
#: log2 of the slots of the pair table.
SLOT_BITS = 19
WIDE = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Vocabulary:
    """Merge ranks and token bytes of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([ids[s] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.slots, self.slot_keys = np.full(1 << SLOT_BITS, NO_PAIR), np.full(1 << SLOT_BITS, -1)
        for slot, k in zip(self.slot(keys).tolist(), keys.tolist()):
            while self.slot_keys[slot] not in (-1, k):
                slot = (slot + 1) % (1 << SLOT_BITS)
            self.slots[slot], self.slot_keys[slot] = self.rank_of[k], k
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(PRE_TOKEN).findall
        self.special_split = (
            regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split
            if self.special
            else lambda text: [text]
        )

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """By open addressing: a pair is at its slot, or further on without an empty slot between, or has no merge."""
        want = left << 20 | right
        at = self.slot(want)
        held = self.slot_keys[at]
        out = np.where(held == want, self.slots[at], NO_PAIR)
        on = np.flatnonzero((held != want) & (held != -1))
        while len(on):
            at[on] = (at[on] + 1) % (1 << SLOT_BITS)
            held = self.slot_keys[at[on]]
            hit = held == want[on]
            out[on[hit]] = self.slots[at[on[hit]]]
            on = on[~hit & (held != -1)]
        return out

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rows(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Merge many short words at once, a segment tree for each."""
    n, width = len(words), 1 << max(1, (max(map(len, words)) - 1).bit_length())
    shift = width.bit_length() - 1
    length = np.fromiter(map(len, words), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
    symbol = vocab.byte_id[raw]
    at = np.arange(width)
    alive = at < length[:, None]
    right = np.broadcast_to(at + 1, (n, width)).copy()
    left = np.broadcast_to(at - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NO_PAIR << shift, dtype=np.int64)
    rows, cols = np.nonzero(at < length[:, None] - 1)
    rank = vocab.pair_ranks(symbol[rows, cols], symbol[rows, cols + 1])
    tree[rows, width + cols] = np.where(rank < NO_PAIR, rank << shift | cols, NO_PAIR << shift)
    size = width
    while size > 1:
        size //= 2
        tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])

    def update(row: np.ndarray, col: np.ndarray, value: np.ndarray | int) -> None:
        node = width + col
        tree[row, node] = value
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        other = right[row, col]
        inside = other < length[row]
        rank = vocab.pair_ranks(symbol[row, col], symbol[row, np.where(inside, other, 0)])
        return np.where(inside & (rank < NO_PAIR), rank << shift | col, NO_PAIR << shift)

    row = np.arange(n)
    while len(row := row[tree[row, 1] < NO_PAIR << shift]):
        root = tree[row, 1]
        col = root & (width - 1)
        gone = right[row, col]
        symbol[row, col] = vocab.merged[root >> shift]
        alive[row, gone] = False
        after = right[row, gone]
        right[row, col] = after
        held = after < width
        left[row[held], after[held]] = col[held]
        update(row, gone, NO_PAIR << shift)
        update(row, col, pair(row, col))
        before = left[row, col]
        held = before >= 0
        update(row[held], before[held], pair(row[held], before[held]))
    flat, ends = symbol[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_long(word: bytes, vocab: Vocabulary) -> list[int]:
    """The same tree for one long word; time grows as n log n."""
    n = len(word)
    width = 1 << (n - 1).bit_length()
    shift = width.bit_length()
    none = NO_PAIR << shift
    symbol = vocab.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of, merged = vocab.rank_of, vocab.merged.tolist()

    def pair(i: int) -> int:
        if right[i] >= n:
            return none
        rank = rank_of.get(symbol[i] << 20 | symbol[right[i]])
        return none if rank is None else rank << shift | i

    tree = [none] * (2 * width)
    tree[width : width + n] = [pair(i) for i in range(n)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def update(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    alive = bytearray(b"\1") * n
    while (root := tree[1]) < none:
        i = root & ((1 << shift) - 1)
        gone = right[i]
        symbol[i] = merged[root >> shift]
        alive[gone] = 0
        right[i] = right[gone]
        if right[i] < n:
            left[right[i]] = i
        update(gone, none)
        update(i, pair(i))
        if left[i] >= 0:
            update(left[i], pair(left[i]))
    return [s for s, a in zip(symbol, alive) if a]


class Codec:
    """Encodes whole texts and decodes ids; keeps the merges of pre-tokens it has met."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        """Merge what is new; known holds each pre-token's ids as decimal text, and those ids decoded."""
        if len(self.known) + len(words) > CACHE_ENTRIES:
            self.known = {}
        by_width: dict[int, list[str]] = {}
        for w in words:
            by_width.setdefault(max(2, 1 << (len(w.encode()) - 1).bit_length()), []).append(w)
        for width, some in by_width.items():
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                raw = [w.encode() for w in part]
                merged = merge_rows(raw, self.vocab) if width <= WIDE else [merge_long(r, self.vocab) for r in raw]
                for w, ids in zip(part, merged):
                    self.known[w] = self.entry(ids)

    def entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        bytes_of = self.vocab.bytes_of
        return ",".join(map(str, ids)).encode(), b"".join([bytes_of[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order, special tokens of the file as pieces of their own."""
        vocab = self.vocab
        if any(t in text for t in vocab.special):
            return [w for i, s in enumerate(vocab.special_split(text)) for w in ([s] if i % 2 else vocab.split(s))]
        return vocab.split(text)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as comma-joined decimals and what those ids decode to, in UTF-8."""
        for lo in range(0, len(texts), 256):
            cut = [self.pieces(t) if t else [] for t in texts[lo : lo + 256]]
            new = {w for words in cut for w in words if w not in self.known}
            if new:
                every = new if len(self.known) + len(new) <= CACHE_ENTRIES else {w for words in cut for w in words}
                special = every & self.vocab.special.keys()
                self.learn(every - special)
                for t in special:
                    self.known[t] = self.entry([self.vocab.special[t]])
            known = self.known
            for words in cut:
                got = [known[w] for w in words]
                yield b",".join([g[0] for g in got]), b"".join([g[1] for g in got])


def ids_of(joined: bytes) -> np.ndarray:
    return np.array(joined.split(b","), dtype=np.int32) if joined else np.empty(0, np.int32)


def decode(ids: list[int], path: str) -> str:
    """Ids to text, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
    bytes_of = vocabulary(path).bytes_of
    return b"".join(bytes_of[i] for i in ids).decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", outputs: tuple = ("ids", "decoded")
) -> DataFrame:
    """One row per document: key, n_tokens, and of outputs those asked for: ids array<int>, decoded string, and their
    digests ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text in UTF-8), which
    are made beside them so that a caller who needs no more need not move the ids."""
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    docs = columns_of(docs, key, text).select(F.col(key), F.col(text).alias("_text"))
    schema = ", ".join(
        [f"`{key}` {docs.schema[0].dataType.simpleString()}", "n_tokens long", *(f"{o} {kinds[o]}" for o in outputs)]
    )

    def run(batches):
        codec = Codec(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for lo in range(0, batch.num_rows, 1024):
                rows = list(codec.encoded(batch.column(1).slice(lo, 1024).to_pylist()))
                made = {"n_tokens": pa.array([x.count(b",") + 1 if x else 0 for x, _ in rows], pa.int64())}
                for o in outputs:
                    if o == "ids":
                        made[o] = pa.array([ids_of(x) for x, _ in rows], pa.list_(pa.int32()))
                    elif o == "decoded":
                        made[o] = pa.array([d.decode("utf-8", "replace") for _, d in rows], pa.string())
                    elif o == "ids_sha256":
                        made[o] = pa.array([hashlib.sha256(x).hexdigest() for x, _ in rows], pa.string())
                    else:
                        made[o] = pa.array(
                            [hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest() for _, d in rows], pa.string()
                        )
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 1024), *made.values()], [key, *made])

    return docs.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, default_tokenizer(), outputs=("ids_sha256", "decoded_sha256"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
