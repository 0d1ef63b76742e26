"""Operator 4: WARC archives in Zstandard frames, written and read back.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is one frame. The
reader loads the dictionary from there, decodes frame after frame and checks the version line, the headers asked for,
the lengths of block and payload, the closing blank lines and the payload's digest.

Payloads are told apart by SHA-256 before anything is written: digests seen more than once are aggregated to the
smallest id, which is a response, and joined back; Spark splits a digest that a third of all rows share. Files go to
the shared folder by the store's own client, under names that hold the task attempt, and a Spark-written manifest lists
those of tasks that succeeded, so a lost executor costs a retry.

Defined cases: a null payload counts as empty; payloads under MIN_BYTES are always responses; null ids never are the
smallest id, so a null id among equal payloads revisits one that has an id, and is a response where none has; equal
rows of the smallest id are all responses; null addresses leave out their header; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, hash_sample, hot_keys, new_path, partitions_for, spread_join, staged

MIN_BYTES = 100
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
#: The dictionary is trained on so many payloads at most, picked by hash, and so many bytes of each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 4096, 32_768
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def classified(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_BYTES) -> DataFrame:
    """(key, url, payload, digest, size, refers_to): refers_to is the response's key for revisits, else null. Pages of a payload
    that holds a large share of all rows are dealt over several tasks."""
    pages = columns_of(pages, key, url, payload)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("long").alias("size"),
    )
    several = (
        rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    )
    several = staged(several, "warc-repeated")
    hot = staged(hot_keys(several, ["digest"], "n", rows.count()), "warc-hot")
    joined = spread_join(rows, several.select("digest", "least"), ["digest"], hot, "left")
    refers = F.when(F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least")), F.col("least"))
    return joined.select("id", "url", "body", "digest", "size", refers.alias("refers_to"))


def dictionary_of(rows: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of bodies; empty where there are too few."""
    rows = rows.where("size > 0")
    sample = hash_sample(rows, SAMPLES, rows.count(), "id", "digest")
    texts = [r[0].encode() for r in sample.select(F.substring("body", 1, SAMPLE_BYTES)).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(row: dict) -> bytes:
    """One WARC record: an HTTP response, or for a revisit its head alone."""
    body = row["body"].encode()
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: <urn:page:{'' if row['id'] is None else row['id']}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe=''':/?#[]@!$&'()*+,;=%~''')}")
    head.append(f"WARC-Payload-Digest: sha256:{row['digest']}")
    if revisit:
        head.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:80]!r}")
        out[name.strip()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """A record's id, address, type, reference, payload, its length and digest; ValueError where anything is wrong."""
    head, gap, rest = raw.partition(END)
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    named = fields(head)
    if missing := [n for n in NEEDED if n not in named]:
        raise ValueError(f"headers missing: {missing}")
    size = int(named["Content-Length"])
    if len(rest) != size + len(END) or rest[size:] != END:
        raise ValueError("a record's length is wrong")
    http, gap, payload = rest[:size].partition(END)
    length = int(fields(http)["Content-Length"])
    kind, digest = named["WARC-Type"], named["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload's length or digest is wrong")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in named):
        raise ValueError("a revisit has a payload or no reference")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "id": number(named["WARC-Record-ID"]), "url": named.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": number(named["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frames(data: bytes):
    """The records of an archive, one for each frame after the leading one."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading skippable frame")
    raw = data[8 : 8 + size]
    if len(raw) != size:
        raise ValueError("the leading frame is cut off")
    if raw.startswith(FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at, end, step = 8 + size, len(data), 1 << 12
    while at < end:
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= end:
                raise ValueError("the last frame is cut off")
            part = data[at : at + step]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write classified() rows; the manifest: (path, records, bytes)."""

    def run(batches):
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        sink, done = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    if sink is None:
                        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.zst"
                        sink, done = fs.open_output_stream(path, compression=None), [*done, [path, 0, 8 + len(dictionary)]]
                        sink.write(leading_frame(dictionary))
                    raw = packer.compress(record(row))
                    sink.write(raw)
                    done[-1][1] += 1
                    done[-1][2] += len(raw)
                    if done[-1][2] >= file_bytes:
                        sink.close()
                        sink = None
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "records": n, "bytes": b} for p, n, b in done],
            pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Records of the manifest's files: id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]."""
    kinds = [("id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long")]
    kinds += [("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string")]
    kinds += [("payload", pa.binary(), "binary")] * payload
    schema = pa.schema([(n, t) for n, t, _ in kinds])

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    data = f.read()
                some, total = [], 0
                for raw in frames(data):
                    some.append({n: v for n, v in parse(raw).items() if payload or n != "payload"})
                    total += 1
                    if len(some) == 256:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if total != row["records"]:
                    raise ValueError(f"{row['path']} holds {total} records, not {row['records']}")
                yield pa.RecordBatch.from_pylist(some, schema)

    n = partitions_for(manifest.sparkSession, manifest.count(), 1)
    return manifest.repartition(n).mapInArrow(run, ", ".join(f"{n} {k}" for n, _, k in kinds))


def write_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", **options) -> DataFrame:
    spark = pages.sparkSession
    rows = classified(pages, key, url, payload)
    folder = new_path(spark, "warc")
    plain = columns_of(pages, key, payload).select(F.col(key).alias("id"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    sample = plain.select("id", "body", F.octet_length("body").alias("size"), F.xxhash64("body").alias("digest"))
    manifest = staged(write_archives(rows, folder, dictionary_of(sample), **options), "warc-manifest")
    return read_archives(manifest, folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLES = {
    "op4_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as least from d)
select page_id, payload_bytes, payload_digest,
       case when least <> page_id then 'revisit' else 'response' end as record_type,
       case when least <> page_id then least end as refers_to
from f
"""
}
