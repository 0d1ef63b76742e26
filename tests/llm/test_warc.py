import hashlib

import pytest

from cityweave.llm import warc

BIG = "<p>" + "é words " * 40
ROWS = [
    (3, "http://a/x y\r\nZ", BIG), (1, "http://b", BIG), (7, None, BIG), (2, "u", "short"), (4, "u", "short"), (5, None, None),
    (6, "u", ""), (8, "u", "y" * 100), (9, "u", "y" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99), (None, "n", BIG), (12, "u", "big" * 90000),
]


def brute(rows):
    least = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        to = least.get(h)
        revisit = to is not None and to != i
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes", [300, warc.FILE_BYTES])
def test_write_and_read(spark, file_bytes):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, BODY string").repartition(2)
    out = warc.write_and_read(pages, file_bytes=file_bytes)
    got = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_query_and_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body>{'common boilerplate text ' * 9}{i * 7919}</body></html>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_reader_refuses_what_is_wrong():
    raw = warc.record({"id": 1, "url": "u", "body": "hello", "digest": hashlib.sha256(b"hello").hexdigest(), "refers_to": None})
    assert warc.parse(raw)["payload"] == b"hello"
    for bad in (raw[:-1], raw.replace(b"hello", b"hellO"), raw.replace(b"WARC-Date", b"WARC-Dat"), raw.replace(b"WARC/1.1", b"WARK/1.1"), raw + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    import zstandard

    data = warc.leading_frame(b"") + zstandard.ZstdCompressor().compress(raw) * 3
    assert list(warc.frames(data)) == [raw] * 3
    for bad in (data[:-1], data[8:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))
