import base64
import hashlib

import pytest
from casewatch.llm import warc
from compare import connect, differences
from pyspark.sql import functions as F


def brute(rows):
    rows = list(rows)
    keep = {}
    for i, h in rows:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        first = (-1 if i is None else i) == keep[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else keep[h or ""]))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def rows_of(got):
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


def test_whole_table(spark, folder, pages):
    got = warc.op1_warc(spark, folder)
    assert rows_of(got) == brute(zip(pages.page_id, pages.html, strict=True))
    assert differences(got.toPandas(), connect(folder).sql(warc.SQL["op1_warc"]).df()) == []
    assert got.filter("NOT valid").count() == 0 and got.filter("segments > 1").count() > 0


def pages_of(spark, rows):
    return spark.createDataFrame([(i, "http://x/\r\nX-Page-Id: 9", h, "r") for i, h in rows], "page_id long, url string, html string, record string")


ROWS = [(1, None), (2, ""), (3, "é" * 9000), (4, "é" * 9000), (5, "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 700), (6, "a\r\n\r\nb"), (7, "é" * 9000), (8, "\r\n"), (None, "z")]


def test_round_trip_of_odd_pages(spark, tmp_path):
    warc.write_archives(pages_of(spark, ROWS).repartition(3), str(tmp_path / "w"), records_per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=True)
    assert rows_of(got) == brute(ROWS)
    held = {r.page_id: bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()}
    assert held[7] == "é" * 9000 and held[5] == ROWS[4][1] and held[6] == "a\r\n\r\nb"


def test_minimum_size_repeats_and_empty(spark, tmp_path):
    rows = [(1, "ab"), (2, "ab"), (3, "long text"), (4, "long text"), (4, "long text")]
    warc.write_archives(pages_of(spark, rows), str(tmp_path / "m"), min_bytes=5)
    got = rows_of(warc.read_archives(spark, str(tmp_path / "m")))
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    warc.write_archives(pages_of(spark, rows).limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_broken_segments_are_reported(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "q" * 9000), (2, "ok")]), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    lost = warc.responses(records.filter("number IS NULL OR number <> 2"), False)
    assert {r.page_id: r.valid for r in lost.collect()} == {1: False, 2: True}
    wrong = warc.responses(records.withColumn("total", F.col("total") + 1), False)
    assert {r.page_id: r.valid for r in wrong.collect()} == {1: False, 2: True}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"abc\r\n0\r\n\r\n" * 5):
        assert warc.dechunked(warc.chunked(payload, size)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_hot_payload_odd_rows_and_clashing_columns(spark, tmp_path):
    """A payload most pages share, nulls, a very long page, columns named as the operator's own."""
    rows = [(i, "u", "same error page") for i in range(300)] + [(300, None, None), (301, "v", ""), (302, "w", "é" * 3_000_000), (None, "n", "same error page"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("sha", "keep", "n", "record", "kind", "again"):
        pages = pages.withColumn(name, warc.F.lit("x"))
    path = str(tmp_path / "w")
    warc.write_archives(pages.repartition(5), path)
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.valid) for r in warc.read_archives(spark, path).collect()]
    want = [(i, 15, "response" if i == 299 else "revisit", None if i == 299 else 299, True) for i in [*range(300), None]]
    want += [(300, 0, "revisit", 301, True), (301, 0, "response", None, True), (302, 6_000_000, "response", None, True), (None, 5, "response", None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
