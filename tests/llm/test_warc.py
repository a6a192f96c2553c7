"""Archives: round trip, revisits against a plain version, pushed predicates, skipped payloads, foreign files."""

import base64
import gzip
import hashlib
import os
from collections import Counter

import pyarrow.fs
import pytest

from msgrisk.llm import catalog, warc
from msgrisk.llm.shared import scratch


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least_bytes=0):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least_bytes and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        own = first.get(data) is None or first[data] == page
        out.append((page, len(data), digest(html), "response" if own else "revisit", None if own else first[data]))
    return Counter(out)


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def test_pages_of_the_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in catalog.table(spark, sf_dir, "pages").collect()]
    found = catalog.QUERIES["op6_warc_pages"](spark, sf_dir)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, found.collect())) == plain(rows)


ODD = [
    (1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "é", "日本" * 40_000),
    (5, "again", "日本" * 40_000), (6, "http://f", "日本" * 40_000), (None, "http://g", "<p>one</p>"), (None, None, "only nameless"),
    (7, "http://h", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (0, "http://z", "<p>one</p>"),
]


@pytest.fixture()
def archive(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ODD], "page_id long, url string, html string, digest string, payload int")
    path = scratch(spark, "warc")
    warc.write_pages(pages, path)
    return path


def test_odd_pages_and_payloads(spark, archive):
    assert Counter(map(tuple, warc.read_records(spark, archive, COLUMNS, verify=True).collect())) == plain(ODD)
    rows = warc.read_records(spark, archive).collect()
    texts = {page: (html or "").encode() for page, _, html in ODD if page is not None}
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None and r.page_id is not None:
            assert bytes(r.payload) == texts[r.page_id]
    assert {r.target_uri for r in rows if r.page_id == 1} == {"http://a/%20b%0D%0AX:%20y"}


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_pages(pages, path, least_bytes=11)
    assert Counter(map(tuple, warc.read_records(spark, path, COLUMNS).collect())) == plain(ODD, 11)


def test_no_pages(spark):
    path = scratch(spark, "warc")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


def test_predicates_are_pushed(spark, archive):
    rows = warc.read_records(spark, archive)
    found = rows.where("record_type = 'revisit' and refers_to = 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan and "= 0" not in plan     # Spark leaves them to the reader
    assert sorted(r.page_id for r in found.collect() if r.page_id) == [1, 2]
    assert rows.where("target_uri like 'http://c%'").count() == 1
    assert rows.where("page_id in (3, 4, 99)").count() == 2
    assert rows.where("page_id > 5").count() == 2


def test_unwanted_payloads_are_not_decoded(spark, archive, monkeypatch):
    reader = warc.WarcSource({"path": archive}).reader(warc.read_records(spark, archive, COLUMNS).schema)
    monkeypatch.setattr(warc._Records, "block", lambda self: pytest.fail("a payload was decoded"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(ODD)


def record(kind, payload, **headers):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    lines = {"WARC-Type": kind, "Content-Length": len(block), **headers}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, packed, tmp_path):
    records = [record("warcinfo", b"x" * 9000), record("response", b"y" * 200_000), record("response", b""), record("request", b"z")]
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "response", "response", "request"]
    assert [len(r.payload) for r in rows if r.payload is not None] == [200_000, 0]
    assert warc.read_records(spark, str(tmp_path)).where("record_type = 'response'").count() == 2


def test_cut_off_and_wrong_archives_are_reported(tmp_path):
    reader = lambda: warc.WarcSource({"path": str(tmp_path), "verify": "true"}).reader(catalog_schema())
    whole = gzip.compress(record("response", os.urandom(90_000)))
    (tmp_path / "a.warc.gz").write_bytes(whole[:-40_000])
    with pytest.raises(ValueError, match="cut off"):
        [list(reader().read(p)) for p in reader().partitions()]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("response", b"abc", **{"WARC-Payload-Digest": "sha1:" + digest("abd")})))
    with pytest.raises(ValueError, match="differs"):
        [list(reader().read(p)) for p in reader().partitions()]


def catalog_schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(warc.SCHEMA)


def test_files_of_lost_attempts_do_not_count(spark, archive):
    system, root = pyarrow.fs.FileSystem.from_uri(archive if ":/" in archive else f"file://{archive}")
    with system.open_output_stream(f"{root}/lost.warc.gz", compression=None) as f:
        f.write(gzip.compress(record("response", b"lost")))
    assert warc.read_records(spark, archive).count() == len(ODD)
