"""Archives round trip, filters reach the headers, files of failed attempts are not read."""

import gzip
import hashlib
import io
import os

import pyarrow as pa
import pytest

from lifeframe.llm import warc


@pytest.fixture
def pages(spark):
    long = "<html>" + "é" * 200
    rows = [
        (5, "http://a/1", long), (3, "http://a/%0A\r\n2", long), (9, None, long), (4, "http://b", "short"), (2, "http://c", "short"),
        (7, "http://d", None), (8, "", ""), (10, "http://e", "x" * 300_000), (11, "http://f", "\r\n\r\nWARC/1.1\r\n" * 10), (12, "u", "a" * 100), (13, "u", "a" * 100),
        (14, "u", "b" * 99), (15, "u", "b" * 99),
    ]
    return spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, type string").repartition(3)


def expected(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[html] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out)


def test_round_trip(spark, pages, rows):
    given = [tuple(r)[:3] for r in pages.collect()]
    assert rows(warc.round_trip(pages), "id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(
        expected(given), key=lambda t: tuple((v is not None, str(v)) for v in t)
    )
    assert warc.round_trip(pages.filter("false")).count() == 0
    twice = warc.round_trip(pages.filter("page_id = 5").unionAll(pages.filter("page_id = 5")).withColumn("page_id", pages["page_id"] * 1))
    assert [r["record_type"] for r in twice.collect()] == ["response", "response"]


def test_filters_and_files(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write(pages, path)
    found = warc.read(spark, path)
    assert {r["target_uri"] for r in found.collect()} >= {"http://a/%0A\r\n2", None, ""}
    picked = found.filter("type = 'revisit' and record_id in ('5', '9', '3')")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "type" in plan
    assert sorted(r["record_id"] for r in picked.collect()) == ["5", "9"]
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())
    # What a lost attempt left is not in the manifest.
    with open(os.path.join(path, "lost.warc.gz"), "wb") as out:
        out.write(warc.member(warc.record_bytes("99", "x", "d", b"", "", None)))
    assert warc.read(spark, path).filter("record_id = '99'").count() == 0
    # Any archive of the folder is read where there is no manifest.
    other = tmp_path / "b"
    other.mkdir()
    record = warc.record_bytes("1", "http://x", "d", b"body", "ab", None)
    (other / "plain.warc").write_bytes(record + record)
    (other / "usual.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record) + warc.member(record))
    assert [bytes(r["payload"]) for r in warc.read(spark, str(other)).collect()] == [b"body"] * 5
    assert warc.read(spark, str(other), payload=False).count() == 5


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        part = super().read(n)
        self.taken += len(part)
        return part


def test_headers_first():
    big = os.urandom(1 << 20)
    data = warc.member(warc.record_bytes("1", "u", "d", big, "x", None)) * 3
    file = Counting(data)
    ids = [f["warc-record-id"] for f, _ in warc.Archive(file, len(data))]
    assert len(ids) == 3 and file.taken < 4 * warc._HEAD
    assert gzip.decompress(data)[:8] == b"WARC/1.1"
    bodies = [warc.payload_of(c(), f) for f, c in warc.Archive(io.BytesIO(data), len(data))]
    assert bodies == [big] * 3
    with pytest.raises(ValueError, match="cut off"):
        [c() for _, c in warc.Archive(io.BytesIO(data[:5000]), 5000)]


def test_pushed_filters_decide_before_content():
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([warc.EqualTo(("type",), "response"), warc.In(("record_id",), ("1", "2")), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and reader.allowed == {"type": {"response"}, "record_id": {"1", "2"}}
    assert isinstance(reader._batch([[None] * 8], [*warc.FIELDS, "payload"], {}), pa.RecordBatch)
