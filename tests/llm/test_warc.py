import io

import pytest
from pyspark.sql import functions as F

from spindrift.llm import warc

PAGES = "page_id bigint, url string, html string, payload string, HTML2 string"
ROWS = [
    (1, "http://a.example.com/x?y=1%20z", "<html>é 日本 &amp;</html>\r\n\r\nWARC/1.1 not a record", "c", "d"),
    (2, "https://b.example.com/", "", "c", "d"),
    (3, None, "<p>no url</p>", "c", "d"),
    (4, "http://c.example.com/null", None, "c", "d"),
    (None, "http://d.example.com/", "no id", "c", "d"),
    (5, "ftp://e.example.com/", "other scheme", "c", "d"),
    (6, "http://f.example.com/long", "abc\n" * 60_000, "c", "d"),
    (1, "http://a.example.com/x?y=1%20z", "again", "c", "d"),
    (7, 'http://ex.com/é?q=a b&c="\\\u2028\r\n', "odd", "c", "d"),
    (8, "", "empty url", "c", "d"),
    (9, " x ", "no scheme", "c", "d"),
]


@pytest.fixture(scope="module", params=[True, False], ids=["gzip", "plain"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "files")
    rows = ROWS + [(100 + i, f"http://g.example.com/{i}", f"body {i} " * (i % 50), "c", "d") for i in range(300)]
    warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(3), path, gzip=request.param)
    return path, rows


@pytest.mark.parametrize("split", [1 << 24, 4_000, 700])
def test_round_trip(spark, folder, split):
    path, rows = folder
    got = sorted((repr((r["page_id"], r["url"], r["html"])) for r in warc.read_pages(spark, path, splitBytes=split).collect()))
    assert got == sorted(repr(r[:3]) for r in rows)
    some = warc.read_pages(spark, path, "http", splitBytes=split)
    assert sorted(repr((r["page_id"], r["url"], r["html"])) for r in some.collect()) == sorted(repr(r[:3]) for r in rows if r[1] and r[1].startswith("http"))


def test_filters_are_pushed_and_payloads_left_alone(spark, folder):
    path, rows = folder
    warc.register(spark)
    df = lambda: spark.read.format("warc").load(path)
    assert df().where("warc_type = 'request'").count() == len(rows) and df().where("warc_type = 'warcinfo'").count() >= 1
    one = df().where((F.col("warc_type") == "response") & (F.col("target_uri") == "http://g.example.com/7"))
    assert [r["payload"] for r in one.collect()] == ["body 7 " * 7]
    plan = one._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter (" in x and ("warc_type" in x or "target_uri" in x)]
    assert df().where("http_status = 200 and warc_type in ('response', 'metadata')").count() == len(rows)
    assert df().where("target_uri is null and warc_type = 'response'").count() == 1
    bare = lambda: spark.read.format("warc").option("payload", "false").load(path)
    assert bare().where("payload is not null or http_status is not null").count() == 0 and bare().count() == df().count()


def test_unwanted_blocks_are_never_parsed(monkeypatch, tmp_path):
    record = lambda kind, body: warc._record(kind, {"WARC-Target-URI": "http://a/"}, body)
    (tmp_path / "a.warc").write_bytes(record("request", b"x" * 200_000) + record("response", b"HTTP/1.1 404 No\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9"))
    seen = []
    monkeypatch.setattr(warc, "_http", lambda b, f=warc._http: seen.append(b) or f(b))
    reader = warc.WarcReader(f"file://{tmp_path}", 1 << 20, True)
    rest = list(reader.pushFilters([warc.EqualTo(("warc_type",), "response"), warc.EqualTo(("payload",), "x")]))
    assert [f.attribute for f in rest] == [("payload",)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["http_status"], r["payload"]) for r in rows] == [(404, "é")] and len(seen) == 1


def test_plain_skip_seeks():
    class Counting(io.BytesIO):
        bytes_read = 0

        def read(self, n=-1):
            out = super().read(n)
            self.bytes_read += len(out)
            return out

    one = warc._record("request", {}, b"x" * 10_000_000)
    f = Counting(one + warc._record("response", {}, b"y"))
    r = warc._Plain(f, 0, 1 << 40, len(f.getvalue()))
    r.sync()
    r.header()
    r.skip(10_000_000)
    assert b"response" in r.header() and r.block(1) == b"y" and f.bytes_read < 300_000


def test_plan():
    assert [(s.start, s.end) for s in warc.plan([("b", 10), ("a", 0)], 4)] == [(0, 3), (3, 6), (6, 10)]


def test_no_files(spark, tmp_path):
    assert warc.read_pages(spark, str(tmp_path)).count() == 0
    assert warc.through_warc(spark.createDataFrame([], PAGES)).count() == 0


def test_only_committed_attempts_are_read(monkeypatch, tmp_path):
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import TaskContext

    uri = f"file://{tmp_path}/files"
    writer = pickle.loads(pickle.dumps(warc.WarcWriter(uri, True)))
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 1], "url": ["http://a/", "http://a/"], "html": ["x", "x"]})

    def attempt(k):
        monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: k))
        return writer.write(iter([batch]))

    def read():
        reader = warc.WarcReader(uri, 1 << 20, True)
        list(reader.pushFilters([warc.EqualTo(("warc_type",), "response")]))
        return [r["payload"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    attempt(0)  # whole, but lost before it was counted
    counted = attempt(1)
    assert read() == []
    writer.commit([counted, None])
    assert read() == ["x", "x"] and len([p for p in (tmp_path / "files").rglob("*")]) == 1
    writer.job = "other"
    gone = attempt(2)
    writer.abort([gone, None])
    assert read() == ["x", "x"] and len([p for p in (tmp_path / "files").rglob("*")]) == 1


def _read(path, split, only=None):
    reader = warc.WarcReader(f"file://{path}", split, True)
    if only:
        list(reader.pushFilters([warc.EqualTo(("warc_type",), only)]))
    return [r["payload"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("split", [1 << 24, 500, 90])
@pytest.mark.parametrize("bad", ["Content-Length: x", "Content-Length: -4", "Content-Length: 999999999999", "Content-Length: 40", "Content-Length: 3", "No-Length: 1"])
def test_damaged_records_of_plain_files(tmp_path, bad, split):
    record = lambda i: warc._record("response", {}, f"HTTP/1.1 200 OK\r\n\r\nbody {i}".encode())
    wrong = record(3).replace(b"Content-Length: 25", bad.encode())
    assert wrong != record(3)
    (tmp_path / "a.warc").write_bytes(record(1) + record(2) + wrong + record(4) + record(5) + record(6)[:40])
    assert _read(tmp_path, split) == ["body 1", "body 2", "body 4", "body 5"]
    assert _read(tmp_path, split, "request") == []


@pytest.mark.parametrize("split", [1 << 24, 300])
def test_damaged_members(tmp_path, split):
    writer = warc.WarcWriter("file:///x", True)
    record = lambda i: writer._member(warc._record("response", {}, f"HTTP/1.1 200 OK\r\n\r\nbody {i} ".encode() + bytes(range(256)).hex().encode() * i))
    flipped, cut, tail = bytearray(record(3)), record(5)[:-30], bytearray(record(7))
    flipped[len(flipped) // 2] ^= 255
    tail[-6] ^= 255  # the checksum
    (tmp_path / "a.warc.gz").write_bytes(record(1) + record(2) + flipped + record(4) + cut + record(6) + tail + record(8) + record(9)[:50])
    assert [p.split(" ")[1] for p in _read(tmp_path, split)] == ["1", "2", "4", "6", "8"]
