"""WARC files as a Python data source: planned splits, pushed filters, headers first, unwanted payloads undecoded.

A file is a run of records, each by itself a gzip member (``.warc.gz``) or plain. Splits are byte ranges; a record
belongs to the range that it starts in. Filters on the record type and on headers are taken over from Spark: they are tested
when a record's header has been read; the block of a record that fails is passed over (plain) or inflated into
nothing (gzip), and never parsed or decoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from spindrift.llm._common import pick, shared_path

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, headers map<string,string>, http_status int, http_headers map<string,string>, payload string"
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.string()),
])
#: Columns that a record's header alone decides, and the header of each.
HEADER_COLUMNS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
SPLIT_BYTES, _CHUNK, _BATCH_BYTES = 16 << 20, 1 << 16, 4 << 20
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


class Damaged(Exception):
    """A record that can't be read; ``resync`` goes on with the next one that starts after its own start."""


class _Plain:
    """Records of a plain file from the first that starts at or after ``start``; ``skip`` seeks."""

    magic = b"WARC/1."

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.at, self.end, self.size, self.buffer, self.start = file, start, end, size, b"", start

    def resync(self) -> None:
        self.at, self.buffer = self.start + 1, b""
        self.sync()
        self.start = self.at

    def _fill(self, n: int) -> None:
        while len(self.buffer) < n and (more := self.file.read(max(_CHUNK, n - len(self.buffer)))):
            self.buffer += more

    def sync(self) -> None:
        if not self.at:
            self.file.seek(0)
            return
        back = max(0, self.at - 4)  # a record follows the end of the one before
        self.file.seek(back)
        mark, offset = b"\r\n\r\n" + self.magic, back
        while True:
            self._fill(len(self.buffer) + _CHUNK)
            if (i := self.buffer.find(mark)) >= 0:
                self.buffer, self.at = self.buffer[i + 4 :], offset + i + 4
                return
            if len(self.buffer) < _CHUNK:
                self.at = self.size
                return
            offset += len(self.buffer) - len(mark)
            self.buffer = self.buffer[-len(mark) :]

    def header(self) -> bytes | None:
        if self.at > self.size:
            raise Damaged("a length beyond the end of the file")
        if self.at >= min(self.end, self.size):
            return None
        self._fill(len(self.magic))
        if not self.buffer.startswith(self.magic):
            raise Damaged("no record where the one before ends")
        self.start, size = self.at, _CHUNK
        while (i := self.buffer.find(b"\r\n\r\n")) < 0:
            before = len(self.buffer)
            self._fill(before + size)
            if len(self.buffer) == before:
                raise Damaged("a header without an end")
        head, self.buffer = self.buffer[:i], self.buffer[i + 4 :]
        self.at += i + 4
        return head

    def block(self, n: int) -> bytes:
        if self.at + n + 4 > self.size:
            raise Damaged("a length beyond the end of the file")
        self._fill(n + 4 + len(self.magic))
        after = self.buffer[n + 4 :]
        if self.buffer[n : n + 4] != b"\r\n\r\n" or after and not after.startswith(self.magic):
            raise Damaged("a block that doesn't end where its length says")
        out, self.buffer = self.buffer[:n], after
        self.at += n + 4
        return out

    def skip(self, n: int) -> None:
        self.at += n + 4
        if len(self.buffer) >= n + 4:
            self.buffer = self.buffer[n + 4 :]
        else:
            self.buffer = b""
            self.file.seek(self.at)


class _Gzip:
    """Records of a file of gzip members; a member is inflated up to its header first, then as far as wanted."""

    magic = b"\x1f\x8b\x08"

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.at, self.end, self.size, self.start = file, start, end, size, start
        self.raw, self.open, self.text = b"", None, b""

    def resync(self) -> None:
        self.at, self.raw, self.open = self.start + 1, b"", None
        self.sync()
        self.start = self.at

    def sync(self) -> None:
        self.file.seek(self.at)
        if not self.at:
            return
        base = self.at
        while True:
            more = self.file.read(_CHUNK)
            self.raw += more
            search = 0
            while (i := self.raw.find(self.magic, search)) >= 0:
                if len(self.raw) - i < 512 and more:
                    break  # too little to tell: read on
                try:
                    if zlib.decompressobj(31).decompress(self.raw[i:], 16).startswith(b"WARC/1."):
                        self.raw, self.at = self.raw[i:], base + i
                        return
                except zlib.error:
                    pass
                search = i + 1
            if not more:
                self.at = self.size
                return
            keep = i if i >= 0 else max(0, len(self.raw) - 2)
            self.raw, base = self.raw[keep:], base + keep

    def _more(self, limit: int) -> bytes:
        """Up to ``limit`` further bytes of the open member; none at its end, after which the next one follows."""
        while self.open is not None:
            if self.open.eof:
                rest = self.open.unused_data
                self.at += self.fed - len(rest)
                self.raw, self.open = rest, None
                return b""
            data = self.open.unconsumed_tail or self.raw or self.file.read(_CHUNK)
            if data is self.raw:
                self.raw = b""
                self.fed += len(data)
            elif data is not self.open.unconsumed_tail:
                self.fed += len(data)
            if not data:
                raise Damaged("a member that is cut off")
            try:
                out = self.open.decompress(data, limit)
            except zlib.error as e:
                raise Damaged("a member that can't be inflated") from e
            if out:
                return out
        return b""

    def header(self) -> bytes | None:
        while self.open is not None:
            self._more(1 << 20)
        if self.at >= min(self.end, self.size):
            return None
        self.open, self.text, self.fed, self.start = zlib.decompressobj(31), b"", 0, self.at
        while (i := self.text.find(b"\r\n\r\n")) < 0:
            if not (more := self._more(2048)):
                raise Damaged("a header without an end")
            self.text += more
        if not self.text.startswith(b"WARC/1."):
            raise Damaged("no record")
        head, self.text = self.text[:i], self.text[i + 4 :]
        return head

    def block(self, n: int) -> bytes:
        parts, have = [self.text], len(self.text)
        while more := self._more(1 << 20):  # to the member's end, where its checksum stands
            parts.append(more)
            have += len(more)
        if have < n:
            raise Damaged("a block that ends before its length")
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        """``header`` inflates what is left into nothing."""


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    if not block.startswith(b"HTTP/"):
        return None, {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    status = head.split(b"\r\n", 1)[0].split(b" ")
    return int(status[1]) if len(status) > 1 and status[1].isdigit() else None, _fields(head), body


def _decode(body: bytes, kind: str) -> str:
    m = _CHARSET.search(kind)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int

    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def plan(files: list[tuple[str, int]], split_bytes: int) -> list[Split]:
    """Byte ranges of about ``split_bytes``; empty files have none."""
    out = []
    for path, size in sorted(files):
        n = max(1, -(-size // split_bytes)) if size else 0
        out += [Split(path, size * i // n, size * (i + 1) // n, size) for i in range(n)]
    return out


def _test(f):
    """(column, predicate of a header's value) of a filter that a record's header decides, or None."""
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in HEADER_COLUMNS:
        return None
    if isinstance(f, IsNotNull):
        return column, lambda v: v is not None
    if isinstance(f, EqualTo):
        return column, lambda v, w=f.value: v is not None and v == w
    if isinstance(f, In):
        return column, lambda v, w=frozenset(f.value): v is not None and v in w
    for kind, ask in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(f, kind):
            return column, lambda v, w=f.value, ask=ask: v is not None and ask(v, w)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payload: bool):
        self.path, self.split_bytes, self.payload, self.filters = path, split_bytes, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True)) if info.type == pafs.FileType.Directory else []
        splits = plan([(i.path, i.size) for i in found if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path)], self.split_bytes)
        return splits or [Split("", 0, 0, 0)]

    def read(self, partition: Split):
        if not partition.path:
            return
        tests = [(HEADER_COLUMNS[c], t) for c, t in map(_test, self.filters)]
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as file:
            reader = (_Gzip if partition.path.endswith(".gz") else _Plain)(file, partition.start, partition.end, partition.size)
            reader.sync()
            while True:
                try:
                    if (head := reader.header()) is None:
                        break
                    h = _fields(head)
                    if not re.fullmatch(r"\d{1,18}", said := h.get("content-length", "")):
                        raise Damaged("no length")
                    length = int(said)
                    if not all(t(h.get(name)) for name, t in tests):
                        reader.skip(length)
                        continue
                    status, http, text = None, {}, None
                    if self.payload:
                        status, http, body = _http(reader.block(length))
                        text = None if h.get("warc-payload-null") else _decode(body, http.get("content-type", h.get("content-type", "")))
                    else:
                        reader.skip(length)
                except Damaged:
                    reader.resync()
                    continue
                rows.append((*[h.get(HEADER_COLUMNS[c]) for c in HEADER_COLUMNS], length, list(h.items()), status, list(http.items()), text))
                size += length
                if size > _BATCH_BYTES or len(rows) >= 2000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{k}: {quote(v, safe=_SAFE) if k == 'WARC-Target-URI' else v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


#: All but control characters and space stand as they are in a written URI; "%" too, so that it reads back the same.
_SAFE = "".join(map(chr, range(33, 127)))


@dataclass
class Written(WriterCommitMessage):
    """A task's file, by the name that it gets when the job commits."""

    name: str


class WarcWriter(DataSourceArrowWriter):
    """A warcinfo record for each file, then a request and a response for each page (page_id, url, html).

    Attempts write into a folder of the job, under names that no reader takes. ``commit`` moves the files of the attempts that
    Spark counts to where they are read; what other attempts left goes with the folder.
    """

    def __init__(self, path: str, gzip: bool):
        self.path, self.gzip, self.job = path, gzip, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{base}/_{self.job}", recursive=True)
        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}-{self.job}.warc" + ".gz" * self.gzip
        with fs.open_output_stream(f"{base}/_{self.job}/{name}.open", compression=None) as out:
            out.write(self._member(_record("warcinfo", {"WARC-Record-ID": self._id("info", name), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
            for batch in iterator:
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    own = {"X-Page-Id": None if page is None else str(page), "X-Page-Url": None if url is None else json.dumps(url, ensure_ascii=False), "WARC-Target-URI": url, "WARC-Date": "2024-01-01T00:00:00Z"}
                    request = _record("request", own | {"WARC-Record-ID": self._id("request", page), "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n")
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "replace")
                    response = _record("response", own | {"WARC-Record-ID": self._id("response", page), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Null": "1" if html is None else None}, block)
                    out.write(self._member(request) + self._member(response))
        return Written(name)

    def commit(self, messages):
        fs, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{base}/_{self.job}/{m.name}.open", f"{base}/{m.name}")
        self._clear()

    def abort(self, messages):
        fs, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{base}/{m.name}").type == pafs.FileType.File:  # a commit broke off
                fs.delete_file(f"{base}/{m.name}")
        self._clear()

    def _clear(self) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{base}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_{self.job}")

    @staticmethod
    def _id(kind: str, what) -> str:
        return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{kind}:{what}'.encode()).hexdigest())}>"

    def _member(self, record: bytes) -> bytes:
        if not self.gzip:
            return record
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(record) + z.flush()


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("splitBytes", n).option("payload", "false").load(folder)``.

    All headers are in ``headers`` (names in lower case, the last of several counts); http_status, http_headers and
    payload are what a block holds, by its declared character set, undecodable bytes as U+FFFD. With ``payload`` off
    blocks are passed over. Load anew for each set of filters: Spark keeps what was pushed with a loaded frame, also when
    that frame is then read without a filter. A null URL, an absent header and a null page read back as null, an empty page as ''.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(_local(self.options["path"]), int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(_local(self.options["path"]), self.options.get("gzip", "true").lower() == "true")


def _local(path: str) -> str:
    """A URI; Spark also writes file:/x for file:///x."""
    return "file://" + path if path.startswith("/") else re.sub(r"^file:/(?!/)", "file:///", path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", gzip: bool = True) -> None:
    """Write (page_id, url, html) as WARC files, one a partition; of a task that runs again only the counted attempt's is read."""
    register(pages.sparkSession)
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows.write.format("warc").option("gzip", str(gzip).lower()).mode("append").save(path)


def read_pages(spark: SparkSession, path: str, prefix: str | None = None, **options) -> DataFrame:
    """(page_id, url, html, content_length) of all responses, or of those whose URI starts with ``prefix``; filters are pushed.

    url is the page's own, as it was written: the URI of the record's header stands percent-encoded there, the URL itself in a
    header of its own. Damaged records (no readable length, a length that doesn't lead to the next record, a member
    that can't be inflated or is cut off) are left out, and reading goes on at the next record that starts after theirs.
    """
    register(spark)
    rows = spark.read.format("warc").options(**options).load(path).where(F.col("warc_type") == "response")
    if prefix is not None:
        rows = rows.where(F.col("target_uri").startswith(prefix))
    own = F.from_json(F.concat(F.lit('{"u":'), F.col("headers")["x-page-url"], F.lit("}")), "u string")["u"]
    return rows.select(F.col("headers")["x-page-id"].cast("bigint").alias("page_id"), F.coalesce(own, "target_uri").alias("url"), F.col("payload").alias("html"), "content_length")


def through_warc(pages: DataFrame, prefix: str | None = None) -> DataFrame:
    """``pages`` written to WARC files in the shared folder and read back by ``read_pages``: every row, null URLs and all."""
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path, prefix)


ORACLE_PAGES = """
SELECT page_id, url, html, CAST(octet_length(encode(coalesce(html, ''))) + octet_length(encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10))) AS BIGINT) AS content_length
FROM pages
"""
