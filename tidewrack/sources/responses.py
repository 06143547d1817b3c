"""Stored HTTP responses as a data source: folders of WARC files, one folder for each host.

A row is one answer as it came from the network, so a redirect is a row of its own with its location: following them is
the work of `operators.hops`. A row that was not answered has status 0 and the error as its body. Bodies are unpacked, and
kept of HTML answers alone unless the option `bodies` is `all`.

Reading: small files come together in tasks of PART_BYTES, a larger file is a task of its own. Equality and lists of hosts choose the folders before any file is opened; filters on
url and status leave records out before their bodies are unpacked. A schema given to the reader chooses the columns.

Writing: a task writes its files to a staging folder, and the commit moves them to the folders of their hosts; what a
failed task or job wrote is never read. Rows of one host should come together (`repartition("host")` and sort): a task keeps one file open.

Paths are local ones or URIs that pyarrow.fs knows."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = {"host": pa.string(), "url": pa.string(), "fetched": pa.string(), "status": pa.int32(), "location": pa.string(), "content_type": pa.string(), "body": pa.binary()}
SCHEMA = "host string, url string, fetched string, status int, location string, content_type string, body binary"
#: Records of a batch, and bytes of bodies after which it is sent on.
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000
#: Bytes of files that a task reads, unless one file is larger.
PART_BYTES = 32_000_000
STAGING = "_staging"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def host_of(url: str) -> str:
    return urlsplit(url).netloc.lower()


def _head(lines: Iterator[bytes]) -> dict[str, str]:
    """Header lines up to the first empty one; names in lower case, the first of equal ones."""
    out: dict[str, str] = {}
    for line in lines:
        if not line.strip():
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def unpacked(body: bytes, encoding: str) -> bytes:
    """A body without its content coding; as it is where that can't be read."""
    try:
        if encoding in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if encoding == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def records(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, content) of each record of an unpacked WARC file."""
    while line := raw.readline():
        if line.startswith(b"WARC/"):
            head = _head(iter(raw.readline, b""))
            yield head, raw.read(int(head["content-length"]))


def answer(head: dict[str, str], content: bytes, wanted: dict[str, set], whole: bool) -> dict | None:
    """The row of a record; None if it is no answer or a filter leaves it out."""
    url = head.get("warc-target-uri", "").strip("<>")
    if head.get("warc-type") not in ("response", "metadata") or ("url" in wanted and url not in wanted["url"]):
        return None
    row = {"host": host_of(url), "url": url, "fetched": head.get("warc-date"), "status": 0, "location": None, "content_type": None, "body": content}
    if head["warc-type"] == "response":
        stream = io.BytesIO(content)
        first = stream.readline().split(None, 2)
        row["status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else 0
        own = _head(iter(stream.readline, b""))
        row["location"], row["content_type"] = own.get("location"), own.get("content-type")
        if "status" not in wanted or row["status"] in wanted["status"]:
            html = "html" in (row["content_type"] or "").lower()
            row["body"] = unpacked(stream.read(), own.get("content-encoding", "").lower()) if whole or (html and row["status"] < 400) else b""
    if ("status" in wanted and row["status"] not in wanted["status"]) or ("host" in wanted and row["host"] not in wanted["host"]):
        return None
    return row


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], whole: bool):
        self.path, self.columns, self.whole = path, columns, whole
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes equality and lists of host, url and status; gives back what Spark must judge itself."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("host",), ("url",), ("status",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            elif not (isinstance(f, IsNotNull) and f.attribute in (("host",), ("url",), ("status",))):  # these never are null
                yield f

    def partitions(self):
        """The files of the wanted hosts' folders; other folders are not listed."""
        store, root = _open(self.path)
        if "host" in self.wanted:
            folders = [f"{root}/host={quote(h, safe='')}" for h in sorted(self.wanted["host"])]
        else:
            folders = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("host=")]
        found = [i for f in folders for i in store.get_file_info(fs.FileSelector(f, allow_not_found=True)) if i.is_file and ".warc" in i.base_name]
        parts: list[list[str]] = [[]]
        held = 0
        for i in sorted(found, key=lambda i: i.path):
            if parts[-1] and held + i.size > PART_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(i.path)
            held += i.size
        return [Files(p) for p in parts]

    def read(self, partition: Files):
        store, _ = _open(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as raw, io.BufferedReader(raw, 1 << 20) as lines:
                for head, content in records(lines):
                    row = answer(head, content, self.wanted, self.whole)
                    if row is None:
                        continue
                    rows.append(row)
                    held += len(row["body"])
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], COLUMNS[c]) for c in self.columns], self.columns)


def record(row: dict) -> bytes:
    """A row as a WARC record, packed by itself."""
    body = row.get("body") or b""
    body = body.encode() if isinstance(body, str) else body
    status = row.get("status") or 0
    if status:
        head = [f"HTTP/1.1 {status} -"] + [f"{n}: {row[k]}" for n, k in (("Location", "location"), ("Content-Type", "content_type")) if row.get(k)]
        content = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body
    else:
        content = body
    kind, form = ("response", "application/http;msgtype=response") if status else ("metadata", "text/plain")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['url'])}>", f"WARC-Target-URI: {row['url']}"]
    lines += [f"WARC-Date: {row['fetched']}"] if row.get("fetched") else []
    whole = "\r\n".join([*lines, f"Content-Type: {form}", f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0)


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        task, out, now, moves = uuid.uuid4().hex, None, None, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    host = host_of(row["url"])
                    if host != now:
                        if out:
                            out.close()
                        now, folder = host, f"host={quote(host, safe='')}"
                        name = f"{task}-{len(moves):05d}.warc.gz"
                        store.create_dir(f"{root}/{STAGING}/{self.job}")
                        moves.append((f"{root}/{STAGING}/{self.job}/{name}", f"{root}/{folder}/{name}"))
                        out = store.open_output_stream(moves[-1][0], compression=None)
                    out.write(record(row))
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.base_name.startswith("host="):
                    store.delete_dir(i.path)
        for m in messages:
            for staged, final in m.staged if m else []:
                store.create_dir(final.rsplit("/", 1)[0])
                store.move(staged, final)
        self.clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*_open(self.path))

    def clear(self, store: fs.FileSystem, root: str) -> None:
        folder = f"{root}/{STAGING}/{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class StoredResponses(DataSource):
    """spark.read.format("stored_responses").load(folder); options: bodies = html (default) or all."""

    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if unknown := [f.name for f in schema if f.name not in COLUMNS]:
            raise ValueError(f"stored responses have no columns {unknown}")
        return Reader(self.options["path"], schema.names, self.options.get("bodies", "html") == "all")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if "url" not in schema.names:
            raise ValueError("stored responses need a url")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredResponses)


def read(spark: SparkSession, path: str, columns: str | None = None, bodies: str = "html") -> DataFrame:
    """(host, url, fetched, status, location, content_type, body) of a folder; columns: a schema of fewer of them."""
    register(spark)
    reader = spark.read.format("stored_responses").option("bodies", bodies)
    return (reader.schema(columns) if columns else reader).load(path)


def store(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (url, status, location, content_type, fetched, body), those that there are; hosts come together first, each spread over salts."""
    from pyspark.sql import functions as F

    register(df.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    # A host may hold a third of all rows: its rows go to several tasks, each of which writes a file of its own.
    salted = df.withColumns({"_host": host, "_salt": F.pmod(F.xxhash64("url"), F.lit(16))})
    ready = salted.repartition("_host", "_salt").sortWithinPartitions("_host", "url").drop("_host", "_salt")
    ready.write.format("stored_responses").mode(mode).save(path)
