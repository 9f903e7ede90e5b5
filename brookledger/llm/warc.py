"""WARC archives with a two-level capture index.

``write`` makes one record per page, each a gzip member of its own, in files that
tasks write side by side in a shared folder. Of records with equal payloads of at
least ``least`` bytes, that with the smallest id is the response; the others are
revisits that hold its id, the digest and the HTTP headers, but no payload.
Payload hashes meet in a grouped minimum of slim rows; a hot payload's rows are
joined as a skewed join, which adaptive execution splits.

``index`` range-sorts captures by reversed-host URL key and packs runs of
``ENTRIES`` of them into compressed blocks; the directory keeps each block's
first and last key and place. A directory of more than ``TOP`` blocks (100 million
captures) is packed into blocks in the same way, and so on, until the topmost one
is small enough to be broadcast. ``lookup`` and ``scan`` binary-search that one, then
read only the byte ranges of the blocks that can match; ``read`` fetches records
by byte range. Only captures that a written table names belong to the archive: a
task that is run again leaves a file that nothing refers to.

Defined results: a null html is an empty payload; a null url has an empty key; a
null id is never referred to while there is another; rows that repeat both the
smallest id and its payload are all responses; an empty table gives an empty
archive; further columns of the pages are ignored. Records have ids of their own;
page ids stand in fields of their own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage

#: Captures a block, blocks that are broadcast at most, and bytes after which a task begins another file.
ENTRIES, TOP, FILE_BYTES = 1024, 100_000, 1 << 30
#: Ids are text in the tasks: beside a null, pandas would read large ones as floating point.
CAPTURE = "key string, page_id string, file string, offset long, length long"
BLOCK = "first_key string, last_key string, file string, offset long, length long"
RECORD = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host parts in reverse, then the path and query: ``com,example,www)/a?b=c``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return (url or "").replace("\n", " ").replace("\t", " ")
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, default) else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{place}){path}".replace("\n", " ").replace("\t", " ") if url else ""


class _Files:
    """Files of one task in a folder that any file system of pyarrow can hold."""

    def __init__(self, folder: str, name: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)
        self.name, self.out, self.at, self.made = name, None, 0, []
        self.fs.create_dir(self.root, recursive=True)

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.file, self.at = self.name.format(uuid.uuid4().hex), 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None)
        place = self.file, self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Byte ranges of files in a folder; keeps the last file open."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.fs, self.root = FileSystem.from_uri(folder)
        self.file, self.handle = None, None

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file != self.file:
            if self.handle is not None:
                self.handle.close()
            self.file, self.handle = file, self.fs.open_input_file(f"{self.root}/{file}")
        self.handle.seek(offset)
        return self.handle.read(length)


def record(name: str, date: str, page_id: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, refers_url: str | None) -> bytes:
    """One record as a gzip member; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    plain = lambda x: (x or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {plain(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {page_id or ''}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {plain(refers_url)}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple:
    """page_id, url, payload, payload_bytes, digest, record_type, refers_to of a record. Fails where a payload doesn't match its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return fields["Page-ID"] or None, fields["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, fields.get("Refers-To-Page-ID")


@dataclass(frozen=True)
class Archive:
    """``directory`` lists the topmost blocks; ``levels`` is how many directories lie below one another."""

    folder: str
    captures: DataFrame
    directory: DataFrame
    levels: int = 1


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str | None = None) -> DataFrame:
    """Writes the records of ``pages`` (page_id, url, html) and returns their captures. ``date`` is that of the records, now if None."""
    folder = folder or new_path(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("sha"),
    )
    first = stage(  # written, so that Spark knows its size when it picks the join
        base.where(F.col("bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "first", "first_url"),
        "warc-first",
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= least)
    rows = base.join(first, "sha", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", F.when(~revisit, F.col("html").cast("binary")).alias("payload"), "bytes", "sha",
        F.when(revisit, F.col("first")).cast("string").alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"),
    )

    names = rows.columns

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, task, n = _Files(folder, "pages-{}.warc.gz"), uuid.uuid4().hex, 0
        for pdf in batches:
            out = []
            for page_id, url, payload, size, sha, refers, refers_url in zip(*(pdf[c].tolist() for c in names)):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(f"{task}-{n}", date, page_id, url, None if refers is not None else bytes(payload), size, digest, refers, refers_url)
                n += 1
                out.append((url_key(url), page_id, *files.add(data)))
            yield pd.DataFrame(out, columns=_columns(CAPTURE))
        files.close()

    return stage(_long(rows.mapInPandas(of, CAPTURE), "page_id"), "warc-captures")


def index(rows: DataFrame, folder: str, entries: int = ENTRIES) -> DataFrame:
    """Writes blocks of captures, or of a directory's rows, and returns their directory."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(parts, 1 + rows.count() // (4 * entries))  # whole blocks, but for the last one of a task
    first, second = rows.columns[:2]  # key and page_id, or first_key and last_key

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, lines, ends = _Files(folder, "index-{}.cdx"), [], []

        def block() -> pd.DataFrame:
            place = files.add(zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass")))
            row = (ends[0][0], max(x for _, x in ends), *place)
            lines.clear()
            ends.clear()
            return pd.DataFrame([row], columns=_columns(BLOCK))

        for pdf in batches:
            for key, other, file, offset, length in zip(*(pdf[c].tolist() for c in pdf.columns)):
                lines.append(f"{key}\t{'' if other is None else other}\t{file}\t{offset}\t{length}")
                ends.append((key, other if second == "last_key" else key))
                if len(lines) == entries:
                    yield block()
        if lines:
            yield block()
        files.close()

    order = [first, second, "offset"]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(sorted_rows.select(first, F.col(second).cast("string").alias(second), "file", "offset", "length").mapInPandas(of, BLOCK), "warc-directory")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, date: str | None = None, entries: int = ENTRIES, top: int = TOP) -> Archive:
    """Records, blocks, and as many directories above one another as it takes for the topmost one to have ``top`` rows at most."""
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write(pages, folder, least, date)
    directory, levels = index(captures, folder, entries), 1
    while directory.count() > top:
        directory, levels = index(directory, folder, entries), levels + 1
    return Archive(folder, captures, directory, levels)


def _directory(made: Archive) -> pd.DataFrame:
    """The topmost directory, sorted; ``archive`` keeps it small."""
    return made.directory.toPandas().sort_values(["first_key", "last_key"], kind="stable").reset_index(drop=True)


def _entries(ranges: _Ranges, file: str, offset: int, length: int) -> Iterator[tuple]:
    for line in zlib.decompress(ranges.read(file, offset, length)).decode("utf-8", "surrogatepass").split("\n"):
        key, other, name, at, size = line.split("\t")
        yield key, other, name, int(at), int(size)


def _captures(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, page_id or None, *place) for key, page_id, *place in rows], columns=_columns(CAPTURE))


def scan(made: Archive, low: str = "", high: str | None = None) -> DataFrame:
    """Captures with ``low <= key < high`` (all keys from ``low`` on where ``high`` is None)."""
    spark, folder = made.captures.sparkSession, made.folder
    rows = _directory(made)
    first = bisect_left(rows["last_key"].cummax().tolist(), low)
    last = len(rows) if high is None else bisect_left(rows["first_key"].tolist(), high)
    rows = rows.iloc[first : max(first, last)]
    if rows.empty:
        return _long(spark.createDataFrame([], CAPTURE), "page_id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def of(captures: bool):
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ranges = _Ranges(folder)
            for pdf in batches:
                for place in zip(pdf["file"].tolist(), pdf["offset"].tolist(), pdf["length"].tolist()):
                    found = [x for x in _entries(ranges, *place) if low <= (x[0] if captures else x[1]) and (high is None or x[0] < high)]
                    yield _captures(found) if captures else pd.DataFrame(found, columns=_columns(BLOCK))

        return read

    blocks = spark.createDataFrame(rows[["file", "offset", "length"]]).repartition(min(len(rows), parts))
    for _ in range(made.levels - 1):
        blocks = blocks.mapInPandas(of(False), BLOCK).select("file", "offset", "length").repartition(parts)
    return _long(blocks.mapInPandas(of(True), CAPTURE), "page_id")


def lookup(made: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each distinct URL of ``urls``. A key meets its blocks by
    binary search; keys are then gathered by block, and each block is read once a task."""
    spark, folder = made.captures.sparkSession, made.folder
    rows = _directory(made)
    shared = spark.sparkContext.broadcast((rows["first_key"].tolist(), rows["last_key"].cummax().tolist(), list(zip(rows["file"].tolist(), rows["offset"].tolist(), rows["length"].tolist()))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = "key string, file string, offset long, length long"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, places = shared.value
        for pdf in batches:
            out = []
            for key in map(url_key, pdf["url"]):
                out += [(key, *places[k]) for k in range(bisect_left(last, key), bisect_right(first, key))]
            yield pd.DataFrame(out, columns=_columns(wanted))

    def of(captures: bool):
        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ranges, at, entries = _Ranges(folder), None, []
            for pdf in batches:
                out = []
                for key, *place in zip(*(pdf[c].tolist() for c in _columns(wanted))):
                    if place != at:
                        at, entries = place, list(_entries(ranges, *place))
                        first = [x[0] for x in entries]
                        last = first if captures else pd.Series([x[1] for x in entries]).cummax().tolist()
                    met = entries[bisect_left(last, key) : bisect_right(first, key)]
                    out += met if captures else [(key, *x[2:]) for x in met]
                yield _captures(out) if captures else pd.DataFrame(out, columns=_columns(wanted))

        return fetch

    gathered = lambda found: found.distinct().repartitionByRange(parts, "file", "offset", "key").sortWithinPartitions("file", "offset", "key")
    found = urls.select(F.col(url_col).cast("string").alias("url")).where("url IS NOT NULL").distinct().mapInPandas(search, wanted)
    for _ in range(made.levels - 1):
        found = gathered(found).mapInPandas(of(False), wanted)
    return _long(gathered(found).mapInPandas(of(True), CAPTURE), "page_id")


def read(made: Archive, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``captures``, checked against their digests, by range reads in
    order of place. A revisit has no payload; its length and digest are those of the record it refers to."""
    folder = made.folder
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = _Ranges(folder)
        for pdf in batches:
            for k in range(0, len(pdf), 200):
                part = pdf.iloc[k : k + 200]
                out = [parse(ranges.read(*x)) for x in zip(part["file"].tolist(), part["offset"].tolist(), part["length"].tolist())]
                yield pd.DataFrame([x if payloads else (*x[:2], None, *x[3:]) for x in out], columns=_columns(RECORD))

    rows = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(of, RECORD)
    return _long(rows, "page_id", "refers_to")
