"""WARC archives, and their index by external merge.

Pages become WARC/1.1 records, each a gzip member of its own, in ``.warc.gz``
files sorted by url key and time within. Every file begins with a warcinfo
record. Of equal payloads one is a response and the others revisit it. Reading
walks each file member by member, checks lengths and payload digests, and
yields index entries with file, offset and length, by which one capture can be
read alone. Entries are dealt by ranges of url key, time and id; in each range
a loser tree merges sorted runs, an equal share of the files each, so captures
are in global order: by ``segment``, then ``position``.

Files are written and read as streams, in any store that Arrow reaches; memory
follows the largest record. A task writes under a name of its own, and the
table ``files`` beside the archives names those of tasks that ended well: files
of lost attempts are not in it and not read.

Cases: a null html is an empty payload. A null url has an empty url key and no
target header. A null id is written without an id header; it never is the
response of a group that has an id. Rows repeated with the id of the response
are responses too. An empty table gives an empty result. Payloads of equal
SHA-1 and length are equal. Line ends in a url are percent-encoded in headers.
Captures of equal url key, time and id stay in the order of their runs. A very
long payload is one record, held once. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.plans.scratch import bound_arrow_batches, materialize, new_path
from meshnet.plans.tables import read_table

#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
#: Up to so many winners are broadcast; more are joined by a shuffle.
BROADCAST_WINNERS = 20_000
#: Rows of each run that a merge holds.
CURSOR_ROWS = 256
#: Fixed value: files tell no time of writing, so that equal pages make equal files.
WRITTEN = "2020-01-01T00:00:00Z"
#: A file is ended at so many bytes.
FILE_BYTES = 1 << 30
#: Runs that a merge takes at most, and rows of a range that it merges.
MOST_RUNS, RANGE_ROWS = 128, 2_000_000
END = "\r\n"
#: Fixed value: the profile of a revisit by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "url_key string, capture_ts timestamp, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, file string, ordinal long, offset long, length long"
)
_FILES = "file string, records long, bytes long"


def url_key(url: Column) -> Column:
    """The url with its host reversed, so that a domain's captures are neighbours."""
    rest = F.when(url.contains("://"), F.substring_index(F.expr("substr(url, locate('://', url) + 3)"), "#", 1)).otherwise(url)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), F.lit(""))


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member; a field whose value is None is left out."""
    head = "".join(f"{name}: {value}{END}" for name, value in fields if value is not None)
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = f"WARC/1.1{END}{head}Content-Length: {len(block)}{END}{END}".encode()
    return gzip.compress(raw) + gzip.compress(block) + gzip.compress(b"\r\n\r\n") + gzip.flush()


def _write_files(folder: str, most_bytes: int):
    """mapInArrow function: pages in order, with what they refer to, to files; yields ``file, records, bytes``."""

    def urn(name: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        out, name, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"]
            )

        for batch in batches:
            for page, url, date, digest, length, of, of_url, of_date, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn(name)), ("WARC-Date", WRITTEN), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size += out.write(_record(info, f"software: meshnet{END}format: WARC File Format 1.1{END}".encode()))
                revisit = of is not None
                http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {length}{END}{END}".encode()
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(f"{name}/{records}")),
                    ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Warcinfo-ID", urn(name)),
                    ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE if revisit else None),
                    ("WARC-Refers-To-Target-URI", of_url), ("WARC-Refers-To-Date", of_date),
                    ("Page-ID", page), ("Refers-To-Page-ID", of), ("Content-Type", "application/http;msgtype=response"),
                ]
                size += out.write(_record(fields, http if revisit else http + html.encode()))
                records += 1
                if size >= most_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, path: str, ts: Column, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One record per row of ``pages`` in files under ``path``; returns the table ``files`` that names them."""
    spark = pages.sparkSession
    bound_arrow_batches(spark)
    when = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        when.alias("date"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        url_key(url).alias("key"),
        ts.alias("ts"),
    )
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    page = F.struct("page_id", "url", "date")
    winners = materialize(
        rows.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest", "size")
        .agg(F.max(F.when(F.col("page_id").isNotNull(), page)).alias("of"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("of").isNotNull())
        .select("digest", "size", "of"),
        "winners",
    )
    small = winners.limit(BROADCAST_WINNERS + 1).count() <= BROADCAST_WINNERS
    rows = rows.join(F.broadcast(winners) if small else winners, ["digest", "size"], "left")
    of = F.when(F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of.page_id")), F.col("of"))
    rows = rows.withColumn("of", of)
    html = F.when(F.col("of").isNull(), F.col("html"))  # a revisit has no payload
    ordered = rows.sortWithinPartitions("key", "ts", "page_id").select(
        F.col("page_id").cast("string").alias("page"), "url", "date", "digest", "size", F.col("of.page_id").cast("string").alias("of_page"),
        F.col("of.url").alias("of_url"), F.col("of.date").alias("of_date"), html.alias("html"),
    )
    files = f"{path}/files"
    ordered.mapInArrow(_write_files(path, FILE_BYTES), _FILES).write.mode("append").parquet(files)
    return spark.read.schema(_FILES).parquet(files)


class ArchiveError(ValueError):
    """An archive that does not hold what its headers say."""


def _members(source: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    offset, data = 0, source.read(1 << 16)
    while data:
        gunzip, parts, length = zlib.decompressobj(31), [], 0
        while not gunzip.eof:
            if not data:
                raise ArchiveError("an archive ends within a record")
            try:
                parts.append(gunzip.decompress(data))
            except zlib.error as e:
                raise ArchiveError(f"no record at {offset}: {e}") from e
            length += len(data) - len(gunzip.unused_data)
            data = gunzip.unused_data if gunzip.eof else source.read(1 << 16)
        yield offset, length, b"".join(parts)
        offset += length
        data = data or source.read(1 << 16)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode().split(END)
    if first != "WARC/1.1" or not found:
        raise ArchiveError(f"no record begins with {raw[:40]!r}")
    headers = dict(f.split(": ", 1) for f in fields)
    block = rest[:-4]
    if not rest.endswith(b"\r\n\r\n") or len(block) != int(headers["Content-Length"]):
        raise ArchiveError("a record is not as long as its header says")
    return headers, block


def read_capture(path: str, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the one record that an index entry names; nothing else is read."""
    store, base = FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{file}") as source:
        source.seek(offset)
        headers, block = parse_record(zlib.decompress(source.read(length), 31))
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _surt(url: str | None) -> str:
    """``url_key`` of a header."""
    if url is None:
        return ""
    rest = url.partition("://")[2].partition("#")[0] if "://" in url else url
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _entries(folder: str):
    """mapInArrow function: names of files to index entries."""
    names = [f.split()[0] for f in _INDEX.split(", ")]
    strings = ("url_key", "payload_digest", "record_type", "file")
    kinds = pa.schema(
        [(n, pa.string() if n in strings else pa.timestamp("us", "UTC") if n == "capture_ts" else pa.int64()) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                for nth, (offset, length, raw) in enumerate(_members(source), -1):
                    headers, block = parse_record(raw)
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(h for h in head.split(b"\r\n") if h.startswith(b"Content-Length: "))[16:])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ArchiveError(f"the payload of {headers['WARC-Record-ID']} is not what its digest says")
                    ts = headers.get("WARC-Date")
                    ts = datetime.strptime(ts, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) if ts else None
                    rows.append(
                        (_surt(headers.get("WARC-Target-URI")), ts, _number(headers.get("Page-ID")), size, digest, kind,
                         _number(headers.get("Refers-To-Page-ID")), name, nth, offset, length)
                    )
                    if len(rows) == 5000:
                        yield batch_of()
                        rows = []
        if rows:
            yield batch_of()

    return run


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives under ``path``, each checked against its digest; a task reads about a file."""
    bound_arrow_batches(spark)
    files = spark.read.schema(_FILES).parquet(f"{path}/files")
    return files.select("file").repartition(max(1, files.count())).mapInArrow(_entries(path), _INDEX)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step plays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)  # losers in 1..k-1, the winner in 0
        for run in range(self.k):
            self._climb(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run a comes first; an ended run comes last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _climb(self, run: int, building: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if building and self.tree[node] < 0:
                self.tree[node] = run  # waits here for its opponent
                return
            if self._before(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (best := self.heads[self.tree[0]]) is not None:
            yield best
            run = self.tree[0]
            self.heads[run] = next(self.runs[run], None)
            self._climb(run)


def _key(row: tuple, at: list[int]) -> tuple:
    """Nulls sort first and never meet a value in a comparison."""
    return tuple((v is not None, v) if v is not None else (False,) for v in (row[i] for i in at))


def _write_runs(batches: Iterator[pa.RecordBatch], run_at: int, folder: str) -> list[str]:
    """One Arrow file a run in ``folder``, in order of run; rows come sorted by run."""
    paths, last, writer = [], None, None
    for batch in batches:
        runs = batch.column(run_at).to_pylist()
        edges = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if writer is None or runs[lo] != last:
                if writer is not None:
                    writer.close()
                last = runs[lo]
                paths.append(f"{folder}/{len(paths)}")
                writer = pa.ipc.new_stream(paths[-1], batch.schema)
            writer.write_table(pa.Table.from_batches([batch.slice(lo, hi - lo)]), max_chunksize=CURSOR_ROWS)
    if writer is not None:
        writer.close()
    return paths


def _cursor(path: str, number: int, at: list[int]) -> Iterator[tuple]:
    """``key, run number, place, row`` of a run's file, of which few rows are held."""
    i = 0
    with pa.OSFile(path) as source:
        for batch in pa.ipc.open_stream(source):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _key(row, at), number, i, row
                i += 1


def merge_index(entries: DataFrame) -> DataFrame:
    """Index entries in global order of url key, time and id: ``segment`` and ``position`` are added.

    Spark sorts a range by run and key, spilling as it needs; a task writes its
    runs to files and merges cursors on them, so it holds some rows a run.
    """
    names = entries.columns
    order = ("url_key", "capture_ts", "page_id")
    at = [names.index(c) for c in order]
    run_at = names.index("run")
    by = [F.col(c).asc_nulls_first() for c in order]
    least = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-entries.count() // RANGE_ROWS))
    dealt = entries.repartitionByRange(ranges, *by).sortWithinPartitions("run", *by)
    schema = entries.select("*", F.lit(0).alias("segment"), F.lit(0).cast("long").alias("position")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, position = TaskContext.get().partitionId(), 0
        first = next(batches, None)
        if first is None:
            return
        kinds = first.schema
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)]
            here = range(position - len(out), position)
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([segment] * len(out), pa.int32()), pa.array(here, pa.int64())], [*names, "segment", "position"]
            )

        with tempfile.TemporaryDirectory(prefix="meshnet-") as folder:
            paths = _write_runs(chain([first], batches), run_at, folder)
            for *_, row in LoserTree([_cursor(path, number, at) for number, path in enumerate(paths)]):
                out.append(row)
                position += 1
                if len(out) == 5000:
                    yield batch_of()
                    out = []
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, schema)


def archive(
    pages: DataFrame, ts: Column, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, ts, id_col, url_col, html_col)
    # Many files are few runs: a merge has a cursor open for each.
    run = F.pmod(F.xxhash64("file"), F.lit(MOST_RUNS))
    return merge_index(materialize(read_archives(spark, path), "index").withColumn("run", run)).drop("run")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``; the table has no time, so a page is captured its id in seconds after 2020 began."""
    pages = read_table(spark, sf_dir, "pages")
    ts = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id"))
    return archive(pages, ts).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN winner END AS refers_to
FROM p
"""
