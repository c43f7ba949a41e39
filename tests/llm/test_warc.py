import gzip
import hashlib
import io
import random
import zlib
from itertools import pairwise
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshnet.llm import warc as op

TRAP = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\n\r" * 40


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    big, html = "<p>é\n</p>" * 200, []
    for i in range(60):
        html.append(rng.choice([big, big + "x", f"<p>{i}</p>", TRAP, None, "", "short", "y" * 999, "y" * 1000, "é" * 500]))
    urls = [rng.choice(["http://b.a.org/x", "https://a.org/y?q=1#f", None, "no url", "http://c.de", "http://A.org/x\r\nEvil: 1"]) for _ in html]
    out = list(zip(range(60), urls, html, strict=True))
    return [*out, out[3], (None, "http://n.org/", big), (None, None, None)]


def brute(rows):
    winner = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            winner[h] = max(winner.get(h, -1), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        w = winner.get(h)
        again = w is not None and w != i
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", w if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)
    path = op.new_path(spark, "test")
    index = op.archive(df, F.timestamp_seconds(F.col("page_id") % 7), path).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=str) == brute(rows)
    order = sorted(index, key=lambda r: (r.segment, r.position))
    key = lambda r: (r.url_key, r.capture_ts is not None, r.capture_ts, r.page_id is not None, r.page_id)
    keys = [key(r) for r in order if None not in key(r)]
    assert keys == sorted(keys)
    assert len({r.file for r in index}) == 3
    for file in {r.file for r in index}:
        own = [r for r in sorted(index, key=lambda r: r.ordinal) if r.file == file]
        assert [r.url_key for r in own] == sorted(r.url_key for r in own)
        assert [r.ordinal for r in own] == list(range(len(own)))
        # Records follow each other without gaps, after the warcinfo, in a file that gzip reads as a whole.
        assert all(a.offset + a.length == b.offset for a, b in pairwise(own))
        raw = Path(path.removeprefix("file://"), file).read_bytes()
        assert own[-1].offset + own[-1].length == len(raw)
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    html = {i: (h or "").encode() for i, _, h in rows}
    records = [(r, *op.read_capture(path, r.file, r.offset, r.length)) for r in index]
    for r, headers, payload in records:
        assert headers["WARC-Type"] == r.record_type and headers.get("Page-ID") == (None if r.page_id is None else str(r.page_id))
        assert r.page_id is None or payload == (b"" if r.record_type == "revisit" else html[r.page_id])
    assert len({headers["WARC-Record-ID"] for _, headers, _ in records}) == len(rows)
    dates = {r.page_id: headers["WARC-Date"] for r, headers, _ in records if r.page_id is not None}
    again = [(r, headers) for r, headers, _ in records if r.record_type == "revisit"]
    assert again and all(headers["WARC-Refers-To-Date"] == dates[r.refers_to] for r, headers in again)


def test_files_end_at_their_size_and_lost_ones_are_not_read(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "FILE_BYTES", 2000)
    path = op.new_path(spark, "test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = op.archive(df, F.timestamp_seconds("page_id"), path)
    before = sorted(map(str, index.collect()))
    files = sorted(Path(path.removeprefix("file://")).glob("*.warc.gz"))
    assert 1 < len(files) == len({r.file for r in index.select("file").distinct().collect()})
    files[0].with_name("lost.warc.gz").write_bytes(files[0].read_bytes()[:-9])
    assert op.read_archives(spark, path).count() == len(before) == len(rows)


def test_many_winners_are_joined_by_a_shuffle(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_WINNERS", 0)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op.archive(df, F.timestamp_seconds("page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.archive(df, F.timestamp_seconds("page_id")).count() == 0


def test_damage_is_noticed():
    member = op._record([("WARC-Type", "response")], b"abc")
    assert [(o, n) for o, n, _ in op._members(io.BytesIO(member * 2))] == [(0, len(member)), (len(member), len(member))]
    assert op.parse_record(zlib.decompress(member, 31)) == ({"WARC-Type": "response", "Content-Length": "3"}, b"abc")
    for broken in (member[:-1], b"junk" + member, member + b"junk"):
        with pytest.raises(op.ArchiveError):
            list(op._members(io.BytesIO(broken)))
    for raw in (b"junk", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(op.ArchiveError):
            op.parse_record(raw)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randint(0, 12))) for _ in range(k)]
    assert list(op.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_merge_streams_runs_that_spark_sorted(spark, tmp_path):
    """Runs are sorted by Spark, not in the task, and a cursor holds a few rows of its file."""
    df = spark.createDataFrame([(f"u{i % 7}", i % 3, i, i % 4) for i in range(2000)], "url_key string, capture_ts int, page_id long, run long")
    merged = op.merge_index(df.repartition(3))
    assert "Sort [run" in merged._jdf.queryExecution().toString()
    rows = sorted(merged.collect(), key=lambda r: (r.segment, r.position))
    assert [r[:3] for r in rows] == sorted(r[:3] for r in df.collect())
    batch = pa.record_batch({"run": [1] * 9000 + [2] * 1000, "k": list(range(10_000))})
    one, two = op._write_runs(iter([batch.slice(0, 3000), batch.slice(3000)]), 0, str(tmp_path))
    assert max(b.num_rows for b in pa.ipc.open_stream(one)) <= op.CURSOR_ROWS
    assert [row for *_, row in op._cursor(one, 0, [1])] == [(1, k) for k in range(9000)]
    assert sum(1 for _ in op._cursor(two, 1, [1])) == 1000
