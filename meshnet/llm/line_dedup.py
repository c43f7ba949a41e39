"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. The distinct line keys of a
batch are merge-joined against every run so far: keys that no run holds become
a new run at level 0, the others were seen before. When a level has ``fanout``
runs they are compacted into one run of the next level, so a batch meets a
logarithmic number of runs. Runs are bucketed and sorted by key, one file a
bucket, so that joins and compactions merge them without a shuffle or a sort.
Runs live in a folder with a manifest: a later call that names the folder meets
the runs of earlier ones, whose documents own their lines. Every version of the
manifest names the call that wrote it, by default a digest of its documents, and
the last one of a call says that it is done. A call starts from what was done
before it, so one that failed between batches leaves nothing behind, and one
that is repeated, soon or after others, gives the same rows again and adds no
keys. One call at a time may write to a folder. Only DataFrame functions run.

Within a batch a key belongs to the smallest id that holds it; since batches
ascend, that is the smallest id over all. Keys are reduced map-side to one row
per task before they meet, and only the final join of lines to repeated keys
sees a hot key, in a sort-merge join that adaptive execution can split.

Cases: a null or empty text is one empty line. A row with a null id takes no
part: its lines stay and do not count. Rows repeated with one id are one
document, each judged by its own text. Keys are compared by 128 bits of hash.
A text is split whole, whatever its length; a row must fit in memory. An empty
table gives an empty result. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.plans.scratch import materialize, new_path
from meshnet.plans.tables import read_table

MIN_CHARS = 10
#: Batches: one for so many bytes of text, within bounds.
BATCH_BYTES, LEAST_BATCHES, MOST_BATCHES = 1 << 41, 4, 64
FANOUT = 2
_MANIFEST = "version long, level int, buckets int, path string, call string, done boolean"
#: Fixed value: the white space stripped from a key, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """``line`` stripped of BLANKS at both ends, with A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() would change letters beyond A-Z, so it serves only where there are none.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, LOWER)
    )


class LineRuns:
    """Levelled runs of line keys ``k1, k2`` in ``folder``; ``add`` takes one batch, ``close`` ends the use of them.

    The catalog holds a run's table while it is open, since it alone tells Spark
    of buckets; the files and the manifest stay in the folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, call: str | None = None):
        """Without a name for the call, every batch counts as done for good."""
        self.spark, self.fanout, self.call, self.recorded = spark, fanout, call, False
        self.folder = folder.rstrip("/") if folder else new_path(spark, "line_runs")
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        self.levels: list[list[tuple[str, str]]] = []  # table and path of each run
        self.tables: list[str] = []
        self._open()

    def _open(self) -> None:
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = max(r.version for r in rows)
        done = {r.version for r in rows if r.done in (None, True)}
        own = [r.version for r in rows if self.call and r.call == self.call]
        self.recorded = any(v in done for v in own)  # this call ended before: it starts where it did then
        start = max((v for v in done if not self.recorded or v < min(own)), default=None)
        for r in rows:  # runs are merged bucket by bucket, so their number is that of the first
            if r.version == start:
                self.buckets = r.buckets
                self._level(r.level).append((self._table(r.path), r.path))

    def _level(self, level: int) -> list[tuple[str, str]]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _table(self, path: str) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, seen BOOLEAN) USING parquet "
            f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        self.tables.append(name)
        return name

    def _write(self, df: DataFrame) -> tuple[str, str]:
        """Write ``df`` in buckets sorted by key; the table's name and path."""
        name, path = f"line_run_{uuid.uuid4().hex}", f"{self.folder}/{uuid.uuid4().hex}"
        order = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(order, "false")
        self.spark.conf.set(order, "true")  # a bucket is one sorted file, so scans of runs need no sort
        try:
            writer = df.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("compression", "zstd")
            writer.option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.set(order, before)
        self.tables.append(name)
        return name, path

    def keys(self, table: str) -> DataFrame:
        """``k1, k2`` of a run: the keys that were new in their batch."""
        return self.spark.table(table).where("not seen").select("k1", "k2")

    def add(self, lines: DataFrame, last: bool = True) -> DataFrame:
        """Take ``lines(id, k1, k2)``; return the repeated keys: ``k1, k2, lo`` (null: seen in a run). ``last``: of its call."""
        keys = lines.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        seen = F.lit(False)
        for i, (table, _) in enumerate(run for level in self.levels for run in level):
            mark = f"in_run_{i}"
            keys = keys.join(self.keys(table).withColumn(mark, F.lit(True)), ["k1", "k2"], "left")
            seen = seen | F.col(mark).isNotNull()
        judged, path = self._write(
            keys.select("k1", "k2", "lo", seen.alias("seen"), (seen | (F.col("lo") != F.col("hi"))).alias("repeated"))
        )
        self._push(0, (judged, path))
        self._record(last or not self.call)
        found = self.spark.read.schema("k1 long, k2 long, lo long, seen boolean, repeated boolean").parquet(path)
        return found.where("repeated").select("k1", "k2", F.when(~F.col("seen"), F.col("lo")).alias("lo"))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        runs = self._level(level)
        runs.append(run)
        if len(runs) >= self.fanout:
            self.levels[level] = []
            merged = self.keys(runs[0][0])
            for table, _ in runs[1:]:  # no key is in two runs: a full outer merge join is their union
                merged = merged.join(self.keys(table), ["k1", "k2"], "full")
            self._push(level + 1, self._write(merged.withColumn("seen", F.lit(False))))

    def _record(self, done: bool) -> None:
        """Add a version to the manifest, unless this call has ended before."""
        if self.recorded:
            return
        self.version += 1
        runs = [
            F.struct(
                F.lit(self.version).cast("long").alias("version"), F.lit(level).alias("level"),
                F.lit(self.buckets).alias("buckets"), F.lit(path).alias("path"),
                F.lit(self.call).cast("string").alias("call"), F.lit(done).alias("done"),
            )
            for level, found in enumerate(self.levels)
            for _, path in found
        ]
        one = self.spark.range(1).coalesce(1).select(F.explode(F.array(*runs)).alias("run")).select("run.*")
        one.write.mode("append").json(f"{self.folder}/manifest")

    def close(self) -> None:
        """Take the tables out of the catalog; they are external, so the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def _batches_of(docs: DataFrame, id_col: str, text_col: str, batches: int | None) -> tuple[Column, int]:
    """The batch of a row, and their number: ids ascend over batches of about equal size."""
    steps = [k / 256 for k in range(1, 256)]
    seen = docs.agg(
        F.sum(F.octet_length(text_col)).alias("bytes"), F.percentile_approx(id_col, steps, 10_000).alias("cuts")
    ).first()
    if batches is None:
        batches = min(MOST_BATCHES, max(LEAST_BATCHES, -(-(seen.bytes or 0) // BATCH_BYTES)))
    batch = F.lit(0)
    for k in range(1, batches):
        if seen.cuts:
            batch = batch + (F.col(id_col) > seen.cuts[max(0, 256 * k // batches - 1)]).cast("int")
    return batch, batches


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int | None = None,
    fanout: int = FANOUT,
    folder: str | None = None,
    call: str | None = None,
) -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_lines``, ``n_dropped`` and ``kept``, the remaining text.

    A key of at least ``min_chars`` code points that two documents hold loses
    all its lines but those of the smallest id. With a ``folder`` the keys stay
    there, and documents of later calls that name it lose lines known by then;
    their ids are taken to be larger. A ``call`` of the same name, or of the same
    documents if none is given, is the same call.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th")]
    rows = docs.select(F.struct("*").alias("row"), *keys)  # texts travel once, in their rows
    slim = docs.select(*keys, text.alias("text")).where("id is not null")
    batch, batches = _batches_of(slim, "id", "text", batches)
    lines = (
        slim.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            "id", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), F.col("key")).alias("k2"),
            batch.alias("batch"),
        )
    )
    lines = materialize(lines, "lines", ["batch"])
    if folder and not call:
        each = F.xxhash64("id", "th").cast("decimal(20)")
        of = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("s"), F.bit_xor(F.xxhash64("th", "id")).alias("x")).first()
        call = f"{of.n}-{of.s}-{of.x}"
    runs, repeated = LineRuns(spark, folder, fanout, call), None
    try:
        for b in range(batches):
            found = runs.add(lines.where(F.col("batch") == b), b == batches - 1).withColumn("batch", F.lit(b))
            repeated = found if repeated is None else repeated.unionByName(found)
    finally:
        runs.close()
    lost = (
        lines.join(repeated, ["k1", "k2", "batch"])
        .where(F.col("lo").isNull() | (F.col("id") != F.col("lo")))
        .groupBy(F.col("id").alias("lost_id"), F.col("th").alias("lost_th"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    parts = F.split(text, "\n")
    joined = rows.join(lost, (F.col("id") == F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    )
    return joined.select(
        "row",
        F.size(parts).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every whole text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed
  WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.line, k.pos, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
