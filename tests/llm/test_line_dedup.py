import pytest
from pyspark.sql import functions as F

from meshnet.llm import line_dedup as op

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(_UP)


def brute(rows, least=10):
    owners, holders = {}, {}
    for i, t in rows:
        if i is None:
            continue
        for line in (t or "").split("\n"):
            if len(k := key(line)) >= least:
                owners[k] = min(owners.get(k, i), i)
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(holders.get(key(x), ())) > 1 and owners[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df, **how):
    got = op.dedup_lines(df, **how).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_same_as_brute_force(docs, batches, fanout):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(docs, batches=batches, fanout=fanout)
    assert got == brute(rows)
    assert any(n for _, _, n, _ in got)


def test_keys(spark):
    rows = [
        (1, "  Über ABCDEFGHI\t\nshort\nshort\nx xxxxxxxxxx"),
        (2, "\x0büber abcdefghi\nÜber abcdefghi\r\nShort\nx xxxxxxxxxx "),
        (2, "Über abcdefghi\nonly here, as it is"),
        (3, "all lines\tof 3: Über ABCDEFGHI".split(": ")[1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert ("3", "") in [(str(i), t) for i, _, _, t in result(df)]


def test_columns_of_any_name(docs):
    names = ["_id", "_th", "_lost", "id", "th", "text_", "k1", "batch", "lost", "kept", "row", "a.b", "n_lines"]
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names) if n not in docs.columns))
    out = op.dedup_lines(wide)
    assert out.select("row.*").columns == wide.columns and out.columns == ["row", "n_lines", "n_dropped", "kept"]
    assert result(wide) == result(docs)


def test_empty(empty):
    assert op.dedup_lines(empty).count() == 0


def held(runs):
    return [tuple(r) for level in runs.levels for table, _ in level for r in runs.keys(table).collect()]


def test_levels_hold_few_runs(spark):
    runs = op.LineRuns(spark, fanout=2)
    for b in range(5):
        lines = spark.createDataFrame([(b * 10 + i, i + b, i) for i in range(3)], "id long, k1 long, k2 long")
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    before = held(runs)
    assert len(before) == len(set(before)) == len({(i + b, i) for b in range(5) for i in range(3)})
    runs.close()
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'line_run_%'").count()
    again = op.LineRuns(spark, runs.folder)
    assert [len(level) for level in again.levels] == [1, 0, 1] and sorted(held(again)) == sorted(before)
    again.close()


def test_later_calls_meet_the_runs_of_earlier_ones(spark, tmp_path):
    rows = [(i, f"the first line of all\nline number {i % 7} of some\nonly in {i} of them") for i in range(40)]
    whole = brute(rows)
    folder, got = f"file://{tmp_path}/runs", []
    for lo in (0, 15, 30):
        df = spark.createDataFrame(rows[lo : lo + 15], "doc_id long, text string")
        got += result(df, folder=folder, batches=2)
    assert sorted(got, key=str) == whole


def test_calls_that_fail_or_are_repeated(spark, tmp_path, monkeypatch):
    """The same call gives the same rows, at once, after a failure between batches, and after later calls."""
    rows = [(i, f"the first line of all\nline number {i % 7} of some\nonly in {i} of them") for i in range(30)]
    folder, whole = f"file://{tmp_path}/runs", brute(rows)
    first, second = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows[:15], rows[15:]))
    add, calls = op.LineRuns.add, []

    def failing(self, *args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("the driver is lost")
        return add(self, *args)

    monkeypatch.setattr(op.LineRuns, "add", failing)
    with pytest.raises(OSError):
        result(first, folder=folder, batches=4)
    monkeypatch.undo()
    one = result(first, folder=folder, batches=4)
    assert one == brute(rows[:15])
    assert result(first.repartition(7), folder=folder, batches=2) == one  # in any order, in other batches
    two = result(second, folder=folder, batches=2)
    assert sorted(one + two, key=str) == whole
    assert result(first, folder=folder, batches=4) == one and result(second, folder=folder, batches=2) == two
    manifest = spark.read.json(f"{folder}/manifest")
    assert manifest.where("done").select("call").distinct().count() == 2 and manifest.agg({"version": "max"}).first()[0] == 8
    # Under another name the same documents are a new call, whose lines are known.
    again = result(second, folder=folder, batches=2, call="other")
    assert all(n == 3 for _, _, n, _ in again)


def test_runs_are_merged_without_sorting_them(spark):
    runs = op.LineRuns(spark)
    lines = spark.range(1000).selectExpr("id", "id % 700 AS k1", "id % 700 AS k2")
    runs.add(lines)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (table, _), = runs.levels[0]
        plan = runs.keys(table).join(runs.keys(table).withColumnRenamed("k2", "other"), "k1")._jdf.queryExecution().toString()
        merged = runs.keys(table).join(runs.keys(table).withColumn("mark", F.lit(1)), ["k1", "k2"], "full")
        assert "Exchange" in plan  # by one of the two columns the buckets are of no use
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.close()


def test_plan_has_no_python(docs):
    plan = op.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
