import subprocess
import sys
import textwrap

import pytest

from meshnet.sources import decks
from meshnet.sources.named_files import NamedTextWriter, read_named, write_named

PIECES = "file string, n int, text string"


def files_of(folder):
    return {f.name: f.read_text() for f in folder.iterdir()}


def test_pieces_in_order(spark, tmp_path):
    rows = [("a", i, f"{i}\n") for i in range(300)] + [("b", 0, "é"), ("c", 0, None), ("d", 1, ""), ("d", 0, "x")]
    folder = tmp_path / "out"
    write_named(spark.createDataFrame(rows, PIECES).repartition(5, "n"), str(folder), ["n"])
    assert files_of(folder) == {"a": "".join(f"{i}\n" for i in range(300)), "b": "é", "c": "", "d": "x"}
    assert {r.file: r.text for r in read_named(spark, f"file://{folder}", "[ab]").collect()} == {k: v for k, v in files_of(folder).items() if k in "ab"}


def test_folders_below(spark, tmp_path):
    write_named(spark.createDataFrame([("r.0/a", 0, "0"), ("r.1/a", 0, "1"), ("b", 0, "2")], PIECES), str(tmp_path / "out"), ["n"])
    assert {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file()} == {"r.0/a": "0", "r.1/a": "1", "b": "2"}
    for bad in ("/a", "a/../../b", "a//b", ""):
        with pytest.raises(Exception, match="no name"):
            write_named(spark.createDataFrame([(bad, 0, "")], PIECES), str(tmp_path / "out"), ["n"])


def test_taken_names(spark, tmp_path):
    folder, one = tmp_path / "out", spark.createDataFrame([("a", 0, "1"), ("b", 0, "1")], PIECES)
    write_named(one, str(folder), ["n"])
    other = spark.createDataFrame([("b", 0, "2"), ("e", 0, "2")], PIECES)
    with pytest.raises(Exception, match="written twice"):
        write_named(other, str(folder), ["n"])
    assert files_of(folder) == {"a": "1", "b": "1"}  # nothing moved, nothing staged left
    write_named(other, str(folder), ["n"], "overwrite")
    assert files_of(folder) == {"a": "1", "b": "2", "e": "2"}
    with pytest.raises(Exception, match="no name"):
        write_named(spark.createDataFrame([("../x", 0, "2")], PIECES), str(folder), ["n"])
    assert files_of(folder) == {"a": "1", "b": "2", "e": "2"} and not (tmp_path / "x").exists()
    write_named(spark.createDataFrame([], PIECES), str(folder), ["n"])
    assert files_of(folder) == {"a": "1", "b": "2", "e": "2"}


def test_only_accepted_attempts_are_moved(tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()

    class Row:
        def __init__(self, file, text):
            self.file, self.text = file, text

    def broken():
        yield Row("a", "half")
        raise OSError("the executor is lost")

    writer = NamedTextWriter(str(folder), False)
    with pytest.raises(OSError):
        writer.write(broken())
    again = writer.write(iter([Row("a", "wh"), Row("a", "ole")]))
    twin = writer.write(iter([Row("a", "of a slower twin")]))  # a speculative attempt that was not the first
    assert twin.staged != again.staged
    writer.commit([again, None])
    assert files_of(folder) == {"a": "whole"}


def test_a_task_that_fails_once(tmp_path):
    """In a session of its own, whose tasks may fail once."""
    script = f"""
    import os
    from pyspark.sql import SparkSession, functions as F
    from meshnet.sources.named_files import write_named
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    @F.udf("string")
    def text(n):
        if n == 40 and not os.path.exists({str(tmp_path / "failed")!r}):
            open({str(tmp_path / "failed")!r}, "w").close()
            raise OSError("lost")
        return str(n)
    rows = spark.range(50).select(F.lit("f").alias("file"), F.col("id").alias("n"))
    made = rows.repartition(1).sortWithinPartitions("n").select("file", "n", text("n").alias("text"))
    from meshnet.sources import named_files
    spark.dataSource.register(named_files.NamedText)
    made.select("file", "text").write.format("named_text").mode("append").option("path", {str(tmp_path / "out")!r}).save()
    spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, timeout=240, capture_output=True)
    assert (tmp_path / "failed").exists()
    assert files_of(tmp_path / "out") == {"f": "".join(map(str, range(50)))}


def test_older_network(spark, tmp_path):
    reactors = spark.createDataFrame([(0, "PSR"), (1, "PFR"), (2, "PSR")], "rid int, rtype string")
    flows = spark.createDataFrame([(0, 1, 2.0), (1, 2, 0.25), (2, 0, 0.0)], "src int, dst int, mass double")
    external = spark.createDataFrame([(0, 2.0, 0.0), (1, 0.0, 1.75), (2, 0.0, 0.25)], "rid int, inlet double, outlet double")
    text = decks.network_deck(reactors, flows, "a.CKI", "b.CKT", ["NO", "O2"], older=True, external=external)
    assert text == (
        "Dictionary ReactorNetwork \n { \n@KineticsPreProcessor      kinetic-mechanism; \n@MinIterations            5;   \n@MaxIterations            500;  \n"
        "@AtomicErrorThreshold     1e-4;\n@NonIsothermalErrorThreshold\t1e-4; \n@MaxUnbalance     0.05; \n"
        "@PlugFlowReactors     \n1        input.pfr.1.dic;  \n@PerfectlyStirredReactors     \n0        input.cstr.0.dic  \n2        input.cstr.2.dic;  \n"
        "@InternalConnections                     0   1   2 \n                  1   2   2.500000e-01; \n@InputStreams   0 2; \n"
        "@OutputStreams    1 1.750000e+00 \n2 2.500000e-01; \n@SpeciesToMonitor   NO  O2 ; \n@VerbosityLevel   1; \n } \n"
        "Dictionary kinetic-mechanism \n { \n@Kinetics a.CKI; \n@Thermodynamics b.CKT; \n@Output kinetics; \n } \n"
    )
    with pytest.raises(ValueError):
        decks.network_deck(reactors, flows, "a", "b", older=True)
    with pytest.raises(ValueError):
        decks.network_deck(reactors, flows, "a", "b", older=True, external=external, MaxIterations=3)


def test_network_folder(spark, tmp_path):
    reactors = spark.createDataFrame(
        [(i, "PSR" if i % 40 else "PFR", True, 1.0, 1.0, i == 0, i == 99) for i in range(100)],
        "rid int, rtype string, isothermal boolean, volume double, Mf double, isinput boolean, isoutput boolean",
    )
    flows = spark.createDataFrame([(i, i + 1, 1.0) for i in range(99)], "src int, dst int, mass double")
    decks.write_network(reactors, flows, str(tmp_path / "net"), "kin", "thermo")
    found = files_of(tmp_path / "net")
    assert sorted(found) == sorted(["input.dic", *(f"input.{'pfr' if i % 40 == 0 else 'cstr'}.{i}.dic" for i in range(100))])
    assert found["input.dic"] == decks.network_deck(reactors, flows, "kin", "thermo")
    assert found["input.cstr.7.dic"] == decks.reactor_decks(reactors.where("rid = 7")).first().deck
