"""Scans of what an external network solver writes: tables, logs and decks of each reactor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A header's name without unit and column number.
_NAME = r"^(.*?)(\[[^\]]*\])?\(\d+\)$"


def _files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``rid, text`` of the file ``name`` of every reactor's folder; a folder of that name, as Spark writes, will do."""
    path = f"{folder}/Reactor.*/{name}"
    rid = F.regexp_extract(F.col("_metadata.file_path"), r"^.*/Reactor\.(\d+)/", 1).cast("int")
    return spark.read.text(path, wholetext=True).select(rid.alias("rid"), F.col("value").alias("text"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda line: F.trim(line) != "")


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_tables(spark: SparkSession, folder: str, name: str = "Output.out", last_only: bool = True) -> DataFrame:
    """The table ``name`` of every reactor, as :func:`table_rows` gives it."""
    return table_rows(_files(spark, folder, name), last_only)


def table_rows(texts: DataFrame, last_only: bool = True) -> DataFrame:
    """``rid, row, variable, basis, value`` of ``texts(rid, text)``: the table in long form, or its last row alone.

    ``variable`` is the header without unit; a species' ``_x`` or ``_w`` is its ``basis`` (mole or mass).
    """
    lines = texts.select("rid", _lines(F.col("text")).alias("lines"))
    header = _tokens(F.element_at("lines", 1))
    if last_only:
        rows = lines.where(F.size("lines") > 1).select("rid", header.alias("header"), (F.size("lines") - 2).alias("row"), F.element_at("lines", -1).alias("line"))
    else:
        rows = lines.select("rid", header.alias("header"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line"))
    cells = rows.select("rid", "row", F.posexplode(F.arrays_zip("header", _tokens(F.col("line")).alias("values"))).alias("at", "cell"))
    bare = F.regexp_replace(F.col("cell.header"), _NAME, "$1")
    tail = F.regexp_extract(bare, r"_([xw])$", 1)
    return cells.where("cell.header is not null").select(
        "rid", "row",
        F.regexp_replace(bare, r"_[xw]$", "").alias("variable"),
        F.when(tail == "x", "mole").when(tail == "w", "mass").alias("basis"),
        F.col("cell.values").cast("double").alias("value"),
    )


def read_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """``rid, T, P, X``: the last state of every reactor, X its mole fractions."""
    return states(read_tables(spark, folder))


def states(last: DataFrame) -> DataFrame:
    """``rid, T, P, X`` of the last rows of tables."""
    species = F.when(F.col("basis") == "mole", F.struct("variable", "value"))
    return last.groupBy("rid").agg(
        F.max(F.when((F.col("variable") == "T") & F.col("basis").isNull(), F.col("value"))).alias("T"),
        F.max(F.when((F.col("variable") == "P") & F.col("basis").isNull(), F.col("value"))).alias("P"),
        F.map_from_entries(F.array_sort(F.collect_list(species))).alias("X"),
    )


def read_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """``rid, T, X``: the converged inlet of every reactor, columns by name."""
    last = read_tables(spark, folder, "log.inlet").where(~F.col("variable").startswith("Iter"))
    species = F.when(F.col("variable") != "T", F.struct("variable", "value"))
    return last.groupBy("rid").agg(
        F.max(F.when(F.col("variable") == "T", F.col("value"))).alias("T"), F.map_from_entries(F.array_sort(F.collect_list(species))).alias("X")
    )


def read_variable(spark: SparkSession, folder: str, variable: str) -> DataFrame:
    """``rid, value`` of one variable: ``T``, ``time``, or the mole fraction of a species."""
    name = {"tau": "t", "time": "t"}.get(variable, variable)
    last = read_tables(spark, folder)
    found = last.where((F.col("variable") == name) & (F.col("basis").isNull() | (F.col("basis") == "mole"))).select("rid", "value")
    if found.limit(1).count() == 0:
        raise ValueError(f"the solver's tables have no {variable!r}")
    return found


def read_rates(spark: SparkSession, folder: str, species: str, name: str = "ROPA.out") -> DataFrame:
    """``rid, rate``: the seventh word of the second line that begins with the species."""
    lines = _files(spark, folder, name).select("rid", F.filter(_lines(F.col("text")), lambda line: F.get(_tokens(line), 0) == species).alias("own"))
    return lines.where(F.size("own") > 1).select("rid", F.get(_tokens(F.get("own", 1)), 6).cast("double").alias("rate"))


def outlet_reactors(spark: SparkSession, deck: str) -> DataFrame:
    """``rid, mass`` of the outlets that a network deck names."""
    block = F.regexp_extract("value", r"(?s)@OutputStreams\s+([^;]*);", 1)
    text = spark.read.text(deck, wholetext=True)
    pairs = F.regexp_extract_all(block, F.lit(r"(\d+)\s+([-+0-9.eE]+)"), 0)
    return text.select(F.explode(pairs).alias("pair")).select(
        F.get(_tokens(F.col("pair")), 0).cast("int").alias("rid"), F.get(_tokens(F.col("pair")), 1).cast("double").alias("mass")
    )


def deck_flows(spark: SparkSession, deck: str) -> DataFrame:
    """``src, dst, mass`` of a network deck."""
    block = F.regexp_extract("value", r"(?s)@InternalConnections\s+([^;]*);", 1)
    text = spark.read.text(deck, wholetext=True)
    pairs = F.regexp_extract_all(block, F.lit(r"(\d+)\s+(\d+)\s+([-+0-9.eE]+)"), 0)
    return text.select(F.explode(pairs).alias("t")).select(
        *(F.get(_tokens(F.col("t")), i).cast(kind).alias(c) for i, (c, kind) in enumerate((("src", "int"), ("dst", "int"), ("mass", "double"))))
    )


def highest_temperature(spark: SparkSession, folder: str) -> float | None:
    return read_outputs(spark, folder).agg(F.max("T")).first()[0]


def outlet_species(spark: SparkSession, folder: str, deck: str, species: Sequence[str] = ("NO", "NO2")) -> DataFrame:
    """``rid, species, x`` at the outlets; names match in any case."""
    wanted = [s.lower() for s in species]
    last = read_tables(spark, folder).where((F.col("basis") == "mole") & F.lower("variable").isin(wanted))
    return last.join(outlet_reactors(spark, deck).select("rid"), "rid", "left_semi").select("rid", F.col("variable").alias("species"), F.col("value").alias("x"))
