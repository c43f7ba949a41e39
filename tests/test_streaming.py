import pytest

from meshnet.functions import features
from meshnet.operators import mesh
from meshnet.streaming.flows import stream_flow_matrix


def test_running_flow_matrix(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "cell_id long, cluster int")
    batches = [[(1, 3, 2.0), (1, 2, 9.0)], [(3, 1, 1.0), (3, 4, -4.0), (1, 3, 0.5)]]
    schema = "c_id0 long, c_id1 long, mass_flowrate double"
    source = str(tmp_path / "in")
    every = spark.createDataFrame([f for b in batches for f in b], schema)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if i == 0:
            query = stream_flow_matrix(spark.readStream.schema(schema).parquet(source), labels, "running", str(tmp_path / "state"))
        query.processAllAvailable()
    got = {(r.src, r.dst): r.mass for r in spark.table("running").collect()}
    query.stop()
    assert got == {(r.src, r.dst): r.mass for r in mesh.flow_matrix(every, labels).collect()} == {(0, 1): 2.5, (1, 0): 1.0, (2, 1): 4.0}
    with pytest.raises(ValueError):
        stream_flow_matrix(every, labels, "no", str(tmp_path / "other"))


def test_species_features(spark):
    df = spark.createDataFrame([(300.0, 1.0, 2.0, 0.25, 0.04, 0.5)], "T double, x double, y double, `molef-o2` double, `molef-oh` double, `molef-ch4` double")
    rows = {s: features.species_features(df, s, "T", ["x", "y"]).first().features for s in ("all", "major", "coord", "pure_h2", "ammonia")}
    assert rows["all"] == [300.0, 0.25, 0.04, 0.5] and rows["major"] == [300.0, 0.25, 0.04, 0.5] and rows["coord"] == [1.0, 2.0, 0.04]
    assert rows["pure_h2"] == [300.0, 0.25, 0.04] and rows["ammonia"] == [300.0, 0.5, 0.2]
    with pytest.raises(ValueError):
        features.species_features(df, "other", "T")
