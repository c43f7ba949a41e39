import pytest
from pyspark.sql import functions as F

from meshnet import pipeline
from meshnet.operators import diffusion, mesh
from meshnet.sources import decks, fields


@pytest.fixture(scope="module")
def case(spark):
    """A 6 by 6 mesh with flow from the left column to the right."""
    cells = [(c + 1, float(c % 6), float(c // 6), 1.0 + c % 3, 1.2, 300.0 + 100 * (c % 6), 1.0 + c % 6, 0.5, 40.0) for c in range(36)]
    df = spark.createDataFrame(cells, "cell_id long, x double, y double, volume double, density double, T double, velocity double, tau double, tvar double")
    faces = []
    for c in range(36):
        if c % 6 < 5:
            faces.append((c + 1, c + 2, 1.0))
        if c + 6 < 36:
            faces.append((c + 7, c + 1, -0.0))
    faces += [(1, -1, 0.0), (2, 0, 0.0)]
    boundary = [(c * 6 + 1, 3 if c < 3 else 4, -1.0, 0.1, 0.0) for c in range(6)] + [(c * 6 + 6, 8, 1.0, 0.1, 0.0) for c in range(6)] + [(2, 5, 0.0, 0.2, 0.0)]
    streams = [(0, 3, 300.0, 101325.0, {"H2": 0.5, "CH4": 0.5}), (1, 4, 872.0, 101000.0, {"O2": 0.21, "N2": 0.79})]
    return (
        df,
        spark.createDataFrame(faces, "c_id0 long, c_id1 long, mass_flowrate double"),
        spark.createDataFrame(boundary, "cell_id long, zone_id int, mass_flowrate double, area double, heat_flux double"),
        spark.createDataFrame(streams, "stream_id int, zone_id int, T double, P double, Y map<string,double>"),
    )


@pytest.mark.parametrize("dataset", ["state-space", "reduced"])
def test_whole_way(spark, case, dataset):
    cells, faces, boundary, streams = case
    build = pipeline.NetworkBuilder(spark, 2).set_cells(cells).set_graph(faces).set_features(dataset, ["T", "y"])
    build.cluster(4)
    assert build.labels.select("cluster").distinct().count() <= 4
    build.mass_flowrates()
    inlets = build.inlet_streams(boundary, streams)
    assert inlets.agg(F.sum("mass")).first()[0] == pytest.approx(6.0)
    assert max(map(abs, build.check_mass_balance(1e-9))) < 1e-9  # cells are in balance, so is every cluster
    total = build.reactor_attributes("max").agg(F.sum("volume")).first()[0]
    assert total == pytest.approx(72 * 6.283185307179586)
    reactors, flows = build.assemble(correct=True)
    n = build.attributes.count()
    assert reactors.count() == n + build.external.where("inlet > 0").count()
    network, each = build.decks("kin", "thermo")
    assert network.count("input.cstr.") == each.count() == reactors.count()
    again = {(r.src, r.dst): r.mass for r in build.adapt(build.external.select("rid", "inlet")).collect()}
    assert again == pytest.approx({(r.src, r.dst): r.mass for r in build.flows.where("mass <> 0").collect()})
    result = build.attributes.select(F.col("cluster").alias("rid"), "T")
    assert build.compare(result).count() == 36


def test_steps_out_of_order(spark, case):
    with pytest.raises(ValueError):
        pipeline.NetworkBuilder(spark, 4)
    with pytest.raises(ValueError):
        pipeline.NetworkBuilder(spark).mass_flowrates()
    build = pipeline.NetworkBuilder(spark, 2).set_cells(case[0])
    with pytest.raises(ValueError):
        build.set_features("other")
    own = case[0].select("cell_id", F.array("T").alias("features"))
    build.set_features("custom", custom=own)
    with pytest.raises(ValueError):
        build.set_features("custom", custom=own.limit(3))
    with pytest.warns(UserWarning):
        build.set_graph(pairs=[(1, 2), (3, 4)], flows=[1.0, 2.0])


def test_mixing(spark, case):
    inlets = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 1, 2.0)], "cluster int, stream_id int, mass double")
    out = {r.cluster: r for r in mesh.mix_streams(inlets, case[3]).collect()}
    assert out[0].T == pytest.approx(729.0) and out[0].P == 101000.0
    assert out[0].Y == pytest.approx({"CH4": 0.125, "H2": 0.125, "N2": 0.5925, "O2": 0.1575})
    assert out[1].Y == pytest.approx({"N2": 0.79, "O2": 0.21})


def test_flow_does_not_depend_on_face_direction(spark, case):
    cells, faces, *_ = case
    labels = cells.select("cell_id", (F.col("x") / 2).cast("int").alias("cluster"))
    rows = lambda f: {(r.src, r.dst): r.mass for r in mesh.flow_matrix(f, labels).collect()}
    turned = faces.select(F.col("c_id1").alias("c_id0"), F.col("c_id0").alias("c_id1"), (-F.col("mass_flowrate")).alias("mass_flowrate"))
    assert {k: v for k, v in rows(faces).items() if v} == {k: v for k, v in rows(turned).items() if v} == {(0, 1): 6.0, (1, 2): 6.0}


def test_composition_and_areas(spark, case):
    cells = spark.createDataFrame([(0, {"A": 0.5}), (0, {"A": 0.1, "B": 1e-9}), (1, {"C": 1e-9})], "cluster int, Y map<string,double>")
    got = {(r.cluster, r.species): r.share for r in mesh.mean_composition(cells).collect()}
    assert got == pytest.approx({(0, "A"): 0.3, (1, "N2"): 0.79, (1, "O2"): 0.21})
    faces = spark.createDataFrame([(1, 2), (2, 3)], "c_id0 long, c_id1 long")
    areas = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.5)], "c_id0 long, c_id1 long, area double")
    assert [(r.c_id0, r.area) for r in diffusion.face_areas(faces, areas).orderBy("c_id0").collect()] == [(1, 0.5), (2, None)]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.3)], "CH4 double, CO2 double, O2 double")
    assert pipeline.progress_variable(df, "CO2:2, CH4:1").first().progress == pytest.approx(0.9)
    assert 0 < pipeline.mixture_fraction(df, ["CH4", "CO2", "O2"], "CH4:1").first().mixture_fraction < 1
    with pytest.raises(ValueError):
        pipeline.progress_variable(df, "NO:1")


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("cellnumber, x-coordinate, y-coordinate, cell-volume\n1, 0.5, 1.5, 2.5\n2, 0.6, 1.6, 2.6\n")
    (tmp_path / "s.csv").write_text("cellnumber, x-coordinate, y-coordinate, temperature, molef-ch4\n2, 0.6, 1.6, 400, 0.2\n1, 0.5, 1.5, 300, 0.1\n")
    (tmp_path / "short.csv").write_text("cellnumber, x-coordinate, y-coordinate, density\n1, 0.5, 1.5, 1.0\n")
    files = {n: str(tmp_path / f) for n, f in (("solution", "s.csv"), ("volume", "v.csv"))}
    cells = fields.read_cells(spark, files, 2)
    assert cells.columns == ["cell_id", "x", "y", "temperature", "molef-ch4", "volume"]
    assert [tuple(r) for r in cells.orderBy("cell_id").collect()] == [(1, 0.5, 1.5, 300.0, 0.1, 2.5), (2, 0.6, 1.6, 400.0, 0.2, 2.6)]
    with pytest.raises(ValueError):
        fields.read_cells(spark, files | {"density": str(tmp_path / "short.csv")}, 2)
    with pytest.raises(ValueError):
        fields.read_cells(spark, {"volume": files["volume"]}, 2)
    (tmp_path / "faces").write_text("x\ty\tz\tc_id0\tc_id1\tmass_flowrate\n0\t0\t0\t1\t2\t-1.5\n0\t0\t0\t2\t-1\t0\n")
    assert [tuple(r) for r in fields.read_faces(spark, str(tmp_path / "faces")).collect()] == [(1, 2, -1.5), (2, -1, 0.0)]
    (tmp_path / "boundary").write_text("17795\t3\t-0.5\t0.01\t12\n")
    assert tuple(fields.read_boundary(spark, str(tmp_path / "boundary")).first()) == (17795, 3, -0.5, 0.01, 12.0)
    out = spark.createDataFrame([(0, "r.0", "a\nb"), (1, "r.1", "c")], "rid int, file string, deck string")
    decks.write_decks(out, str(tmp_path / "decks"))
    assert {f.name: f.read_text() for f in (tmp_path / "decks").iterdir()} == {"r.0": "a\nb", "r.1": "c"}
