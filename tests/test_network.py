import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshnet import pipeline
from meshnet.functions import chem, features
from meshnet.operators import filters, network
from meshnet.sources import decks, solver


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def two(spark):
    flows = table(spark, [(0, 1, 2.0), (1, 0, 1.0)], "src int, dst int, mass double")
    external = table(spark, [(0, 1.0, 0.0), (1, 0.0, 1.0)], "rid int, inlet double, outlet double")
    return flows, external


def test_two_reactors(two):
    assert network.check_balance(*two) == (0.0, 0.0)
    split = {(r.src, r.dst): r.ratio for r in network.mass_split(*two).collect()}
    assert split == {(0, 1): 1.0, (1, 0): 0.5}
    back = {(r.src, r.dst): r.mass for r in network.adapt_flows(network.mass_split(*two), two[1]).collect()}
    assert back == pytest.approx({(0, 1): 2.0, (1, 0): 1.0})
    through = two[1].select("rid", F.lit(2.0).alias("M"))
    assert {r.rid: r.residual for r in network.residual(through, network.mass_split(*two), two[1]).collect()} == {0: 0.0, 1: 0.0}


def test_unbalanced(spark, two):
    off = table(spark, [(0, 1.0, 0.0), (1, 0.0, 3.0)], "rid int, inlet double, outlet double")
    with pytest.raises(network.Unbalanced):
        network.check_balance(two[0], off)
    with pytest.warns(UserWarning):
        assert network.warn_balance(two[0], off).count() == 1


def test_adapted_and_balanced_networks(spark):
    rng = np.random.default_rng(0)
    n, inlet = 8, np.zeros(8)
    inlet[:2] = 5.0
    ratios = rng.random((n, n)) * (rng.random((n, n)) < 0.5)
    np.fill_diagonal(ratios, 0)
    ratios *= 0.9 / np.maximum(ratios.sum(axis=1), 1e-9)[:, None]
    through = np.linalg.solve(np.eye(n) - ratios.T, inlet)
    m = ratios * through[:, None]
    outlet = through - m.sum(axis=1)
    external = table(spark, [(i, float(inlet[i]), float(outlet[i])) for i in range(n)], "rid int, inlet double, outlet double")
    flows = table(spark, [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src int, dst int, mass double")
    assert max(map(abs, network.check_balance(flows, external, 1e-9))) < 1e-9
    again = network.adapt_flows(network.mass_split(flows, external), external)
    assert {(r.src, r.dst): r.mass for r in again.collect()} == pytest.approx({(r.src, r.dst): r.mass for r in flows.collect()})
    noisy = flows.withColumn("mass", F.col("mass") * (1 + 0.02 * F.sin(F.col("src") * 7 + F.col("dst"))))
    network.check_balance(network.balance_flows(noisy, external), external, 1e-9)


def test_assembly(spark, two):
    attributes = table(spark, [(0, 2.0, 1200.0, 1200.0, 5.0), (1, 1.0, 600.0, 600.0, 4.0)], "cluster int, volume double, T double, Tmean double, Tvar double")
    reactors, flows = network.assemble(attributes, *two, correct=True)
    rows = {r.rid: r for r in reactors.collect()}
    assert sorted(rows) == [0, 1, 2]
    assert (rows[2].tau, rows[2].Mf, rows[2].isinput) == (1e-6, 1.0, True)
    assert (rows[0].Mf, rows[0].kincorr, rows[1].kincorr, rows[1].isoutput) == (2.0, True, False, True)
    assert {(r.src, r.dst): r.mass for r in flows.collect()} == {(0, 1): 2.0, (1, 0): 1.0, (2, 0): 1.0}


def test_layers(spark):
    net = network.LayeredNetwork().input_layer([1.0, 3.0]).connected_layer(3, "PFR").output_layer(2)
    net.check(spark)
    flows, external = net.flows(spark)
    assert flows.agg(F.sum("mass")).first()[0] == pytest.approx(8.0)
    assert {n: (t, p.get("tau"), p.get("L")) for n, (_, t, p) in net.nodes.items()}["H00"] == ("PFR", None, 1.0)
    leaky = network.LayeredNetwork(round4=True).input_layer([1.0]).output_layer(3)
    with pytest.raises(network.Unbalanced):
        leaky.check(spark)
    with pytest.raises(ValueError):
        network.LayeredNetwork().output_layer(1)


def test_small_flows(spark):
    flows = table(spark, [(0, 1, 1.0), (0, 2, 1e-5), (3, 0, 0.0)], "src int, dst int, mass double")
    assert [(r.src, r.dst) for r in filters.drop_small_flows(flows).collect()] == [(0, 1)]
    assert sorted(r.mass for r in filters.threshold_flows(flows.withColumn("mass", F.col("mass") * 1.23456789)).collect()) == [0.0, 1.23457e-05, 1.23457]


def test_formulas():
    assert chem.elements("CH3OH") == {"C": 1, "H": 4, "O": 1} and chem.elements("c12h26") == {"C": 12, "H": 26}
    weights = {"CH4": 16, "C2H6": 30, "CH3OH": 32, "H2O": 18, "CO2": 44, "O2": 32, "N2": 28, "NO": 30, "NH3": 17}
    assert {s: chem.molecular_weight(s) for s in weights} == weights
    for bad in ("", "X2", "CH4!", "2H"):
        with pytest.raises(ValueError):
            chem.elements(bad)
    assert chem.parse_composition("CH4:0.5, H2:0.5") == chem.parse_composition(["H2:0.5", "CH4:0.5"]) == {"CH4": 0.5, "H2": 0.5}
    assert chem.species_of("    molef-ch4") == "CH4"


def test_mixture_fraction_ends(spark):
    one = spark.range(1)
    pure = {"CH4": F.lit(1.0), "O2": F.lit(0.0), "N2": F.lit(0.0)}
    air = {"CH4": F.lit(0.0), "O2": F.lit(0.233), "N2": F.lit(0.767)}
    z = one.select(chem.mixture_fraction(pure, {"CH4": 1.0}), chem.mixture_fraction(air, {"CH4": 1.0}), chem.equivalence_ratio({"CH4": F.lit(1.0), "O2": F.lit(2.0)})).first()
    assert tuple(z) == pytest.approx((1.0, 0.0, 1.0))
    none = one.select(chem.mole_to_mass({"CH4": F.lit(0.0)})["CH4"], features.log_scale(F.lit(0.0)), features.log_scale(F.lit(-np.e))).first()
    assert none[0] is None and none[1] == -100.0 and none[2] == pytest.approx(1.0)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from(["C", "H", "N", "O"]), st.integers(1, 30), min_size=1))
def test_any_formula(counts):
    assert chem.elements("".join(f"{e}{n}" for e, n in counts.items())) == counts


REACTOR = (
    "Dictionary PerfectlyStirredReactor \n { \n     @Type     NonIsothermal-ConstantPressure;\n     @KineticsFolder     dummy;\n"
    "     @Volume    3.430000e-01 m3;\n     @MassFlowRate    2.000000e+00 kg/s;\n     @ExchangeArea    1.000000e+00 m2;\n"
    "     @GlobalThermalExchangeCoefficient    1.500000e+03 W/m2/K;\n     @EnvironmentTemperature    300 K;\n"
    "     @InitialStatus     initial-status;\n     @InletStatus     inlet-mixture;\n} \n"
    "Dictionary inlet-mixture \n { \n     @Temperature     3.000000e+02 K;\n     @Pressure        1.013250e+05 Pa;\n"
    "@Moles     O2 0.190045 \nCH4 0.095023 \nN2 0.714932; \n} \n"
    "Dictionary initial-status \n { \n     @Temperature     2.500000e+03 K;\n     @Pressure        1.013250e+05 Pa;\n"
    "     @Moles     O2 0.190045 \nCH4 0.095023 \nN2 0.714932; \n} \n"
)  # the text of a deck that the solver takes
NETWORK = (
    "Dictionary ReactorNetwork \n { \n@KineticsPreProcessor     kinetic-mechanism;\n@MinIterations                     5;\n"
    "@MaxIterations                     500;\n@AtomicErrorThreshold              1.000000e-03;\n@NonIsothermalErrorThreshold       1.000000e-04;\n"
    "@MaxUnbalance                      5.000000e-02;\n@PerfectlyStirredReactors \n0       input.cstr.0.dic\n1       input.cstr.1.dic;\n"
    "@InternalConnections     0     1     2.000000e+00 \n1     0     1.000000e+00;\n@InputStreams     0     1.000000e+00; \n"
    "@OutputStreams     1     1.000000e+00; \n@SpeciesToMonitor     NO\tCO\t;\n@VerbosityLevel     1;\n} \n \n"
    "Dictionary kinetic-mechanism \n { \n@Kinetics          a.CKI;\n@Thermodynamics    b.dat;\n@Output     kinetics;\n} \n"
)


def test_decks(spark, two, tmp_path):
    x = [("O2", 0.190045), ("CH4", 0.095023), ("N2", 0.714932), ("NO", 1e-7)]
    schema = "rid int, rtype string, isothermal boolean, volume double, Mf double, Aq double, Uq double, Tenv double, initial boolean, inlet struct<T:double,P:double,X:array<struct<species:string,x:double>>>"
    r = table(spark, [(0, "PSR", False, 0.343, 2.0, 1.0, 1500.0, 300.0, True, (300.0, 101325.0, x))], schema)
    row = decks.reactor_decks(r).first()
    assert (row.file, row.deck) == ("input.cstr.0.dic", REACTOR)
    both = table(spark, [(0, "PSR", 1.0, True, False), (1, "PSR", 2.0, False, True)], "rid int, rtype string, Mf double, isinput boolean, isoutput boolean")
    text = decks.network_deck(both, two[0], "a.CKI", "b.dat")
    assert text == NETWORK
    path = tmp_path / "input.dic"
    path.write_text(text)
    assert [tuple(o) for o in solver.outlet_reactors(spark, str(path)).collect()] == [(1, 1.0)]
    assert sorted(tuple(f) for f in solver.deck_flows(spark, str(path)).collect()) == [(0, 1, 2.0), (1, 0, 1.0)]
    diffusion = table(spark, [(0, 1, 0.5, 0.25)], "src int, dst int, area double, distance double")
    wide = decks.network_deck(both, two[0], "a", "b", diffusion=diffusion, MaxIterations=9)
    assert "@DiffusionEnabled     true;" in wide and "0     1     2.000000e+00     5.000000e-01     2.500000e-01" in wide and "@MaxIterations                     9;" in wide
    with pytest.raises(ValueError):
        decks.network_deck(both.withColumn("isinput", F.lit(False)), two[0], "a", "b")
    with pytest.raises(ValueError):
        decks.reactor_decks(r.withColumn("rtype", F.lit("tank"))).count()
    pfr = decks.reactor_decks(table(spark, [(4, "PFR", True, 1.0, 0.1, True, 900.0, 9.0)], "rid int, rtype string, isothermal boolean, L double, D double, kincorr boolean, Tmean double, Tvar double")).first()
    assert pfr.file == "input.pfr.4.dic" and "@ConstantPressure   true" in pfr.deck and "@AverageTemperature     9.000000e+02" in pfr.deck


def test_older_decks(spark):
    schema = "rid int, T double, P double, Y array<struct<species:string,y:double>>, volume double, Mf double"
    r = table(spark, [(3, 300.0, 101325.0, [("H2", 0.5), ("CH4", 0.5)], 2.0, 1.0)], schema)
    deck = decks.cgs_decks(r).first().deck
    assert "@Volume             2.000000e+00 cm3" in deck and "@Masses" in deck and "H2 0.500000" in deck
    with pytest.raises(ValueError):
        decks.cgs_decks(r.drop("Mf"))


def test_coded_reactors(spark, two):
    y = [("O2", 0.232), ("N2", 0.768)]
    rows = table(spark, [(0, 0, 300.0, 101325.0, y, 5.0, 1.0, 1.0), (1, 1, 300.0, 101325.0, y, 5.0, 900.0, 10.0), (2, 2, 300.0, 101325.0, y, 5.0, 1.0, 1.0)],
                 "rid int, code int, T double, P double, Y array<struct<species:string,y:double>>, volume double, L double, D double")
    text = {r.file: r.deck for r in decks.cgs_decks(decks.coded_reactors(rows, *two, heat=900.0, outlet_t=1200.0)).collect()}
    assert sorted(text) == ["input.cstr.0.dic", "input.cstr.2.dic", "input.pfr.1.dic"]
    assert "@MassFlowRate      2.000000e+04 kg/s" in text["input.cstr.0.dic"] and "Coefficient" not in text["input.cstr.0.dic"]
    assert "@GlobalThermalExchangeCoefficient   1.000000e+00 W/m2/K" in text["input.cstr.2.dic"]
    assert "PlugFlowReactor" in text["input.pfr.1.dic"] and "@Length             9.000000e+02 mm" in text["input.pfr.1.dic"] and "@Volume" not in text["input.pfr.1.dic"]


def test_solver_files(spark, tmp_path):
    head = "t[s](1) T0[K](2) T[K](3) P[Pa](4) H2_x(5) NO_x(6) H2_w(7) NO_w(8)"
    for rid, t in ((0, 1500.0), (10, 1272.0)):
        folder = tmp_path / f"Reactor.{rid}"
        folder.mkdir()
        (folder / "Output.out").write_text(f"{head}\n0 1 2 3 4 5 6 7\n0.5 300 {t} 101325 0.25 1e-05 0.1 2e-05\n")
        (folder / "log.inlet").write_text("Iter.  T[K](2)  H2(3)  NO(4)\n1 300 0.1 0.2\n2 310 0.3 0.4\n")
        (folder / "ROPA.out").write_text("NO a b c d e 1.5\nX\nNO a b c d e 2.5\n")
    path = str(tmp_path)
    out = {r.rid: r for r in solver.read_outputs(spark, path).collect()}
    assert out[10].T == 1272.0 and out[10].P == 101325.0 and out[10].X == {"H2": 0.25, "NO": 1e-05}
    assert {r.rid: (r.T, r.X) for r in solver.read_inputs(spark, path).collect()}[0] == (310.0, {"H2": 0.3, "NO": 0.4})
    assert {tuple(r) for r in solver.read_variable(spark, path, "tau").collect()} == {(0, 0.5), (10, 0.5)}
    assert {tuple(r) for r in solver.read_variable(spark, path, "NO").collect()} == {(0, 1e-05), (10, 1e-05)}
    assert {tuple(r) for r in solver.read_rates(spark, path, "NO").collect()} == {(0, 2.5), (10, 2.5)}
    assert solver.highest_temperature(spark, path) == 1500.0
    assert solver.read_tables(spark, path, last_only=False).count() == 32
    (tmp_path / "input.dic").write_text("@OutputStreams     10     6.429002e-03; \n")
    assert [tuple(r) for r in solver.outlet_species(spark, path, f"{path}/input.dic", ["no"]).collect()] == [(10, "NO", 1e-05)]
    with pytest.raises(ValueError):
        solver.read_variable(spark, path, "XX")


def test_layers_as_decks(spark):
    net = network.LayeredNetwork().input_layer([1.0, 3.0]).connected_layer(2, "PFR", length=2.0).output_layer(1, params=[{"volume": 0.5, "T": 900.0}])
    reactors, flows = net.tables(spark)
    rows = {r.rid: r for r in reactors.collect()}
    assert [rows[i].isinput for i in range(5)] == [True, True, False, False, False] and rows[4].isoutput and rows[2].L == 2.0
    assert [rows[i].Mf for i in range(5)] == pytest.approx([1.0, 3.0, 2.0, 2.0, 4.0])
    texts = {r.rid: r.deck for r in decks.reactor_decks(reactors).collect()}
    assert "PlugFlowReactor" in texts[2] and "@Length    2.000000e+00 m" in texts[2] and "@Volume" in texts[4]
    deck = decks.network_deck(reactors, flows, "kin", "thermo")
    assert "input.pfr.2.dic" in deck and "input.cstr.4.dic" in deck
    with pytest.raises(ValueError, match="without L"):
        network.LayeredNetwork().input_layer([1.0]).output_layer(1, "PFR", params=[{"D": 1.0}]).tables(spark)


def test_networks_that_are_given(spark):
    flows = [[0, 2.0], [1.0, 0]]
    reactors, links = network.given_network(spark, [2.0, 0], [0, 2.0], flows, [1.0, 2.0], [300.0, 900.0])
    assert {(r.src, r.dst): r.mass for r in links.collect()} == pytest.approx({(0, 1): 3.0, (1, 0): 1.0, (2, 0): 2.0})
    assert {r.rid: r.isoutput for r in reactors.collect()} == {0: False, 1: True, 2: False}
    with pytest.raises(network.Unbalanced):
        network.given_network(spark, [2.0, 0], [0, 2.0], [[0, 9.0], [1.0, 0]], [1.0, 2.0], [300.0, 900.0], adapt=False)
    for wrong in ({"inlets": [1.0]}, {"flows": [[0, 1.0]]}, {"flows": [[0, 1.0], [0]]}, {"temperatures": []}, {"outlets": [0, -1.0]}):
        own = {"inlets": [2.0, 0], "outlets": [0, 2.0], "flows": flows, "volumes": [1.0, 2.0], "temperatures": [300.0, 900.0]} | wrong
        with pytest.raises(ValueError):
            network.given_network(spark, **own)


@pytest.mark.parametrize(
    ("rids", "links"), [([0, 2], []), ([0, 0], []), ([1, 2], []), ([0, 1], [(0, 2, 1.0)]), ([0, 1], [(0, 1, -1.0)]), ([0, 1], [(0, 1, None)]), ([], [])]
)
def test_reactors_and_flows_fit(spark, rids, links):
    with pytest.raises(ValueError):
        network.check_network(table(spark, [(r,) for r in rids], "rid int"), table(spark, links, "src int, dst int, mass double"))


def test_mixture_fraction_between_two_streams(spark):
    """0 in the oxidiser, 1 in the fuel, linear in between, with oxygen in both."""
    fuel, air = {"CH4": 0.8, "O2": 0.2}, {"O2": 0.3, "N2": 0.7}
    rows = [(z, z * 0.8, z * 0.2 + (1 - z) * 0.3, (1 - z) * 0.7) for z in (0.0, 0.25, 1.0)]
    df = table(spark, rows, "z double, CH4 double, O2 double, N2 double")
    out = df.select("z", chem.mixture_fraction({c: F.col(c) for c in ("CH4", "O2", "N2")}, fuel, air).alias("got")).collect()
    assert [r.got for r in out] == pytest.approx([r.z for r in out])
    with pytest.raises(ValueError):
        chem.mixture_fraction({"CH4": F.col("CH4")}, fuel, fuel)
    solved = table(spark, [(0, {"CH4": 1.0}), (1, {"O2": 0.21, "N2": 0.79})], "rid int, X map<string,double>")
    got = {r.rid: r.mixture_fraction for r in pipeline.mixture_fraction_of_reactors(solved, ["CH4", "O2", "N2"], "CH4:1", "O2:0.233, N2:0.767").collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.0}, abs=2e-3)


@pytest.mark.parametrize("solved", [
    lambda flows, external: network.adapt_flows(network.mass_split(flows, external), external),
    lambda flows, external: network.adjust_flows(flows, external, 0.1),
])
def test_given_tables_are_scanned_once(spark, solved):
    """Flows and inlets that a query makes are made once, however often a solve reads them."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r

    flows = spark.createDataFrame(spark.sparkContext.parallelize([(0, 1, 3.0), (1, 2, 2.0), (2, 1, 1.0)], 2).mapPartitions(count), "src int, dst int, mass double")
    external = spark.createDataFrame([(0, 3.0, 0.0), (1, 0.0, 2.0), (2, 0.0, 1.0)], "rid int, inlet double, outlet double")
    got = {(r.src, r.dst): r.mass for r in solved(flows, external).collect()}
    assert got == pytest.approx({(0, 1): 3.0, (1, 2): 2.0, (2, 1): 1.0})
    assert seen.value == 3
