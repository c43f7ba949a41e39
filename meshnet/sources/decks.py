"""Sinks: text decks of reactors and networks, as columns and as the folder that the solver reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshnet.sources.named_files import read_named, write_named

#: Columns that a deck can show and their types; those that ``reactors`` lacks are null.
DECK_COLUMNS = {
    "rid": "int", "rtype": "string", "isothermal": "boolean", "volume": "double", "tau": "double", "Mf": "double", "L": "double", "D": "double",
    "Aq": "double", "Uq": "double", "Tenv": "double", "AcOverP": "double", "inlet": "struct<T:double,P:double,X:array<struct<species:string,x:double>>>",
    "initial": "boolean", "kinpath": "string", "preprocessor": "boolean", "kinfile": "string", "thermofile": "string", "kincorr": "boolean",
    "Tmean": "double", "Tvar": "double", "corrtype": "string", "ropa": "struct<species:array<string>,reference:array<string>,threshold:double>",
}
#: Lines of a reactor's deck in their order, with the column each shows.
VALUE_LINES = [
    ("volume", "     @Volume    %e m3;\n"),
    ("tau", "     @ResidenceTime    %e s;\n"),
    ("Mf", "     @MassFlowRate    %e kg/s;\n"),
    ("L", "     @Length    %e m;\n"),
    ("D", "     @Diameter    %e m;\n"),
    ("Aq", "     @ExchangeArea    %e m2;\n"),
    ("Uq", "     @GlobalThermalExchangeCoefficient    %e W/m2/K;\n"),
    ("Tenv", "     @EnvironmentTemperature    %d K;\n"),
    ("AcOverP", "     @CrossSectionOverPerimeter    %d m;\n"),
]
#: Shares up to this are not written, and the temperature an initial state has.
LEAST_SHARE, INITIAL_T = 1e-6, 2500.0


def _show(pattern: str, *values: Column) -> Column:
    """A line, or nothing if one of its values is null."""
    missing = values[0].isNull()
    for v in values[1:]:
        missing = missing | v.isNull()
    return F.when(missing, "").otherwise(F.format_string(pattern, *values))


def _if(condition: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), text if isinstance(text, Column) else F.lit(text)).otherwise("")


def _moles(x: Column) -> Column:
    """Species above the least share, a line each."""
    kept = F.filter(x, lambda s: s["x"] > LEAST_SHARE)
    return F.array_join(F.transform(kept, lambda s: F.format_string("%s %f", s["species"], s["x"])), " \n")


def _with_columns(reactors: DataFrame) -> DataFrame:
    return reactors.select(*(F.col(c).cast(t).alias(c) if c in reactors.columns else F.lit(None).cast(t).alias(c) for c, t in DECK_COLUMNS.items()))


def reactor_decks(reactors: DataFrame) -> DataFrame:
    """``rid, file, deck`` of every reactor (see ``DECK_COLUMNS``)."""
    r = _with_columns(reactors)
    bad = r.where(~F.coalesce(F.col("rtype").isin("PSR", "PFR"), F.lit(False)) | (F.col("preprocessor") & (F.col("kinfile").isNull() | F.col("thermofile").isNull())))
    if bad.limit(1).count():
        raise ValueError("a reactor is PSR or PFR, and a preprocessor needs both kinetic files")
    psr, hot = F.col("rtype") == "PSR", ~F.coalesce("isothermal", F.lit(True))
    kind = F.when(hot, "NonIsothermal").otherwise("Isothermal")
    has_inlet, initial = F.col("inlet").isNotNull(), F.coalesce("initial", F.lit(False)) & hot
    pre, own = F.coalesce("preprocessor", F.lit(False)), F.col("inlet.X")
    values = [_show(p, F.col(c).cast("long") if "%d" in p else F.col(c)) for c, p in VALUE_LINES]
    # The blocks of a reactor's deck.
    head = F.concat(
        F.when(psr, "Dictionary PerfectlyStirredReactor \n { \n").otherwise("Dictionary PlugFlowReactor \n { \n"),
        F.lit("     @Type     "), kind, F.when(psr, "-ConstantPressure;\n").otherwise(";\n     @ConstantPressure   true;\n"),
        F.when(pre, "      @KineticsPreProcessor     kinetic-mechanism; \n").otherwise(
            F.format_string("     @KineticsFolder     %s;\n", F.coalesce("kinpath", F.lit("dummy")))
        ),
        *values,
        _if(initial, "     @InitialStatus     initial-status;\n"),
        _if(has_inlet, "     @InletStatus     inlet-mixture;\n"),
        _if(F.col("ropa").isNotNull(), "     @OnTheFlyROPA      ropa;\n"),
        _if(F.col("kincorr"), "     @KineticCorrections      kinetic-corrections;\n"),
        F.lit("} \n"),
    )
    inlet = F.concat(
        F.lit("Dictionary inlet-mixture \n { \n"),
        F.format_string("     @Temperature     %e K;\n     @Pressure        %e Pa;\n", F.col("inlet.T"), F.col("inlet.P")),
        F.lit("@Moles     "), _moles(own), F.lit("; \n} \n"),
    )
    state = F.concat(
        F.lit("Dictionary initial-status \n { \n"),
        F.format_string("     @Temperature     %e K;\n     @Pressure        %e Pa;\n", F.lit(INITIAL_T), F.col("inlet.P")),
        F.lit("     @Moles     "), _moles(own), F.lit("; \n} \n"),
    )
    names = lambda c: F.concat(F.lit(" "), F.array_join(c, " "))
    ropa = F.concat(
        F.lit("Dictionary ropa \n{ \n     @Species "), names(F.col("ropa.species")), F.lit(";\n     @ReferenceSpecies "), names(F.col("ropa.reference")),
        F.format_string(";\n     @Threshold    %e;\n} \n", F.col("ropa.threshold")),
    )
    corrections = F.format_string(
        "\nDictionary kinetic-corrections \n{ \n     @AverageTemperature     %e;\n     @TemperatureVariance     %e;\n     @Type     %s; \n} \n",
        F.col("Tmean"), F.col("Tvar"), F.coalesce("corrtype", F.lit("beta")),
    )
    mechanism = F.format_string(
        "\nDictionary kinetic-mechanism \n{ \n     @Kinetics     %s; \n     @Thermodynamics    %s;   \n     @Output     kinetics; \n } \n", F.col("kinfile"), F.col("thermofile")
    )
    deck = F.concat(head, _if(has_inlet, inlet), _if(initial, state), _if(F.col("ropa").isNotNull(), ropa), _if(F.col("kincorr"), corrections), _if(pre, mechanism))
    file = F.format_string("input.%s.%d.dic", F.when(psr, "cstr").otherwise("pfr"), F.col("rid"))
    return r.select("rid", file.alias("file"), deck.alias("deck"))


#: Settings of a network and their lines.
SETTINGS = {
    "MinIterations": ("@MinIterations                     %d;\n", 5),
    "MaxIterations": ("@MaxIterations                     %d;\n", 500),
    "AtomicErrorThreshold": ("@AtomicErrorThreshold              %e;\n", 1e-3),
    "NonIsothermalErrorThreshold": ("@NonIsothermalErrorThreshold       %e;\n", 1e-4),
    "MaxUnbalance": ("@MaxUnbalance                      %e;\n", 0.05),
}
#: What a network's deck says around its lists; a list has what stands before, in a line, between lines and after.
LAYOUT = {
    "head": "Dictionary ReactorNetwork \n { \n@KineticsPreProcessor     kinetic-mechanism;\n",
    "diffusion": "@DiffusionEnabled     true;\n",
    "PSR": ("@PerfectlyStirredReactors \n", "%d       input.cstr.%d.dic", "\n", ";\n"),
    "PFR": ("@PlugFlowReactors \n", "%d       input.pfr.%d.dic", "\n", ";\n"),
    "links": ("@InternalConnections     ", "%d     %d     ", " \n", ";\n"),
    "inputs": ("@InputStreams     ", "%d     ", " \n", "; \n"),
    "outputs": ("@OutputStreams     ", "%d     ", " \n", "; \n"),
    "species": ("@SpeciesToMonitor     ", "%s\t", ";\n"),
    "tail": "@VerbosityLevel     1;\n} \n \n",
    "kinetics": "Dictionary kinetic-mechanism \n { \n@Kinetics          %s;\n@Thermodynamics    %s;\n@Output     kinetics;\n} \n",
}
#: The same in the older dialect, whose settings are not to be changed.
OLDER_LAYOUT = {
    "head": "Dictionary ReactorNetwork \n { \n@KineticsPreProcessor      kinetic-mechanism; \n",
    "settings": "@MinIterations            5;   \n@MaxIterations            500;  \n@AtomicErrorThreshold     1e-4;\n@NonIsothermalErrorThreshold\t1e-4; \n@MaxUnbalance     0.05; \n",
    "diffusion": "@DiffusionEnabled     true; \n",
    "PFR": ("@PlugFlowReactors     \n", "%d        input.pfr.%d.dic", "  \n", ";  \n"),
    "PSR": ("@PerfectlyStirredReactors     \n", "%d        input.cstr.%d.dic", "  \n", ";  \n"),
    "links": ("@InternalConnections   ", "                  %d   %d   ", " \n", "; \n"),
    "inputs": ("@InputStreams   ", "%d ", " \n", "; \n"),
    "outputs": ("@OutputStreams    ", "%d ", " \n", "; \n"),
    "species": ("@SpeciesToMonitor ", "  %s", " ; \n"),
    "tail": "@VerbosityLevel   1; \n } \n",
    "kinetics": "Dictionary kinetic-mechanism \n { \n@Kinetics %s; \n@Thermodynamics %s; \n@Output kinetics; \n } \n",
}
NETWORK_FILE = "input.dic"
_LAST = 2**62


def _plain(value: Column) -> Column:
    """A number as the older dialect shows it: whole ones without a fraction, others in powers of ten."""
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(F.format_string("%e", value))


def _list_of(place: int, rows: DataFrame, order: Sequence[str], line: Column, before: str, between: str, after: str) -> DataFrame:
    """``place, a, b, text`` of a list of a line a row: what stands before it, its lines in order, what follows."""
    keys = [F.col(c).cast("long") for c in order] + [F.lit(0).cast("long")] * (2 - len(order))
    lines = rows.select(F.struct(*(k.alias(c) for k, c in zip(keys, "ab", strict=True))).alias("at"), line.alias("line"))
    first = lines.agg(F.min("at")).first()[0]
    lead = F.when((F.col("at.a") == F.lit(first.a)) & (F.col("at.b") == F.lit(first.b)), "").otherwise(F.lit(between)) if first else F.lit("")
    listed = lines.select(F.lit(place).alias("place"), "at.a", "at.b", F.concat(lead, "line").alias("text"))
    ends = [(place, -1, 0, before), (place, _LAST, 0, after)]
    return listed.unionByName(rows.sparkSession.createDataFrame(ends, "place int, a long, b long, text string"))


def network_pieces(
    reactors: DataFrame, flows: DataFrame, kinfile: str, thermofile: str, species: Sequence[str] = ("NO", "CO"), diffusion: DataFrame | None = None,
    older: bool = False, external: DataFrame | None = None, **settings: float,
) -> DataFrame:
    """``file, place, a, b, text``: the deck of a whole network in pieces, whose order is that of the other columns.

    ``diffusion(src, dst, area, distance)`` adds both to each connection. The ``older`` dialect takes inlets and
    outlets from ``external(rid, inlet, outlet)``, has no settings, and lists tubes before tanks.
    """
    if unknown := set(settings) - set(() if older else SETTINGS):
        raise ValueError(f"no setting {', '.join(sorted(unknown))}")
    spark, layout = reactors.sparkSession, OLDER_LAYOUT if older else LAYOUT
    number = _plain if older else lambda v: F.format_string("%e", v)
    if external is not None:
        inputs, outputs = external.where("inlet > 0").select("rid", F.col("inlet").alias("m")), external.where("outlet > 0").select("rid", F.col("outlet").alias("m"))
    elif older:
        raise ValueError("the older dialect needs external flows")
    else:
        net = (
            flows.select(F.col("src").alias("rid"), F.col("mass").alias("m"))
            .unionByName(flows.select(F.col("dst").alias("rid"), (-F.col("mass")).alias("m")))
            .groupBy("rid").agg(F.abs(F.sum("m")).alias("m"))
        )
        inputs = reactors.where("isinput").select("rid", F.col("Mf").alias("m"))
        outputs = reactors.where("isoutput and not coalesce(isinput, false)").join(net, "rid", "left").select("rid", F.coalesce("m", F.lit(0.0)).alias("m"))
    if inputs.limit(1).count() == 0 or outputs.limit(1).count() == 0:
        raise ValueError("the network has no inlet or no outlet")
    head = layout["head"] + (layout["diffusion"] if diffusion is not None else "")
    head += layout["settings"] if older else "".join(pattern % settings.get(name, default) for name, (pattern, default) in SETTINGS.items())
    parts = []
    kinds = ("PFR", "PSR") if older else ("PSR", "PFR")
    for place, kind in enumerate(kinds, 1):
        own = reactors.where(F.col("rtype") == kind)
        if own.limit(1).count():
            before, line, between, after = layout[kind]
            parts.append(_list_of(place, own, ["rid"], F.format_string(line, "rid", "rid"), before, between, after))
    links, values = flows.where("mass <> 0"), [F.col("mass")]
    if diffusion is not None:
        links = links.join(diffusion.select("src", "dst", "area", "distance"), ["src", "dst"], "left")
        values += [F.coalesce("area", F.lit(0.0)), F.coalesce("distance", F.lit(0.0))]
    before, line, between, after = layout["links"]
    shown = F.concat(F.format_string(line, "src", "dst"), F.concat_ws("   " if older else "     ", *map(number, values)))
    parts.append(_list_of(3, links, ["src", "dst"], shown, before, between, after))
    for place, key, rows in ((4, "inputs", inputs), (5, "outputs", outputs)):
        before, line, between, after = layout[key]
        parts.append(_list_of(place, rows, ["rid"], F.concat(F.format_string(line, "rid"), number(F.col("m"))), before, between, after))
    before, one, after = layout["species"]
    tail = before + "".join(one % s for s in species) + after + layout["tail"] + layout["kinetics"] % (kinfile, thermofile)
    out = spark.createDataFrame([(0, 0, 0, head), (6, 0, 0, tail)], "place int, a long, b long, text string")
    for part in parts:
        out = out.unionByName(part)
    return out.select(F.lit(NETWORK_FILE).alias("file"), "place", "a", "b", "text")


def whole_files(pieces: DataFrame) -> DataFrame:
    """``file, deck`` of ``file, place, a, b, text``: a row a file, for files that fit in one."""
    all_of = F.array_sort(F.collect_list(F.struct("place", "a", "b", "text")))
    return pieces.groupBy("file").agg(all_of.alias("all")).select("file", F.array_join(F.transform("all", lambda r: r["text"]), "").alias("deck"))


def network_deck(reactors: DataFrame, flows: DataFrame, kinfile: str, thermofile: str, *args, **options) -> str:
    """The deck of a whole network as one string, for networks that fit in it; see :func:`network_pieces`."""
    return whole_files(network_pieces(reactors, flows, kinfile, thermofile, *args, **options)).first().deck


def exchange_coefficient(heat: Column, area: Column, outlet_t: Column, env_t: Column) -> Column:
    """``U = Q / (A (Tout - Tenv))``; null where a denominator is 0."""
    return F.try_divide(heat, area * (outlet_t - env_t))


def cgs_decks(reactors: DataFrame) -> DataFrame:
    """``rid, deck`` in cm3 and mass fractions, the older dialect.

    ``reactors`` has ``rid, T, P, Y array<struct<species,y>>`` and at least two of ``volume`` (cm3), ``Mf`` and ``tau``,
    or for an ``rtype`` of PFR ``Mf``, ``L`` and ``D`` (mm); optional ``isothermal, U, A, Tenv, kincorr, Tmean, Tvar, diffusivity, initial, abstol, reltol, sensitivity array<string>, basis``.
    """
    types = {"rtype": "string", "L": "double", "D": "double", "volume": "double", "Mf": "double", "tau": "double", "isothermal": "boolean", "U": "double", "A": "double", "Tenv": "double", "kincorr": "boolean",
             "Tmean": "double", "Tvar": "double", "diffusivity": "double", "initial": "boolean", "abstol": "double", "reltol": "double",
             "sensitivity": "array<string>", "basis": "string"}
    r = reactors.select("rid", "T", "P", "Y", *(F.col(c).cast(t).alias(c) if c in reactors.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
    given = sum((F.col(c).isNotNull().cast("int") for c in ("volume", "Mf", "tau")), F.lit(0))
    tube = F.coalesce(F.col("rtype") == "PFR", F.lit(False))
    lacking = F.when(tube, F.col("Mf").isNull() | F.col("L").isNull() | F.col("D").isNull()).otherwise(given < 2)
    if r.where(lacking).limit(1).count():
        raise ValueError("give at least two of volume, mass flow and residence time, of a PFR mass flow, length and diameter")
    hot = ~F.coalesce("isothermal", F.lit(False))
    # The blocks of a reactor's deck in this dialect.
    head = F.concat(
        F.when(tube, "Dictionary PlugFlowReactor \n").otherwise("Dictionary PerfectlyStirredReactor \n"),
        F.lit("{ \n      @KineticsFolder     dummy; \n      @InletStatus        Inlet-Mixture; \n"),
        _if(F.col("initial"), "       @InitialStatus     Initial-Status; \n"),
        _if(F.col("abstol").isNotNull(), "       @OdeParameters       ode-settings; \n"),
        _if(F.col("sensitivity").isNotNull(), "        @SensitivityAnalysis      sensitivity; \n"),
        F.lit("      @Type               "), F.when(hot, "NonIsothermal").otherwise("Isothermal"),
        F.when(tube, "; \n      @ConstantPressure   true; \n").otherwise("-ConstantPressure; \n"),
        _if(hot, _show("      @GlobalThermalExchangeCoefficient   %e W/m2/K; \n      @ExchangeArea               %e m2; \n      @EnvironmentTemperature     %e K;  \n",
                       F.col("U"), F.col("A"), F.col("Tenv"))),
        _if(F.col("kincorr"), "      @KineticCorrections     kinetic-corrections; \n"),
        _show("      @TurbulentDiffusivity     %e kg/m/s; \n", F.col("diffusivity")),
        _if(tube, _show("      @Diameter           %e mm; \n      @Length             %e mm; \n", F.col("D"), F.col("L"))),
        _show("      @Volume             %e cm3; \n", F.when(~tube, F.col("volume"))),
        _show("      @MassFlowRate      %e kg/s;   \n", F.col("Mf")),
        _show("      @ResidenceTime      %e s;   \n", F.col("tau")),
        F.lit("} \n"),
    )
    shares = F.array_join(F.transform("Y", lambda s: F.format_string("          %s %f", s["species"], s["y"])), "\n")
    inlet = F.concat(
        F.format_string("\n Dictionary Inlet-Mixture \n { \n      @Pressure           %e Pa; \n      @Temperature        %e K;  \n", "P", "T"),
        F.when(F.lower("basis").startswith("mol"), "      @Moles       ").otherwise("      @Masses       "), shares, F.lit("; \n} \n"),
    )
    tail = F.concat(
        _if(F.col("initial"), F.format_string("\n Dictionary Initial-Status \n { \n @Temperature 2000 K; \n @Pressure %e Pa; \n @Moles O2 0.21 \n N2 0.79; \n } \n", "P")),
        _show("\n Dictionary ode-settings \n { \n@AbsoluteTolerance     %e; \n@RelativeTolerance     %e; \n} \n", F.col("abstol"), F.col("reltol")),
        _if(F.col("sensitivity").isNotNull(), F.concat(
            F.lit("\n Dictionary sensitivity \n { \n     @Type     kinetic-constants; \n     @DenseSolver      Eigen; \n     @DenseFullPivoting     false; \n     @SubSteps     5; \n     @Species "),
            F.array_join("sensitivity", " "), F.lit("; \n} \n"))),
        _if(F.col("kincorr"), F.format_string("\n Dictionary kinetic-corrections \n { \n     @AverageTemperature     %e; \n     @TemperatureVariance    %e; \n     @Type beta; \n } \n",
                                              "Tmean", "Tvar")),
    )
    file = F.format_string("input.%s.%d.dic", F.when(tube, "pfr").otherwise("cstr"), F.col("rid"))
    return r.select("rid", file.alias("file"), F.concat(head, inlet, tail).alias("deck"))


#: Kinds of coded reactors, and the factor by which their flows are written.
ADIABATIC_TANK, TUBE, COOLED_TANK, CODED_FACTOR = 0, 1, 2, 10_000.0


def coded_reactors(
    reactors: DataFrame, flows: DataFrame, external: DataFrame, heat: float, outlet_t: float, area: float = 1.0, env_t: float = 300.0, factor: float = CODED_FACTOR
) -> DataFrame:
    """``reactors(rid, code, T, P, Y, ...)`` ready for :func:`cgs_decks`: type, heat exchange and mass flow by code.

    Mass flow is all that enters, times ``factor``; a cooled tank exchanges ``heat`` with its surroundings.
    """
    into = (
        flows.select(F.col("dst").alias("rid"), F.col("mass").alias("m"))
        .unionByName(external.select("rid", F.col("inlet").alias("m")))
        .groupBy("rid").agg((F.sum("m") * F.lit(factor)).alias("Mf"))
    )
    cooled, u = F.col("code") == COOLED_TANK, exchange_coefficient(F.lit(heat), F.lit(area), F.lit(outlet_t), F.lit(env_t))
    return reactors.join(into, "rid", "left").withColumns(
        {"Mf": F.coalesce("Mf", F.lit(0.0)), "rtype": F.when(F.col("code") == TUBE, "PFR").otherwise("PSR"), "U": F.when(cooled, u),
         "A": F.when(cooled, F.lit(area)), "Tenv": F.when(cooled, F.lit(env_t))}
    )


def _deck_pieces(decks: DataFrame) -> DataFrame:
    return decks.select("file", F.lit(0).alias("place"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("deck").alias("text"))


def write_decks(decks: DataFrame, folder: str, mode: str = "append") -> None:
    """Each of ``file, deck`` as the file of that name in ``folder``."""
    write_named(_deck_pieces(decks), folder, ["place", "a", "b"], mode)


def write_network(
    reactors: DataFrame, flows: DataFrame, folder: str, kinfile: str, thermofile: str, older: bool = False, external: DataFrame | None = None,
    mode: str = "append", **options,
) -> None:
    """The folder that the solver reads: the network's deck and those of its reactors, by their names, in one write.

    In the ``older`` dialect ``reactors`` are as :func:`cgs_decks` takes them, with ``code`` as :func:`coded_reactors`
    gives it (``options["coded"]`` has that function's further arguments), and flows bear its factor too.
    """
    if older:
        coded = options.pop("coded", None)
        if coded is not None:
            factor = coded.get("factor", CODED_FACTOR)
            reactors = coded_reactors(reactors, flows, external, **coded)
            flows = flows.withColumn("mass", F.col("mass") * F.lit(factor))
            external = external.withColumns({c: F.col(c) * F.lit(factor) for c in ("inlet", "outlet")})
        typed = reactors if "rtype" in reactors.columns else reactors.withColumn("rtype", F.lit("PSR"))
        own = cgs_decks(typed)
        pieces = network_pieces(typed, flows, kinfile, thermofile, older=True, external=external, **options)
    else:
        own, pieces = reactor_decks(reactors), network_pieces(reactors, flows, kinfile, thermofile, external=external, **options)
    write_named(pieces.unionByName(_deck_pieces(own)), folder, ["place", "a", "b"], mode)


def read_decks(spark: SparkSession, folder: str) -> DataFrame:
    """``file, deck`` of a folder of decks."""
    return read_named(spark, folder, "*.dic").withColumnRenamed("text", "deck")
