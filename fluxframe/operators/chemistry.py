"""Species tables and abundances: formulas, molar masses, mixing ratios, metallicity, filling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions.expr import ColumnLike, col
from fluxframe.operators.groups import with_scalars

LAYER = ["col_id", "layer"]
TINY = 2.2250738585072014e-308
ELECTRON = "e-"


def explode_elements(df: DataFrame, formula: str = "formula", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per element of each formula, with its count. Repeated symbols add up."""
    keys = list(keep) if keep is not None else [c for c in df.columns]
    symbol, count = F.regexp_extract_all(F.col(formula), F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(1)), F.regexp_extract_all(F.col(formula), F.lit(r"([A-Z][a-z]?)(\d*)"), F.lit(2))
    flat = df.select(*keys, F.inline(F.arrays_zip(symbol.alias("element"), count.alias("n"))))
    amount = F.when(F.col("n") == "", F.lit(1)).otherwise(F.col("n").cast("bigint"))
    return flat.withColumn("n", amount).groupBy(*keys, "element").agg(F.sum("n").alias("n"))


def molar_mass(df: DataFrame, masses: DataFrame, formula: str = "formula", keep: Sequence[str] | None = None) -> DataFrame:
    """Sum of count times element mass per formula; ``masses`` has element and mass. An unknown element gives NULL."""
    parts = explode_elements(df, formula, keep).join(masses.select("element", "mass"), "element", "left")
    keys = [c for c in parts.columns if c not in ("element", "n", "mass")]
    known = F.count("mass") == F.count(F.lit(1))
    return parts.groupBy(*keys).agg(F.when(known, F.sum(F.col("n") * F.col("mass"))).alias("molar_mass"))


def is_cloud(species: ColumnLike) -> Column:
    s = col(species)
    return s.contains("(s)") | s.contains("(l)")


def base_name(species: ColumnLike) -> Column:
    """The species name without a resolving-power suffix."""
    return F.split_part(col(species), F.lit(".R"), F.lit(1))


def mean_molar_mass(df: DataFrame, masses: DataFrame, mode: str = "mmr", by: Sequence[str] = LAYER, species: str = "species",
                    value: str = "mass_fraction", out: str = "mean_molar_mass") -> DataFrame:
    """Mean molar mass of each layer from mass fractions (``mmr``) or volume mixing ratios (``vmr``); clouds do not count.

    A negative sum fails, and so does a species without a molar mass; a sum of 0 counts as tiny.
    """
    gas = df.filter(~is_cloud(species)).withColumn("__base", base_name(species))
    joined = gas.join(masses.select(F.col(species).alias("__base"), "molar_mass"), "__base", "left")
    mass = F.coalesce(F.col("molar_mass"), F.raise_error(F.concat(F.lit("no molar mass of "), F.coalesce("__base", F.lit("NULL")))).cast("double"))
    term = F.col(value) / mass if mode == "mmr" else F.col(value) * mass
    summed = joined.groupBy(*by).agg(F.sum(term).alias("__s"))
    total = (
        F.when(F.col("__s") < 0, F.raise_error(F.lit("negative mean molar mass")).cast("double"))
        .when(F.col("__s") == 0, F.lit(TINY)).otherwise(F.col("__s"))
    )
    return summed.select(*by, (1 / total if mode == "mmr" else total).alias(out))


def mmr_to_vmr(df: DataFrame, masses: DataFrame, by: Sequence[str] = LAYER, species: str = "species", value: str = "mass_fraction") -> DataFrame:
    """Add volume_mixing_ratio = X / M * mean molar mass."""
    mean = mean_molar_mass(df, masses, "mmr", by, species, value)
    got = df.withColumn("__base", base_name(species)).join(masses.select(F.col(species).alias("__base"), "molar_mass"), "__base", "left").join(mean, list(by), "left")
    return got.withColumn("volume_mixing_ratio", F.col(value) / F.col("molar_mass") * F.col("mean_molar_mass")).select(*df.columns, "volume_mixing_ratio")


def vmr_to_mmr(df: DataFrame, masses: DataFrame, by: Sequence[str] = LAYER, species: str = "species", value: str = "volume_mixing_ratio",
               out: str = "mass_fraction") -> DataFrame:
    mean = mean_molar_mass(df, masses, "vmr", by, species, value)
    got = df.withColumn("__base", base_name(species)).join(masses.select(F.col(species).alias("__base"), "molar_mass"), "__base", "left").join(mean, list(by), "left")
    return got.withColumn(out, F.col(value) * F.col("molar_mass") / F.col("mean_molar_mass")).select(*[c for c in df.columns if c != out], out)


def element_abundances(vmr: DataFrame, elements: DataFrame, by: Sequence[str] = LAYER, species: str = "species", value: str = "volume_mixing_ratio") -> DataFrame:
    """Amount of each element per layer. ``elements``: species, element, n. Electrons count as hydrogen; an unknown species fails."""
    electron = elements.sparkSession.createDataFrame([(ELECTRON, "H", 1)], f"{species} string, element string, n bigint") if dict(elements.dtypes)[species] == "string" else None
    table = elements.select(species, "element", F.col("n").cast("bigint").alias("n"))
    if electron is not None:
        table = table.filter(F.col(species) != ELECTRON).unionByName(electron)
    n = F.coalesce(F.col("n"), F.raise_error(F.concat(F.lit("no elements of "), F.coalesce(F.col(species).cast("string"), F.lit("NULL")))).cast("bigint"))
    # A list of species is short, which Spark does not see of a table made from rows; joined otherwise, layers would be dealt by species.
    return vmr.join(F.broadcast(table), species, "left").groupBy(*by, "element").agg(F.sum(n * F.col(value)).alias("amount"))


def hydrogen_ratios(abundance: DataFrame, solar: DataFrame, by: Sequence[str] = LAYER) -> DataFrame:
    """Element/H per layer and relative to the sun. ``solar``: element, abundance."""
    h = abundance.filter(F.col("element") == "H").select(*by, F.col("amount").alias("__h"))
    sun = with_scalars(solar, solar, {"__sh": F.max(F.when(F.col("element") == "H", F.col("abundance")))})
    sun = sun.select("element", (F.col("abundance") / F.col("__sh")).alias("__solar"))
    got = abundance.filter(F.col("element") != "H").join(h, list(by)).join(F.broadcast(sun), "element", "left")
    ratio = F.col("amount") / F.col("__h")
    return got.select(*by, "element", ratio.alias("h_ratio"), (ratio / F.col("__solar")).alias("relative_to_solar"))


def metallicity(abundance: DataFrame, solar: DataFrame, by: Sequence[str] = LAYER, neglect_helium: bool = False,
                only_present: bool = False, out: str = "metallicity") -> DataFrame:
    """(metals / H and He) of each layer over that of the sun.

    ``only_present`` limits the sun to the elements that occur in the layers.
    """
    light = ["H"] if neglect_helium else ["H", "He"]

    def z(amount: str) -> Column:
        metals = F.sum(F.when(~F.col("element").isin("H", "He"), F.col(amount)))
        return F.coalesce(metals, F.lit(0.0)) / F.sum(F.when(F.col("element").isin(light), F.col(amount)))

    sun = solar
    if only_present:
        sun = solar.join(abundance.select("element").distinct(), "element", "left_semi")
    got = with_scalars(abundance.groupBy(*by).agg(z("amount").alias("__z")), sun, {"__sun": z("abundance")})
    return got.select(*by, (F.col("__z") / F.col("__sun")).alias(out))


def mixing_ratio_sums(vmr: DataFrame, by: Sequence[str] = LAYER, value: str = "volume_mixing_ratio") -> DataFrame:
    """Layers whose mixing ratios do not add up to 1 within 1e-6: results there are inaccurate."""
    return vmr.groupBy(*by).agg(F.sum(value).alias("total")).filter(F.abs(F.col("total") - 1) > 1e-6)


def _gas(name: Column) -> Column:
    return ~(name.contains("(s)") | name.contains("(l)"))


def _total(entries: Column, keep=None) -> Column:
    """Sum of the values of a layer's (species, value) entries."""
    chosen = entries if keep is None else F.filter(entries, keep)
    return F.aggregate(chosen, F.lit(0.0), lambda acc, e: acc + e["value"])


def _filled(entries: Column, filling: dict) -> Column:
    """A layer's entries after the filling species took what is missing to 1."""
    names = list(filling)
    others = F.filter(entries, lambda e: ~e["species"].isin(names))
    rest = 1 - _total(others, lambda e: _gas(e["species"]))
    if all(w is None for w in filling.values()):
        weights = [_total(entries, lambda e, s=s: e["species"] == s) for s in names]
    else:
        weights = [F.lit(float(w)) for w in filling.values()]
    sum_weights = reduce(lambda a, b: a + b, weights)
    shares = [w / sum_weights * rest for w in weights[:-1]]
    last = reduce(lambda a, b: a - b, shares, rest)
    new = F.array(*[F.struct(F.lit(s).alias("species"), v.alias("value")) for s, v in zip(names, [*shares, last])])
    return F.when(rest > 0, F.concat(others, new)).otherwise(entries)


def _check_filling(filling: dict) -> None:
    weighted = [w is not None for w in filling.values()]
    if any(weighted) and not all(weighted):
        raise ValueError("weighted and unweighted filling species cannot be mixed")


def fill_to_one(df: DataFrame, filling: dict, by: Sequence[str] = LAYER, species: str = "species", value: str = "mass_fraction") -> DataFrame:
    """Share what is missing to a sum of 1 among the filling species.

    Weights are numbers, or all None to use each species' own value. The last
    species takes the remainder by subtraction. Clouds neither count nor change;
    a layer without anything missing stays as it is. A layer is its short list of
    species (each once), folded as an array after one shuffle.
    """
    if not filling:
        return df
    _check_filling(filling)
    entries = F.collect_list(F.struct(F.col(species).alias("species"), F.col(value).alias("value")))
    got = df.groupBy(*by).agg(entries.alias("__e")).select(*by, F.inline(_filled(F.col("__e"), filling)))
    return got.select(*by, F.col("species").alias(species), F.col("value").alias(value))


def override_abundances(table: DataFrame, imposed: DataFrame, by: Sequence[str] = LAYER, species: str = "species", value: str = "mass_fraction",
                        requested: Sequence[str] = (), filling: dict | None = None) -> DataFrame:
    """Imposed species replace table species; then the layer is scaled or filled to a sum of 1.

    Imposed values above a sum of 1 are scaled down. Weighted filling species do
    not come from the table. Requested species that are missing get a tiny value.
    Above a sum of 1 the table species shrink, below it the filling species take the rest.
    The names of the imposed species (a short list) are read first, so that the
    table is filtered in its scan; all else is one shuffle by layer.
    """
    _check_filling(filling or {})
    names = [r[0] for r in imposed.select(species).distinct().collect()]
    fill = {s: w for s, w in (filling or {}).items() if s not in names}
    dropped = [*names, *[s for s, w in fill.items() if w is not None]]

    def tagged(df: DataFrame, is_imposed: bool) -> DataFrame:
        return df.select(*by, F.struct(F.col(species).alias("species"), F.col(value).alias("value"), F.lit(is_imposed).alias("imposed")).alias("e"))

    rest = table.filter(~F.col(species).isin(dropped)) if dropped else table
    got = tagged(rest, False).unionByName(tagged(imposed, True)).groupBy(*by).agg(F.collect_list("e").alias("__e"))
    given = F.filter("__e", lambda e: e["imposed"])
    got = got.withColumn("__raw", _total(given, lambda e: _gas(e["species"])))
    down = F.when(F.col("__raw") > 1, F.col("__raw")).otherwise(F.lit(1.0))

    def entry(name: Column, v: Column) -> Column:
        return F.struct(name.alias("species"), v.alias("value"))

    got = got.withColumn("__imp", F.transform(given, lambda e: entry(e["species"], F.when(_gas(e["species"]), e["value"] / down).otherwise(e["value"]))))
    got = got.withColumn("__tab", F.transform(F.filter("__e", lambda e: ~e["imposed"]), lambda e: entry(e["species"], e["value"])))
    if requested:
        asked = F.array(*[entry(F.lit(s), F.lit(TINY)) for s in requested])
        missing = F.filter(asked, lambda a: ~F.exists("__e", lambda e: e["species"] == a["species"]))
        got = got.withColumn("__tab", F.concat("__tab", missing))
    got = got.withColumns({"__a": _total(F.col("__imp")), "__b": _total(F.col("__tab"))})
    shrink = F.when((F.col("__a") + F.col("__b") > 1) & (F.col("__b") > 0), (1 - F.col("__a")) / F.col("__b")).otherwise(F.lit(1.0))
    got = got.withColumn("__shrink", shrink)
    entries = F.concat("__imp", F.transform("__tab", lambda e: entry(e["species"], e["value"] * F.col("__shrink"))))
    out = got.withColumn("__all", entries)
    result = _filled(F.col("__all"), fill) if fill else F.col("__all")
    return out.select(*by, F.inline(result)).select(*by, F.col("species").alias(species), F.col("value").alias(value))
