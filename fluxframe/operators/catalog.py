"""Planet catalogues: column names and units, best measurements, derived quantities, population cuts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions import planets as pl
from fluxframe.functions.expr import total

# Archive heads, tails and quantity names with their unit factor.
# A factor None keeps the value; LOG10 marks a decadic logarithm, with the unit behind it.
HEADS = {"pl_": "", "sy_": "system_", "st_": "star_", "disc_": "discovery_"}
TAILS = {"err1": "_error_upper", "err2": "_error_lower", "lim": "_limit_flag", "str": "_str"}
LOG10 = "log10"
QUANTITIES = {
    "orbper": ("orbital_period", k.DAY),
    "orblper": ("argument_of_periastron", None),
    "orbsmax": ("orbit_semi_major_axis", k.AU),
    "orbincl": ("orbital_inclination", None),
    "orbtper": ("epoch_of_periastron", k.DAY),
    "orbeccen": ("orbital_eccentricity", None),
    "eqt": ("equilibrium_temperature", None),
    "occdep": ("occultation_depth", None),
    "insol": ("insolation_flux", k.S_EARTH),
    "dens": ("density", None),
    "trandep": ("transit_depth", 1e2),
    "tranmid": ("transit_midpoint_time", k.DAY),
    "trandur": ("transit_duration", k.HOUR),
    "spectype": ("spectral_type", None),
    "rotp": ("rotational_period", k.DAY),
    "projobliq": ("projected_obliquity", None),
    "rvamp": ("radial_velocity_semi_amplitude", 1e2),
    "radj": ("radius", k.R_JUP),
    "ratror": ("planet_stellar_radius_ratio", None),
    "trueobliq": ("true_obliquity", None),
    "ratdor": ("semi_major_axis_stellar_radius_ratio", None),
    "imppar": ("impact_parameter", None),
    "msinij": ("mass_sini", k.M_JUP),
    "massj": ("mass", k.M_JUP),
    "teff": ("effective_temperature", None),
    "met": ("metallicity", None),
    "radv": ("radial_velocity", 1e5),
    "vsin": ("rotational_velocity", 1e5),
    "lum": ("luminosity", (LOG10, k.L_SUN)),
    "logg": ("reference_gravity", (LOG10, 1.0)),
    "age": ("age", 1e9 * k.YEAR),
    "mass": ("mass", k.M_SUN),
    "rad": ("radius", k.R_SUN),
    "dist": ("distance", k.PC),
    "plx": ("parallax", 3.6e-6),
    "pm": ("proper_motion", 4.84813681109536e-09 / k.YEAR),
    "pmra": ("proper_motion_ra", 4.84813681109536e-09 / k.YEAR),
    "pmdec": ("proper_motion_dec", 4.84813681109536e-09 / k.YEAR),
    "snum": ("star_number", None),
    "pnum": ("planet_number", None),
    "mnum": ("moon_number", None),
    "metratio": ("metallicityratio", None),
}
PLAIN_NAMES = {"hostname": "host_name", "discoverymethod": "discovery_method", "soltype": "confirmation_status",
               "pl_controv_flag": "controversy_flag", "disc_refname": "discovery_reference", "st_refname": "star_reference"}
MAGNITUDE_BANDS = {"kep": "kepler", "gaia": "gaia"}


def _convert(name: str, best_mass: bool) -> tuple[str, object]:
    """New name of an archive column and its unit factor."""
    if name in PLAIN_NAMES:
        return PLAIN_NAMES[name], None
    head = next((h for h in HEADS if name.startswith(h)), "")
    tail = next((t for t in TAILS if name.endswith(t) and len(name) > len(t)), "")
    core = name[len(head):len(name) - len(tail)]
    new_tail = TAILS.get(tail, "")
    magnitude = re.fullmatch(r"(\w+)mag", core)
    if core == "massj" and best_mass:
        return "massj" + new_tail, None
    if core == "bmassj" and best_mass:
        core = "massj"
    if core in QUANTITIES:
        new, factor = QUANTITIES[core]
    elif magnitude:
        band = magnitude.group(1)
        new, factor = f"apparent_magnitude_{MAGNITUDE_BANDS.get(band, band)}", None
    else:
        new, factor = core, None
    if tail in ("lim", "str"):
        factor = None
    return HEADS.get(head, "") + new + new_tail, factor


def normalize_catalog(df: DataFrame, best_mass: bool = False) -> DataFrame:
    """Readable names and CGS units in one projection. Error columns are converted like their quantity."""
    out = []
    for name in df.columns:
        new, factor = _convert(name, best_mass)
        value: Column = F.col(f"`{name}`")
        if isinstance(factor, tuple):
            value = F.pow(F.lit(10.0), value.cast("double")) * F.lit(factor[1])
        elif factor is not None:
            value = value.cast("double") * F.lit(float(factor))
        out.append(value.alias(new))
    return df.select(*out)


def best_measurement(df: DataFrame, entity: str = "entity_id", parameter: str = "parameter", order: str = "source_order") -> DataFrame:
    """Per entity and parameter the value with the smallest error interval, the first of equals.

    Groups without any error interval give their first value behind the first
    row, or the first row itself if nothing follows. Both choices are minima of
    a struct, so Spark combines them before the shuffle.
    """
    width = F.abs("err_upper") + F.abs("err_lower")
    fields = ["value", "err_upper", "err_lower"]
    ranked = F.struct(width.alias("w"), F.col(order).alias("o"), *fields)
    first = F.struct(F.col(order).alias("o"), *fields)
    got = df.groupBy(entity, parameter).agg(
        F.min(F.when(width.isNotNull(), ranked)).alias("best"),
        F.min(first).alias("first"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    # Only rows without an interval can matter now; where all rows have one, the scan returns nothing.
    head = got.filter(F.col("best").isNull()).select(entity, parameter, F.col("first.o").alias("__first"))
    bare = df.filter((F.col("err_upper").isNull() | F.col("err_lower").isNull()) & F.col("value").isNotNull())
    rest = bare.join(head, [entity, parameter]).filter(F.col(order) > F.col("__first"))
    got = got.join(rest.groupBy(entity, parameter).agg(F.min(first).alias("later")), [entity, parameter], "left")
    pick = F.coalesce(F.col("best.value"), F.col("later.value"), F.col("first.value"))
    return got.select(entity, parameter, pick.alias("value"), F.col("best.err_upper").alias("err_upper"),
                      F.col("best.err_lower").alias("err_lower"), "n_sources")


def _errors(name: str) -> tuple[str, str]:
    return f"{name}_upper", f"{name}_lower"


def _fill(df: DataFrame, name: str, when: Column, derived: tuple[Column, Column, Column]) -> DataFrame:
    """Set value and errors of ``name`` from ``derived`` where ``when`` holds."""
    up, low = _errors(name)
    picked = [F.when(when, d) for d in derived]
    new = {f"__{name}": picked[0].otherwise(F.col(name)), f"__{up}": picked[1].otherwise(F.col(up)),
           f"__{low}": picked[2].otherwise(F.col(low))}
    return df.withColumns(new).withColumns({c: F.col(f"__{c}") for c in (name, up, low)}).drop(*new)


def derive_catalog(df: DataFrame) -> DataFrame:
    """Fill missing radius, mass and star radius; add gravity, equilibrium and intrinsic temperatures.

    Quantities: mass, radius, density, axis, star_radius, star_mass, star_teff,
    star_age, each but star_mass with ``_upper`` and ``_lower`` errors; optional
    star_gravity and star_density (with errors) fill a missing star radius.
    """
    def missing(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == 0)

    have = df.columns
    start = df
    no_radius = missing("radius") & (F.col("mass") > 0) & (F.col("density") > 0)
    no_mass = missing("mass") & ~missing("radius") & (F.col("density") > 0)
    start = start.withColumns({"__no_radius": no_radius, "__no_mass": no_mass})
    start = _fill(start, "radius", F.coalesce("__no_radius", F.lit(False)),
                  pl.radius_from_density("mass", "density", _errors("mass"), _errors("density")))
    start = _fill(start, "mass", F.coalesce("__no_mass", F.lit(False)),
                  pl.mass_from_density("radius", "density", _errors("radius"), _errors("density")))
    star_error = _errors("star_mass") if "star_mass_upper" in have else pl.NONE
    if "star_gravity" in have:
        start = _fill(start, "star_radius", missing("star_radius") & (F.col("star_gravity") > 0),
                      pl.radius_from_gravity("star_gravity", "star_mass", _errors("star_gravity"), star_error))
    if "star_density" in have:
        start = _fill(start, "star_radius", missing("star_radius") & (F.col("star_density") > 0),
                      pl.radius_from_density("star_mass", "star_density", star_error, _errors("star_density")))
    g, g_up, g_low = pl.surface_gravity("mass", "radius", _errors("mass"), _errors("radius"))
    t, t_up, t_low = pl.equilibrium_temperature(
        "axis", "star_teff", "star_radius", 0.0, _errors("axis"), _errors("star_teff"), _errors("star_radius"))
    i, i_up, i_low = pl.intrinsic_temperature("mass", "radius", "star_age", _errors("mass"), _errors("radius"), _errors("star_age"))
    out = start.drop("__no_radius", "__no_mass").withColumns({
        "gravity": g, "gravity_upper": g_up, "gravity_lower": g_low,
        "t_eq": t, "t_eq_upper": t_up, "t_eq_lower": t_low,
        "t_int": i, "t_int_upper": i_up, "t_int_lower": i_low,
    })
    return out.withColumn("t_int_inflated", pl.intrinsic_temperature_inflated("t_eq"))


def with_relative_uncertainty(df: DataFrame, quantities: Sequence[str] = ("mass", "radius")) -> DataFrame:
    """Add ``max_uncertainty``: the largest relative error over the quantities, NULL if one is unknown or <= 0."""
    relative = [
        F.when(F.col(q) > 0, F.greatest(F.abs(f"{q}_upper"), F.abs(f"{q}_lower")) / F.col(q)) for q in quantities
    ]
    known = ~total([r.isNull().cast("int") for r in relative]).cast("boolean")
    return df.withColumn("max_uncertainty", F.when(known, F.greatest(*relative) if len(relative) > 1 else relative[0]))


def select_population(df: DataFrame, tolerance: float, quantities: Sequence[str] = ("mass", "radius")) -> DataFrame:
    """Rows precise enough for the scatter of the quantities."""
    return with_relative_uncertainty(df, quantities).filter(F.col("max_uncertainty") <= tolerance)


def population_counts(df: DataFrame, tolerance: float, by: Sequence[str] = (), quantities: Sequence[str] = ("mass", "radius")) -> DataFrame:
    """How many rows enter the table, each histogram and the scatter."""
    return with_relative_uncertainty(df, quantities).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_table"),
        *[F.count(q).alias(f"n_{q}") for q in quantities],
        F.count_if(F.col("max_uncertainty") <= tolerance).alias("n_scatter"),
    )
