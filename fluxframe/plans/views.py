"""Views over the given tables: one Spark form and one SQL form each.

The given data contain no spectra, so spectra, samples, layers and lookup
tables are derived from them; every view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.session import in_parts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _points(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select("label", "vec_id", F.posexplode("embedding").alias("pos", "v"))


def spectra_long(spark: SparkSession, sf: str) -> DataFrame:
    """Orders = label, exposures = vec_id, 64 channels."""
    pos = F.col("pos")
    return _points(spark, sf).select(
        F.col("label").cast("bigint").alias("order_id"),
        F.col("vec_id").alias("exposure_id"),
        pos.cast("bigint").alias("channel"),
        (F.lit(1.0) + F.lit(0.01) * pos).alias("wavelength"),
        (F.lit(1.0) + F.col("v").cast("double")).alias("flux"),
        (F.lit(0.05) + F.lit(0.01) * (pos % 5)).alias("uncertainty"),
        (F.lit(1.0) + F.lit(0.01) * (F.col("vec_id") % 50)).alias("airmass"),
    )


def spectra_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The same spectra, one row of arrays each."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("order_id"),
        F.col("vec_id").alias("exposure_id"),
        F.transform("embedding", lambda v: F.lit(1.0) + v.cast("double")).alias("flux"),
        F.transform("embedding", lambda _, i: F.lit(0.05) + F.lit(0.01) * (i % 5)).alias("uncertainty"),
    )


def series_long(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular series, one per user: x in seconds since 2024, y the event value."""
    # The wall-clock stamps count as UTC whatever the session's time zone.
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"),
        (micros / F.lit(1e6) - F.lit(1704067200.0)).alias("x"),
        F.col("value").alias("y"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior draws of five runs."""
    p1 = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderkey").alias("sample_id"),
        p1.alias("p1"),
        F.col("o_custkey").cast("double").alias("p2"),
        (F.lit(-0.5) * F.pow((p1 - F.lit(250000.0)) / F.lit(50000.0), 2)).alias("log_l"),
    )


def loglik_long(spark: SparkSession, sf: str) -> DataFrame:
    """Per-point log-likelihoods of ten datasets."""
    return _points(spark, sf).select(
        F.col("label").alias("dataset"),
        F.col("vec_id").alias("sample_id"),
        F.col("pos").cast("bigint").alias("point_id"),
        (F.lit(-0.5) * F.pow(F.col("v").cast("double") / F.lit(0.1), 2)).alias("log_lik"),
    )


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated measurements with asymmetric errors. ``source_order`` orders them like the columns it packs."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity_id"),
        F.col("l_returnflag").alias("parameter"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("err_upper"),
        (-F.col("l_tax")).alias("err_lower"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate").alias("source_order"),
    )


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of stacked layers; pressure grows with the position in the column.

    The position is the line's rank among the lines of its order. Lines of one
    order are at most a few dozen in this schema, so the rank is a plain window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    ranked = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("col_id"),
        F.row_number().over(w).cast("bigint").alias("layer"),
        F.col("l_quantity").alias("kappa"),
        (F.lit(500.0) + F.col("l_extendedprice") / F.lit(100.0)).alias("temperature"),
    )
    return ranked.select(
        "col_id", "layer", F.pow(F.lit(10.0), F.lit(-6.0) + F.lit(0.5) * F.col("layer")).alias("pressure"), "kappa", "temperature"
    )


def abundances(spark: SparkSession, sf: str) -> DataFrame:
    """Species shares per layer; they add up to 1.

    Lines are dealt by layer once, in partitions of bounded size; sums, shares
    and whatever is later grouped by layer stay where they are.
    """
    from pyspark.sql import Window

    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("col_id"),
        F.col("l_linenumber").cast("bigint").alias("layer"),
        (F.col("l_suppkey") % 7).alias("species_id"),
        "l_quantity",
    ).filter("col_id IS NOT NULL AND layer IS NOT NULL")
    part = in_parts(lines, ["col_id", "layer"], lines.count()).groupBy("col_id", "layer", "species_id").agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("col_id", "layer"))  # seven species at most
    return part.select("col_id", "layer", "species_id", (F.col("q") / total).alias("mass_fraction"))


def planets(spark: SparkSession, sf: str) -> DataFrame:
    """One planet per part, CGS, with some masses and radii missing and a density to fill them."""
    size, price, key = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("planet_id"),
        F.when(key % 13 != 0, F.lit(k.M_JUP) * (F.lit(0.1) + F.lit(0.05) * size)).alias("mass"),
        F.when(key % 11 != 0, F.lit(k.R_JUP) * (F.lit(0.5) + price / F.lit(2000.0))).alias("radius"),
        (F.lit(0.5) + F.lit(0.05) * size).alias("density"),
        (F.lit(k.AU) * (F.lit(0.02) + F.lit(0.001) * (key % 97))).alias("axis"),
        (F.lit(k.R_SUN) * (F.lit(0.5) + F.lit(0.02) * size)).alias("star_radius"),
        (F.lit(k.M_SUN) * (F.lit(0.5) + F.lit(0.02) * size)).alias("star_mass"),
        (F.lit(4000.0) + price).alias("star_teff"),
        (F.lit(1e9 * k.YEAR) * (F.lit(1.0) + F.lit(0.1) * (key % 60))).alias("star_age"),
        (F.lit(1.0) + F.lit(0.1) * (key % 50)).alias("period"),
        (F.lit(88.0) + F.lit(0.04) * size).alias("inclination"),
        (F.lit(0.01) * (F.lit(1.0) + key % 5)).alias("rel_upper"),
        (F.lit(-0.02) * (F.lit(1.0) + key % 3)).alias("rel_lower"),
    )


VIEW_SQL = {
    "planets": f"""SELECT p_partkey planet_id,
        CASE WHEN p_partkey % 13 <> 0 THEN {k.M_JUP!r}::DOUBLE*(0.1::DOUBLE+0.05::DOUBLE*p_size) END mass,
        CASE WHEN p_partkey % 11 <> 0 THEN {k.R_JUP!r}::DOUBLE*(0.5::DOUBLE+p_retailprice/2000) END radius,
        0.5::DOUBLE+0.05::DOUBLE*p_size density, {k.AU!r}::DOUBLE*(0.02::DOUBLE+0.001::DOUBLE*(p_partkey % 97)) axis,
        {k.R_SUN!r}::DOUBLE*(0.5::DOUBLE+0.02::DOUBLE*p_size) star_radius, {k.M_SUN!r}::DOUBLE*(0.5::DOUBLE+0.02::DOUBLE*p_size) star_mass,
        4000+p_retailprice star_teff, {1e9 * k.YEAR!r}::DOUBLE*(1::DOUBLE+0.1::DOUBLE*(p_partkey % 60)) star_age,
        1::DOUBLE+0.1::DOUBLE*(p_partkey % 50) period, 88::DOUBLE+0.04::DOUBLE*p_size inclination,
        0.01::DOUBLE*(1+p_partkey % 5) rel_upper, -0.02::DOUBLE*(1+p_partkey % 3) rel_lower FROM part""",
    "spectra_long": """SELECT label::BIGINT order_id, vec_id exposure_id, (i-1)::BIGINT channel,
        1.0::DOUBLE + 0.01::DOUBLE*(i-1) wavelength, 1.0::DOUBLE + embedding[i]::DOUBLE flux,
        0.05::DOUBLE + 0.01::DOUBLE*((i-1)%5) uncertainty, 1.0::DOUBLE + 0.01::DOUBLE*(vec_id%50) airmass
        FROM embeddings, range(1,65) t(i)""",
    "series_long": "SELECT user_id series_id, epoch_us(ts)::DOUBLE/1e6 - 1704067200 x, value y FROM events",
    "samples": """SELECT o_orderpriority run_id, o_orderkey sample_id, o_totalprice p1, o_custkey::DOUBLE p2,
        -0.5::DOUBLE*power((o_totalprice-250000)/50000,2) log_l FROM orders""",
    "loglik_long": """SELECT label dataset, vec_id sample_id, (i-1)::BIGINT point_id,
        -0.5::DOUBLE*power(embedding[i]::DOUBLE/0.1::DOUBLE,2) log_lik FROM embeddings, range(1,65) t(i)""",
    "measurements": """SELECT l_partkey entity_id, l_returnflag parameter, l_extendedprice AS value,
        l_discount err_upper, -l_tax err_lower,
        row_number() OVER (PARTITION BY l_partkey, l_returnflag
            ORDER BY l_orderkey,l_linenumber,l_suppkey,l_extendedprice,l_shipdate) source_order FROM lineitem""",
    "layers": """SELECT col_id, layer, power(10::DOUBLE, -6 + 0.5::DOUBLE*layer) pressure, kappa, temperature FROM (
        SELECT l_orderkey col_id, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) layer,
        l_quantity kappa, 500 + l_extendedprice/100 temperature FROM lineitem)""",
    "abundances": """SELECT l_orderkey col_id, l_linenumber::BIGINT layer, l_suppkey % 7 species_id,
        sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey, l_linenumber) mass_fraction
        FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey % 7""",
}


def sql(views: str, body: str, keys: str = "", vals: str = "", digits: int = 6, **ctes: str) -> str:
    """SQL text: the named views, extra CTEs, then ``body`` with its value columns rounded."""
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views.split()]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    if not vals:
        return head + body
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    for v in (v.strip() for v in vals.split(",")):
        cols.append(f"CASE WHEN round({v}, {digits}) = 0 THEN 0::DOUBLE ELSE round({v}, {digits}) END AS {v}")
    return f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n) q_"
