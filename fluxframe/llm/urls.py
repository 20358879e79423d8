"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses; the rest is compared behind it.
PREFIX_DIGITS = 8
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for NULL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """Judge every url by rules (host, path, verdict): [key, host, path, rule, verdict].

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path. The longest rule text wins, then the longer host, then
    ``block``; the same rule given twice counts once. A url that no rule fits
    gets ``default`` and a NULL rule. NULL urls and urls without ``://`` have an
    empty host and path, which no rule fits: rules with a NULL or empty host are
    void, a NULL path is empty, a NULL verdict is ``block``.

    Every url is expanded only at the label counts and path lengths that occur
    among the rules, so a host of thousands of labels costs no more than others.
    Rules meet expressions in an equi-join on the first ``prefix_digits`` digits
    of SHA-256 alone; behind it the full digests confirm, so a rule that shares
    only the prefix of a digest does not count. Spark broadcasts small rule tables by their size and splits
    skewed prefixes of large ones, as nothing above the join needs its keys
    together. Each input row is judged on its own, so repeated rows and NULL
    keys stay; other columns of ``pages`` are not read.
    """
    listed = rules.select(
        F.translate(F.col("host"), *LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict"),
    ).filter("host IS NOT NULL AND host <> ''")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    shapes = listed.agg(F.struct(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"),
    )).scalar()
    text = F.concat("host", "path")
    hashed = listed.select(
        F.substr(F.sha2(text, 256), F.lit(1), F.lit(prefix_digits)).alias("prefix"), F.sha2(text, 256).alias("digest"), text.alias("rule"),
        F.length("host").alias("host_length"), F.col("verdict").alias("said"),
    )

    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    ).withColumn("shapes", shapes)
    suffixes = F.expr("transform(filter(shapes.labels, n -> n <= size(split(host, '[.]'))), n -> array_join(slice(split(host, '[.]'), -n, n), '.'))")
    prefixes = F.expr("transform(filter(shapes.lengths, n -> n <= length(path)), n -> left(path, n))")
    expanded = rows.withColumn("suffixes", suffixes).withColumn("prefixes", prefixes).select(
        "row", key, "host", "path",
        F.explode_outer(F.expr("flatten(transform(suffixes, s -> transform(prefixes, p -> sha2(concat(s, p), 256))))")).alias("full"),
    ).withColumn("short", F.substr("full", F.lit(1), F.lit(prefix_digits)))
    met = expanded.join(hashed, F.col("short") == F.col("prefix"), "left")
    best = F.max(F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("n"), "host_length", F.col("said"), "rule")))
    judged = met.groupBy("row", key, "host", "path").agg(best.alias("best"))
    return judged.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.said"), F.lit(default)).alias("verdict"))
