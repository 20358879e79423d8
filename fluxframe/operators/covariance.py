"""Likelihoods with a full covariance matrix.

Matrices are tables of square blocks, so neither a task nor the driver ever
holds more than a few blocks: inversion is a block Gauss-Jordan elimination of
one round per block row, the quadratic form joins residual blocks with block rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fluxframe.functions.expr import ColumnLike, col
from fluxframe.session import staged

BLOCK = 512
Cells = ArrayType(DoubleType())


def _square(cells) -> np.ndarray:
    n = int(round(math.sqrt(len(cells))))
    return np.asarray(cells, dtype=float).reshape(n, n)


@F.pandas_udf(StructType([StructField("inverse", Cells), StructField("logdet", DoubleType())]))
def _invert(blocks: pd.Series) -> pd.DataFrame:
    squares = [_square(b) for b in blocks]
    return pd.DataFrame({
        "inverse": [np.linalg.inv(m).ravel().tolist() for m in squares],
        "logdet": [float(np.linalg.slogdet(m)[1]) for m in squares],
    })


def _matmul(a, b, rows: int, inner: int) -> np.ndarray:
    return np.asarray(a, dtype=float).reshape(rows, inner) @ np.asarray(b, dtype=float).reshape(inner, -1)


@F.pandas_udf(Cells)
def _product(a: pd.Series, b: pd.Series, rows: pd.Series, inner: pd.Series) -> pd.Series:
    return pd.Series([_matmul(*v).ravel().tolist() for v in zip(a, b, rows, inner)])


@F.pandas_udf(Cells)
def _subtract_product(c: pd.Series, a: pd.Series, b: pd.Series, rows: pd.Series, inner: pd.Series) -> pd.Series:
    return pd.Series([(np.asarray(w, dtype=float) - _matmul(*v).ravel()).tolist() for w, *v in zip(c, a, b, rows, inner)])


def to_blocks(cov: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(by, i, j, c) cells to (by, bi, bj, rows, cells row by row). Indices run from 0 without gaps."""
    cut = cov.select(*by, F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"), "i", "j", "c")
    packed = cut.groupBy(*by, "bi", "bj").agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "c"))).alias("__c"), (F.max("i") - F.min("i") + 1).alias("rows"))
    return packed.select(*by, "bi", "bj", "rows", F.transform("__c", lambda e: e["c"]).alias("cells"))


def invert_covariance(cov: DataFrame, by: Sequence[str] = ("dataset",), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Inverse blocks and ln det per matrix, for symmetric positive definite matrices of any size."""
    by = list(by)
    blocks = staged(to_blocks(cov, by, block))
    rounds = blocks.agg(F.max("bi").alias("m")).first()["m"] + 1
    logdet: DataFrame | None = None
    for k in range(rounds):
        pivot = blocks.filter((F.col("bi") == k) & (F.col("bj") == k)).withColumn("__p", _invert("cells"))
        pivot = pivot.select(*by, F.col("__p.inverse").alias("__inv"), F.col("__p.logdet").alias("logdet"), F.col("rows").alias("__k"))
        pivot = staged(pivot)
        part = pivot.select(*by, "logdet")
        logdet = part if logdet is None else logdet.unionByName(part)
        inv = pivot.drop("logdet")
        diagonal = inv.select(*by, F.lit(k).cast("bigint").alias("bi"), F.lit(k).cast("bigint").alias("bj"), F.col("__k").alias("rows"), F.col("__inv").alias("cells"))
        if rounds == 1:
            blocks = diagonal
            break
        here = blocks.join(inv, by, "left")  # matrices with fewer block rows stay as they are
        done = here.filter(F.col("__k").isNull()).select(*blocks.columns)
        live = here.filter(F.col("__k").isNotNull())
        row = staged(live.filter((F.col("bi") == k) & (F.col("bj") != k)).select(
            *by, "bj", "rows", _product("__inv", "cells", "__k", "__k").alias("cells")))
        column = live.filter((F.col("bi") != k) & (F.col("bj") == k)).select(*by, "bi", F.col("cells").alias("__left"))
        rest = live.filter((F.col("bi") != k) & (F.col("bj") != k)).join(column, [*by, "bi"]).join(
            row.select(*by, "bj", F.col("cells").alias("__right")), [*by, "bj"])
        rest = rest.withColumn("cells", _subtract_product("cells", "__left", "__right", "rows", "__k")).select(*blocks.columns)
        left = live.filter((F.col("bi") != k) & (F.col("bj") == k))
        left = left.withColumn("cells", F.transform(_product("cells", "__inv", "rows", "__k"), lambda v: -v)).select(*blocks.columns)
        top = row.select(*by, F.lit(k).cast("bigint").alias("bi"), "bj", "rows", "cells")
        parts = [rest, left, top, diagonal, done]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p.select(*out.columns))
        blocks = staged(out)
    return blocks, logdet.groupBy(*by).agg(F.sum("logdet").alias("logdet"))


def apply_inverse(resid: DataFrame, inverse: DataFrame, by: Sequence[str], vector: Sequence[str], point: str = "i", value: str = "d",
                  block: int = BLOCK) -> DataFrame:
    """g = C^-1 d for every vector (by + vector): rows (by, vector, i, d, g, inv_ii)."""
    by, vector = list(by), list(vector)
    packed = resid.withColumn("bj", F.floor(F.col(point) / block)).groupBy(*by, *vector, "bj").agg(
        F.array_sort(F.collect_list(F.struct(F.col(point).alias("i"), F.col(value).alias("d")))).alias("__c"))
    packed = packed.withColumn("__d", F.transform("__c", lambda e: e["d"]))
    size = F.size("__d")
    dots = F.transform(
        F.sequence(F.lit(0), F.col("rows").cast("int") - 1),
        lambda r: F.struct(
            r.cast("bigint").alias("r"),
            F.aggregate(F.zip_with(F.slice("cells", r * size + 1, size), "__d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("g"),
        ),
    )
    spread = packed.join(inverse, [*by, "bj"]).select(*by, *vector, "bi", F.inline(dots))
    g = spread.select(*by, *vector, (F.col("bi") * block + F.col("r")).alias(point), "g").groupBy(*by, *vector, point).agg(F.sum("g").alias("g"))
    diagonal = inverse.filter("bi = bj").select(
        *by, "bi", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("rows").cast("int") - 1),
                                            lambda r: F.element_at("cells", (r * F.col("rows").cast("int") + r + 1).cast("int")))).alias("r", "inv_ii"))
    diagonal = diagonal.select(*by, (F.col("bi") * block + F.col("r")).alias(point), "inv_ii")
    return resid.select(*by, *vector, point, value).join(g, [*by, *vector, point]).join(diagonal, [*by, point])


def cov_loglik(resid: DataFrame, inverse: DataFrame, logdet: DataFrame, by: Sequence[str], vector: Sequence[str], scale: ColumnLike = 1.0,
               point: str = "i", value: str = "d", block: int = BLOCK) -> DataFrame:
    """-1/2 d^T C^-1 d - 1/2 ln det(2 pi C), with C scaled by scale^2. No vector-wide product is formed."""
    keys = [*by, *vector]
    g = apply_inverse(resid, inverse, by, vector, point, value, block)
    s2 = F.pow(col(scale), 2)
    sums = g.groupBy(*keys).agg(F.sum(F.col(value) * F.col("g")).alias("__q"), F.count(F.lit(1)).alias("__n"))
    return sums.join(logdet, list(by)).select(
        *keys, (F.lit(-0.5) * F.col("__q") / s2 - F.lit(0.5) * (F.col("logdet") + F.col("__n") * F.log(F.lit(2 * math.pi) * s2))).alias("log_l"))


def diagonal_loglik(resid: DataFrame, cov: DataFrame, by: Sequence[str], vector: Sequence[str], b: ColumnLike, point: str = "i", value: str = "d") -> DataFrame:
    """With an inflation exponent b only the diagonal counts: variance C_ii + 10^b."""
    diagonal = cov.filter("i = j").select(*by, F.col("i").alias(point), F.col("c").alias("__c"))
    var: Column = F.col("__c") + F.pow(F.lit(10.0), col(b))
    term = F.pow(F.col(value), 2) / var + F.log(F.lit(2 * math.pi) * var)
    return resid.join(diagonal, [*by, point]).groupBy(*by, *vector).agg((F.lit(-0.5) * F.sum(term)).alias("log_l"))


def pointwise_cov_loglik(resid: DataFrame, inverse: DataFrame, by: Sequence[str], vector: Sequence[str], point: str = "i", value: str = "d",
                         block: int = BLOCK) -> DataFrame:
    """Conditional leave-one-out density of each point given the others."""
    g = apply_inverse(resid, inverse, by, vector, point, value, block)
    lik = F.lit(0.5) * F.log(F.col("inv_ii") / F.lit(2 * math.pi)) - F.lit(0.5) * F.pow("g", 2) / F.col("inv_ii")
    return g.select(*by, *vector, point, lik.alias("log_lik"))
