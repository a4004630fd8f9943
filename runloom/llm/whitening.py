"""Operator 13. Embedding whitening: one aggregation sums centred products over the upper triangle, LAPACK decomposes the covariance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import table
from runloom.session import written

#: Eigenvalues up to this share of the trace count as none: nothing is scaled by them.
_NONE = 1e-12


def rounded(vector: Column, scale: int = 256) -> Column:
    """The entries of a vector as whole multiples of 1/scale, rounded down; null for a vector that is null or has an entry that is null, infinite or not a number."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * scale) + 0))


def dimension_sums(df: DataFrame, vector: str) -> list[int]:
    """The sum of each dimension over all rows, exact."""
    entries = df.select(F.posexplode(vector).alias("i", "x"))
    return [int(r["s"]) for r in entries.groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()]


def triangle_sums(df: DataFrame, vector: str, means: list[float], tile: int = 4) -> np.ndarray:
    """The sums over all rows of the products of centred entries, for every pair of dimensions in the upper triangle, by one aggregation.

    Its expressions are generated: tile * tile sums of products, grouped by the tile of the
    triangle, so that they fit in compiled code whatever the number of dimensions. Sums are
    combined in each task; a row of sums for each tile and task is all that is shuffled.
    """
    d = len(means)
    centred = df.select(F.zip_with(vector, F.array(*map(F.lit, means)), lambda x, m: x - m).alias("c"))
    tiles = centred.select("c", F.explode(F.sequence(F.lit(0), F.lit(d - 1), F.lit(tile))).alias("a")).select("c", "a", F.explode(F.sequence("a", F.lit(d - 1), F.lit(tile))).alias("b"))
    entries = tiles.select("a", "b", *[F.get("c", F.col(side) + k).alias(f"{side}{k}") for side in "ab" for k in range(tile)])
    sums = entries.groupBy("a", "b").agg(*[F.expr(f"sum(a{i} * b{j})").alias(f"s{i}_{j}") for i in range(tile) for j in range(tile)])
    out = np.zeros((d, d))
    for r in sums.collect():
        for i in range(min(tile, d - r["a"])):
            for j in range(min(tile, d - r["b"])):
                out[r["a"] + i, r["b"] + j] = out[r["b"] + j, r["a"] + i] = r[f"s{i}_{j}"]
    return out


def _long(x: int) -> Column:
    return F.lit(x if abs(x) < 1 << 63 else None).cast("long")


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error), up to `components` for each row of df with a sound vector.

    Vectors become whole numbers (see rounded()). The fit list has each distinct one once: n
    in all, with sums S. Components are the unit eigenvectors of the fit list's covariance
    (divisor n) by falling eigenvalue e, numbered from 1. deviation is the sum of (n*x-S)^2
    over the dimensions, exact, null where it or a number on the way to it is no long;
    whitened is the projection of x - S/n divided by sqrt(e); explained is e's share of the
    trace; identity_error is the largest absolute entry of the covariance of whitened over the
    fit list, less the identity.

    Rows whose vector is null or empty, or has a null or non-finite entry, are left out. All
    others must agree in length: those that haven't the most frequent length (by distinct
    vectors, the longest of several) are left out as well. Components whose eigenvalue is 0,
    but for rounding, have null in whitened; identity_error is over the others, and null if
    there are none, as is explained. Equal vectors have equal results, repeated rows and null
    keys each theirs; an empty table gives no rows; other columns of df are not looked at.
    Only sums come to the driver: d, then d(d+1)/2 numbers.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), rounded(F.col(vector)).alias("_x")).where(F.size("_x") > 0)
    fit = written(rows.select("_x").distinct(), "fit")
    counted = fit.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if counted is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d, n = counted
    fit, rows = fit.where(F.size("_x") == d), rows.where(F.size("_x") == d)
    sums = dimension_sums(fit, "_x")
    means = [s / n for s in sums]
    covariance = triangle_sums(fit, "_x", means) / n
    trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components].T

    centred = F.zip_with("_x", F.array(*map(F.lit, means)), lambda x, m: x - m)
    dot = lambda v: F.aggregate(F.zip_with("_c", F.array(*map(F.lit, v.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    whitened = [dot(v) / float(np.sqrt(e)) if e > _NONE * trace else None for e, v in zip(values, vectors, strict=True)]
    scaled = [w for w in whitened if w is not None]
    error = None
    if scaled:
        pairs = [(i, j) for i in range(len(scaled)) for j in range(i, len(scaled))]
        of = fit.select(centred.alias("_c")).select(*[w.alias(f"w{i}") for i, w in enumerate(scaled)])
        found = of.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    far = F.zip_with("_x", F.array(*map(_long, sums)), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n), x), s))
    deviation = F.aggregate(far, F.lit(0).cast("long"), lambda a, x: F.try_add(a, F.try_multiply(x, x)))
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.lit(None).cast("double") if w is None else w).alias("whitened"), F.lit(float(e) / trace if trace > 0 else None).cast("double").alias("explained")) for i, (w, e) in enumerate(zip(whitened, values, strict=True))])
    out = rows.select("_key", deviation.alias("deviation"), centred.alias("_c")).select("_key", "deviation", F.explode(each).alias("_r"))
    return out.select(F.col("_key").alias(key), "_r.component", F.lit(n).cast("long").alias("n"), "deviation", "_r.whitened", "_r.explained", F.lit(error).cast("double").alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
