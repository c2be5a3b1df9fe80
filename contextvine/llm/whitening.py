"""Whitening of embeddings: covariance from column aggregates, decomposed once, applied as expressions.

Vectors are read as whole numbers ``x = floor(256 * c)``.  Means and every entry
of the covariance's upper triangle are ordinary sums in one aggregation each, so
partial sums leave the tasks and the driver meets one row of ``d (d + 1) / 2``
numbers.  LAPACK decomposes that matrix; the components return as literals in the
expression that projects each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SCALE = 256
#: One aggregation holds an expression per pair of dimensions: 8256 at this width.
MOST_DIMS = 128
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; unit ``components`` (rows) by falling ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    trace: float
    largest: int


def usable(embedding: Column) -> Column:
    """No null vector, and no null or non-finite entry."""
    return embedding.isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def whole_numbers(embedding: Column) -> Column:
    return F.transform(embedding, lambda v: F.floor(v.cast("double") * SCALE))


def centred(k: int, n: int, sums: tuple[int, ...]) -> str:
    """``x[k] - S[k] / n``: the whole part of the mean is taken off in whole numbers, so a far-off mean costs no digits."""
    whole, rest = divmod(sums[k], n)
    return f"(cast(get(x, {k}) - {whole}L as double) - {rest / n!r}D)"


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as rows, the largest entry of each positive.

    Directions without spread, whose eigenvalue is 0 but for rounding, are left out.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    spread = values > len(values) * np.finfo(float).eps * max(values[0], 0.0) if len(values) else np.zeros(0, dtype=bool)
    values, vectors = values[spread], vectors[spread]
    top = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)] if len(vectors) else np.ones(0)
    return values, vectors * np.sign(top)[:, None]


def fit(distinct: DataFrame, dims: int) -> Whitening | None:
    """The model of a table of distinct vectors ``x`` of ``dims`` whole numbers; None without rows or spread."""
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions: one aggregation sums at most {MOST_DIMS} * {MOST_DIMS + 1} / 2 pairs")
    size = f"array_max(array({', '.join(f'max(abs(get(x, {k})))' for k in range(dims))})) AS size" if dims else "0 AS size"
    total = distinct.selectExpr("count(*) AS n", size, *(f"sum(cast(get(x, {k}) AS decimal(20,0))) AS s{k}" for k in range(dims))).head(1)[0]
    n = total["n"]
    if not n or not dims:
        return None
    sums = tuple(int(total[f"s{k}"]) for k in range(dims))
    # thousands of expressions are stated as SQL: building as many columns takes longer than summing them
    ys = distinct.selectExpr(*(f"{centred(k, n, sums)} AS y{k}" for k in range(dims)))
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    row = ys.selectExpr(*(f"sum(y{i} * y{j}) AS v{i}_{j}" for i, j in pairs)).head(1)[0]
    covariance = np.zeros((dims, dims))
    for (i, j), value in zip(pairs, row):
        covariance[i, j] = covariance[j, i] = value / n
    values, vectors = decompose(covariance)
    if not len(values):
        return None
    return Whitening(n, sums, tuple(values.tolist()), tuple(map(tuple, vectors.tolist())), float(np.trace(covariance)), int(total["size"]))


def _sum(terms: list[str]) -> str:
    """A balanced sum: a plain one would nest as deep as there are dimensions."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[k : k + 2])})" for k in range(0, len(terms), 2)]
    return terms[0]


def projections(model: Whitening, k: int) -> list[str]:
    """The first ``k`` whitened coordinates of a vector ``x``."""
    weights = [[float(w / np.sqrt(e)) for w in c] for c, e in zip(model.components[:k], model.eigenvalues)]
    return [_sum([f"{centred(i, model.n, model.sums)} * {w!r}D" for i, w in enumerate(row)]) for row in weights]


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    ws = distinct.selectExpr(*(f"{p} AS w{i}" for i, p in enumerate(projections(model, k))))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = ws.selectExpr(*(f"covar_pop(w{i}, w{j}) AS v{i}_{j}" for i, j in pairs)).head(1)[0]
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, row))


def deviation(model: Whitening) -> str:
    """The sum over dimensions of ``(n * x - S)^2``, exact; in 64 bits where these surely hold it."""
    small = len(model.sums) * (2 * model.n * max(model.largest, 1)) ** 2 < 1 << 63
    kind = "bigint" if small else "decimal(38,0)"
    number = lambda v: f"cast('{v}' AS {kind})"
    off = [f"cast(cast(get(x, {k}) AS {kind}) * {number(model.n)} - {number(s)} AS {kind})" for k, s in enumerate(model.sums)]
    return f"cast({_sum([f'cast({o} * {o} AS {kind})' for o in off])} AS decimal(38,0))"


def whiten(embeddings: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: the whitened coordinate, the component's share of the variance, and the model's figures.

    Rows whose vector is null or holds a null or non-finite entry are left out, as
    are vectors of another length than the most frequent one (of equally frequent
    ones the longest).  An entry beyond 64 bits counts as the largest whole number;
    a deviation beyond 38 digits is an error.  Each distinct vector counts once in
    the model, repeated rows and rows without an id each have their rows in the
    result.  Components without spread have none: a single distinct vector, empty
    vectors or an empty table give no rows.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(usable(F.col("e")))
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    dims = lengths[0]["d"] if lengths else 0
    rows = rows.where(F.size("e") == dims).select("vec_id", whole_numbers(F.col("e")).alias("x"))
    distinct = materialise(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, dims)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    k = min(components, len(model.components))
    error = identity_error(distinct, model, k)
    each = [f"named_struct('component', {i + 1}, 'whitened', {p}, 'explained', {model.eigenvalues[i] / model.trace!r}D)" for i, p in enumerate(projections(model, k))]
    out = rows.selectExpr("vec_id", f"{deviation(model)} AS deviation", f"explode(array({', '.join(each)})) AS c")
    return out.select("vec_id", "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
