"""Means and products of many columns as small mergeable tables: one pass over the rows, numpy inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schema import finite
from .series import By


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _groups(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[list, pd.DataFrame]]:
    """(key values, rows) of each group of a batch; the batch itself without keys."""
    if not keys:
        yield [], pdf
        return
    for key, part in pdf.groupby(keys, sort=False, dropna=False):
        yield list(key), part


def centred(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sums of products of deviations) of the rows without missing values."""
    x = x[~np.isnan(x).any(axis=1)]
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    d = x - mean
    return len(x), mean, d.T @ d


def merge(n: np.ndarray, mean: np.ndarray, products: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """One (n, means, products) from several; deviations are taken from the common mean, so nothing cancels."""
    total = int(n.sum())
    if not total:
        return 0, np.zeros(mean.shape[1]), np.zeros(products.shape[1:])
    centre = n @ mean / total
    d = mean - centre
    return total, centre, products.sum(axis=0) + (d * n[:, None]).T @ d


def cell_moments(df: DataFrame, columns: Sequence[str], cell: str, *, by: By = ("symbol",)) -> DataFrame:
    """(by, cell, rows, n, mean, products) per group and Arrow batch: ``rows`` in all, ``n`` of them with all columns.

    Parts of a cell that lie in several batches are merged by whoever reads the table. Infinite values are missing.
    """
    keys, k = [*by, cell], len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in _groups(pdf, keys):
                n, mean, products = centred(part[list(columns)].to_numpy(dtype=float))
                out.append([*key, len(part), n, mean.tolist(), products[np.triu_indices(k)].tolist()])
            yield pd.DataFrame(out, columns=[*keys, "rows", "n", "mean", "products"])

    d = df.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return d.mapInPandas(run, f"{_types(d, keys)}, rows long, n long, mean array<double>, products array<double>")


def unfold(parts: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, product matrices) of a table of moments."""
    means = np.array(parts["mean"].tolist(), dtype=float).reshape(-1, k)
    products = np.zeros((len(parts), k, k))
    i, j = np.triu_indices(k)
    products[:, i, j] = np.array(parts["products"].tolist(), dtype=float).reshape(len(parts), -1)
    products[:, j, i] = products[:, i, j]
    return parts["n"].to_numpy(dtype=float), means, products


def pair_moments(df: DataFrame, columns: Sequence[str], *, by: By = ()) -> DataFrame:
    """(by, i, j, n, r) for all column pairs i < j: rows that have both, and their Pearson correlation.

    Sums over pairwise complete rows are five matrix products a batch; without keys a task gives one row a pair. Columns are shifted by
    their means first, which leaves the correlation as it is and keeps the sums small. A constant column has no correlation.
    """
    d = df.select(*by, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    first = d.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift = np.array([first[c] or 0.0 for c in columns])
    i, j = np.triu_indices(len(columns), 1)
    sums = ("n", "x", "y", "xx", "yy", "xy")

    def sums_of(part: pd.DataFrame) -> np.ndarray:
        x = part[list(columns)].to_numpy(dtype=float) - shift
        known = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x, nan=0.0)
        n, s, q = known.T @ known, x.T @ known, (x * x).T @ known
        return np.stack([n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], (x.T @ x)[i, j]])

    def rows(key: list, total: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"i": i, "j": j, **dict(zip(sums, total))})
        for at, (name, value) in enumerate(zip(by, key)):
            out.insert(at, name, value)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for key, part in _groups(pdf, list(by)):
                one = sums_of(part)
                if by:
                    yield rows(key, one)
                else:
                    total = one if total is None else total + one
        if total is not None:
            yield rows([], total)

    kinds = _types(d, by) + (", " if by else "") + "i int, j int, " + ", ".join(f"{s} double" for s in sums)
    found = d.mapInPandas(run, kinds).groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    vx = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), F.col("n"))
    vy = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n"))
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    # deviations that are rounding errors of the sums count as none
    real = (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    r = F.when(real, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))))
    return found.select(*by, "i", "j", F.col("n").cast("long").alias("n"), r.alias("r"))
