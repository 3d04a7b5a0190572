"""Embeddings as exact integer vectors, and sums of them over groups, for the operators on vectors."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of a component. Squared distances of 64 such components still fit a long.
LARGEST = 1 << 27
SCALE = 256


def as_doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")


def floors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without nulls and non-finite components, the lengths of all rows, and floor(256 * x) of all components of those rows.

    Raises ValueError where a component is beyond ``LARGEST``: no distance to it would fit a long.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    of_row = np.repeat(np.arange(len(lengths)), lengths)
    whole = there.copy()
    whole[of_row[~np.isfinite(flat)]] = False
    values = np.floor(flat[whole[of_row]] * SCALE)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE:g}: its squared distances don't fit a long")
    return np.flatnonzero(whole), lengths, values.astype(np.int64)


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``dim`` whole components, their integers as a matrix, all whole rows)."""
    rows, lengths, values = floors(lists)
    fits = lengths[rows] == dim
    if not fits.all():
        values = values[np.repeat(fits, lengths[rows])]
    return rows[fits], values.reshape(-1, dim), rows


def whole_vectors(name: str) -> Column:
    """True for vectors without null or non-finite components (the rule of ``floors`` as an expression)."""
    odd = F.exists(as_doubles(name), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(name).isNotNull() & ~odd


def integers(name: str) -> Column:
    return F.transform(as_doubles(name), lambda x: F.floor(x * SCALE))


def sums_by_group(partials: DataFrame, keys: Iterable[str]) -> list:
    """Adds up (keys, n, sums array) of the tasks: rows of keys, place, n, total; as many as groups times places."""
    one = partials.select(*keys, "n", F.posexplode("sums").alias("place", "partial"))
    return one.groupBy(*keys, "place").agg(F.sum("n").alias("n"), F.sum(F.col("partial").cast("decimal(38,0)")).alias("total")).collect()
