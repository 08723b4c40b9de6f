"""Vector functions in double precision, on array columns and on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are scored in one go, so that their partial sums stay in a processor's cache.
CHUNK = 1024


def dot(vec: Column, query: list[float]) -> Column:
    """Dot product with a literal vector; cosine for unit vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """Unit length; a vector shorter than 1e-12 is divided by that."""
    # The outer lambda binds the length, which would else be summed anew for each component.
    length = F.array(F.greatest(norm(vec), F.lit(1e-12)))
    return F.element_at(F.transform(length, lambda n: F.transform(vec, lambda x: x.cast("double") / n)), 1)


def rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors of ``dim`` numbers without nulls, their numbers as a matrix)."""
    sized = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    part = column if len(sized) == len(column) else column.take(pa.array(sized))
    flat = part.flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    if flat.null_count:
        good = ~np.isnan(x).any(axis=1)
        return sized[good], x[good]
    return sized, x


def dots(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Dot products of all rows with all queries, added up component by component.

    The order of the sums is that of :func:`dot`, so results are the same bit by bit wherever a row stands: equal vectors
    get equal scores, which a matrix product doesn't promise.
    """
    out = np.zeros((len(x), len(queries)))
    q = np.ascontiguousarray(queries.T, float)
    for i in range(0, len(x), CHUNK):
        columns = np.ascontiguousarray(x[i : i + CHUNK].T, float)
        sums, part = out[i : i + CHUNK], np.empty((columns.shape[1], len(queries)))
        for k in range(len(q)):
            np.multiply(columns[k][:, None], q[k][None, :], out=part)
            sums += part
    return out
