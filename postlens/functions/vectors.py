"""Similarity of embedding columns to a profile vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1] in double arithmetic; 0 for a zero vector, NULL for vectors of different length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = _dot(a, b) / F.nullif(norm, F.lit(0.0))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), bounded)


def with_cosine(df: DataFrame, vector: str, profile: Sequence[float], name: str = "similarity") -> DataFrame:
    """Replace ``vector`` by its cosine to one profile vector; NULL vectors and vectors of
    another length give NULL.

    Batches go to numpy over Arrow, where one matrix product per batch beats evaluating an
    expression per element several times over. The profile is a single vector, so it
    travels with the task.
    """
    unit = np.asarray(profile, dtype="float64")
    norm = np.linalg.norm(unit)
    keep = [c for c in df.columns if c != vector]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            present = np.asarray(pc.equal(pc.fill_null(pc.list_value_length(column), -1), len(unit)))
            rows = np.asarray(column.filter(pa.array(present)).flatten(), dtype="float64").reshape(-1, len(unit))
            lengths = np.linalg.norm(rows, axis=1) * norm
            cosines = np.divide(rows @ unit, lengths, out=np.zeros(len(rows)), where=lengths > 0)
            values = np.full(len(column), np.nan)
            values[present] = np.clip(cosines, -1.0, 1.0)
            result = pa.array(values, mask=~present)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], result], names=[*keep, name])

    return df.select(*keep, vector).mapInArrow(similarities, schema)
