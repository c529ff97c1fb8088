"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import least_hashed


def usable(embedding: str = "embedding") -> Column:
    """True for a vector that is not null or empty, holds no null, NaN or infinite component, and is not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def complete(most: float, embedding: str = "embedding") -> Column:
    """True for a vector that is not null or empty and whose entries are all numbers of a size below ``most``; it may be zero."""
    numbers = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(most)))
    return F.coalesce(numbers & (F.size(embedding) > 0), F.lit(False))


def numbers(vectors: DataFrame, embedding: str = "embedding") -> Column:
    """The vectors as they are stored: float stays float, which is half to shuffle; anything else is double."""
    return F.col(embedding).cast("array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>").alias(embedding)


def stack(column: pd.Series) -> np.ndarray:
    """A column of arrays as rows of doubles."""
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b in double precision; the same for the same two vectors wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def hashed_sample(df: DataFrame, n: int, *by: str) -> pd.DataFrame:
    """At most n rows, those of least hash, the same in every run; rows of equal hash are told apart by all columns."""
    return least_hashed(df, n, *by).toPandas()
