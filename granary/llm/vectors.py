"""What the operators on embeddings share: vectors as packed binary, and which of them count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(name: str = "embedding") -> Column:
    """The vector isn't null or empty and holds only finite components."""
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def width(df: DataFrame, name: str = "embedding") -> np.dtype:
    """Floats of a vector column as they are stored: of four bytes if the table has such, else of eight."""
    return np.dtype("<f4") if isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.FloatType) else np.dtype("<f8")


def flat(lists: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All components of an Arrow list column, and where each vector begins and the last ends; null is an empty vector."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.r_[0, np.cumsum(sizes)].astype(np.int64)

