"""Vectors as binary rows: reading them once, and back to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

from syndica.llm.common import pick


def usable(vector: list | None) -> bool:
    """Neither null nor holding a null or a component that is not finite."""
    return vector is not None and None not in vector and bool(np.isfinite(np.asarray(vector, np.float64)).all())


def packed_rows(vectors: DataFrame, vec_id: str, embedding: str, transform=None) -> tuple[DataFrame, np.dtype]:
    """``(vec_id, key binary)``: the components as they are, or as ``transform`` (of a float64
    array) makes them; NULL for vectors that are not usable or that it makes None."""
    rows = pick(vectors, vec_id=vec_id, embedding=embedding)
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    dtype = np.dtype("<f4" if single and transform is None else "<f8")

    def pack(vector):
        if not usable(vector):
            return None
        if transform is None:
            return (np.asarray(vector, dtype) + dtype.type(0)).tobytes()  # one zero
        made = transform(np.asarray(vector, np.float64))
        return None if made is None else np.asarray(made, dtype).tobytes()

    def run(batches):
        for batch in batches:
            keys = [pack(v) for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())],
                                             names=["vec_id", "key"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {id_type}, key binary"), dtype


def directions(keys, dtype: np.dtype) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, as squares of very small or
    large ones are no doubles."""
    x = matrix(keys, dtype)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(keys, dtype: np.dtype) -> np.ndarray:
    """Rows of equal length as one float64 matrix."""
    keys = list(keys)
    return np.frombuffer(b"".join(keys), dtype).reshape(len(keys), -1).astype(np.float64)
