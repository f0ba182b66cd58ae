"""Vectors stored as base64 text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


@F.arrow_udf(ArrayType(FloatType()))
def _floats(blobs: pa.Array) -> pa.Array:
    """The floats of all blobs are one buffer; no value of its own is made of any."""
    length = pc.binary_length(blobs)
    whole = pc.fill_null(pc.equal(pc.bit_wise_and(length, 3), 0), False)
    ends = np.cumsum(pc.if_else(whole, length, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // 4
    kept = blobs.filter(whole).cast(pa.large_binary())
    values = np.zeros(0, "<f4")
    if len(kept):
        places = np.frombuffer(kept.buffers()[1], np.int64)[kept.offset:kept.offset + len(kept) + 1]
        values = np.frombuffer(kept.buffers()[2] or b"", np.uint8)[places[0]:places[-1]].view("<f4")
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values), mask=pc.invert(whole))


def decode_vector(df: DataFrame, col: str, out: str = "vector") -> DataFrame:
    """Vector from base64 of float32 values, plain or wrapped as ``{"$binary": ...}``.

    What is not base64 of whole floats gives NULL.
    """
    wrapped = F.when(F.col(col).startswith("{"), F.get_json_object(col, "$['$binary']"))
    text = F.coalesce(wrapped, F.col(col))
    return df.withColumn(out, _floats(F.try_to_binary(text, F.lit("base64"))))
