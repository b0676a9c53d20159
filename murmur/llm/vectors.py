"""Embedding rows packed as binary, for the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, column: str = "embedding") -> int:
    """Length of the longest vector; shorter ones count as padded with zeros."""
    return rows.agg(F.max(F.size(column))).first()[0] or 0


def pack(rows: DataFrame, dim: int, kind: str = "<f4") -> DataFrame:
    """(vec_id, vec): vec is binary of dim numbers; null if the vector is null or holds null or non-finite numbers."""
    width = dict(rows.dtypes)["embedding"]
    src = "<f4" if width == "array<float>" else "<f8"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["embedding"]:
                x = None
                if v is not None:
                    a = np.zeros(dim, dtype=src)
                    v = np.asarray([np.nan if y is None else y for y in v], dtype=src)
                    a[: len(v)] = v
                    if np.isfinite(a).all():
                        if kind == "int":
                            n = np.floor(a.astype("<f8") * 64)
                            if np.abs(n).max() >= 2.0**63:
                                raise OverflowError("a number of this vector does not fit 64 bits")
                            x = n.astype("<i8").tobytes()
                        else:
                            x = (a + 0.0).tobytes()  # -0.0 becomes 0.0
                out.append(x)
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "vec": pd.Series(out, dtype=object)})

    return rows.select("vec_id", "embedding").mapInPandas(run, "vec_id long, vec binary")


def unpack(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def float_kind(rows: DataFrame) -> str:
    return "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
