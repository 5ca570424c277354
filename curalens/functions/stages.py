"""Keeping costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Compute the named columns here, once per row.

    A filter on a computed column is normally pushed below it, with the whole
    expression copied into the condition. A one-row generator stops that. It
    needs no shuffle.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
