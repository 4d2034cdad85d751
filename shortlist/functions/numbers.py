"""Numbers as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def three_decimals(value: Column) -> Column:
    """Three decimals, rounded from the exact binary value (Java rounds its decimal text). For results of a few rows."""
    def told(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if pd.isna(x) else f"{x:.3f}")

    return F.pandas_udf("string")(told)(value)
