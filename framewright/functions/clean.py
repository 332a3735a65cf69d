"""Missing values: NaN and infinities become NULL, which aggregates leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column | str) -> Column:
    """c, or NULL where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def finite_table(df: DataFrame) -> DataFrame:
    """df with all floating columns cleaned; done once, at the scan."""
    floats = [c for c, kind in df.dtypes if kind in ("float", "double")]
    return df.withColumns({c: finite(c) for c in floats}) if floats else df


def zscore(c: Column | str, *by: str) -> Column:
    """Population z-score within by; 0 where all values are alike."""
    c = finite(c)
    w = W.partitionBy(*by)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd == 0, F.when(c.isNotNull(), F.lit(0.0))).otherwise((c - F.avg(c).over(w)) / sd)


def minmax(c: Column | str, *by: str) -> Column:
    """Scaled to 0..1 within by; 0 where all values are alike."""
    c = finite(c)
    w = W.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.when(c.isNotNull(), F.lit(0.0))).otherwise((c - low) / (high - low))


def impute(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), how: str = "mean") -> DataFrame:
    """Fill what is missing with the mean or the median of its column, within by."""
    agg = F.avg if how == "mean" else F.median
    if not by:
        values = df.agg(*(agg(finite(c)).alias(f"__{c}") for c in columns))
        return df.join(F.broadcast(values)).withColumns({c: F.coalesce(finite(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))
    values = df.groupBy(*by).agg(*(agg(finite(c)).alias(f"__{c}") for c in columns))
    return df.join(values, list(by)).withColumns({c: F.coalesce(finite(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))
