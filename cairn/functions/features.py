"""Feature expressions over a transaction table (time in seconds, amount, V columns)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

DAY_SECONDS = 86_400.0


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def _phase(time: Column) -> Column:
    return F.lit(2.0) * F.pi() * F.pmod(time, F.lit(DAY_SECONDS)) / F.lit(DAY_SECONDS)


def time_sin(time: Column) -> Column:
    return F.sin(_phase(time))


def time_cos(time: Column) -> Column:
    return F.cos(_phase(time))


def elapsed_day(time: Column) -> Column:
    return time / F.lit(DAY_SECONDS)


#: Derived features by name; anything else is a raw column.
DERIVED: dict[str, Callable[[Column, Column], Column]] = {
    "Amount_log1p": lambda time, amount: log_amount(amount),
    "Time_sin": lambda time, amount: time_sin(time),
    "Time_cos": lambda time, amount: time_cos(time),
    "Elapsed_day": lambda time, amount: elapsed_day(time),
}


def build_features(rows: DataFrame, names: Sequence[str], time: str = "Time", amount: str = "Amount", keep: Sequence[str] = ("row_id",), label: str = "Class") -> DataFrame:
    """The named features in the order asked for, one projection. A feature that is neither derived
    nor a column raises KeyError; the external label can never be a feature."""
    if label in names:
        raise ValueError(f"the label {label} must not be a feature")
    columns = []
    for name in names:
        if name in DERIVED:
            columns.append(DERIVED[name](F.col(time), F.col(amount)).cast("double").alias(name))
        elif name in rows.columns:
            columns.append(F.col(name).cast("double").alias(name))
        else:
            raise KeyError(name)
    return rows.select(*keep, *columns)


def default_features(rows: DataFrame, amount_log: bool = True, cyclic: bool = True, elapsed: bool = False) -> list[str]:
    """V columns in number order, then the derived features that are switched on."""
    vs = sorted((c for c in rows.columns if c[:1] == "V" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return vs + ["Amount_log1p"] * amount_log + ["Time_sin", "Time_cos"] * cyclic + ["Elapsed_day"] * elapsed


def number(c: Column) -> Column:
    """A double; text that is none, and NaN, become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)
