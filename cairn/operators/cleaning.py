"""Validation, cleaning, keys and splits of a transaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cairn.functions.features import number
from cairn.runtime import materialize

#: (rule, column, condition that a row breaks), from :func:`contract`.
Rule = tuple[str, str, Column]


def coerce(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns as doubles; junk and NaN become null."""
    return rows.withColumns({c: number(F.col(c)) for c in columns})


def validate_raw(rows: DataFrame, expected: Sequence[str], numeric: Sequence[str], amount: str = "Amount", time: str = "Time", label: str = "Class") -> DataFrame:
    """One row a check: (check, column, violations, severity), all counted in one pass."""
    missing = [c for c in expected if c not in rows.columns]
    extra = [c for c in rows.columns if c not in expected]
    there = lambda c: c in rows.columns
    checks: list[tuple[str, str, Column]] = [("junk", c, F.count_if(F.col(c).isNotNull() & number(F.col(c)).isNull())) for c in numeric if there(c)]
    checks += [("null", c, F.count_if(F.col(c).isNull())) for c in numeric if there(c)]
    checks += [("negative", c, F.count_if(number(F.col(c)) < 0)) for c in (amount, time) if there(c)]
    if there(label):
        checks.append(("domain", label, F.count_if(~F.coalesce(number(F.col(label)).isin(0.0, 1.0), F.lit(False)))))
    checks.append(("empty", "*", F.when(F.count("*") == 0, 1).otherwise(0)))
    counted = rows.agg(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(c).alias("column"), v.cast("long").alias("violations"), F.lit("error").alias("severity")) for n, c, v in checks)).alias("a"))
    out = counted.select(F.inline("a"))
    fixed = [("missing", c, 1, "error") for c in missing] + [("unexpected", c, 1, "warning") for c in extra]
    if fixed:
        out = out.unionByName(rows.sparkSession.createDataFrame(fixed, "check string, column string, violations long, severity string"))
    return out


def contract(numeric: Sequence[str], label: str | None = None, amount: str = "Amount", time: str = "Time") -> list[Rule]:
    """Row rules of the serving schema: present numbers, no negative amount or time, label 0 or 1 if required."""
    rules: list[Rule] = [("not_null", c, number(F.col(c)).isNull()) for c in numeric]
    rules += [("non_negative", c, F.coalesce(number(F.col(c)) < 0, F.lit(False))) for c in (amount, time)]
    if label:
        rules.append(("binary", label, ~F.coalesce(number(F.col(label)).isin(0.0, 1.0), F.lit(False))))
    return rules


def violations(rows: DataFrame, rules: Sequence[Rule], key: str = "row_id") -> DataFrame:
    """(key, rule, column) of every broken rule of every row, all at once."""
    found = F.array(*(F.when(bad, F.struct(F.lit(n).alias("rule"), F.lit(c).alias("column"))) for n, c, bad in rules))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(key, "v.rule", "v.column")


def cross_check(tables: dict[str, DataFrame], key: str = "row_id") -> DataFrame:
    """(artifact, n_rows, n_missing, n_null): rows, keys of the first table that are missing, null keys."""
    first = next(iter(tables.values())).select(key).distinct()
    out = None
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_null"))
        gone = first.join(df.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_missing"))
        row = own.crossJoin(gone).select(F.lit(name).alias("artifact"), "n_rows", "n_missing", "n_null")  # two one-row tables
        out = row if out is None else out.unionByName(row)
    return out


NUMERIC = (T.NumericType, T.BooleanType)


def artifact_status(tables: dict[str, DataFrame | None], required: dict[str, Sequence[str]], numeric: Sequence[str] = ()) -> DataFrame:
    """(artifact, status, n_rows, n_null, n_nan, problems): whether each table can be used, from one aggregation each.

    ``status`` is missing (no table), incomplete (lacks required columns), not numeric (a table named in ``numeric`` has
    other columns), has gaps (null or NaN in a required column), unequal (other rows than the first usable table) or valid.
    """
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    out, rows = [], None
    for name, df in tables.items():
        if df is None:
            out.append((name, "missing", None, None, None, ""))
            continue
        lacking = [c for c in required.get(name, ()) if c not in df.columns]
        odd = [f.name for f in df.schema.fields if name in numeric and not isinstance(f.dataType, NUMERIC)]
        own = [f for f in df.schema.fields if f.name in required.get(name, ())]
        nan = [F.count_if(F.isnan(F.col(f"`{f.name}`"))) for f in own if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        n, null, nans = df.agg(F.count("*"), sum((F.count_if(F.col(f"`{f.name}`").isNull()) for f in own), F.lit(0)), sum(nan, F.lit(0))).first()
        rows = n if rows is None else rows
        status = "incomplete" if lacking else "not numeric" if odd else "has gaps" if null or nans else "unequal" if n != rows else "valid"
        out.append((name, status, n, null, nans, ", ".join(lacking or odd)))
    return spark.createDataFrame(out, "artifact string, status string, n_rows long, n_null long, n_nan long, problems string")


def drop_exact_duplicates(rows: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """The first row, by position, of each group of rows that agree in all columns."""
    rest = [c for c in rows.columns if c not in columns]
    least = F.min_by(F.struct(*rest), F.col(position)).alias("_rest")
    return rows.groupBy(*columns).agg(least).select(*columns, *(F.col(f"_rest.{c}").alias(c) for c in rest)).select(*rows.columns)


def duplicate_count(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg((F.count("*") - F.count_distinct(F.struct(*columns))).alias("n_duplicates"))


def clean(rows: DataFrame, numeric: Sequence[str], position: str, amount: str = "Amount", time: str = "Time", label: str = "Class") -> DataFrame:
    """Coerced rows without nulls, out-of-range values and exact duplicates (first position stays)."""
    own = coerce(rows, [*numeric, label]).na.drop(subset=[*numeric, label])
    own = own.where((F.col(amount) >= 0) & (F.col(time) >= 0) & F.col(label).isin(0.0, 1.0))
    return drop_exact_duplicates(own, [*numeric, label], position)


def decision_log(rows: DataFrame, numeric: Sequence[str], position: str, amount: str = "Amount", time: str = "Time", label: str = "Class") -> DataFrame:
    """Counts of what :func:`clean` does; each range count is taken after the null drop, before the joint filter."""
    own = coerce(rows, [*numeric, label])
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in [*numeric, label])) == 1
    bad_amount, bad_time, bad_label = F.col(amount) < 0, F.col(time) < 0, ~F.col(label).isin(0.0, 1.0)
    good = ~null & ~bad_amount & ~bad_time & ~bad_label
    return own.agg(
        F.count("*").alias("n_input"),
        F.count_if(null).alias("n_null"),
        F.count_if(~null & bad_amount).alias("n_negative_amount"),
        F.count_if(~null & bad_time).alias("n_negative_time"),
        F.count_if(~null & bad_label).alias("n_bad_label"),
        (F.count_if(good) - F.count_distinct(F.when(good, F.struct(*numeric, label)))).alias("n_duplicates"),
        F.count_distinct(F.when(good, F.struct(*numeric, label))).alias("n_output"),
    )


def dense_key(rows: DataFrame, order: Sequence[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """0..n-1 in the given order (its columns together should be unique), without a one-partition window.

    Rows are dealt to ranges and sorted there once, and written with their range and their place in
    it; places are then moved by the number of rows in the ranges before (a row for each range).
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tail = next(t for t in ("_" * k for k in range(1, 100)) if not {f"part{t}", f"place{t}", f"before{t}", f"n{t}"} & {*rows.columns, name})
    part, at, ahead, size = (f"{c}{tail}" for c in ("part", "place", "before", "n"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place within the task
    placed = materialize(placed.withColumns({part: F.spark_partition_id(), at: place}), "ordered")
    sizes = placed.groupBy(part).agg(F.count("*").alias(size))
    before = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(ahead))
    return placed.join(F.broadcast(before), part).withColumn(name, F.col(at) + F.col(ahead)).drop(part, at, ahead, size)


def temporal_split(rows: DataFrame, time: str = "Time", key: str = "row_id", fraction: float = 0.8) -> DataFrame:
    """Adds ``split``: train for the earliest floor(n * fraction) rows by (time, key), else test."""
    ranked = dense_key(rows, [time, key], "_position")
    n = ranked.count()
    return ranked.withColumn("split", F.when(F.col("_position") < int(n * fraction), "train").otherwise("test")).drop("_position")


def hash_order(key: Column, seed: int) -> Column:
    """A shuffle of the keys that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_sample(rows: DataFrame, size: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """min(size, n) rows without replacement, blind to everything but the key."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(size)


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons (its first 12 hex digits)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def bootstrap_draws(keys: DataFrame, runs: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """(run, key, weight): n draws with replacement for each run, as counts. Slots draw positions of the dense order."""
    n = keys.count()
    placed = dense_key(keys.select(key), [key], "_slot")
    drawn = placed.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.col("_slot").alias("slot"))
    drawn = drawn.withColumn("_slot", F.floor(hash_unit(F.lit(seed), F.col("run"), F.col("slot")) * n))
    counts = drawn.groupBy("run", "_slot").agg(F.count("*").alias("weight"))
    return counts.join(placed, "_slot").select("run", key, "weight")


def stratified_split(rows: DataFrame, label: str, fraction: float = 0.75, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Adds ``split``: in each label's hash order the first round-down share is train.

    Places come from one order by (label, hash), less the rows of the labels before, so a label that
    holds most rows is still dealt to many tasks.
    """
    placed = dense_key(rows.withColumn("_hash", hash_order(F.col(key), seed)), [label, "_hash", key], "_at")
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_label")) - F.col("_size"))  # a row for each label
    own = placed.join(before, F.col(label).eqNullSafe(F.col("_label")))
    train = F.col("_at") - F.col("_before") < F.floor(F.col("_size") * fraction)
    return own.withColumn("split", F.when(train, "train").otherwise("test")).select(*rows.columns, "split")
