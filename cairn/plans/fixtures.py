"""The driver's tables in the roles of the analytics (frames), and the same as SQL views (text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators.cleaning import hash_order
from cairn.operators.pairs import nearest_centroid, vectors_of
from cairn.runtime import materialize, ship


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, Time, Amount, Class, kind): events as transactions; time in seconds since 2024."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), t.alias("Time"), F.col("value").alias("Amount"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("Class"), F.col("event_type").alias("kind"))


EVENTS = "ev AS (SELECT event_id AS row_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS Time, value AS Amount, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Class, event_type AS kind FROM events)"


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Text columns with nulls, junk, NaN, negatives, odd labels, and every 50th row twice."""
    e = events(spark, d).withColumn("pos", F.col("row_id"))
    twice = e.unionByName(e.where("row_id % 50 = 0").withColumn("pos", F.col("row_id") + 10_000_000))
    m = lambda n, r=0: F.col("row_id") % n == r
    return twice.select(
        "pos",
        F.when(m(97), F.lit(None)).when(m(89), "junk").when(m(83), "NaN").when(m(79), F.concat(F.lit("-"), (F.col("row_id") + 1).cast("string"))).otherwise(F.col("row_id").cast("string")).alias("Time"),
        F.when(m(71), F.lit(None)).when(m(67), "-5").otherwise((F.col("row_id") % 100).cast("string")).alias("Amount"),
        F.when(m(61), "2").otherwise(F.col("Class").cast("string")).alias("Class"),
    )


DIRTY = (
    EVENTS
    + """, dirty AS (SELECT pos,
  CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 89 = 0 THEN 'junk' WHEN row_id % 83 = 0 THEN 'NaN' WHEN row_id % 79 = 0 THEN '-' || CAST(row_id + 1 AS VARCHAR) ELSE CAST(row_id AS VARCHAR) END AS Time,
  CASE WHEN row_id % 71 = 0 THEN NULL WHEN row_id % 67 = 0 THEN '-5' ELSE CAST(row_id % 100 AS VARCHAR) END AS Amount,
  CASE WHEN row_id % 61 = 0 THEN '2' ELSE CAST(Class AS VARCHAR) END AS Class
  FROM (SELECT *, row_id AS pos FROM ev UNION ALL SELECT *, row_id + 10000000 FROM ev WHERE row_id % 50 = 0)),
num AS (SELECT pos, """
    + ", ".join(f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in ("Time", "Amount", "Class"))
    + " FROM dirty)"
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v, label) of the embeddings."""
    return vectors_of(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label").cast("long").alias("label"))


VECTORS = "vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS BIGINT) AS label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"

#: Deterministic partitions of the embeddings: (run, k, seed).
RUNS = (("a", 3, 1), ("b", 3, 2), ("c", 4, 1), ("d", 5, 3))


def seeds(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(cluster, c): the k rows with the smallest md5 of (seed, id)."""
    got = rows.orderBy(hash_order(F.col("id"), seed), "id").limit(k).select("v").collect()
    return rows.sparkSession.createDataFrame([(i, list(r["v"])) for i, r in enumerate(got)], "cluster long, c array<double>")


def partitions(spark: SparkSession, d: str, runs=RUNS) -> DataFrame:
    """(id, v, label, run_id, cluster): every row in the cluster of its nearest seed, for several runs."""
    rows = vectors(spark, d)
    out = None
    for name, k, seed in runs:
        own = nearest_centroid(rows, seeds(rows, k, seed)).select("id", F.lit(name).alias("run_id"), "cluster", "distance")
        out = own if out is None else out.unionByName(own)
    return rows.join(materialize(out, "partitions"), "id")


def _runs_sql(runs=RUNS) -> str:
    def one(name: str, k: int, seed: int) -> str:
        return (
            f"seed_{name} AS (SELECT row_number() OVER (ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1 AS cluster, v AS c FROM vec QUALIFY cluster < {k}), "
            f"run_{name} AS (SELECT id, '{name}' AS run_id, arg_min(cluster, (dist, cluster)) AS cluster, min(dist) AS distance FROM (SELECT v.id, s.cluster, list_distance(v.v, s.c) AS dist FROM vec v, seed_{name} s) GROUP BY id)"
        )

    union = " UNION ALL ".join(f"SELECT * FROM run_{n}" for n, _, _ in runs)
    return VECTORS + ", " + ", ".join(one(*r) for r in runs) + f", part AS (SELECT vec.id, v, label, run_id, CAST(cluster AS BIGINT) AS cluster, distance FROM vec JOIN ({union}) USING (id))"


PARTITIONS = _runs_sql()


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The wide numeric table."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def split_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Long (feature, value) tables of the earlier four fifths and the later fifth of the events."""
    from cairn.functions.features import build_features
    from cairn.operators.cleaning import temporal_split
    from cairn.operators.profiling import unpivot

    own = temporal_split(events(spark, d))
    names = ["Amount_log1p", "Time_sin", "Time_cos", "Amount"]
    long = materialize(unpivot(build_features(own, names, keep=("row_id", "split")), names, ids=("split",)), "features")
    return long.where("split = 'train'").drop("split"), long.where("split = 'test'").drop("split")


SPLIT = (
    EVENTS
    + """, sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY Time, row_id) - 1 < CAST(floor((SELECT count(*) FROM ev) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ev),
lf AS (SELECT split, 'Amount_log1p' AS feature, ln(1 + Amount) AS value FROM sp
  UNION ALL SELECT split, 'Time_sin', sin(2 * pi() * (Time % 86400) / 86400) FROM sp
  UNION ALL SELECT split, 'Time_cos', cos(2 * pi() * (Time % 86400) / 86400) FROM sp
  UNION ALL SELECT split, 'Amount', Amount FROM sp)"""
)
