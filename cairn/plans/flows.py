"""The three flows end to end: prepare a raw table, cluster a sample and reach a consensus, deploy and monitor.

Each flow writes its tables below a folder and returns them by name; a later flow reads what an
earlier one wrote, so every one can be run by itself:

    python -m cairn prepare --input raw.csv --output out
    python -m cairn segment --output out
    python -m cairn deploy --output out
    python -m cairn assign --input new.csv --output out
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions.features import build_features, default_features
from cairn.operators import cleaning, dbscan, drift, ensemble, hierarchy, interpret, kmeans, metrics, mixture, profiling, scaling, selection, serving, tendency
from cairn.operators.cleaning import hash_sample
from cairn.sources import tables as io


@dataclass(frozen=True)
class Config:
    """What a run can set; the defaults follow the published configuration of the method."""

    train_fraction: float = 0.8
    variance: float = 0.95
    seed: int = 42
    sample: int = 6_000
    consensus_sample: int = 2_500
    hierarchy_sample: int = 2_000
    hopkins_rows: int = 500
    hopkins_repeats: int = 5
    ks: Sequence[int] = tuple(range(2, 9))
    kmeans_seeds: int = 3
    steps: int = 100
    dimensions: Sequence[int] = (5, 10, 15, 20)
    dbscan_samples: Sequence[int] = (10, 20, 30)
    dbscan_quantiles: Sequence[float] = (0.85, 0.90, 0.95, 0.97, 0.99)
    psi_bins: int = 10


def _save(tables: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    for name, df in tables.items():
        io.write(df, f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def prepare(spark: SparkSession, raw: DataFrame, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """Validate, clean, key, build features, split by time, scale and project. The label is kept apart."""
    numeric = [c for c in raw.columns if c not in ("Class", "_pos")]
    checks = cleaning.validate_raw(raw.drop("_pos"), io.RAW_COLUMNS, numeric)
    own = raw if "_pos" in raw.columns else raw.withColumn("_pos", F.monotonically_increasing_id())
    clean = cleaning.dense_key(cleaning.clean(own, numeric, "_pos"), ["Time", "_pos"]).drop("_pos")
    first = _save({"validation": checks, "decisions": cleaning.decision_log(own, numeric, "_pos"), "clean": clean}, out)
    clean = first["clean"]
    names = default_features(clean)
    features = build_features(clean, names)
    split = cleaning.temporal_split(clean, fraction=config.train_fraction).select("row_id", "split")
    second = _save({"features": features, "metadata": clean.select("row_id", "Time", "Amount", "Class"), "split": split, "profile": profiling.column_profile(clean, numeric), "summary": profiling.eda_summary(clean, numeric)}, out)
    train = second["features"].join(second["split"].where("split = 'train'").select("row_id"), "row_id", "left_semi")
    standard, robust = scaling.fit_columns(train, names), scaling.fit_columns(train, names, robust=True)
    boxed = lambda df: df.select(F.col("row_id").alias("id"), F.array(*names).alias("v"))
    scaled = boxed(scaling.apply_columns(second["features"], standard))
    mean, loadings, share, kept = scaling.fit_pca(boxed(scaling.apply_columns(train, standard)), variance=config.variance)
    components = spark.createDataFrame([(-1, [float(x) for x in mean], None), *((i, [float(x) for x in loadings[i]], float(share[i])) for i in range(kept))], "component int, loading array<double>, share double")
    third = _save({"standard": standard, "robust": robust, "components": components, "x_standard": io.as_floats(scaled, "v"), "x_robust": io.as_floats(boxed(scaling.apply_columns(second["features"], robust)), "v"), "x_pca": io.as_floats(scaling.apply_pca(scaled, mean, loadings, kept), "v")}, out)
    sample = hash_sample(third["x_standard"].withColumn("v", F.col("v").cast("array<double>")), config.sample, config.seed, "id")
    fourth = _save({"hopkins": tendency.repeated_hopkins(sample, config.hopkins_rows, config.hopkins_repeats, config.seed)}, out)
    return first | second | third | fourth


def segment(spark: SparkSession, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The portfolio on a sample, its ranking, the consensus of the base clusterings, and what it means."""
    x = spark.read.parquet(f"{out}/x_pca").withColumn("v", F.col("v").cast("array<double>"))
    rows = _save({"sample": hash_sample(x, config.sample, config.seed, "id")}, out)["sample"]
    _, best = kmeans.search(rows, config.ks, range(config.kmeans_seeds), config.steps)
    small = hash_sample(rows, config.hierarchy_sample, config.seed, "id")
    trees = _save({"trees": hierarchy.trees(small, ks=config.ks)}, out)["trees"]
    gmm_table, models = mixture.search(rows, config.ks, steps=config.steps)
    partitions = kmeans.assign(rows, best).withColumn("run_id", F.concat(F.lit("kmeans/"), "run_id"))
    partitions = partitions.unionByName(hierarchy.cuts_of(trees).withColumn("run_id", F.concat(F.lit("hierarchical/"), "run_id")))
    partitions = partitions.unionByName(mixture.assign(rows, models).withColumn("run_id", F.concat(F.lit("gmm/"), "run_id")))
    partitions = partitions.unionByName(dbscan.search(rows, config.dbscan_samples, config.dbscan_quantiles).withColumn("run_id", F.concat(F.lit("dbscan/"), "run_id")))
    made = _save({"partitions": partitions, "gmm": gmm_table, "kmeans": kmeans.search_table(spark, best)}, out)
    inner = metrics.cluster_counts(made["partitions"]).join(metrics.internal(made["partitions"].join(rows, "id")), "run_id", "left")
    # the label joins here for the first time, for evaluation only
    label = spark.read.parquet(f"{out}/metadata").select(F.col("row_id").alias("id"), F.col("Class").cast("long").alias("label"))
    outer = metrics.external(made["partitions"].join(label, "id"))
    board = selection.rank_sum(inner.join(outer, "run_id"), ties=[F.desc("silhouette"), F.col("run_id")])
    picked = hash_sample(rows, config.consensus_sample, config.seed, "id")
    width = len(picked.limit(1).collect()[0]["v"])
    bases = _save({"bases": ensemble.base_clusterings(picked, ensemble.base_grid(config.dimensions, config.ks, width=width), config.seed)}, out)["bases"]
    cuts = _save({"consensus_cuts": ensemble.consensus(bases, config.ks), "scoreboard": board}, out)
    scored = selection.rank_sum(metrics.internal(cuts["consensus_cuts"].join(picked, "id")), ties=[F.desc("silhouette"), F.col("run_id").cast("long")])
    k = scored.orderBy("final_order").limit(1).select("run_id")
    chosen = cuts["consensus_cuts"].join(F.broadcast(k), "run_id", "left_semi").select("id", "cluster")
    last = _save({"consensus_search": scored, "consensus": chosen, "base_evaluation": ensemble.evaluate_bases(bases, picked.join(label, "id"))}, out)
    chosen_row = metrics.evaluate(last["consensus"].withColumn("run_id", F.lit("c")).join(picked, "id").join(label, "id")).withColumn("requested_k", F.col("n_clusters"))
    last |= _save({"consensus_vs_best_base": ensemble.against_best_base(last["base_evaluation"], chosen_row)}, out)
    member = last["consensus"].join(picked, "id").join(label, "id")
    points = interpret.centroid_margin(member.select("id", "v", "cluster"), metrics.centroids(member.withColumn("run_id", F.lit("c"))).select("cluster", "c"))
    long = member.select("cluster", F.posexplode("v").alias("dim", "value")).select("cluster", F.concat(F.lit("pc"), (F.col("dim") + 1).cast("string")).alias("feature"), "value")
    profile = interpret.profiles(long)
    told = _save({"profiles": profile, "labels": interpret.domain_labels(profile), "composition": interpret.composition(member.select("cluster", "label")), "anomalies": interpret.anomalies(points.select("cluster", "id", F.col("own").alias("distance")))}, out)
    return made | cuts | last | told


def deploy(spark: SparkSession, out: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The registry of the consensus, the drift report of the test split, and a manifest of what was written."""
    x = spark.read.parquet(f"{out}/x_pca").withColumn("v", F.col("v").cast("array<double>"))
    features = spark.read.parquet(f"{out}/features")
    names = [c for c in features.columns if c != "row_id"]
    cents = serving.fit_registry(x, spark.read.parquet(f"{out}/consensus"))
    parts = {r["component"]: r["loading"] for r in spark.read.parquet(f"{out}/components").collect()}  # the components
    serving.save_registry(f"{out}/registry", cents, spark.read.parquet(f"{out}/standard"), names, [parts[i] for i in sorted(parts) if i >= 0], parts[-1])
    long = profiling.unpivot(features.join(spark.read.parquet(f"{out}/split"), "row_id"), names, ids=("split",))
    side = lambda s: long.where(F.col("split") == s).drop("split")
    report = _save({"drift": drift.drift_report(side("train"), side("test"), config.psi_bins)}, out)["drift"]
    done = _save({"drift_summary": drift.drift_summary(report), "manifest": io.file_manifest(spark, f"{out}/registry", f"{out}/consensus"), "environment": io.environment(spark)}, out)
    return {"drift": report} | done


def assign(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    """New rows with their cluster; rows that break the contract are refused all at once."""
    numeric = [c for c in io.RAW_COLUMNS if c != "Class"]
    keyed = rows.withColumn("row_id", F.monotonically_increasing_id()) if "row_id" not in rows.columns else rows
    broken = cleaning.violations(keyed, cleaning.contract(numeric)).groupBy("rule", "column").count().collect()  # a row for each rule
    if broken:
        raise ValueError("; ".join(f"{r['column']}: {r['rule']} broken by {r['count']} rows" for r in broken))
    return serving.Registry.load(spark, f"{out}/registry").assign(cleaning.coerce(keyed, numeric))
