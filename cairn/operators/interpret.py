"""What clusters mean: profiles, labels, composition, exemplars, anomalies, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.operators.profiling import quantile
from cairn.operators.quantiles import exact_quantiles
from cairn.runtime import materialize


def profiles(long: DataFrame) -> DataFrame:
    """(cluster, feature, n, mean, median, z) of (cluster, feature, value); z against the whole (sample deviation, 0 as 1)."""
    median = exact_quantiles(long, ["cluster", "feature"], "value", [0.5]).select("cluster", "feature", F.get("q", F.lit(0)).alias("median"))
    own = long.groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).join(median, ["cluster", "feature"], "left")
    whole = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return own.join(F.broadcast(whole), "feature").select("cluster", "feature", "n", "mean", "median", ((F.col("mean") - F.col("mu")) / sd).alias("z"))  # a row for each feature


def top_features(profile: DataFrame, n: int = 15) -> DataFrame:
    """(position, feature, strength): features by their largest |z| over the clusters."""
    own = profile.groupBy("feature").agg(F.max(F.abs("z")).alias("strength"))
    return own.withColumn("position", F.row_number().over(Window.orderBy(F.desc("strength"), "feature")).cast("long")).where(F.col("position") <= n).select("position", "feature", "strength")


def domain_labels(profile: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, label): "Cluster c: high x, low y", by the n largest |z|."""
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("z")), "feature"))
    word = F.concat(F.when(F.col("z") >= 0, "high ").otherwise("low "), F.col("feature"))
    top = profile.select("cluster", r.alias("r"), word.alias("word")).where(F.col("r") <= n)
    words = F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"])
    return top.groupBy("cluster").agg(F.array_join(words, ", ").alias("w")).select("cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), "w").alias("label"))


def composition(rows: DataFrame) -> DataFrame:
    """(cluster, size, positives, rate, global_rate, lift) of (cluster, label); lift is null without positives anywhere."""
    own = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("label").cast("long").alias("positives"))
    whole = own.agg((F.sum("positives") / F.sum("size")).alias("global_rate"))
    return own.crossJoin(F.broadcast(whole)).select("cluster", "size", "positives", (F.col("positives") / F.col("size")).alias("rate"), "global_rate", F.when(F.col("global_rate") > 0, F.col("positives") / F.col("size") / F.col("global_rate")).alias("lift"))  # one row


def exemplars(points: DataFrame) -> DataFrame:
    """(cluster, kind, id, value) of (cluster, id, distance, silhouette): closest to the centroid, best and worst
    silhouette (without any: the farthest row is the boundary). Ties to the smaller id."""
    closest = points.groupBy("cluster").agg(F.min(F.struct("distance", "id")).alias("m")).select("cluster", F.lit("closest").alias("kind"), "m.id", F.col("m.distance").alias("value"))
    s = points.where("silhouette is not null")
    best = s.groupBy("cluster").agg(F.max(F.struct("silhouette", -F.col("id"))).alias("m")).select("cluster", F.lit("representative").alias("kind"), (-F.col("m.col2")).alias("id"), F.col("m.silhouette").alias("value"))
    worst = s.groupBy("cluster").agg(F.min(F.struct("silhouette", "id")).alias("m")).select("cluster", F.lit("boundary").alias("kind"), "m.id", F.col("m.silhouette").alias("value"))
    far = points.groupBy("cluster").agg(F.max(F.struct("distance", -F.col("id"))).alias("m")).join(s.select("cluster").distinct(), "cluster", "left_anti")
    far = far.select("cluster", F.lit("boundary").alias("kind"), (-F.col("m.col2")).alias("id"), F.col("m.distance").alias("value"))
    return closest.unionByName(best).unionByName(worst).unionByName(far)


def enrich_prototypes(prototypes: DataFrame, points: DataFrame, names: DataFrame) -> DataFrame:
    """Prototypes (cluster, kind, id, value) with what is known of their rows (id, ...) and the cluster's label text."""
    facts = points.drop("cluster")
    return prototypes.join(facts, "id", "left").join(names, "cluster", "left")  # a few rows for each cluster


def medoid_diagnostics(medoids: DataFrame, sums: DataFrame, closest: DataFrame) -> DataFrame:
    """(cluster, size, medoid_id, medoid_mean, closest_id, closest_mean, improvement): how much less the medoid's mean
    distance to its cluster is than that of the row closest to the centroid, as a share; ``sums``: (id, cluster, n, total)
    of each row to its own cluster."""
    mean = F.col("total") / F.greatest(F.col("n") - 1, F.lit(1))
    of = sums.select("id", "cluster", mean.alias("m"), F.col("n").alias("size"))
    a = medoids.select("cluster", F.col("id").alias("medoid_id")).join(of.select("cluster", F.col("id").alias("medoid_id"), F.col("m").alias("medoid_mean"), "size"), ["cluster", "medoid_id"])
    b = closest.select("cluster", F.col("id").alias("closest_id")).join(of.select("cluster", F.col("id").alias("closest_id"), F.col("m").alias("closest_mean")), ["cluster", "closest_id"])
    gain = F.when(F.col("closest_mean") > 0, (F.col("closest_mean") - F.col("medoid_mean")) / F.col("closest_mean")).otherwise(0.0)
    return a.join(b, "cluster").select("cluster", "size", "medoid_id", "medoid_mean", "closest_id", "closest_mean", gain.alias("improvement"))


def check_prototypes(prototypes: DataFrame, kinds: tuple[str, ...] = ("medoid", "closest", "representative", "boundary")) -> DataFrame:
    """(cluster, complete): whether a cluster has each kind exactly once."""
    want = F.array(*(F.lit(k) for k in sorted(kinds)))
    return prototypes.groupBy("cluster").agg((F.sort_array(F.collect_list("kind")) == want).alias("complete"))


def anomalies(points: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(cluster, id, distance, score, anomaly_rank): distance against its cluster's median, in units of 1.4826 times
    the median absolute deviation; rank by score over all, then id."""
    middle = lambda df, c, name: df.groupBy("cluster").agg(quantile(c, 0.5, accuracy).alias(name)) if accuracy else exact_quantiles(df, ["cluster"], c, [0.5]).select("cluster", F.get("q", F.lit(0)).alias(name))
    med = middle(points, "distance", "med")
    dev = points.join(med, "cluster").withColumn("dev", F.abs(F.col("distance") - F.col("med")))
    mad = middle(dev, "dev", "mad")
    scored = dev.join(mad, "cluster").withColumn("score", (F.col("distance") - F.col("med")) / F.greatest(F.col("mad") * 1.4826, F.lit(2.220446049250313e-16)))
    ranked = _dense_rank_desc(scored, "score", "id")
    return ranked.select("cluster", "id", "distance", "score", F.col("anomaly_rank"))


def _dense_rank_desc(rows: DataFrame, value: str, key: str) -> DataFrame:
    from cairn.operators.cleaning import dense_key

    return dense_key(rows.withColumn("_neg", -F.col(value)), ["_neg", key], "anomaly_rank").withColumn("anomaly_rank", F.col("anomaly_rank") + 1).drop("_neg")


def anomaly_summary(ranked: DataFrame, labels: DataFrame, share: float = 0.99, top: int = 100) -> DataFrame:
    """Threshold at the share's quantile, number flagged, and label rates of all, top and flagged rows."""
    cut = exact_quantiles(ranked, [], "score", [share]).select(F.get("q", F.lit(0)).alias("threshold"))
    own = ranked.join(labels, "id").crossJoin(F.broadcast(cut))  # one row
    flag = F.col("score") >= F.col("threshold")
    return own.agg(F.max("threshold").alias("threshold"), F.count_if(flag).alias("n_flagged"), F.avg("label").alias("rate_all"), F.avg(F.when(F.col("anomaly_rank") <= top, F.col("label"))).alias("rate_top"), F.avg(F.when(flag, F.col("label"))).alias("rate_flagged"))


def centroid_margin(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster, own, other, other_distance, margin) of (id, v, cluster) against (cluster, c): how much nearer the
    own centroid is than the nearest other one."""
    from cairn.functions.vectors import euclidean

    d = rows.crossJoin(F.broadcast(centroids.select(F.col("cluster").alias("cc"), "c"))).select("id", "cluster", "cc", euclidean(F.col("v"), F.col("c")).alias("d"))  # a row for each cluster
    own = F.max(F.when(F.col("cc") == F.col("cluster"), F.col("d")))
    near = F.min(F.when(F.col("cc") != F.col("cluster"), F.struct(F.col("d").alias("d"), F.col("cc").alias("cc"))))
    out = d.groupBy("id", "cluster").agg(own.alias("own"), near.alias("n"))
    return out.select("id", "cluster", "own", F.col("n.cc").alias("other"), F.col("n.d").alias("other_distance"), (F.col("n.d") - F.col("own")).alias("margin"))


def lowest_silhouettes(points: DataFrame, n: int = 100) -> DataFrame:
    """The n lowest silhouettes with their category (a report: the limit is the feature)."""
    from cairn.functions.text import misassignment_class

    low = points.where("silhouette is not null").orderBy("silhouette", "id").limit(n)
    return low.select("id", "cluster", "silhouette", misassignment_class(F.col("silhouette")).alias("category"))


def error_summary(low: DataFrame, labels: DataFrame) -> DataFrame:
    """(category, n, min, mean, label_rate) of the lowest silhouettes."""
    return low.join(labels, "id").groupBy("category").agg(F.count("*").alias("n"), F.min("silhouette").alias("min"), F.avg("silhouette").alias("mean"), F.avg("label").alias("label_rate"))


def error_report(low: DataFrame, facts: DataFrame) -> DataFrame:
    """One row on the lowest silhouettes with ``facts`` (id, label, amount): count, least and mean silhouette, negative and
    boundary counts and shares, label rate, and the amount's mean and median."""
    own = materialize(low.join(facts, "id"), "lowest")
    s = F.col("silhouette")
    told = own.agg(
        F.count("*").alias("n"), F.min(s).alias("min_silhouette"), F.avg(s).alias("mean_silhouette"), F.count_if(s < 0).alias("n_negative"), F.avg((s < 0).cast("double")).alias("negative_fraction"),
        F.count_if(F.abs(s) <= 0.10).alias("n_boundary"), F.avg((F.abs(s) <= 0.10).cast("double")).alias("boundary_fraction"), F.avg("label").alias("label_rate"), F.avg("amount").alias("amount_mean"),
    )
    median = exact_quantiles(own, [], "amount", [0.5]).agg(F.max(F.get("q", F.lit(0))).alias("amount_median"))
    return told.crossJoin(F.broadcast(median))  # one row each


def error_counts(low: DataFrame) -> DataFrame:
    """(cluster, category, n) of the lowest silhouettes."""
    return low.groupBy("cluster", "category").agg(F.count("*").alias("n"))


def surrogate_tree(rows: DataFrame, features: list[str], label: str = "cluster", depth: int = 4, least: int = 30, seed: int = 42):
    """A shallow tree that tells clusters apart, balanced by class, on a stratified three quarters:
    (model, frame of rule text, train and test accuracy, depth and number of leaves)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    from cairn.operators.cleaning import stratified_split

    split = stratified_split(rows, label, 0.75, seed, "id")
    n, k = rows.count(), rows.select(label).distinct().count()
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    own = split.join(F.broadcast(sizes), label).withColumn("_weight", F.lit(n / k) / F.col("_size"))  # a row for each cluster
    own = VectorAssembler(inputCols=features, outputCol="_features").transform(own).withColumn("_label", F.col(label).cast("double"))
    tree = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxDepth=depth, minInstancesPerNode=least, seed=seed)
    model = tree.fit(own.where("split = 'train'"))
    hit = (F.col("prediction") == F.col("_label")).cast("double")
    score = model.transform(own).agg(F.avg(F.when(F.col("split") == "train", hit)).alias("train_accuracy"), F.avg(F.when(F.col("split") == "test", hit)).alias("test_accuracy"))
    text = model.toDebugString
    for i, name in enumerate(features):
        text = text.replace(f"feature {i} ", f"{name} ")
    leaves = (model.numNodes + 1) // 2
    return model, score.withColumns({"rules": F.lit(text), "depth": F.lit(model.depth), "leaves": F.lit(leaves)})


def importances(model, features: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def permutation_importance(model, rows: DataFrame, features: list[str], label: str = "cluster", seed: int = 42) -> DataFrame:
    """Loss of accuracy when one feature's values are dealt anew, by hash order, over the rows (in place of Shapley values)."""
    from pyspark.ml.feature import VectorAssembler

    from cairn.operators.cleaning import dense_key, hash_order

    def accuracy(df: DataFrame) -> float:
        own = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
        return model.transform(own).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).collect()[0][0] or 0.0

    base = accuracy(rows)
    placed = dense_key(rows, ["id"], "_at")
    mixed = dense_key(rows.withColumn("_h", F.conv(F.substring(hash_order(F.col("id"), seed), 1, 12), 16, 10).cast("long")), ["_h", "id"], "_at")
    out = []
    for f in features:
        other = placed.drop(f).join(mixed.select("_at", f), "_at")
        out.append((f, base - accuracy(other)))
    return rows.sparkSession.createDataFrame(out, "feature string, importance double")
