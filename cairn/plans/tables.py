"""Queries over events and lines: validation, cleaning, profiles, features, splits, scaling, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import features as ff
from cairn.operators import cleaning, drift, profiling, scaling
from cairn.plans import fixtures as fx
from cairn.plans.registry import query
from cairn.sources import tables as io

NUM = ["Time", "Amount"]


@query(
    "raw_schema_validation",
    f"""WITH {fx.DIRTY}
SELECT 'junk' AS "check", c AS "column", v AS violations, 'error' AS severity FROM (
  SELECT 'Time' AS c, count(*) FILTER (d.Time IS NOT NULL AND n.Time IS NULL) AS v FROM dirty d JOIN num n USING (pos)
  UNION ALL SELECT 'Amount', count(*) FILTER (d.Amount IS NOT NULL AND n.Amount IS NULL) FROM dirty d JOIN num n USING (pos))
UNION ALL SELECT 'null', 'Time', count(*) FILTER (Time IS NULL), 'error' FROM dirty
UNION ALL SELECT 'null', 'Amount', count(*) FILTER (Amount IS NULL), 'error' FROM dirty
UNION ALL SELECT 'negative', 'Amount', count(*) FILTER (Amount < 0), 'error' FROM num
UNION ALL SELECT 'negative', 'Time', count(*) FILTER (Time < 0), 'error' FROM num
UNION ALL SELECT 'domain', 'Class', count(*) FILTER (NOT coalesce(Class IN (0, 1), FALSE)), 'error' FROM num
UNION ALL SELECT 'empty', '*', 0, 'error'
UNION ALL SELECT 'missing', 'V1', 1, 'error'
UNION ALL SELECT 'unexpected', 'pos', 1, 'warning'""",
    longs="violations",
)
def raw_schema_validation(spark, d):
    return cleaning.validate_raw(fx.dirty(spark, d), ["Time", "V1", "Amount", "Class"], NUM)


@query(
    "contract_violations",
    f"""WITH {fx.DIRTY}
SELECT pos, 'not_null' AS rule, 'Time' AS "column" FROM num WHERE Time IS NULL
UNION ALL SELECT pos, 'not_null', 'Amount' FROM num WHERE Amount IS NULL
UNION ALL SELECT pos, 'non_negative', 'Amount' FROM num WHERE Amount < 0
UNION ALL SELECT pos, 'non_negative', 'Time' FROM num WHERE Time < 0
UNION ALL SELECT pos, 'binary', 'Class' FROM num WHERE NOT coalesce(Class IN (0, 1), FALSE)""",
)
def contract_violations(spark, d):
    return cleaning.violations(fx.dirty(spark, d), cleaning.contract(NUM, "Class"), "pos")


@query("numeric_coercion", f"WITH {fx.DIRTY} SELECT pos, Time, Amount, Class FROM num", doubles="Time Amount Class")
def numeric_coercion(spark, d):
    return cleaning.coerce(fx.dirty(spark, d), [*NUM, "Class"])


_GOOD = "Time IS NOT NULL AND Amount IS NOT NULL AND Class IS NOT NULL"
_CLEAN = f"{fx.DIRTY}, cl AS (SELECT min(pos) AS pos, Time, Amount, Class FROM num WHERE {_GOOD} AND Amount >= 0 AND Time >= 0 AND Class IN (0, 1) GROUP BY Time, Amount, Class)"


@query("clean_rows", f"WITH {_CLEAN} SELECT pos, Time, Amount, Class FROM cl", doubles="Time Amount Class")
def clean_rows(spark, d):
    return cleaning.clean(fx.dirty(spark, d), NUM, "pos")


@query(
    "clean_decision_log",
    f"""WITH {_CLEAN} SELECT count(*) AS n_input, count(*) FILTER (NOT ({_GOOD})) AS n_null,
count(*) FILTER ({_GOOD} AND Amount < 0) AS n_negative_amount, count(*) FILTER ({_GOOD} AND Time < 0) AS n_negative_time,
count(*) FILTER ({_GOOD} AND Class NOT IN (0, 1)) AS n_bad_label,
count(*) FILTER ({_GOOD} AND Amount >= 0 AND Time >= 0 AND Class IN (0, 1)) - (SELECT count(*) FROM cl) AS n_duplicates, (SELECT count(*) FROM cl) AS n_output FROM num""",
)
def clean_decision_log(spark, d):
    return cleaning.decision_log(fx.dirty(spark, d), NUM, "pos")


@query("exact_dedup", f"WITH {fx.DIRTY} SELECT min(pos) AS pos, Time, Amount, Class FROM dirty GROUP BY Time, Amount, Class")
def exact_dedup(spark, d):
    return cleaning.drop_exact_duplicates(fx.dirty(spark, d), [*NUM, "Class"], "pos")


@query("duplicate_count", f"WITH {fx.DIRTY} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT Time, Amount, Class FROM dirty)) AS n_duplicates FROM dirty")
def duplicate_count(spark, d):
    return cleaning.duplicate_count(fx.dirty(spark, d), [*NUM, "Class"])


@query("surrogate_row_id", f"WITH {fx.EVENTS} SELECT row_id AS source_id, row_number() OVER (ORDER BY Time, row_id) - 1 AS dense_id FROM ev")
def surrogate_row_id(spark, d):
    return cleaning.dense_key(fx.events(spark, d), ["Time", "row_id"], "dense_id").select(F.col("row_id").alias("source_id"), "dense_id")


@query(
    "cross_artifact_check",
    f"""WITH {fx.EVENTS}, part AS (SELECT * FROM ev WHERE row_id % 7 <> 0)
SELECT 'features' AS artifact, count(*) AS n_rows, 0 AS n_missing, 0 AS n_null FROM ev
UNION ALL SELECT 'metadata', count(*), (SELECT count(*) FROM ev WHERE row_id % 7 = 0), 0 FROM part""",
    longs="n_rows n_missing n_null",
)
def cross_artifact_check(spark, d):
    e = fx.events(spark, d)
    return cleaning.cross_check({"features": e, "metadata": e.where("row_id % 7 <> 0")})


@query(
    "engineered_features",
    f"WITH {fx.EVENTS} SELECT row_id, ln(1 + Amount) AS Amount_log1p, sin(2 * pi() * (Time % 86400) / 86400) AS Time_sin, cos(2 * pi() * (Time % 86400) / 86400) AS Time_cos, Time / 86400 AS Elapsed_day FROM ev",
    doubles="Amount_log1p Time_sin Time_cos Elapsed_day",
)
def engineered_features(spark, d):
    e = fx.events(spark, d)
    return ff.build_features(e, ff.default_features(e, elapsed=True))


@query("served_features", f"WITH {fx.EVENTS} SELECT row_id, cos(2 * pi() * (Time % 86400) / 86400) AS Time_cos, Amount, ln(1 + Amount) AS Amount_log1p FROM ev", doubles="Time_cos Amount Amount_log1p")
def served_features(spark, d):
    return ff.build_features(fx.events(spark, d), ["Time_cos", "Amount", "Amount_log1p"])


@query("temporal_split", f"WITH {fx.SPLIT} SELECT row_id, split FROM sp")
def temporal_split(spark, d):
    return cleaning.temporal_split(fx.events(spark, d)).select("row_id", "split")


@query("split_manifest", f"WITH {fx.SPLIT} SELECT split, count(*) AS n, min(Time) AS first_time, max(Time) AS last_time, avg(Class) AS label_rate FROM sp GROUP BY split", doubles="first_time last_time label_rate")
def split_manifest(spark, d):
    s = cleaning.temporal_split(fx.events(spark, d))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("Time").alias("first_time"), F.max("Time").alias("last_time"), F.avg("Class").alias("label_rate"))


@query("hash_sample", "SELECT event_id AS row_id FROM events ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def hash_sample(spark, d):
    return cleaning.hash_sample(fx.events(spark, d), 500).select("row_id")


@query(
    "bootstrap_draws",
    """WITH k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings), n AS (SELECT count(*) AS n FROM k),
draw AS (SELECT run, CAST(floor(CAST('0x' || substr(md5('42:' || CAST(run AS VARCHAR) || ':' || CAST(slot AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 * n) AS BIGINT) AS slot FROM k, n, (SELECT unnest([0, 1, 2]) AS run))
SELECT run, k.id, count(*) AS weight FROM draw JOIN k USING (slot) GROUP BY ALL""",
    longs="run",
)
def bootstrap_draws(spark, d):
    return cleaning.bootstrap_draws(fx.vectors(spark, d), 3, 42, "id")


@query(
    "stratified_split",
    "SELECT event_id AS row_id, event_type AS kind, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 0.75) THEN 'train' ELSE 'test' END AS split FROM events",
)
def stratified_split(spark, d):
    return cleaning.stratified_split(fx.events(spark, d), "kind").select("row_id", "kind", "split")


_G1 = "CASE WHEN count({c}) > 2 AND stddev_pop({c}) > 0 THEN skewness({c}) END"
_G2 = "CASE WHEN count({c}) > 3 AND stddev_pop({c}) > 0 THEN kurtosis({c}) END"


def _each(template: str, columns) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query(
    "column_profile",
    _each("SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS n_missing, (count(*) - count({c})) * 100.0 / count(*) AS missing_percent, count(DISTINCT {c}) AS n_distinct, count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_duplicates, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std, " + _G1 + " AS skew FROM lineitem", fx.WIDE),
    doubles="missing_percent min max mean median std skew",
)
def column_profile(spark, d):
    return profiling.column_profile(fx.lines(spark, d), fx.WIDE)


@query(
    "eda_summary",
    _each("SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, " + ", ".join(f"quantile_cont({{c}}, {q}) AS p{int(q * 100)}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + ", max({c}) AS max, " + _G1 + " AS skew, " + _G2 + " AS kurtosis, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM lineitem", fx.WIDE),
    doubles="mean std min p1 p5 p25 p50 p75 p95 p99 max skew kurtosis iqr",
)
def eda_summary(spark, d):
    return profiling.eda_summary(fx.lines(spark, d), fx.WIDE)


@query(
    "iqr_feature_selection",
    "SELECT row_number() OVER (ORDER BY CASE feature WHEN 'l_tax' THEN 0 ELSE 1 END, spread DESC, feature) AS position, feature, spread FROM ("
    + _each("SELECT '{c}' AS feature, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS spread FROM lineitem", fx.WIDE)
    + ") WHERE spread > 0 QUALIFY position <= 3",
    doubles="spread",
)
def iqr_feature_selection(spark, d):
    return profiling.informative_features(fx.lines(spark, d), fx.WIDE, 3, ["l_tax"])


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {f'corr({a}, {b})' if a != b else '1.0'} AS r FROM lineitem" + (" LIMIT 1" if a == b and False else "") for a in fx.WIDE for b in fx.WIDE if a != b) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{a}', 1.0" for a in fx.WIDE), doubles="r")
def correlation_matrix(spark, d):
    return profiling.correlations(fx.lines(spark, d), fx.WIDE)


@query("correlation_significance")
def correlation_significance(spark, d):
    return profiling.correlation_significance(fx.lines(spark, d), fx.WIDE)


@query(
    "histogram_data",
    "SELECT CAST(least(floor((value - lo) / ((hi - lo) / 60)), 59) AS BIGINT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1",
)
def histogram_data(spark, d):
    return profiling.histogram(fx.events(spark, d), "Amount")


@query(
    "density_grid",
    f"WITH {fx.EVENTS}, b AS (SELECT min(Time) AS t0, max(Time) AS t1, min(Amount) AS a0, max(Amount) AS a1 FROM ev) SELECT CAST(least(floor((Time - t0) / ((t1 - t0) / 20)), 19) AS BIGINT) AS gx, CAST(least(floor((Amount - a0) / ((a1 - a0) / 20)), 19) AS BIGINT) AS gy, count(*) AS n, log10(count(*)) AS log_n FROM ev, b GROUP BY 1, 2",
    doubles="log_n",
)
def density_grid(spark, d):
    return profiling.grid_counts(fx.events(spark, d), "Time", "Amount", 20)


@query(
    "box_statistics",
    _each("SELECT '{c}' AS feature, q25, median, q75, min({c}) FILTER ({c} >= q25 - 1.5 * (q75 - q25) AND {c} <= q75 + 1.5 * (q75 - q25)) AS low, max({c}) FILTER ({c} >= q25 - 1.5 * (q75 - q25) AND {c} <= q75 + 1.5 * (q75 - q25)) AS high FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM lineitem) GROUP BY ALL", fx.WIDE),
    doubles="q25 median q75 low high",
)
def box_statistics(spark, d):
    return profiling.box_statistics(fx.lines(spark, d), fx.WIDE)


@query(
    "quantile_plot",
    "WITH p AS (SELECT unnest(range(1, 100)) / 100.0 AS share), m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT share, (SELECT quantile_cont(value, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "]) FROM events)[CAST(round(share * 100) AS BIGINT)] AS empirical, m, s FROM p, m",
    doubles="share empirical m s",
)
def quantile_plot(spark, d):
    e = fx.events(spark, d)
    own = profiling.quantile_plot(e, "Amount")
    z = own.where("abs(share - 0.5) < 0.001").select(F.col("theoretical").alias("m"))
    return own.drop("theoretical").crossJoin(z).crossJoin(e.agg(F.stddev_samp("Amount").alias("s")))  # one row each


@query("value_counts", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return profiling.value_counts(fx.events(spark, d), "kind")


@query("metric_unpivot", _each("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '{c}' AS metric, {c} AS value FROM lineitem", fx.WIDE), doubles="value", longs="l_linenumber")
def metric_unpivot(spark, d):
    return profiling.unpivot(fx.lines(spark, d), fx.WIDE, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "metric")


_TRAIN = f"WITH {fx.SPLIT}, lx AS (SELECT feature, value FROM lf WHERE split = 'train'), st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iq, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, min(value) AS mn, max(value) AS mx FROM lx GROUP BY feature)"


def _train(spark, d):
    own = cleaning.temporal_split(fx.events(spark, d))
    return ff.build_features(own, ["Amount_log1p", "Time_sin", "Time_cos", "Amount"], keep=("row_id", "split"))


@query("standard_scale", f"{_TRAIN}, w AS (SELECT row_id, Amount, ln(1 + Amount) AS al FROM sp) SELECT row_id, (al - (SELECT m FROM st WHERE feature = 'Amount_log1p')) / (SELECT s FROM st WHERE feature = 'Amount_log1p') AS Amount_log1p, (Amount - (SELECT m FROM st WHERE feature = 'Amount')) / (SELECT s FROM st WHERE feature = 'Amount') AS Amount FROM w", doubles="Amount_log1p Amount")
def standard_scale(spark, d):
    own, names = _train(spark, d), ["Amount_log1p", "Amount"]
    return scaling.apply_columns(own, scaling.fit_columns(own.where("split = 'train'"), names)).select("row_id", *names)


@query("robust_scale", f"{_TRAIN}, w AS (SELECT row_id, Amount, ln(1 + Amount) AS al FROM sp) SELECT row_id, (al - (SELECT md FROM st WHERE feature = 'Amount_log1p')) / (SELECT iq FROM st WHERE feature = 'Amount_log1p') AS Amount_log1p, (Amount - (SELECT md FROM st WHERE feature = 'Amount')) / (SELECT iq FROM st WHERE feature = 'Amount') AS Amount FROM w", doubles="Amount_log1p Amount")
def robust_scale(spark, d):
    own, names = _train(spark, d), ["Amount_log1p", "Amount"]
    return scaling.apply_columns(own, scaling.fit_columns(own.where("split = 'train'"), names, robust=True)).select("row_id", *names)


@query(
    "scaler_summary",
    f"{_TRAIN} SELECT feature, m AS mean, s AS std, md AS median, q25, q75, mn AS min, mx AS max, 'train' AS scaler FROM st",
    doubles="mean std median q25 q75 min max",
)
def scaler_summary(spark, d):
    return profiling.scaler_summary(_train(spark, d).where("split = 'train'"), ["Amount_log1p", "Time_sin", "Time_cos", "Amount"], "train")


@query("vector_standard_parameters", f"WITH {fx.VECTORS}, x AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec) SELECT dim, avg(x) AS center, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END AS scale FROM x GROUP BY dim", doubles="center scale")
def vector_standard_parameters(spark, d):
    return scaling.fit_standard(fx.vectors(spark, d))


@query("vector_robust_parameters", f"WITH {fx.VECTORS}, x AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec) SELECT dim, quantile_cont(x, 0.5) AS center, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS scale FROM x GROUP BY dim", doubles="center scale")
def vector_robust_parameters(spark, d):
    return scaling.fit_robust(fx.vectors(spark, d))


@query("pca_variance")
def pca_variance(spark, d):
    return scaling.pca_table(fx.vectors(spark, d))


@query("pca_total_variance", f"WITH {fx.VECTORS}, x AS (SELECT unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec) SELECT sum(s) AS total_variance FROM (SELECT var_samp(x) AS s FROM x GROUP BY dim)", doubles="total_variance")
def pca_total_variance(spark, d):
    rows = fx.vectors(spark, d)
    mean, loadings, _, _ = scaling.fit_pca(rows)
    scores = scaling.apply_pca(rows, mean, loadings, len(mean))
    return scaling.explode_vector(scores).groupBy("dim").agg(F.var_samp("value").alias("s")).agg(F.sum("s").alias("total_variance"))


_PSI = (
    fx.SPLIT
    + """, q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM lf WHERE split = 'train' GROUP BY feature),
e AS (SELECT feature, list_slice(q, 2, len(q) - 1) AS edges FROM q),
b AS (SELECT feature, split, len(list_filter(edges, lambda x: value >= x)) AS bin FROM lf JOIN e USING (feature)),
n AS (SELECT feature, count(*) FILTER (split = 'train') AS nr, count(*) FILTER (split = 'test') AS nc FROM lf GROUP BY feature),
cells AS (SELECT feature, unnest(range(len(edges) + 1)) AS bin FROM e),
f AS (SELECT c.feature, c.bin, greatest(count(*) FILTER (b.split = 'train') / any_value(nr), 1e-8) AS r, greatest(count(*) FILTER (b.split = 'test') / any_value(nc), 1e-8) AS c FROM cells c LEFT JOIN b ON b.feature = c.feature AND b.bin = c.bin JOIN n ON n.feature = c.feature GROUP BY 1, 2),
psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM f GROUP BY feature)"""
)
_KS = """, st AS (SELECT feature, value, count(*) FILTER (split = 'train') AS r, count(*) FILTER (split = 'test') AS c FROM lf GROUP BY 1, 2),
wk AS (SELECT feature, sum(r) OVER w AS r, sum(c) OVER w AS c FROM st WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, max(abs(r / nr - c / nc)) AS ks_statistic, any_value(nr) AS nr, any_value(nc) AS nc FROM wk JOIN n USING (feature) GROUP BY feature),
kp AS (SELECT feature, ks_statistic, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x))), 0.0), 1.0) END AS ks_pvalue FROM (SELECT *, ks_statistic * sqrt(CAST(nr AS DOUBLE) * nc / (nr + nc)) AS x FROM ks))"""
_REPORT = (
    _PSI
    + _KS
    + """, rep AS (SELECT feature, psi, ks_statistic, ks_pvalue, CASE WHEN psi >= 0.25 THEN 'refit' WHEN psi >= 0.10 OR (ks_statistic >= 0.10 AND ks_pvalue <= 0.01) THEN 'warning' ELSE 'stable' END AS status,
avg(value) FILTER (split = 'train') AS reference_mean, avg(value) FILTER (split = 'test') AS current_mean, stddev_pop(value) FILTER (split = 'train') AS reference_std, stddev_pop(value) FILTER (split = 'test') AS current_std
FROM psi JOIN kp USING (feature) JOIN lf USING (feature) GROUP BY ALL)"""
)


@query("psi", f"WITH {_PSI} SELECT feature, psi FROM psi", doubles="psi")
def psi(spark, d):
    return drift.psi(*fx.split_features(spark, d))


@query("ks", f"WITH {_PSI}{_KS} SELECT feature, ks_statistic, ks_pvalue FROM kp", doubles="ks_statistic ks_pvalue")
def ks(spark, d):
    """With the asymptotic p, which SQL can follow; ``ks_exact`` has the exact one."""
    return drift.ks(*fx.split_features(spark, d), method="asymptotic")


@query("drift_report", f"WITH {_REPORT} SELECT * FROM rep", doubles="psi ks_statistic ks_pvalue reference_mean current_mean reference_std current_std")
def drift_report(spark, d):
    return drift.drift_report(*fx.split_features(spark, d), method="asymptotic")


@query(
    "drift_summary",
    f"WITH {_REPORT} SELECT count(*) FILTER (status = 'stable') AS n_stable, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'refit') AS n_refit, max(psi) AS max_psi, max(ks_statistic) AS max_ks, bool_or(status = 'refit') AS any_refit FROM rep",
    doubles="max_psi max_ks",
)
def drift_summary(spark, d):
    return drift.drift_summary(drift.drift_report(*fx.split_features(spark, d), method="asymptotic"))


@query("ks_exact")
def ks_exact(spark, d):
    """The exact two-sided p where both sides have at most 10,000 values."""
    return drift.ks(*fx.split_features(spark, d))


@query("artifact_manifest")
def artifact_manifest(spark, d):
    return io.file_manifest(spark, f"{d}/region.parquet", f"{d}/nation.parquet", f"{d}/missing.parquet")


@query(
    "artifact_status",
    f"WITH {fx.EVENTS}, m AS (SELECT count(*) AS n FROM ev), h AS (SELECT count(*) AS n, count(*) FILTER (row_id % 10 = 3) AS gaps FROM ev WHERE row_id % 2 = 1) SELECT 'features' AS artifact, 'valid' AS status, n AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_nan, '' AS problems FROM m UNION ALL SELECT 'kinds', 'not numeric', n, 0, 0, 'kind' FROM m UNION ALL SELECT 'gaps', CASE WHEN gaps > 0 THEN 'has gaps' ELSE 'unequal' END, n, gaps, 0, '' FROM h UNION ALL SELECT 'half', 'unequal', n, 0, 0, '' FROM h UNION ALL SELECT 'short', 'incomplete', n, 0, 0, 'Amount' FROM m UNION ALL SELECT 'gone', 'missing', NULL, NULL, NULL, ''",
)
def artifact_status(spark, d):
    e = fx.events(spark, d)
    features, half = e.select("row_id", "Time", "Amount"), e.where("row_id % 2 = 1").select("row_id", "Time", "Amount")
    gaps = half.withColumn("Amount", F.when(F.col("row_id") % 10 != 3, F.col("Amount")))
    gone = spark.read.parquet(f"{d}/gone.parquet") if io.exists(spark, f"{d}/gone.parquet") else None
    tables = {"features": features, "kinds": e.select("row_id", "kind"), "gaps": gaps, "half": half, "short": e.select("row_id", "Time"), "gone": gone}
    needed = {"features": ["row_id", "Time", "Amount"], "gaps": ["Amount"], "half": ["Amount"], "short": ["Time", "Amount"]}
    return cleaning.artifact_status(tables, needed, ["features", "kinds"])


@query("row_to_long", "SELECT 'quantity' AS feature, avg(l_quantity) AS value FROM lineitem UNION ALL SELECT 'tax', avg(l_tax) FROM lineitem", doubles="value")
def row_to_long(spark, d):
    wide = fx.lines(spark, d).agg(F.avg("l_quantity").alias("quantity_mean"), F.max("l_quantity").alias("quantity_max"), F.avg("l_tax").alias("tax_mean"))
    return profiling.row_to_long(wide, "_mean")


@query("environment_manifest")
def environment_manifest(spark, d):
    return io.environment(spark)
