"""The flows end to end on a small synthetic transaction table, with their reports and dashboard."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.plans import dashboard, flows, reports
from cairn.sources import tables as io


def test_flows_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 240
    v = rng.normal(size=(n, 28)) + np.where(np.arange(n)[:, None] % 3 == 0, 6, 0)
    rows = [tuple(str(x) for x in (i * 600.0, *v[i].round(6), round(float(rng.gamma(2, 20)), 2), int(i % 40 == 0))) for i in range(n)]
    rows += [rows[5], ("junk", *rows[1][1:]), (*rows[2][:29], "-1", "0")]
    raw = spark.createDataFrame(rows, io.raw_schema(text=True))
    out = str(tmp_path / "run")
    config = flows.Config(sample=200, consensus_sample=120, hierarchy_sample=120, hopkins_rows=20, hopkins_repeats=1, ks=(2,), kmeans_seeds=1, steps=3, dimensions=(5,), dbscan_samples=(5,), dbscan_quantiles=(0.9,))
    first = flows.prepare(spark, raw, out, config)
    log = first["decisions"].collect()[0]
    assert (log["n_input"], log["n_null"], log["n_negative_amount"], log["n_duplicates"], log["n_output"]) == (243, 1, 1, 1, 240)
    assert first["features"].columns[1:] == [*(f"V{i}" for i in range(1, 29)), "Amount_log1p", "Time_sin", "Time_cos"]
    second = flows.segment(spark, out, config)
    assert second["consensus"].count() == 120 and second["scoreboard"].where("run_id like 'dbscan/%'").count() >= 0
    third = flows.deploy(spark, out, config)
    assert third["drift"].count() == 31
    new = raw.limit(5).select(*(F.col(c).cast("double").alias(c) for c in raw.columns if c != "Class"))
    got = flows.assign(spark, new, out)
    assert got.count() == 5 and "assigned_cluster" in got.columns
    with pytest.raises(ValueError):
        flows.assign(spark, new.withColumn("Amount", F.lit(-1.0)), out).count()
    told = reports.findings(spark, out)
    assert told["decisions"][0] == "Of 243 rows, 240 are kept." and "1 repeat another row" in told["decisions"][1]
    top = third["drift"].orderBy(F.desc("psi"), "feature").first()
    assert told["drift"][1].startswith(f"{top['feature']} moved most")
    first = second["scoreboard"].where("final_order = 1").first()
    assert f"Partition {first['run_id']} ranks first" in told["scoreboard"][0]
    text = reports.report(spark, out)
    assert text.startswith("# Segmentation report") and told["composition"][0] in text and text.index("## summary") < text.index("## drift")
    book = json.loads(reports.notebook(spark, out))
    assert book["nbformat"] == 4 and sum(c["cell_type"] == "code" for c in book["cells"]) == len(told) + 1
    made = reports.pdf(text)
    start = int(re.search(rb"startxref\n(\d+)", made)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", made[start:])]
    assert all(made[at:].startswith(b"%d 0 obj" % n) for n, at in enumerate(places, 1))
    page = dashboard.page(spark, out, shown=50)
    assert page.count("<circle") == 50 and page.count("data-toggle=") == second["consensus"].select("cluster").distinct().count()
    assert "240" in page and "Explorer" in page and "population stability index" in page
    near = dashboard.assign_record(spark, out, {"Amount": 20.0, "V1": 6.0}).collect()
    assert [r["nearest"] for r in near] == [True] + [False] * (len(near) - 1) and len(near) == second["consensus"].select("cluster").distinct().count()
    with pytest.raises(ValueError):
        dashboard.assign_record(spark, out, {"V99": 1.0})


def test_reports_of_nothing(spark, tmp_path):
    out = str(tmp_path / "none")
    assert reports.findings(spark, out) == {} and "## limits" in reports.report(spark, out)
    assert dashboard.page(spark, out).count("<h2>") == 0 and reports.pdf("").startswith(b"%PDF")


def test_texts_are_escaped(spark):
    df = spark.createDataFrame([("a|b\nc", "<b>&", None, float("nan"))], "x string, y string, z string, w double")
    assert "a\\|b c" in reports.markdown(df) and "&lt;b&gt;&amp;" in dashboard.table(df)
