"""Every pipeline stage on its own input, against brute force and on awkward tables."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cairn.llm import quality, toxicity
from tests.llm.test_nearcopies import keepers
from tests.llm.test_operators import BASE, DOC, ODD, WORDS, base_spans, frame, quality_brute

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "pii", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_stage_keeps_clean_and_drops_bad(spark, stages):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert not any(quality_brute(t)[5] for t in kept.values())
    for r in stages[0].collect():
        q = labels.get(r["doc_id"], (None, None))[0]
        if q == 0:
            assert r["doc_id"] not in kept
        if q == 1 and not quality_brute(r["text"])[5]:
            assert r["doc_id"] in kept
    assert {r["doc_id"] for r in quality.assess(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()} == set(kept)


def test_toxicity_stage_is_the_operator(spark, stages):
    marks = toxicity.assess(stages[1], spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r["doc_id"] for r in marks.where("not flagged").collect()} == {r["doc_id"] for r in stages[2].collect()}


def test_toxicity_stage_learns_from_all_labelled_rows(spark):
    own = spark.range(6_000).selectExpr("id AS doc_id", "concat('word', id % 50) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    labels = own.selectExpr("doc_id", "1L AS quality", "if(doc_id % 9 = 0, 1, 0) AS toxic")
    want = labels.where("crc32(cast(doc_id AS string)) % 5 != 0")
    parts, _, rows = toxicity.dealt(own, labels)
    assert rows == parts.count() == want.count() and want.where("toxic = 0").count() > 4_000


def test_one_document_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    assert sorted(r["doc_id"] for r in stages[3].collect()) == keepers(rows)  # 5-word shingles, Jaccard 0.8 or more


def test_no_personal_data_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not base_spans(before[r["doc_id"]]) and "[SECRET]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]
    assert any(any(f"[{k.upper()}]" in r["text"] for k in BASE) for r in stages[4].collect())


def test_packing_holds_every_token(stages):
    tokenizer = Tokenizer.from_file(WORDS)
    want = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    got = {r["doc_id"]: r["n"] for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    assert cp.run(spark, SMALL).count() == stages[5].count() and cp.ORACLE_SQL is None


@pytest.mark.parametrize("at", range(5))
def test_stages_survive_awkward_rows(spark, at):
    nameless = frame(spark, ["no id " * 60] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    odd = frame(spark, [*ODD, ODD[6], "word " * 30_000]).unionByName(frame(spark, ODD[:3])).unionByName(nameless)
    odd = odd.withColumns({"fp": F.lit(1), "_row": F.lit(2), "cands": F.lit(3), "m_email": F.lit(4), "_own": F.lit(5), "row": F.lit(6)})
    stage = cp.STAGES[at][1]
    rows = stage(spark, odd, SMALL).collect()
    assert stage(spark, spark.createDataFrame([], DOC), SMALL).count() == 0
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    if at == 0:
        assert not any(quality_brute(r["text"] or "")[5] for r in rows)
    if at == 1:
        flagged = {(r["doc_id"]) for r in toxicity.assess(odd, spark.read.parquet(f"{SMALL}/labels.parquet")).where("flagged").collect()}
        assert len(rows) == sum(d not in flagged for d, _ in given)
    if at == 2:
        named = [(d, t or "") for d, t in given if d is not None]
        kept = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert sorted(kept) == keepers([(d, t) for d, t in named]) and len(kept) == len(set(kept))
        assert [r["text"] for r in rows if r["doc_id"] is None] == ["no id " * 60]
    if at == 3:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in given)
        assert not [r for r in rows if r["text"] and re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"])]
    if at == 4:
        assert {r["doc_id"] for r in rows} == {d for d, _ in given} and all(0 <= r["offset"] and r["offset"] + r["length"] <= 4096 for r in rows)
