"""Every operator on nulls, empty and long texts, repeated rows, clashing column names and empty tables."""

import pytest
from llm_cases import no_docs, odd_docs
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, decontaminate, jaccard, line_dedup, mil, pii, quality_rules, quotes, sharding, url_rules


def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (99, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three four"), (None, "some words"), (3, None), (4, "")], "item_id long, text string")
    return labels, bench


OPS = {
    "bpe": lambda d, lab, ben: bpe.op3_bpe(d),
    "decontaminate": lambda d, lab, ben: decontaminate.op2_decontaminate(d, ben),
    "jaccard": lambda d, lab, ben: jaccard.op6_jaccard(d),
    "line_dedup": lambda d, lab, ben: line_dedup.op5_line_dedup(d),
    "mil": lambda d, lab, ben: mil.op7_quality_mil(d, lab),
    "pii": lambda d, lab, ben: pii.op10_pii(d),
    "quality_rules": lambda d, lab, ben: quality_rules.op9_quality_rules(d, lab),
    "sharding": lambda d, lab, ben: sharding.op4_sharding(d),
}


@pytest.mark.parametrize("name", list(OPS))
def test_one_row_per_row(spark, name):
    docs, n = odd_docs(spark)
    labels, bench = tables(spark)
    got = OPS[name](docs, labels, bench).collect()
    assert len(got) == n
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    equal = [tuple(r) for r in got if r["doc_id"] == 1]
    assert name == "sharding" or equal[0] == equal[1]


@pytest.mark.parametrize("name", list(OPS))
def test_empty_table(spark, name):
    labels, bench = tables(spark)
    assert OPS[name](no_docs(spark), labels, bench).collect() == []
    assert OPS[name](no_docs(spark), labels.where("false"), bench.where("false")).collect() == []


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup_stage", "jaccard_join", "decontaminate_stage"])
def test_stages_keep_columns(spark, tmp_path, stage):
    docs, _ = odd_docs(spark)
    labels, bench = tables(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    fn = getattr(corpus_pipeline, stage)
    out = fn(spark, docs, str(tmp_path))
    assert out.dtypes == docs.dtypes
    out.collect()
    assert fn(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_contents_of_odd_rows(spark):
    docs, _ = odd_docs(spark)
    labels, bench = tables(spark)
    hit = {r["doc_id"]: r for r in decontaminate.op2_decontaminate(docs, bench).collect()}
    assert (hit[1]["n_hit"], hit[1]["n_items"]) == (3, 1) and not hit[2]["contaminated"] and hit[2]["n_words"] == 0
    assert hit[None]["n_items"] in (0, 1)
    same = {r["doc_id"]: r for r in jaccard.op6_jaccard(docs.where("doc_id IS NOT NULL")).collect()}
    assert same[6]["component_id"] == 5 and same[2]["n_shingles"] == 0 and same[3]["component_id"] == 3 and same[8]["n_shingles"] == 1
    lines = {r["doc_id"]: r for r in line_dedup.op5_line_dedup(docs).collect()}
    assert lines[2]["kept_sha256"] is None and lines[9]["n_removed"] == 2 and lines[6]["n_chars_kept"] == 0 and lines[4]["n_removed"] == 0


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "no scheme", 2), (None, "http://A.org/x", 3), (3, "http://", 4)], "page_id long, url string, tokens long")
    labels, _ = tables(spark)
    rows = [tuple(r) for r in url_rules.op8_url_rules(pages, labels).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, "", "", None, "allow")] * 2 + [(2, "", "", None, "allow"), (None, "a.org", "/x", "org/", "allow"), (3, "", "", None, "allow")], key=str
    )
    assert url_rules.op8_url_rules(pages.where("false"), labels).collect() == []
    turns = spark.createDataFrame([(None, None, None, None, 1)] * 2 + [(1, 0, "user", "", 2)], "conv_id long, turn long, role string, text string, mid long")
    got = quotes.op1_quotes(turns).collect()
    assert len(got) == 2 and {r["copies"] for r in got} == {1, 2}
    assert quotes.op1_quotes(turns.where("false")).collect() == []


def test_nothing_is_read_twice_by_name(spark):
    docs, n = odd_docs(spark)
    assert quality_rules.keep_good(docs, tables(spark)[0]).columns == docs.columns
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.clean_rows(docs).where(F.col("n_removed") > 0).count() > 0
