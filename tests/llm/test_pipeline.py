import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pricebench.llm import near_dedup, quality_model, quality_rules

from .conftest import prose


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What every stage writes."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        out.append((docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][1]
    return out


def test_stages_follow_their_operators(stages):
    (given, ruled), (_, modelled), (_, distinct), (_, packed) = stages
    assert ruled.columns == modelled.columns == distinct.columns == given.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(ruled) == ids(quality_rules.quality_rules(given).where("kept"))
    assert ids(modelled) == ids(quality_model.classify(ruled).where("kept"))
    assert ids(distinct) == ids(near_dedup.near_duplicates(modelled).where("kept"))
    assert set(ids(packed.select("doc_id").distinct())) == set(ids(distinct)) and 0 < distinct.count() < modelled.count() < given.count()


def test_rows_survive_unchanged_but_for_the_lines_above_the_limit(stages):
    (given, ruled), _, (_, distinct), _ = stages
    rest = [c for c in given.columns if c not in ("text", "n_chars")]
    assert distinct.select(rest).subtract(given.select(rest)).count() == 0 and distinct.subtract(ruled).count() == 0
    want = quality_rules.keep_good(given).select("doc_id", "text", F.length("text").alias("n_chars"))
    assert ruled.select("doc_id", "text", "n_chars").exceptAll(want.withColumn("n_chars", F.col("n_chars").cast("long"))).count() == 0


def test_lines_above_the_limit_go(spark):
    """A notice in 30 documents of a host stays with the first of them, through all stages but the last."""
    notice = "Published by the society of parts and prices. All texts are checked by hand."
    docs = spark.createDataFrame([(i, f"{prose(i, 60)}\n{notice}", "en", "h", 1) for i in range(1, 31)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[0][1](spark, docs, "").collect()
    assert len(out) == 30 and {r["doc_id"] for r in out if notice in r["text"]} == {1}
    assert all(r["n_chars"] == len(r["text"]) for r in out) and all(r["text"].startswith(prose(r["doc_id"], 60)) for r in out)
    assert corpus_pipeline.STAGES[0][1](spark, docs.drop("n_chars"), "").columns == ["doc_id", "text", "lang", "source"]


def test_pipeline_of_odd_and_no_documents(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs.select(*columns), "").count() >= 0
