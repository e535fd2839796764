import shutil

import corpus_pipeline as pipeline
import pytest

from parley.llm import line_dedup, near_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents of sf0.001 with odd rows and clashing columns."""
    out = tmp_path_factory.mktemp("sf")
    src = "/root/testdata/sf0.001"
    shutil.copy(f"{src}/labels.parquet", out / "labels.parquet")
    docs = spark.read.parquet(f"{src}/documents.parquet")
    odd = spark.createDataFrame([(None, "plain words without an id " * 9, "en", "src1", 1), (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "word " * 50_000, "en", "src2", 1), (9004, "twice here " * 30, "en", "src3", 1), (9004, "twice here " * 30, "en", "src3", 1)], docs.schema)
    docs.unionByName(odd).selectExpr("*", "1 as kept", "'x' as n_lines", "2L as of", "3 as row", "4 as words").write.parquet(str(out / "documents.parquet"))
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, before, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert after.columns == columns, name
            assert after.count() > 0
        if name == "quality classifier":
            assert after.count() <= before.count() and after.exceptAll(before).count() == 0
        if name == "line dedup":
            assert after.count() == before.count()
            rows = {(r.doc_id, r.kept_text) for r in line_dedup.drop_repeated_lines(before.select("doc_id", "text")).collect() if r.n_dropped}
            assert rows <= {(r.doc_id, r.text) for r in after.collect()}
        if name == "near dedup":
            judged = near_dedup.near_duplicates(before)
            assert after.count() == judged.where("kept").count()
            assert near_dedup.near_duplicates(after).where("not kept").count() == 0
        if name == "source mixing":
            assert after.where("text is null or trim(text) = ''").count() == 0
            assert after.join(before.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").count() == 0
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}
        before = after


def test_run_is_the_chain_of_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    pieces = lambda df: sorted(map(repr, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    whole = lambda df: sorted(map(repr, df.groupBy("doc_id", "doc_tokens").sum("length").collect()))
    run = pipeline.run(spark, folder)
    assert whole(run) == whole(docs) and run.count() > 100
    assert len(pieces(run)) == run.count()


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
