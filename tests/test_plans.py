"""What the plans must look like, whatever the data."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from matchloom.operators import evaluation, parsing, retrieval, skills
from matchloom.plans import corpus
from matchloom.plans.catalog import QUERIES
from matchloom.plans.corpus import jd_texts, resume_texts, table
from matchloom.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_parsing_and_scoring_one_row_never_shuffle(spark):
    texts = resume_texts(table(spark, SF, "orders"))
    parsed = parsing.parse_resumes(texts)
    with_job = parsing.parse_job_descriptions(parsed.withColumn("jd", F.col("text")), "jd", None)
    p = plan(evaluation.evaluate(with_job, chunks=None))
    assert not any(node in p for node in ("Exchange", "EvalPython", "InPandas", "Window"))


def test_columns_are_pruned(spark):
    p = plan(parsing.explode_lines(table(spark, SF, "documents").select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    titles = parsing.parse_job_descriptions(jd_texts(table(spark, SF, "part"))).select("job.meta.title")
    assert "EvalPython" not in plan(titles) and "Exchange" not in plan(titles)


def test_a_filter_does_not_repeat_the_parser(spark):
    df = spark.createDataFrame([("a",)], "text string")
    parsed = parsing.parse_resumes(df, metadata=None)
    wanted = parsed.where(F.size("resume.skills") > 0).select("resume.summary")
    # marking the headings is the costly step: one pattern, once
    assert wanted._jdf.queryExecution().optimizedPlan().toString().count("professional summary|summary)|") == 1


def test_top_chunks_limit_before_the_shuffle(spark):
    assert plan(QUERIES["topk_chunks"](spark, SF)).count("WindowGroupLimit") >= 2


def test_counts_combine_before_the_shuffle(spark):
    lists = spark.createDataFrame([("t", "j", "s", ["a"])], "tenantId string, jobId string, source string, skills array<string>")
    p = plan(skills.aggregate_skills(lists))
    assert "partial_count" in p and "partial_sum" in p


def test_key_prefix_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "feedback")
    df = spark.createDataFrame([("t", "j#1", "x", 1.0, ["a"])], "tenantId string, feedbackId string, text string, score double, tags array<string>")
    df.write.partitionBy("tenantId").parquet(path)
    p = plan(retrieval.scan_feedback(spark.read.parquet(path), "t", "j"))
    assert "StringStartsWith(feedbackId,j#)" in p and "PartitionFilters: [isnotnull(tenantId" in p
    p = plan(tables.list_artifacts(spark.read.parquet(path).withColumnRenamed("feedbackId", "key"), "t"))
    assert "PartitionFilters: [isnotnull(tenantId" in p


def test_text_work_is_dealt_by_rows(spark, monkeypatch):
    orders = corpus.table(spark, SF, "orders")
    monkeypatch.setattr(corpus, "TASK_ROWS", 50)
    wanted = -(-orders.count() // 50)
    assert wanted > spark.sparkContext.defaultParallelism
    assert corpus.spread(orders, "o_orderkey").rdd.getNumPartitions() == wanted
    assert corpus.jobs(spark, SF).rdd.getNumPartitions() == wanted


def test_resumes_are_written_behind_the_join(spark):
    plan = corpus.jobs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Professional Summary" in plan and "Professional Summary" not in plan[plan.index("Join ") :]


def test_gate_reads_one_validation(spark):
    files = QUERIES["gate"](spark, SF).inputFiles()
    assert files and all("/outcomes-" in f for f in files)


def test_embedding_documents_are_written_without_raw_text(spark):
    df = QUERIES["embedding_docs"](spark, SF)
    resumes = next(f for f in df.inputFiles() if "/resumes-" in f)
    written = spark.read.parquet(resumes.rsplit("/", 1)[0])
    assert set(written.schema["resume"].dataType.names) == {"meta", "summary", "experience", "skills"}


def test_embedding_summary_names_all_vectors(spark):
    rows = QUERIES["embedding_summary"](spark, SF).collect()
    ids = sorted(r.id for r in QUERIES["embedding_docs"](spark, SF).select("id").collect())
    assert sorted(i for r in rows for i in r.vector_ids.split("|")) == ids
    assert all(len(r.vector_ids.split("|")) == r.document_count for r in rows)
    assert {(r.index_name, r.collection, r.stamped) for r in rows} == {("index", "collection", True)}


def test_descriptions_are_prepared_once_before_the_join(spark):
    for name in ("evaluate_report", "quality_gate"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "forall" in plan[: plan.index("Join ")] and "zip_with" in plan[plan.index("Join ") :]
        assert "zip_with" not in plan[: plan.index("Join ")]  # descriptions are cut into tokens before they meet resumes


def test_a_prepared_description_gives_the_same_report(spark):
    rows = corpus.jobs(spark, SF, evaluation.prepare_jobs).withColumn("chunks", F.array(F.struct(F.lit("HANDLED Returns").alias("text"))))
    made = ["missingCoverageTargets", "missingAtsKeywords", "hallucinations", "targets", "targetHits", "keywords", "keywordHits", "readabilityGradeLevel"]
    one = evaluation.evaluate(rows, wanted="wanted").select("k", *made)
    other = evaluation.evaluate(rows.drop("wanted")).select("k", *made)
    assert one.exceptAll(other).isEmpty() and one.count() == other.count() > 0


def test_embed_once_parses_once(spark):
    files = QUERIES["embed_once"](spark, SF).inputFiles()
    assert any("/queries-" in f for f in files) and not any("orders.parquet" in f for f in files)
