import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.operators import embedding, parsing, prompts
from matchloom.sources.answers import answered_once

TEMPLATES = {
    "competency_extraction": "Rank competencies of {jobDescription}",
    "experience_alignment": "Align {competencies} {baseResume} {validatedResumes} {retrievedChunks}",
    "bullet_rewrite": "Rewrite {alignmentPlan} with {options}",
    "skills_harmonization": "Merge {extractedSkills} {alignmentPlan} {bulletRewrites}",
    "consistency_check": "Write {jobDescription} {baseResume} {rewrittenBullets} {skills} {options} {styleGuide} as {{json}}",
}
ANSWERS = {
    "Rank": {"competencies": [{"name": "ML", "priority": 1, "evidenceIndicators": []}]},
    "Align": {"alignments": []},
    "Rewrite": {"bullets": []},
    "Merge": {"skills": ["Python"]},
    "Write": {"tailoredResume": {"summary": "S", "experience": [], "skills": ["Python"]},
              "changeLog": [{"type": "bullet", "detail": "d", "rationale": "r"}], "coverLetter": {"body": "b", "tone": "formal"}},
}


@pytest.fixture(scope="module")
def templates(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("prompts") / "prompts.json"
    path.write_text(json.dumps({n: {"description": "", "template": t, "stopSequences": ["</r>"], "fewShot": [{}]} for n, t in TEMPLATES.items()}, indent=1))
    return prompts.load_prompts(spark, str(path))


def job_rows(spark, options):
    schema = (
        "tenantId string, jobId string, jd string, cv string, "
        "options struct<tone:string,keywords:array<string>,length:string,includeCoverLetter:boolean>"
    )
    df = spark.createDataFrame([("t", "j", "Role: X\nRequirements\nPython", "Summary\nhi", options)], schema)
    df = parsing.parse_job_descriptions(df, "jd", None)
    df = parsing.parse_resumes(df, "cv", None)
    none = {"validated": "array<string>", "chunks": S.CHUNKS, "skills": "array<string>", "profile": S.STYLE_PROFILE}
    for name, kind in none.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def model(answers):
    @F.pandas_udf("string")
    def answer(prompt: pd.Series, stops: pd.Series) -> pd.Series:
        return prompt.map(lambda p: json.dumps({"results": [{"outputText": answers[p.split()[0]]}]}))

    return answer


def test_chain(spark, templates):
    answers = {k: json.dumps(v) for k, v in ANSWERS.items()}
    out = prompts.run_chain(job_rows(spark, (None, None, None, True)), templates, model(answers))
    row = out.first()
    assert row.tailoredResume.skills == ["Python"] and row.changeLog[0].detail == "d" and row.coverLetter.tone == "formal"
    meta = prompts.prompt_metadata(out, "m").collect()
    assert [m.stage for m in meta] == R.PROMPT_STAGES and meta[0].temperature == 0.3 and meta[0].maxTokens == 2000
    without = prompts.run_chain(job_rows(spark, None), templates, model(answers), durable=False).first()
    assert without.coverLetter is None


def test_bad_model_answer_names_its_stage(spark, templates):
    with pytest.raises(Exception, match="competency_extraction did not return valid JSON"):
        prompts.run_stage(job_rows(spark, None), templates, "competency_extraction", model({"Rank": "oops"}), durable=False).collect()


def test_prompt_texts(spark, templates):
    df = spark.createDataFrame([("t", "j", "consistency_check", {n: "{options}" for n in ("jobDescription", "baseResume", "rewrittenBullets", "skills", "options", "styleGuide")})], "tenantId string, jobId string, stage string, variables map<string,string>")
    assert prompts.build_prompts(df, templates).first().prompt == "Write " + " ".join(["{options}"] * 6) + " as {json}"
    with pytest.raises(Exception, match="unknown prompt nope"):
        prompts.build_prompts(df.withColumn("stage", F.lit("nope")), templates).collect()


def test_extract_output(spark):
    cases = [
        ('{"results": [{"outputText": "a", "text": "b"}]}', "a"),
        ('{"results": [{"text": "b"}]}', "b"),
        ('{"results": [{}], "outputText": "z"}', ""),
        ('{"results": [], "output": [{"text": "c"}]}', "c"),
        ('{"outputText": "d"}', "d"),
        ('{"other": 1}', '{"other": 1}'),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(prompts.extract_output("p")).collect()] == [w for _, w in cases]


def test_parse_model_json(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "nope"), (3, '{"k": "x"}'), (4, None)], "id int, raw string")
    good, bad = prompts.parse_model_json(df, "struct<k:int>")
    assert [(r.id, r.data.k) for r in good.collect()] == [(1, 3)]
    assert {r.id for r in bad.collect()} == {2, 3, 4}


def test_embedding(spark):
    jobs = job_rows(spark, None)
    docs = embedding.build_embedding_docs(jobs)
    assert {(r.id, r.text) for r in docs.collect()} == {("t#j#jd", "Role: X\nPython")}
    vec = embedding.embed(docs).first().embedding
    assert len(vec) == 64 and abs(sum(x * x for x in vec) - 1) < 1e-6

    @F.pandas_udf("array<float>")
    def sizes(t: pd.Series) -> pd.Series:
        return t.map(lambda s: [float(len(s))] if s != "hi" else [])

    assert embedding.embed(docs, sizes).first().embedding == [14.0]
    queries = embedding.build_queries(jobs)
    assert [r.text for r in queries.orderBy("query_no").collect()] == ["Role: X", "Python", ""]
    assert embedding.embed(queries, sizes, drop_empty=True).count() == 2
    with pytest.raises(Exception, match="no vector"):
        embedding.embed(docs.withColumn("text", F.lit("hi")), sizes).collect()
    summary = embedding.embedding_summary(docs, "i", "c").first()
    assert summary.vectorIds == ["t#j#jd"] and summary.documentCount == 1


def counting(spark, answer, kind="string"):
    """A column function and the number of questions it was asked."""
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf(kind)
    def ask(*columns: pd.Series) -> pd.Series:
        asked.add(len(columns[0]))
        return columns[0].map(answer)

    return ask, asked


def test_answers_are_asked_once_and_kept(spark, tmp_path):
    rows = [(i, f"q{i % 7}") for i in range(100)] + [(200, None), (201, ""), (202, "nothing")]
    df = spark.createDataFrame(rows, "id int, text string")
    store, say = str(tmp_path / "store"), lambda t: None if t == "nothing" else f"a:{t}"
    model, asked = counting(spark, say)
    for _ in range(2):
        got = answered_once(df, ["text"], model, "answer", store)
        assert {(r.id, r.text, r.answer) for r in got.collect()} == {(i, t, say(t)) for i, t in rows}
    assert asked.value == 10 + 1  # what has no answer is asked again
    more = df.unionByName(spark.createDataFrame([(300, "new")], "id int, text string"))
    assert answered_once(more, ["text"], model, "answer", store).count() == 104
    assert asked.value == 11 + 2
    assert answered_once(df.where("id < 0"), ["text"], model, "answer", str(tmp_path / "empty")).count() == 0


def test_a_broken_run_goes_on_behind_its_answers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i}") for i in range(80)], "id int, text string").coalesce(1)
    store, flag = str(tmp_path / "store"), tmp_path / "broken"
    flag.touch()
    path = str(flag)

    def say(text):
        import os

        if text == "q41" and os.path.exists(path):
            raise RuntimeError("the model is away")
        return f"a:{text}"

    model, asked = counting(spark, say)
    with pytest.raises(Exception, match="the model is away"):
        answered_once(df, ["text"], model, "answer", store, batches=8)
    flag.rename(tmp_path / "mended")
    before = asked.value
    got = answered_once(df, ["text"], model, "answer", store, batches=8)
    assert got.where("answer = concat('a:', text)").count() == 80
    kept = 80 - (asked.value - before)
    assert kept == spark.read.parquet(store).count() - (asked.value - before) and kept > 0


def test_generation_with_rejects_and_resume(spark, templates, tmp_path):
    base = job_rows(spark, None)
    jobs = base.drop("jobId").crossJoin(spark.range(12).select(F.format_string("j%02d", "id").alias("jobId")))
    jobs = jobs.withColumn("job", F.col("job").withField("summary", F.concat(F.lit("#"), F.substring("jobId", 2, 2))))
    answers = {k: json.dumps(v) for k, v in ANSWERS.items()}

    def say(prompt):
        stage, number = prompt.split()[0], int(prompt.split("#")[1][:2]) if "#" in prompt else -1
        if stage == "Rank" and number % 4 == 1:
            return "not JSON"
        if stage == "Rank":
            return json.dumps({"competencies": [{"name": f"#{number:02d}"}]})
        if stage == "Write" and number % 4 == 2:
            return json.dumps({"results": [{"outputText": '{"tailoredResume": 5'}]})
        return json.dumps({"results": [{"outputText": answers[stage]}]})

    model, asked = counting(spark, say)
    store = str(tmp_path / "answers")
    for _ in range(2):
        good, bad = prompts.generate_all(jobs, templates, model, store)
        assert {r.jobId for r in good.collect()} == {f"j{i:02d}" for i in range(12) if i % 4 in (0, 3)}
        assert {(r.jobId, r.stage) for r in bad.collect()} == {(f"j{i:02d}", "competency_extraction") for i in (1, 5, 9)} | {
            (f"j{i:02d}", "consistency_check") for i in (2, 6, 10)
        }
        assert good.first().tailoredResume.summary == "S" and good.first().coverLetter is None
        # 12 first prompts, 9 alignments of their own, one rewrite and one merge for all, 9 final prompts; the second run asks none
        assert asked.value == 12 + 9 + 1 + 1 + 9
    assert {r.error for r in bad.collect()} == {"no valid JSON: not JSON", 'no valid JSON: {"tailoredResume": 5'}


def test_embedding_with_a_store(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab" * (i % 3)) for i in range(30)], "id int, text string")
    model, asked = counting(spark, lambda t: [float(len(t))], "array<float>")
    for _ in range(2):
        got = embedding.embed(df, model, drop_empty=True, store=str(tmp_path / "v")).collect()
        assert {(r.id, r.embedding[0]) for r in got} == {(i, 2.0 * (i % 3)) for i in range(30) if i % 3}
    assert asked.value == 2


def test_documents_of_a_row_equal_the_long_form(spark):
    from matchloom.operators import skills

    cv = "Summary\nhi\nExperience\nLead at Desk - Jan 2020 - Present\n- Built X\nSkills\nSQL, Python\nsql\nRust"
    base = job_rows(spark, None).drop("validated", "resume")
    rows = parsing.parse_resumes(base.withColumn("cv", F.lit(cv)), "cv", None).withColumn("k", F.explode(F.array(F.lit(0), F.lit(2))))
    rows = rows.withColumn("jobId", F.concat("jobId", "k")).withColumn("validated", F.array_repeat("resume", F.col("k")))
    long = rows.select("tenantId", "jobId", F.posexplode("validated").alias("idx", "resume"))
    counted = skills.rank_skills(skills.aggregate_skills(skills.skill_lists(rows, long)))
    want = embedding.build_embedding_docs(rows, long, counted).collect()
    got = embedding.job_documents(rows)
    key = lambda r: (r.tenantId, r.jobId, r.id, r.text, tuple(sorted(r.metadata.items())))
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and len(want) > 8
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
