import json

from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.operators import coverage, delta, evaluation, validation
from matchloom.sources import intake

# Seven targets: two requirements, one responsibility, two skills, one competency and its indicator. The resume has the
# first requirement, Irrigation, Stewardship and the indicator: 4 of 7. Keywords are the skills and the competency: 2 of 3.
JOB = {
    "requirements": ["Plan crop rotations", "Repair old tractors"],
    "responsibilities": ["Report to growers"],
    "skills": ["Irrigation", "Welding"],
    "competencies": [{"name": "Stewardship", "priority": 3, "evidenceIndicators": ["soil health records"]}],
}
RESUME = {
    "summary": "Known for stewardship and for soil health records on mixed farms.",
    "experience": [
        {
            "title": "Farm Manager", "company": "Hillside", "startDate": "2019-03-01", "endDate": "2023-10-31",
            "achievements": [
                "Plan crop rotations on nine dry fields.",
                "Kept soil health records of three farms for years.",
                "Laid irrigation lines with pumps and filters.",
            ],
        }
    ],
    "skills": ["Irrigation", "Pruning"],
}


def rows(spark, **columns):
    """One row whose struct columns are given as Python values."""
    df = spark.createDataFrame([(json.dumps(columns),)], "j string")
    fields = {"job": S.JOB_DESCRIPTION, "resume": S.RESUME, "chunks": S.CHUNKS, "changeLog": S.CHANGE_LOG, "coverLetter": S.COVER_LETTER}
    schema = ",".join(f"{n}:{t}" for n, t in fields.items())
    return df.select(F.from_json("j", f"struct<{schema}>").alias("r")).select("r.*")


def test_report_on_the_known_case(spark):
    chunks = [{"text": "Notes on soil health from the growers."}]
    r = evaluation.evaluate(rows(spark, job=JOB, resume=RESUME, chunks=chunks)).first()
    assert r.jdCoverage == 0.571 and r.atsKeywordScore == 0.667
    assert r.missingCoverageTargets == ["Repair old tractors", "Report to growers", "Welding"]
    assert r.missingAtsKeywords == ["Welding"]
    assert r.hallucinations == RESUME["experience"][0]["achievements"]
    assert r.consistency == 1.0


def test_report_from_files(spark, tmp_path):
    for name, value in (("job", JOB), ("resume", RESUME)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"tenantId": "t", "jobId": "j", name: value}], indent=1))
    df, rejects = intake.load_eval_inputs(spark, str(tmp_path / "job.json"), str(tmp_path / "resume.json"))
    assert rejects.count() == 0
    (tmp_path / "bad.json").write_text('{"tenantId": "t", "jobId": ')
    (tmp_path / "none.json").write_text('{"tenantId": "t"}')
    found = [intake.load_eval_inputs(spark, str(tmp_path / f), str(tmp_path / "resume.json"))[1].first() for f in ("bad.json", "none.json")]
    assert [(r.kind, r.file, r.reason) for r in found] == [("job", "bad.json", "no valid JSON"), ("job", "none.json", "tenantId and jobId are required")]
    assert evaluation.evaluate(df).first().jdCoverage == 0.571


def test_empty_report(spark):
    r = evaluation.evaluate(rows(spark, job={}, resume={})).first()
    assert (r.jdCoverage, r.atsKeywordScore, r.consistency, r.readabilityGradeLevel) == (1.0, 1.0, 0.0, 12.0)
    assert r.hallucinations == []


def test_evidence_in_the_job_text(spark):
    resume = {"experience": [{"achievements": ['Said "É"', "unseen"]}]}
    r = evaluation.evaluate(rows(spark, job={"rawText": 'they said "é" twice'}, resume=resume)).first()
    assert r.hallucinations == ["unseen"]


def test_quality_gate(spark):
    good = {"summary": "alpha beta", "experience": [{"achievements": ["alpha beta"]}], "skills": ["alpha"]}
    df = rows(spark, job={"requirements": ["alpha beta"], "skills": ["alpha"]}, resume=good)
    report = evaluation.evaluate(df)
    assert evaluation.quality_gate(report).first().passed
    long = dict(good, summary="alpha beta " * 600)
    report = evaluation.evaluate(rows(spark, job={"requirements": ["alpha beta"]}, resume=long))
    assert not evaluation.quality_gate(report).first().passed
    assert evaluation.quality_gate(report, override=F.lit(True)).first().passed


def test_chunk_coverage(spark):
    df = rows(spark, job={"requirements": ["Python", "Go"], "skills": [""]}, resume={})
    some = coverage.add_chunk_coverage(df, F.array(F.lit("loves PYTHON"))).first().coverage
    assert (some.requirements, some.responsibilities, some.skills, some.mean) == (0.5, 1.0, 1.0, 0.833)
    none = coverage.add_chunk_coverage(df, F.array().cast("array<string>")).first().coverage
    assert (none.requirements, none.responsibilities, none.skills, none.mean) == (0.0, 0.0, 0.0, None)


def test_long_consistency_equals_row_form(spark):
    texts = ["a b c", "a", "a b c d e f g h i j k l m n o p", "x y"]
    df = spark.createDataFrame([(1, t) for t in texts], "k int, text string")
    long = evaluation.bullet_consistency(df, ["k"]).first()
    row = evaluation.add_consistency(df.groupBy("k").agg(F.collect_list("text").alias("b")), F.col("b")).first()
    # mean 5.5, allowed distance 3.3: only the bullet of three words lies near
    assert (long.bullets, long.near) == (4, 1) and long.consistency == row.consistency == 0.25


def issues(spark, **columns):
    return [(i.code, i.message) for i in validation.validate_resumes(rows(spark, **columns)).first().issues]


OK = {
    "summary": "s", "skills": ["Python"],
    "experience": [{"title": "T", "company": "C", "startDate": "2020", "endDate": "2021", "achievements": ["Did 3 things"]}],
}


def test_valid_resume_passes(spark):
    log = [{"type": "bullet", "detail": "d", "rationale": "r"}]
    r = validation.validate_resumes(rows(spark, resume=OK, changeLog=log)).first()
    assert r.status == "PASSED" and r.issues == [] and r.metrics.bulletCount == 1 and r.metrics.skillsCount == 1


def test_banned_claim(spark):
    resume = dict(OK, summary="A Wizard of data")
    df = rows(spark, resume=resume, changeLog=[{"type": "a", "detail": "b", "rationale": ""}])
    r = validation.validate_resumes(df, banned=["wizard", "ninja"]).first()
    assert r.status == "FAILED" and [i.code for i in r.issues] == ["BANNED_CLAIM"]


def test_every_rule_in_order(spark):
    bad = {
        "summary": "", "skills": [],
        "experience": [{"achievements": []}, {"achievements": ["x" * 501]}],
    }
    assert issues(spark, resume=bad) == [
        ("MISSING_SECTION", "Required section 'summary' is missing"),
        ("MISSING_SECTION", "Required section 'skills' is missing"),
        ("EMPTY_ACHIEVEMENTS", "Experience item 0 missing achievements"),
        ("BULLET_TOO_LONG", "Achievement exceeds 500 characters: " + "x" * 50),
        ("NO_METRIC", "Achievement lacks metric: " + "x" * 50),
        ("NO_SKILLS", "Skills section is empty"),
    ]
    assert issues(spark, resume={}) == [("EMPTY_RESUME", "Tailored resume payload missing or invalid")]
    assert issues(spark) == [("EMPTY_RESUME", "Tailored resume payload missing or invalid")]


def test_skills_personal_data_and_letter(spark):
    resume = dict(OK, skills=["SQL", "Go", "SQL", "go", "Go", "sql"], summary="a@b.io 415-555-0199")
    letter = {"body": "x" * 4001, "tone": "rude"}
    log = [{"detail": "d", "rationale": ""}, {"type": "t", "detail": "d"}]
    assert issues(spark, resume=resume, coverLetter=letter, changeLog=log) == [
        ("DUPLICATE_SKILL", "Duplicate skills detected: ['go', 'sql']"),
        ("PII_EMAIL", "Email detected in tailored resume"),
        ("PII_PHONE", "Phone number detected in tailored resume"),
        ("CHANGE_LOG_FORMAT", "Change log entry 0 missing type/detail"),
        ("CHANGE_LOG_RATIONALE", "Change log entry 1 missing rationale"),
        ("COVER_LENGTH", "Cover letter exceeds 4000 characters"),
        ("COVER_TONE", "Unsupported tone 'rude'"),
    ]


def test_banned_table_form(spark):
    df = spark.createDataFrame([("t", 1, "A Wizard"), ("t", 2, "plain")], "tenantId string, id int, payload string")
    words = spark.createDataFrame([("wizard",), ("AI",)], "keyword string")
    for grid in (False, True):
        got = validation.banned_claims(df, words, ["tenantId", "id"], force_index=grid).collect()
        assert {(r.tenantId, r.id, r.keyword) for r in got} == {("t", 1, "wizard"), ("t", 2, "AI")}


def test_conformance(spark):
    df = rows(spark, resume={"summary": "x", "experience": [{"title": "t"}], "projects": [{"name": "n"}]})
    got = delta.schema_conformance(df, "resume", "resume").first()
    assert "skills: required" in got.problems and "experience.company: required" in got.problems
    assert "projects.description: required" in got.problems and not got.conforms
    docs = spark.createDataFrame(
        [('{"competencies": [{"name": "a", "priority": 6}]}', '{"changes": [{"section": "s", "action": "drop", "detail": "d"}]}')], "c string, d string"
    ).select(F.from_json("c", S.COMPETENCIES).alias("c"), F.from_json("d", S.DELTA).alias("d"))
    assert delta.schema_conformance(docs, "competencies", "c").first().problems == ["competencies.priority: not in 1..5"]
    assert delta.schema_conformance(docs, "delta", "d").first().problems == ["changes.action: not add, update or remove"]


def test_diff(spark):
    a = rows(spark, resume=OK).withColumn("id", F.lit(1))
    b = rows(spark, resume=dict(OK, summary="new", skills=["Python", "Go"], experience=[])).withColumn("id", F.lit(1))
    got = {(r.section, r.slot, r.action) for r in delta.resume_diff(a, b, ["id"]).collect()}
    assert got == {("summary", "0", "update"), ("skills", "1", "add"), ("role", "0", "remove"), ("experience", "0.0", "remove")}


def role(title, company, *bullets):
    return {"title": title, "company": company, "startDate": "a", "endDate": "b", "achievements": list(bullets) or None}


def test_changes_of_roles():
    a, b, c = role("A", "x", "one", "two"), role("B", "y", "three"), role("C", "z")
    diff = lambda old, new: {(s, p, x, y, z) for s, p, x, y, z in delta.changes_of({"experience": old}, {"experience": new})}
    assert diff([a, b, c], [a, b, c]) == set() == diff(None, [])
    assert diff([a, b, c], [b, c, a]) == {("role", "2", "move", "0", "A")}
    renamed = dict(b, title="B2", startDate="later")
    assert diff([a, b, c], [a, renamed, c]) == {("role", "1.title", "update", "B", "B2"), ("role", "1.startDate", "update", "a", "later")}
    more = role("A", "x", "zero", "one", "2", "new")
    assert diff([a, c], [more]) == {
        ("experience", "0.0", "add", None, "zero"), ("experience", "0.2", "update", "two", "2"), ("experience", "0.3", "add", None, "new"),
        ("role", "1", "remove", "C", None),
    }
    assert diff([a, a], [a]) == {("role", "1", "remove", "A", None), ("experience", "1.0", "remove", "one", None), ("experience", "1.1", "remove", "two", None)}
    project = lambda n, d: {"name": n, "description": d}
    got = set(delta.changes_of({"projects": [project("p", "d"), project("q", "e")]}, {"projects": [project("r", "e"), project("p", "f")]}))
    assert got == {("projects", "1.description", "update", "d", "f"), ("projects", "0.name", "update", "q", "r")}
    assert list(delta.changes_of(None, None)) == []


def test_changes_need_no_shuffle(spark):
    df = rows(spark, resume=OK).withColumn("id", F.lit(1))
    plan = delta.resume_changes(df, "resume", "resume", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
