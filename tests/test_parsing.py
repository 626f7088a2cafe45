from pyspark.sql import functions as F

from matchloom.operators import parsing, redaction, skills, style


def resume(spark, text, metadata=None):
    df = spark.createDataFrame([(text, metadata)], "text string, metadata map<string,string>")
    return parsing.parse_resumes(df).first()["resume"].asDict(True)


def job(spark, text, metadata=None):
    df = spark.createDataFrame([(text, metadata)], "text string, metadata map<string,string>")
    return parsing.parse_job_descriptions(df).first()["job"].asDict(True)


def test_basic_documents(spark):
    r = resume(spark, "Summary\nExperience\nML Engineer at Org - Jan 2020 - Present\n- Built pipelines")
    assert r["experience"] == [
        {"title": "ML Engineer", "company": "Org - Jan 2020 - Present", "startDate": "Jan 2020", "endDate": "Present",
         "achievements": ["Built pipelines"]}
    ]
    j = job(spark, "Data Scientist\nResponsibilities\nBuild models")
    assert j["responsibilities"] == ["Build models"] and j["summary"] == "Data Scientist"
    assert j["meta"] == {"title": "Unknown Role", "industry": "Unknown", "location": "Unknown", "source": "upload"}
    assert j["skills"] == ["Build", "Data", "Responsibilities", "Scientist"]


def test_job_title_sources(spark):
    text = "Role: Boss\nRequirements\nx\nTools\nSQL"
    assert job(spark, text)["meta"]["title"] == "Boss"
    assert job(spark, text, {"role": "Chief"})["meta"]["title"] == "Chief"
    assert job(spark, "role:\nx", {"title": "T"})["meta"]["title"] == "T"
    assert job(spark, text)["skills"] == ["SQL"]
    assert len(job(spark, "word " * 1000)["summary"]) == 4999  # whole, less the last blank
    df = spark.createDataFrame([("word " * 1000,)], "text string")
    short = parsing.parse_job_descriptions(df, metadata=None, summary_chars=2000).first()["job"]
    assert len(short["summary"]) == 2000


def test_headings_are_lines_with_a_cue(spark):
    r = resume(spark, "intro\n5 years of experience\nDev at X - Jan 2020 - Feb 2021\nSkills: many\nSQL")
    assert r["summary"] == "intro" and r["skills"] == ["SQL"] and r["experience"][0]["title"] == "Dev"


def test_untitled_role_and_lost_bullets(spark):
    r = resume(spark, "Experience\n- lost\nplain\n* kept\nA at B at C Jan 2020 – mar 2021\n•\nlast")
    assert [x["achievements"] for x in r["experience"]] == [["plain", "kept"], ["", "last"]]
    assert r["experience"][0]["title"] is None
    assert r["experience"][1]["title"] == "A" and r["experience"][1]["company"] == "C Jan 2020 – mar 2021"
    assert r["experience"][1]["endDate"] == "mar 2021"


def test_dates_may_be_part_of_a_longer_word_only_at_its_start(spark):
    r = resume(spark, "Experience\nDesk 1499 - Oct 1998 – Present\nno date 20201 - Present")
    assert (r["experience"][0]["startDate"], r["experience"][0]["endDate"]) == ("Desk 1499", "Oct 1998")
    assert r["experience"][0]["achievements"] == ["no date 20201 - Present"]


def test_one_project_at_most(spark):
    assert resume(spark, "Projects\nA: b\nmore: c\nend")["projects"] == [{"name": "A", "description": "b more: c end"}]
    assert resume(spark, "Projects\nno colon\nA: b")["projects"] == []
    assert resume(spark, "Projects\nA:\nx")["projects"] == [{"name": "A", "description": "x"}]


def test_resume_skills_are_never_derived(spark):
    assert resume(spark, "Knows SQL")["skills"] == []


def test_empty_text(spark):
    r = resume(spark, " \n ")
    assert r["summary"] == "" and r["experience"] == [] and r["skills"] == []


def test_long_forms(spark):
    df = spark.createDataFrame([(1, "a\nExperience\nX at Y - Jan 2020 - Present\n- b1\n- b2")], "id int, text string")
    labelled = {(r.section, r.line_no, r.line) for r in parsing.label_resume_sections(df).collect()}
    assert ("summary", 0, "a") in labelled and ("experience", 2, "- b2") in labelled
    parsed = parsing.parse_resumes(df, metadata=None).select("id", "resume")
    assert [(r.role_no, r.bullet_no, r.text) for r in parsing.resume_bullets(parsed).collect()] == [(0, 0, "b1"), (0, 1, "b2")]
    assert parsing.resume_roles(parsed).count() == 1
    assert {(r.section, r.lines) for r in parsing.section_sizes(df).collect()} == {("summary", 1), ("experience", 3)}


def test_style_profile(spark):
    text = "SUMMARY\nShip things\nEXPERIENCE\n- a\n* b\nSKILLS\nEDUCATION\nPROFILE"
    meta = "struct<sectionOrder:array<string>,headingCase:string,bulletStyle:string,fontFamily:string,fontSize:double,layoutDensity:string,includeSectionDividers:boolean,accentColor:string>"
    rows = [
        (0, text, (["summary", "skills"], None, "dash", "Arial", 11.0, None, True, "#fff")),
        (1, text, None),
        (2, "plain words\nmore words", (None, None, None, "", 26.9, "condensed", None, "")),
    ]
    df = spark.createDataFrame(rows, f"i int, text string, style_metadata {meta}")
    a, b, c = [r.profile for r in style.build_style_profiles(df).orderBy("i").collect()]
    assert a.fontFamily == "Arial" and a.fontSize == 22 and a.bulletStyle == "dash" and a.includeSectionDividers
    assert a.sectionOrder == ["summary", "skills", "experience", "education"]
    assert b.headingCase == "upper" and b.bulletStyle == "dash" and b.fontSize == 22 and b.layoutDensity == "spacious"
    assert b.sectionOrder == ["summary", "experience", "skills", "education"]
    assert c.sectionOrder == ["summary", "skills", "experience", "projects", "education"]
    assert c.fontFamily == "Calibri" and c.fontSize == 26 and c.headingCase == "sentence" and c.layoutDensity == "condensed"


def test_package_style(spark):
    df = spark.createDataFrame(
        [(1, ("k", {"a": "b"}, "txt")), (2, None)],
        "i int, pointer struct<s3Key:string,metadata:map<string,string>,documentType:string>",
    )
    profile = F.when(F.col("i") == 1, F.struct(F.lit("x").alias("headingCase")))
    sample = F.when(F.col("i") == 1, F.struct(F.lit("m").alias("meta"), F.lit("raw").alias("rawText")))
    one, two = [r[0] for r in df.orderBy("i").select(style.package_style(profile, sample, "pointer")).collect()]
    assert one.profile.headingCase == "x" and one.sample.rawText == "raw" and one.source.s3Key == "k"
    assert two is None


def test_skill_aggregation(spark):
    lists = spark.createDataFrame(
        [("t", "j", "job", ["SQL", " sql ", "Go", ""]), ("t", "j", "base", ["sql"]), ("t", "k", "base", ["Go"])],
        "tenantId string, jobId string, source string, skills array<string>",
    )
    ranked = skills.rank_skills(skills.aggregate_skills(lists)).orderBy("jobId", "skill_no").collect()
    assert [(r.jobId, r.skill, r.sources, r.frequency) for r in ranked] == [
        ("j", "sql", ["base", "job"], 3), ("j", "go", ["job"], 1), ("k", "go", ["base"], 1)]


def test_redaction_leaves_skills_alone(spark):
    text = "Summary\nme@x.io\nExperience\nA at B - Jan 2020 - Present\n- mail me@x.io\nSkills\nme@x.io\nProjects\nP: me@x.io"
    df = spark.createDataFrame([("r", text)], "id string, text string")
    df = parsing.parse_job_descriptions(parsing.parse_resumes(df, metadata=None), metadata=None)
    on = redaction.redact_jobs(df, True).first()
    off = redaction.redact_jobs(df).first()
    assert on.resume.summary == "[REDACTED]" and on.resume.experience[0].achievements == ["mail [REDACTED]"]
    assert on.resume.skills == ["me@x.io"] and on.resume.projects[0].description == "[REDACTED]"
    assert "me@x.io" in on.resume.rawText and off.resume.summary == "me@x.io"
