import json

from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.operators import rendering

RESUME = {
    "meta": {"role": "Designer"}, "summary": "Creative professional",
    "experience": [{"title": "Designer", "company": "Studio", "startDate": "2021", "endDate": "Present",
                    "achievements": ["Improved visual systems"]}],
    "skills": ["Figma", "", "Illustrator"], "projects": [{"name": "", "description": ""}, {"name": "P", "description": "d"}],
    "education": ["B.A. Design"],
}
PROFILE = {"sectionOrder": ["skills", "summary", "experience", "education"], "headingCase": "upper",
           "bulletStyle": "dash", "fontFamily": "Arial", "fontSize": 26}


def frame(spark, resume, profile=None, log=None):
    df = spark.createDataFrame([("t", "j", json.dumps({"resume": resume, "profile": profile, "changeLog": log}))], "tenantId string, jobId string, v string")
    schema = f"struct<resume:{S.RESUME},profile:{S.STYLE_PROFILE},changeLog:{S.CHANGE_LOG}>"
    return df.withColumn("v", F.from_json("v", schema)).select("tenantId", "jobId", "v.*")


KEYS = ["tenantId", "jobId"]


def test_text_lines_with_profile(spark):
    rows = rendering.render_text_lines(frame(spark, RESUME, PROFILE), KEYS).orderBy("line_no").collect()
    assert [r.text for r in rows] == [
        "TAILORED RESUME – DESIGNER", "SKILLS", "  - Figma", "  - ", "  - Illustrator", "SUMMARY", "Creative professional",
        "EXPERIENCE", "Designer – Studio (2021 - Present)", "  - Improved visual systems", "EDUCATION", "  - B.A. Design",
        "PROJECTS", "  - : ", "  - P: d",
    ]


def test_paragraphs_drop_empty_lines_and_escape(spark):
    resume = dict(RESUME, skills=["A&B", ""], projects=[{"name": "", "description": ""}])
    profile = dict(PROFILE, includeSectionDividers=True, fontSize=4, layoutDensity="condensed", headingCase=None)
    log = [{"type": "bullet", "detail": "<x>"}, {"detail": "y"}]
    rows = rendering.render_paragraphs(frame(spark, resume, profile, log), KEYS).orderBy("para_no").collect()
    assert [r.text for r in rows] == [
        "Tailored Resume – Designer", "Skills", "―" * 20, "- A&amp;B", "Summary", "―" * 20, "Creative professional",
        "Experience", "Designer – Studio (2021 – Present)", "- Improved visual systems", "Education", "―" * 20,
        "- B.A. Design", "Change Log", "―" * 20, "- bullet: &lt;x&gt;", "- update: y",
    ]
    assert rows[0].bold and rows[0].size == 10 and rows[0].spacing_after == 40 and rows[0].font == "Arial"
    assert not rows[3].bold


def test_defaults_and_empty_resume(spark):
    rows = rendering.render_paragraphs(frame(spark, {"summary": ""}), KEYS).collect()
    assert [(r.text, r.size, r.spacing_after, r.font) for r in rows] == [("Tailored Resume – Candidate", 26, 80, "Calibri")]


def test_experience_header_forms(spark):
    roles = [("T", "C", "a", None), ("T", None, None, "b"), (None, "C", None, None), ("T", "", "a", "b")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(roles)], "i int, r struct<title:string,company:string,startDate:string,endDate:string>")
    got = [x[0] for x in df.orderBy("i").select(rendering.experience_header(F.col("r"), F.lit("title"))).collect()]
    assert got == ["T – C (a – Present)", "T (b)", "– C", "T (a – b)"]


def test_write_texts(spark, tmp_path):
    texts = rendering.render_texts(frame(spark, RESUME, PROFILE), KEYS)
    rendering.write_texts(texts, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "tenantId=t").glob("*.txt"))
    assert text.startswith("TAILORED RESUME – DESIGNER\nSKILLS\n  - Figma")
