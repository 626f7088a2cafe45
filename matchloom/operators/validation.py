"""Rule checks of generated resumes. Each rule is a predicate that yields issue structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, settle
from matchloom.operators.matching import contained
from matchloom.operators.parsing import all_bullets

_STRINGS = "array<string>"


def _issue(code: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), message.alias("message"))


def _none() -> Column:
    return F.array().cast(S.ISSUES)


def _when(condition: Column, *issues: Column) -> Column:
    return F.when(condition, F.array(*issues)).otherwise(_none())


def _list(c: Column, ddl: str = _STRINGS) -> Column:
    return F.coalesce(c, F.array().cast(ddl))


def _missing_sections(resume: Column) -> Column:
    empty = {
        "summary": F.coalesce(resume["summary"], F.lit("")) == "",
        "experience": F.size(_list(resume["experience"], f"array<{S.ROLE}>")) == 0,
        "skills": F.size(_list(resume["skills"])) == 0,
    }
    found = [F.when(empty[s], _issue("MISSING_SECTION", f"Required section '{s}' is missing")) for s in R.REQUIRED_SECTIONS]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def _role_issues(role: Column, index: Column) -> Column:
    bullets = _list(role["achievements"])
    nothing = _when(
        F.size(bullets) == 0,
        _issue("EMPTY_ACHIEVEMENTS", F.concat(F.lit("Experience item "), index.cast("string"), F.lit(" missing achievements"))),
    )

    def bullet_issues(b):
        start = F.left(b, F.lit(R.BULLET_EXCERPT_CHARS))
        too_long = F.when(
            F.length(b) > R.MAX_BULLET_CHARS,
            _issue("BULLET_TOO_LONG", F.concat(F.lit(f"Achievement exceeds {R.MAX_BULLET_CHARS} characters: "), start)),
        )
        no_metric = F.when(
            ~b.rlike(r"\p{Nd}"), _issue("NO_METRIC", F.concat(F.lit("Achievement lacks metric: "), start))
        )
        return F.filter(F.array(too_long, no_metric), lambda i: i.isNotNull())

    return F.concat(nothing, F.flatten(F.transform(bullets, bullet_issues)))


def duplicate_skills(skills: Column) -> Column:
    """Skills that occur more than once as written, reported in lower case, sorted."""
    skills = _list(skills)
    counted = F.filter(
        F.array_distinct(skills), lambda s: F.size(F.filter(skills, lambda t: t == s)) > 1
    )
    return F.sort_array(F.array_distinct(F.transform(counted, F.lower)))


def _skill_issues(skills: Column) -> Column:
    repeated = duplicate_skills(skills)
    listed = F.concat(F.lit("['"), F.array_join(repeated, "', '"), F.lit("']"))
    return (
        F.when(F.size(_list(skills)) == 0, F.array(_issue("NO_SKILLS", "Skills section is empty")))
        # the pairwise count runs only where a repeat exists at all
        .when(
            F.size(F.array_distinct(skills)) < F.size(skills),
            F.array(_issue("DUPLICATE_SKILL", F.concat(F.lit("Duplicate skills detected: "), listed))),
        )
        .otherwise(_none())
    )


def is_empty_resume(resume: Column) -> Column:
    """Null, or every field of the payload null."""
    return resume.isNull() | (F.to_json(resume) == "{}")


def resume_issues(resume: Column | str, resume_json: Column | str | None = None) -> Column:
    resume = X.col(resume)
    payload = F.to_json(resume) if resume_json is None else X.col(resume_json)
    roles = _list(resume["experience"], f"array<{S.ROLE}>")
    checks = F.concat(
        _missing_sections(resume),
        F.flatten(F.transform(roles, _role_issues)),
        _skill_issues(resume["skills"]),
        _when(X.has_email(payload), _issue("PII_EMAIL", "Email detected in tailored resume")),
        _when(X.has_phone(payload), _issue("PII_PHONE", "Phone number detected in tailored resume")),
    )
    empty = F.array(_issue("EMPTY_RESUME", "Tailored resume payload missing or invalid"))
    return F.when(resume.isNull() | (payload == "{}"), empty).otherwise(checks)


def change_log_issues(change_log: Column | str) -> Column:
    entries = _list(X.col(change_log), S.CHANGE_LOG)

    def entry_issues(e, i):
        at = F.concat(F.lit("Change log entry "), i.cast("string"))
        form = F.when(
            e["type"].isNull() | e["detail"].isNull(),
            _issue("CHANGE_LOG_FORMAT", F.concat(at, F.lit(" missing type/detail"))),
        )
        reason = F.when(e["rationale"].isNull(), _issue("CHANGE_LOG_RATIONALE", F.concat(at, F.lit(" missing rationale"))))
        return F.filter(F.array(form, reason), lambda x: x.isNotNull())

    return F.flatten(F.transform(entries, entry_issues))


def cover_letter_issues(cover_letter: Column | str) -> Column:
    letter = X.col(cover_letter)
    tone = X.nonempty(letter["tone"])
    return F.when(letter.isNull(), _none()).otherwise(
        F.concat(
            _when(
                F.length(F.coalesce(letter["body"], F.lit(""))) > R.MAX_COVER_CHARS,
                _issue("COVER_LENGTH", f"Cover letter exceeds {R.MAX_COVER_CHARS} characters"),
            ),
            _when(
                F.coalesce(~tone.isin(R.COVER_TONES), F.lit(False)),
                _issue("COVER_TONE", F.concat(F.lit("Unsupported tone '"), tone, F.lit("'"))),
            ),
        )
    )


def banned_claim_issues(resume_json: Column | str, keywords: Sequence[str]) -> Column:
    """Row form for a configured word list: one issue per keyword found in the JSON text."""
    payload = F.lower(X.col(resume_json))
    found = [
        F.when(F.contains(payload, F.lower(F.lit(k))), _issue("BANNED_CLAIM", f"Banned keyword present: {k}"))
        for k in sorted(set(keywords))
    ]
    if not found:
        return _none()
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def banned_claims(
    resumes: DataFrame, keywords: DataFrame, keys: Sequence[str], payload: str = "payload", force_index: bool = False
) -> DataFrame:
    """Table form for a keyword table of any size: (keys, keyword) per keyword contained in the payload."""
    texts = resumes.select(F.struct(*keys).alias("_key"), F.lower(payload).alias("text"))
    # a struct id keeps any key shape; it is opened again below
    texts = texts.select(F.to_json("_key").alias("text_id"), "text")
    words = keywords.select(F.col("keyword").alias("needle_id"), F.lower("keyword").alias("needle"))
    found = contained(texts, words, pairs=True, force_index=force_index)
    key_type = resumes.select(F.struct(*keys).alias("k")).schema["k"].dataType
    return found.select(F.from_json("text_id", key_type).alias("k"), F.col("needle_id").alias("keyword")).select(
        *[F.col(f"k.{k}").alias(k) for k in keys], "keyword"
    )


def validate_resumes(
    df: DataFrame,
    resume: str = "resume",
    change_log: str | None = "changeLog",
    cover_letter: str | None = "coverLetter",
    banned: Sequence[str] = (),
    coverage: str | None = None,
) -> DataFrame:
    """Add ``issues`` (in rule order), ``status`` and the metrics to each row."""
    staged = settle(df, **{resume: F.col(resume)})
    staged = settle(staged, _json=F.to_json(resume))
    parts = [resume_issues(resume, "_json")]
    if change_log:
        parts.append(change_log_issues(change_log))
    if cover_letter:
        parts.append(cover_letter_issues(cover_letter))
    if banned:
        parts.append(F.coalesce(banned_claim_issues("_json", banned), _none()))
    metrics = F.struct(
        F.coalesce(F.size(all_bullets(resume)), F.lit(0)).alias("bulletCount"),
        F.size(_list(F.col(f"{resume}.skills"))).alias("skillsCount"),
        (F.col(coverage) if coverage else F.lit(None).cast("string")).alias("jdCoverage"),
    )
    return (
        settle(staged, issues=F.concat(*parts))
        .withColumn("status", validation_status("issues"))
        .withColumn("metrics", metrics)
        .drop("_json")
    )


def validation_status(issues: Column | str) -> Column:
    return F.when(F.size(X.col(issues)) == 0, "PASSED").otherwise("FAILED")


def explode_issues(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: (keys, ord, code, message)."""
    return explode_rows(validated, keys, "issues", "issue", "ord").select(*keys, "ord", "issue.*")


def gate(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go on to rendering, rows that failed)."""
    return validated.where(F.col("status") == "PASSED"), validated.where(F.col("status") != "PASSED")
