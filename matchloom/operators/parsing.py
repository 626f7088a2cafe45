"""Raw text -> canonical job descriptions and resumes.

A document is one row, and parsing it is a chain of projections: no shuffle, no
window, no Python. Each stage is kept as a temporary column because it is used
several times; Catalyst then evaluates it once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, inline_rows, settle


def _meta(metadata: str | None, key: str) -> Column:
    if metadata is None:
        return F.lit(None).cast("string")
    return F.element_at(F.col(metadata), key)


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per stripped, non-blank line, numbered from 0 in text order."""
    keep = [c for c in df.columns if c != text]
    return explode_rows(df, keep, X.lines(text), "line", "line_no")


def first_regex_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first line that matches; null when none does.

    ``pattern`` is a Java multi-line regex over the line text of a document.
    """
    c = X.col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def parse_job_descriptions(
    df: DataFrame, text: str = "text", metadata: str | None = "metadata", out: str = "job", summary_chars: int | None = None
) -> DataFrame:
    """Add the canonical job description of ``text`` as struct column ``out``.

    The struct is built from plain fields, so a query that reads some of them does not pay for the
    others. A null text gives null fields. The summary is whole unless ``summary_chars`` limits it
    (``rules.JD_SUMMARY_CHARS`` to match documents made with that limit).
    """
    staged = settle(df, _lines=X.line_text(text))
    staged = settle(staged, _marked=X.mark_sections("_lines", R.JD_HEADINGS))
    section_skills = X.section_lines("_marked", "skills", R.JD_HEADINGS)
    role = X.nonempty(_meta(metadata, "role"))
    title = F.coalesce(
        role,
        X.nonempty(first_regex_match("_lines", R.JD_ROLE_PATTERN)),
        _meta(metadata, "title"),
        F.lit(R.UNKNOWN_TITLE),
    )
    summary = F.replace(X.strip(X.section_text("_marked", "summary", R.JD_HEADINGS)), F.lit("\n"), F.lit(" "))
    job = F.struct(
        F.struct(
            title.alias("title"),
            F.coalesce(_meta(metadata, "industry"), F.lit(R.UNKNOWN)).alias("industry"),
            F.coalesce(_meta(metadata, "location"), F.lit(R.UNKNOWN)).alias("location"),
            F.coalesce(_meta(metadata, "source"), F.lit(R.DEFAULT_SOURCE)).alias("source"),
        ).alias("meta"),
        (summary if summary_chars is None else F.substring(summary, 1, summary_chars)).alias("summary"),
        X.section_lines("_marked", "responsibilities", R.JD_HEADINGS).alias("responsibilities"),
        X.section_lines("_marked", "requirements", R.JD_HEADINGS).alias("requirements"),
        F.when(F.size("_skills") > 0, F.col("_skills"))
        .otherwise(X.skill_words("_lines"))
        .alias("skills"),
        F.array().cast("array<struct<name:string,priority:int,evidenceIndicators:array<string>>>").alias("competencies"),
        F.array().cast("array<string>").alias("keywords"),
        F.col(text).alias("rawText"),
    )
    return staged.withColumn("_skills", section_skills).withColumn(out, job).drop("_lines", "_marked", "_skills")


def label_jd_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Long form: one row per line of a job description with its section."""
    return _label(df, text, R.JD_HEADINGS)


def label_resume_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Long form: one row per line of a resume with its section."""
    return _label(df, text, R.RESUME_HEADINGS)


def section_sizes(df: DataFrame, text: str = "text", headings: list = R.RESUME_HEADINGS) -> DataFrame:
    """Number of lines per section that has any, counted inside each row (no shuffle)."""
    keep = [c for c in df.columns if c != text]
    marked = settle(df, _marked=X.mark_sections(X.line_text(text), headings))
    names = list(dict.fromkeys(["summary", *[h[0] for h in headings]]))
    counts = F.array(
        *[
            F.struct(
                F.lit(n).alias("section"),
                X.count_char(X.section_text("_marked", n, headings), "\n").cast("long").alias("lines"),
            )
            for n in names
        ]
    )
    return inline_rows(marked, keep, counts).where(F.col("lines") > 0)


def _label(df: DataFrame, text: str, headings: list) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    marked = settle(df, _marked=X.mark_sections(X.line_text(text), headings))
    names = list(dict.fromkeys(["summary", *[h[0] for h in headings]]))
    sections = F.array(
        *[F.struct(F.lit(n).alias("section"), X.section_lines("_marked", n, headings).alias("lines")) for n in names]
    )
    per_section = explode_rows(marked, keep, sections, "_s")
    return explode_rows(per_section, [*keep, F.col("_s.section").alias("section")], "_s.lines", "line", "line_no")


# --- experience -----------------------------------------------------------

_MONTH = rf"[{R.WORD}]++[{R.BLANKS}]++\p{{Nd}}{{4}}"
_DATES = rf"(?<![{R.WORD}])({_MONTH})[{R.BLANKS}]*+[–\-][{R.BLANKS}]*+(Present|{_MONTH})"
_DATED_LINE = rf"(?ium)^(?![{R.BULLETS}])(?=[^\n]*?{_DATES})"  # the first pair of dates counts


def experience_segments(section: Column | str) -> Column:
    """Lines of the experience section, cut into [lines before any role, role, role, ...].

    Each role starts with its two dates, set off by U+001D; both U+001D and the mark U+001E are
    line breaks and so cannot occur inside a line. Bullet signs are cut.
    """
    marked = F.regexp_replace(X.col(section), _DATED_LINE, "\x1e$1\x1d$2\x1d")
    # bullets before anything opened a role belong to nobody
    opened = F.regexp_replace(marked, rf"\A(?:[{R.BULLETS}][^\n]*\n)++", "")
    return F.split(F.regexp_replace(opened, rf"(?m)^[{R.BULLETS}][{R.BLANKS}]*+", ""), "\x1e")


def _role(segment: Column) -> Column:
    first = F.substring_index(segment, "\n", 1)
    header = F.substring_index(first, "\x1d", -1)
    rest = F.substr(segment, F.length(first) + 2)
    return F.struct(
        X.strip(F.substring_index(header, " at ", 1)).alias("title"),
        X.strip(F.substring_index(header, " at ", -1)).alias("company"),
        F.substring_index(first, "\x1d", 1).alias("startDate"),
        F.substring_index(F.substring_index(first, "\x1d", 2), "\x1d", -1).alias("endDate"),
        X.ended_lines(rest).alias("achievements"),
    )


def _roles(segments: Column) -> Column:
    untitled = F.array(
        F.struct(
            *[F.lit(None).cast("string").alias(n) for n in ("title", "company", "startDate", "endDate")],
            X.ended_lines(segments[0]).alias("achievements"),
        )
    )
    dated = F.transform(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), _role)
    return F.when(segments[0] != "", F.concat(untitled, dated)).otherwise(dated)


def parse_projects(section: Column | str) -> Column:
    """At most one project: its first line must hold ``name: description``; later lines
    continue the description."""
    section = X.col(section)
    first = F.substring_index(section, "\n", 1)
    rest = F.substr(section, F.length(first) + 2)
    name = F.substring_index(first, ":", 1)
    description = X.strip(F.substr(first, F.length(name) + 2))
    tail = F.replace(rest, F.lit("\n"), F.lit(" "))
    project = F.struct(
        X.strip(name).alias("name"),
        X.strip(F.concat(description, F.lit(" "), tail)).alias("description"),
    )
    return F.when(F.contains(first, F.lit(":")), F.array(project)).otherwise(
        F.array().cast(f"array<{S.PROJECT}>")
    )


def parse_resumes(
    df: DataFrame, text: str = "text", metadata: str | None = "metadata", out: str = "resume"
) -> DataFrame:
    """Add the canonical resume of ``text`` as struct column ``out``."""
    staged = (
        settle(df, _marked=X.mark_sections(X.line_text(text), R.RESUME_HEADINGS))
        .withColumn("_segments", experience_segments(X.section_text("_marked", "experience", R.RESUME_HEADINGS)))
        .withColumn("_projects", X.section_text("_marked", "projects", R.RESUME_HEADINGS))
    )
    meta = F.struct(
        *[_meta(metadata, k).alias(k) for k in ("sourceKey", "role", "industry", "outcome")],
        F.coalesce(_meta(metadata, "updatedAt"), F.date_format(F.current_date(), "yyyy-MM-dd")).alias("updatedAt"),
    )
    summary = F.replace(X.strip(X.section_text("_marked", "summary", R.RESUME_HEADINGS)), F.lit("\n"), F.lit(" "))
    resume = F.struct(
        meta.alias("meta"),
        summary.alias("summary"),
        _roles(F.col("_segments")).alias("experience"),
        X.section_lines("_marked", "education", R.RESUME_HEADINGS).alias("education"),
        X.section_lines("_marked", "skills", R.RESUME_HEADINGS).alias("skills"),
        parse_projects("_projects").alias("projects"),
        F.col(text).alias("rawText"),
    )
    return staged.withColumn(out, resume).drop("_marked", "_segments", "_projects")


def resume_roles(df: DataFrame, resume: str = "resume") -> DataFrame:
    """Long form: one row per role."""
    keep = [c for c in df.columns if c != resume]
    roles = explode_rows(df, keep, f"{resume}.experience", "role", "role_no")
    return roles.select(*keep, "role_no", "role.*")


def resume_bullets(df: DataFrame, resume: str = "resume") -> DataFrame:
    """Long form: one row per achievement."""
    keep = [c for c in df.columns if c != resume]
    roles = explode_rows(df, keep, f"{resume}.experience.achievements", "_bullets", "role_no")
    return explode_rows(roles, [*keep, "role_no"], "_bullets", "text", "bullet_no")


def all_bullets(resume: Column | str) -> Column:
    """All achievements of a resume in order, as one array."""
    experience = X.col(resume)["experience"] if not isinstance(resume, str) else F.col(f"{resume}.experience")
    lists = F.transform(
        F.coalesce(experience, F.array().cast(f"array<{S.ROLE}>")),
        lambda r: F.coalesce(r["achievements"], F.array().cast("array<string>")),
    )
    return F.flatten(lists)
