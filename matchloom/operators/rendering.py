"""Resume -> ordered lines and paragraphs. The sections of one resume are laid out inside its row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import explode_rows, settle

_LINES = "array<struct<section:string,kind:string,text:string>>"
_STRINGS = "array<string>"


def order_sections(preferred: Column | str, available: Sequence[str] = tuple(R.DEFAULT_SECTION_ORDER)) -> Column:
    """Preferred sections that are available, in preferred order, then the rest."""
    avail = F.array(*[F.lit(s) for s in available])
    pref = F.coalesce(X.col(preferred), F.array().cast(_STRINGS))
    return F.array_distinct(F.concat(F.array_intersect(pref, avail), avail))


def _by_case(case: Column, upper: Column, title: Column, other: Column) -> Column:
    return F.when(case == "upper", upper).when(case == "title", title).otherwise(other)


def render_header(role: Column, case: Column) -> Column:
    name = F.coalesce(X.nonempty(role), F.lit("Candidate"))
    return F.concat(
        F.when(case == "upper", "TAILORED RESUME – ").otherwise("Tailored Resume – "),
        _by_case(case, F.upper(name), X.title_case(name), name),
    )


def section_heading(name: str | Column, case: Column) -> Column:
    base = F.lit(name) if isinstance(name, str) else name
    base = F.when(F.contains(base, F.lit(" ")), base).otherwise(F.replace(base, F.lit("_"), F.lit(" ")))
    base = F.coalesce(X.nonempty(X.strip(base)), base)
    return _by_case(case, F.upper(base), X.title_case(base), X.capitalise(base))


def experience_header(role: Column, case: Column) -> Column:
    """``title – company (start – end)`` without the parts that are missing."""
    title, company, start, end = (
        F.coalesce(role[n], F.lit("")) for n in ("title", "company", "startDate", "endDate")
    )
    dash = F.when(case == "upper", "-").otherwise("–")
    # a missing end reads as the present as soon as there is a start
    dates = (
        F.when(start != "", F.concat(F.lit(" ("), start, F.lit(" "), dash, F.lit(" "), F.coalesce(X.nonempty(end), F.lit("Present")), F.lit(")")))
        .when(end != "", F.concat(F.lit(" ("), end, F.lit(")")))
        .otherwise("")
    )
    company_part = F.when(company != "", F.concat(F.lit(" – "), company)).otherwise("")
    return X.strip(F.concat(title, company_part, dates))


def bullet_symbol(style: Column) -> Column:
    out = F.lit(R.DEFAULT_BULLET_SYMBOL)
    for name, symbol in R.BULLET_SYMBOLS.items():
        out = F.when(style == name, symbol).otherwise(out)
    return out


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column, ddl: str = _STRINGS) -> Column:
    return F.coalesce(c, F.array().cast(ddl))


def _line(section: str, kind: str, text: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(kind).alias("kind"), text.alias("text"))


def _sections(
    resume: Column,
    case: Column,
    bullet: Callable[[Column], Column],
    block: Callable[[str, str, Column, bool], Column],
    keep_empty_projects: bool,
) -> dict[str, Column]:
    """Lines of each section; ``block(section, heading, items, bulleted)`` lays out the plain ones."""
    none = F.array().cast(_LINES)

    def role_lines(role):
        head = F.array(_line("experience", "role", experience_header(role, case)))
        return F.concat(
            head, F.transform(_list(role["achievements"]), lambda b: _line("experience", "bullet", bullet(b)))
        )

    roles = _list(resume["experience"], f"array<{S.ROLE}>")
    experience = F.concat(
        F.array(_line("experience", "heading", section_heading("Experience", case))),
        F.flatten(F.transform(roles, role_lines)),
    )
    projects = _list(resume["projects"], f"array<{S.PROJECT}>")
    named = (
        projects
        if keep_empty_projects
        else F.filter(projects, lambda p: (_text(p["name"]) != "") | (_text(p["description"]) != ""))
    )
    project_lines = F.transform(named, lambda p: F.concat(_text(p["name"]), F.lit(": "), _text(p["description"])))

    def present(condition, lines):
        return F.when(condition, lines).otherwise(none)

    return {
        "summary": present(
            _text(resume["summary"]) != "", block("summary", "Summary", F.array(_text(resume["summary"])), False)
        ),
        "skills": present(F.size(_list(resume["skills"])) > 0, block("skills", "Skills", _list(resume["skills"]), True)),
        "experience": present(F.size(roles) > 0, experience),
        "projects": present(F.size(projects) > 0, block("projects", "Projects", project_lines, True)),
        "education": present(
            F.size(_list(resume["education"])) > 0, block("education", "Education", _list(resume["education"]), True)
        ),
    }


def _change_lines(change_log: Column) -> Column:
    return F.transform(
        _list(change_log, S.CHANGE_LOG),
        lambda e: F.concat(F.coalesce(e["type"], F.lit("update")), F.lit(": "), _text(e["detail"])),
    )


def _profile(df: DataFrame, profile: str | None, resume: str) -> DataFrame:
    col = F.lit(None).cast(S.STYLE_PROFILE) if profile is None else F.col(profile).cast(S.STYLE_PROFILE)
    df = settle(df, **{resume: F.col(resume), "_p": col})
    return settle(
        df,
        _case=F.coalesce(X.nonempty(F.col("_p.headingCase")), F.lit("title")),
        _symbol=bullet_symbol(F.coalesce(F.col("_p.bulletStyle"), F.lit("bullet"))),
        _order=order_sections(F.col("_p.sectionOrder")),
    )


def _in_order(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """Add ``_body``: the lines of all sections in the row's order, each section laid out once."""
    table = F.create_map(*[x for name, c in sections.items() for x in (F.lit(name), c)])
    staged = settle(df, _table=table)
    return staged.withColumn("_body", F.flatten(F.transform("_order", lambda s: F.element_at(F.col("_table"), s))))


def _text_layout(df: DataFrame, resume: str, change_log: str | None, profile: str | None) -> DataFrame:
    """Add ``_all``: every line of the plain text form, in order."""
    staged = _profile(df, profile, resume)
    case = F.col("_case")

    def bullet(t):
        return F.concat(F.lit("  "), F.col("_symbol"), F.lit(" "), _text(t))

    def block(section, heading, items, bulleted):
        head = F.array(_line(section, "heading", section_heading(heading, case)))
        kind = "bullet" if bulleted else "body"
        return F.concat(head, F.transform(items, lambda t: _line(section, kind, bullet(t) if bulleted else _text(t))))

    header = F.array(_line("header", "header", render_header(F.col(f"{resume}.meta.role"), case)))
    log = F.col(change_log).cast(S.CHANGE_LOG) if change_log else F.lit(None).cast(S.CHANGE_LOG)
    changes = F.when(
        F.size(_list(log, S.CHANGE_LOG)) > 0, block("change_log", "Change Log", _change_lines(log), True)
    ).otherwise(F.array().cast(_LINES))
    staged = _in_order(staged, _sections(F.col(resume), case, bullet, block, keep_empty_projects=True))
    return staged.withColumn("_all", F.concat(header, F.col("_body"), changes))


def render_text_lines(
    df: DataFrame,
    keys: Sequence[str],
    resume: str = "resume",
    change_log: str | None = "changeLog",
    profile: str | None = "profile",
) -> DataFrame:
    """Plain text form: (keys, line_no, section, kind, text); bullets are indented by two blanks."""
    laid_out = _text_layout(df, resume, change_log, profile)
    return explode_rows(laid_out, keys, "_all", "_l", "line_no").select(*keys, "line_no", "_l.*")


def render_texts(
    df: DataFrame,
    keys: Sequence[str],
    resume: str = "resume",
    change_log: str | None = "changeLog",
    profile: str | None = "profile",
) -> DataFrame:
    """Plain text form, whole: (keys, text), joined inside the row."""
    laid_out = _text_layout(df, resume, change_log, profile)
    return laid_out.select(*keys, F.array_join(F.col("_all.text"), "\n").alias("text"))


def render_paragraphs(
    df: DataFrame,
    keys: Sequence[str],
    resume: str = "resume",
    change_log: str | None = "changeLog",
    profile: str | None = "profile",
) -> DataFrame:
    """Paragraph form: (keys, para_no, section, kind, text, bold, font, size, spacing_after), text escaped."""
    staged = _profile(df, profile, resume)
    case = F.col("_case")

    def bullet(t):
        return F.concat(F.col("_symbol"), F.lit(" "), _text(t))

    def block(section, heading, items, bulleted):
        kept = F.filter(items, lambda t: t.isNotNull() & (t != ""))
        kind = "bullet" if bulleted else "body"
        divider = F.when(
            F.col("_p.includeSectionDividers"), F.array(_line(section, "divider", F.lit(R.DIVIDER)))
        ).otherwise(F.array().cast(_LINES))
        lines = F.transform(kept, lambda t: _line(section, kind, bullet(t) if bulleted else t))
        head = F.array(_line(section, "heading", section_heading(heading, case)))
        return F.when(F.size(kept) > 0, F.concat(head, divider, lines)).otherwise(F.array().cast(_LINES))

    header = F.array(_line("header", "header", render_header(F.col(f"{resume}.meta.role"), case)))
    log = F.col(change_log).cast(S.CHANGE_LOG) if change_log else F.lit(None).cast(S.CHANGE_LOG)
    staged = _in_order(staged, _sections(F.col(resume), case, bullet, block, keep_empty_projects=False))
    changes = block("change_log", "Change Log", _change_lines(log), True)
    density = F.coalesce(F.col("_p.layoutDensity"), F.lit("balanced"))
    spacing = F.lit(R.DEFAULT_SPACING_AFTER)
    for name, value in R.SPACING_AFTER.items():
        spacing = F.when(density == name, value).otherwise(spacing)
    base_size = F.coalesce(F.col("_p.fontSize"), F.lit(R.DEFAULT_FONT_SIZE))
    laid_out = staged.withColumn("_all", F.concat(header, F.col("_body"), changes))
    keep = [
        *keys,
        F.coalesce("_p.fontFamily", F.lit(R.DEFAULT_FONT)).alias("font"),
        base_size.alias("_size"),
        spacing.alias("spacing_after"),
    ]
    long = explode_rows(laid_out, keep, "_all", "_l", "para_no")
    extra = F.when(F.col("_l.kind") == "header", R.HEADER_SIZE_DELTA).otherwise(0)
    return long.select(
        *keys,
        "para_no",
        "_l.section",
        "_l.kind",
        X.escape_xml("_l.text").alias("text"),
        F.col("_l.kind").isin("header", "heading", "role").alias("bold"),
        "font",
        F.greatest(F.lit(R.MIN_FONT_SIZE), F.col("_size") + extra).alias("size"),
        "spacing_after",
    )


def write_texts(texts: DataFrame, path: str, partition: str = "tenantId") -> None:
    """Rendered texts (output of :func:`render_texts`) as text files below one folder per tenant."""
    texts.select(partition, F.col("text").alias("value")).write.mode("append").partitionBy(partition).text(path)
