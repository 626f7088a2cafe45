"""Prompt rows, model output parsing and the five-stage generation chain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import rules as R
from matchloom import schemas as S
from matchloom.functions import text as X
from matchloom.functions.rows import inline_rows, settle
from matchloom.session import materialise
from matchloom.sources.answers import answered_once

KEYS = ("tenantId", "jobId")
_JSON = {"ignoreNullFields": "false"}


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates from one JSON object: (name, description, template, stopSequences)."""
    raw = spark.read.text(path, wholetext=True)
    table = F.from_json("value", S.PROMPTS, {"mode": "FAILFAST"})
    return raw.select(F.explode(table).alias("name", "p")).select(
        "name", "p.description", "p.template", F.coalesce("p.stopSequences", F.array().cast("array<string>")).alias("stopSequences")
    )


def fill_template(template: Column | str, variables: Column | str) -> Column:
    """Put map values for ``{name}``; doubled braces stand for themselves.

    The template is cut into pieces once, so braces inside a value are never read again.
    """
    pieces = F.regexp_extract_all(X.col(template), F.lit(r"\{\{|\}\}|\{\w+\}|[^{}]+"), F.lit(0))
    values = X.col(variables)

    def piece(p):
        name = F.regexp_extract(p, r"^\{(\w+)\}$", 1)
        missing = F.raise_error(F.concat(F.lit("no value for prompt variable "), name)).cast("string")
        return (
            F.when(p == "{{", "{")
            .when(p == "}}", "}")
            .when(name != "", F.coalesce(F.element_at(values, name), missing))
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, piece), "")


def build_prompts(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Join (keys, stage, variables map) with the templates and fill them in.

    A stage without a template is an error. The template table is tiny and Spark picks the
    broadcast by its size.
    """
    named = prompts.select(F.col("name").alias("stage"), "template", "stopSequences")
    joined = rows.join(named, "stage", "left")
    template = F.coalesce(
        "template", F.raise_error(F.concat(F.lit("unknown prompt "), F.col("stage"))).cast("string")
    )
    staged = settle(joined, variables=F.col("variables"), template=template)
    return staged.withColumn("prompt", fill_template("template", "variables")).drop("template", "variables")


def as_json(c: Column) -> Column:
    return F.to_json(c, _JSON)


def stage_variables(stage: str) -> dict[str, Column]:
    """The variables of one stage over the wide job row (a JSON string each)."""

    def field(name, empty):
        return F.coalesce(as_json(F.col(name)), F.lit(empty))

    style = F.coalesce(as_json(F.col("profile")), F.lit("{}"))

    def options(**parts):
        body = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in parts.items()])
        return F.concat(F.lit("{"), body, F.lit("}"))

    def quoted(c):
        # to_json of a one-element array without its brackets is the JSON string
        text = F.to_json(F.array(c))
        return F.substr(text, F.lit(2), F.length(text) - 2)

    tone = F.coalesce("options.tone", F.lit(R.DEFAULT_TONE))
    length = F.coalesce("options.length", F.lit(R.DEFAULT_LENGTH))
    keywords = F.coalesce(as_json(F.col("options.keywords")), F.lit("[]"))
    letter = F.coalesce("options.includeCoverLetter", F.lit(False)).cast("string")
    outputs = {n: F.col(f"out_{n}") for n in R.PROMPT_STAGES}
    table = {
        "competency_extraction": lambda: {"jobDescription": field("job", "{}")},
        "experience_alignment": lambda: {
            "competencies": F.coalesce(F.get_json_object(outputs["competency_extraction"], "$.competencies"), F.lit("[]")),
            "baseResume": field("resume", "{}"),
            "validatedResumes": field("validated", "[]"),
            "retrievedChunks": field("chunks", "[]"),
        },
        "bullet_rewrite": lambda: {
            "alignmentPlan": outputs["experience_alignment"],
            "options": options(tone=quoted(tone), keywords=keywords, styleGuide=style),
        },
        "skills_harmonization": lambda: {
            "extractedSkills": field("skills", "[]"),
            "alignmentPlan": outputs["experience_alignment"],
            "bulletRewrites": outputs["bullet_rewrite"],
        },
        "consistency_check": lambda: {
            "jobDescription": field("job", "{}"),
            "baseResume": field("resume", "{}"),
            "rewrittenBullets": outputs["bullet_rewrite"],
            "skills": outputs["skills_harmonization"],
            "options": options(length=quoted(length), includeCoverLetter=letter, styleGuide=style),
            "styleGuide": style,
        },
    }
    return table[stage]()


def stage_rows(jobs: DataFrame, stage: str) -> DataFrame:
    pairs = [x for name, value in stage_variables(stage).items() for x in (F.lit(name), value)]
    return jobs.withColumn("stage", F.lit(stage)).withColumn("variables", F.create_map(*pairs))


# --- model output ---------------------------------------------------------

def extract_output(payload: Column | str) -> Column:
    """Text of a model response: first result's ``outputText`` or ``text``, else the top-level
    ``outputText``, else the response itself."""
    payload = X.col(payload)

    def full(path):
        value = F.get_json_object(payload, path)
        return F.when(value.rlike(r"^\[\s*\S") & ~value.rlike(r"^\[\s*\]$"), value)

    def entry(path):
        # 'results' counts when it holds anything; 'output' is looked at only otherwise
        return F.coalesce(
            X.nonempty(F.get_json_object(payload, f"$.{path}[0].outputText")),
            F.get_json_object(payload, f"$.{path}[0].text"),
            F.lit(""),
        )

    return (
        F.when(full("$.results").isNotNull(), entry("results"))
        .when(full("$.output").isNotNull(), entry("output"))
        .otherwise(F.coalesce(F.get_json_object(payload, "$.outputText"), payload))
    )


def parse_model_json(df: DataFrame, schema: str, raw: str = "raw", out: str = "data") -> tuple[DataFrame, DataFrame]:
    """(rows with parsed ``out``, rejects with the text and an error). ``schema`` is a struct DDL."""
    body = schema.strip()
    if not body.startswith("struct<"):
        raise ValueError("schema must be a struct")
    with_corrupt = body[:-1] + ",_corrupt:string>"
    parsed = settle(
        df, _parsed=F.from_json(raw, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    good = parsed.where(~bad).withColumn(out, F.col("_parsed").dropFields("_corrupt")).drop("_parsed")
    rejects = parsed.where(bad).withColumn(
        "error", F.concat(F.lit("no valid JSON: "), F.coalesce(raw, F.lit("")))
    ).drop("_parsed")
    return good, rejects


def generation_result(df: DataFrame, data: str = "data", include_cover: Column | None = None) -> DataFrame:
    """Add tailoredResume, changeLog (default []) and coverLetter (only if asked for)."""
    asked = include_cover if include_cover is not None else F.col("options.includeCoverLetter")
    return (
        df.withColumn("tailoredResume", F.col(f"{data}.tailoredResume"))
        .withColumn("changeLog", F.coalesce(f"{data}.changeLog", F.array().cast(S.CHANGE_LOG)))
        .withColumn("coverLetter", F.when(F.coalesce(asked, F.lit(False)), F.col(f"{data}.coverLetter")))
    )


def prompt_metadata(df: DataFrame, model: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (job, stage) with model, settings and raw response."""
    raws = F.array(
        *[F.struct(F.lit(s).alias("stage"), F.col(f"out_{s}").alias("rawResponse")) for s in R.PROMPT_STAGES]
    )
    return inline_rows(df, keys, raws).select(
        *keys,
        "stage",
        F.lit(model).alias("model"),
        F.lit(R.TEMPERATURE).alias("temperature"),
        F.lit(R.MAX_TOKENS).alias("maxTokens"),
        "rawResponse",
    )


def run_stage(
    jobs: DataFrame,
    prompts: DataFrame,
    stage: str,
    generate: Callable[[Column, Column], Column],
    durable: bool = True,
) -> DataFrame:
    """Add ``out_<stage>``: the model's answer to this stage's prompt.

    ``generate(prompt, stop_sequences)`` is a column function, for example a pandas UDF. The
    answers are written out before the next stage reads them: a model call must not be
    repeated because an executor was lost.
    """
    asked = build_prompts(stage_rows(jobs, stage), prompts)
    # the model is asked once per row, and its answers are kept before anything is checked
    raw = asked.withColumn("_answer", generate(F.col("prompt"), F.col("stopSequences")))
    raw = materialise(raw, f"stage-{stage}") if durable else settle(asked, _answer=generate(F.col("prompt"), F.col("stopSequences")))
    out = settle(raw.drop("prompt", "stopSequences", "stage"), **{f"out_{stage}": extract_output(F.col("_answer"))}).drop("_answer")
    return out.withColumn(
        f"out_{stage}",
        F.when(F.try_parse_json(f"out_{stage}").isNotNull(), F.col(f"out_{stage}")).otherwise(
            F.raise_error(
                F.concat(F.lit(f"prompt {stage} did not return valid JSON: "), F.col(f"out_{stage}"))
            ).cast("string")
        ),
    )


def run_chain(
    jobs: DataFrame, prompts: DataFrame, generate: Callable[[Column, Column], Column], durable: bool = True
) -> DataFrame:
    """All five stages in order, then the parsed result columns."""
    for stage in R.PROMPT_STAGES:
        jobs = run_stage(jobs, prompts, stage, generate, durable)
    data = F.from_json(f"out_{R.PROMPT_STAGES[-1]}", S.GENERATION)
    return generation_result(jobs.withColumn("data", data)).drop("data")


REJECTS = "stage string, raw string, error string"


def generate_all(
    jobs: DataFrame, prompts: DataFrame, generate: Callable[[Column, Column], Column], store: str, batches: int = 1,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(finished jobs, rejects) of the five stages. A bad answer ends its own job only, as a row (keys, stage, raw, error).

    Answers are kept below ``store`` by stage and prompt: a run that starts again asks only what has no answer yet, and
    jobs with equal prompts share one.
    """
    rejects = []
    for stage in R.PROMPT_STAGES:
        out = f"out_{stage}"
        asked = build_prompts(stage_rows(jobs, stage), prompts)
        said = answered_once(asked, ["prompt", "stopSequences"], generate, "_answer", f"{store.rstrip('/')}/{stage}", batches=batches)
        read = settle(said.drop("prompt", "stopSequences", "stage"), **{out: extract_output(F.col("_answer"))})
        # written, for the next stage and the rejects both read it
        read = materialise(read.withColumn("_valid", F.coalesce(F.try_parse_json(out).isNotNull(), F.lit(False))), f"stage-{stage}")
        error = F.when(F.col("_answer").isNull(), F.lit("no answer")).otherwise(F.concat(F.lit("no valid JSON: "), F.col(out)))
        bad = read.where("not _valid")
        rejects.append(bad.select(*keys, F.lit(stage).alias("stage"), F.col(out).alias("raw"), error.alias("error")))
        jobs = read.where("_valid").drop("_valid", "_answer")
    good, bad = parse_model_json(jobs, S.GENERATION, out)
    rejects.append(bad.select(*keys, F.lit(R.PROMPT_STAGES[-1]).alias("stage"), F.col(out).alias("raw"), "error"))
    return generation_result(good).drop("data"), reduce(DataFrame.unionByName, rejects)
