"""Answers of costly models, asked once per distinct question and kept for later runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.rows import settle
from matchloom.sources.files import Files


def answered_once(
    df: DataFrame, inputs: Sequence[str], model: Callable[..., Column], out: str, store: str, ddl: str = "string", batches: int = 1
) -> DataFrame:
    """``df`` with ``out``: the answer of ``model(*inputs)``, a column function, or null if the model has none.

    Equal inputs are one question. Questions whose answer lies in the Parquet folder ``store`` are not asked again; new
    answers are added to it, in ``batches`` jobs: a run that breaks off loses the answers of one batch at most, and the next
    run goes on behind the others. Rows meet their answers by a 256-bit hash of the inputs.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_question", T.StringType()), T.StructField(out, T._parse_datatype_string(ddl))])

    def kept() -> DataFrame:
        if not Files(spark, store).names(""):
            return spark.createDataFrame([], schema)
        # two runs at the same time may both have asked
        return spark.read.schema(schema).parquet(store).groupBy("_question").agg(F.min(out).alias(out))

    keyed = settle(df, _question=F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256))
    # as keys of a hash aggregate; the inputs follow from the hash, but picking one of them would sort whole texts
    questions = keyed.select("_question", *inputs).distinct()
    for batch in range(batches):
        some = questions.where(F.pmod(F.crc32("_question"), F.lit(batches)) == batch) if batches > 1 else questions
        new = some.join(kept().select("_question"), "_question", "left_anti")
        answers = settle(new, **{out: model(*[F.col(c) for c in inputs]).cast(ddl)}).select("_question", out)
        answers.where(F.col(out).isNotNull()).write.mode("append").parquet(store)
    return keyed.join(kept(), "_question", "left").drop("_question")
