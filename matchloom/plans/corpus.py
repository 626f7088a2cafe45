"""Text corpora derived from the base tables, one document per row.

``documents`` has no section headings, so resumes are written from ``orders`` and job
descriptions from ``part``: each text depends on its own row only, hence a single projection
(no join, no grouping) at any scale. The same values can be read straight from the base
columns, which gives every parser a round-trip check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.parsing import parse_job_descriptions, parse_resumes

TENANTS = 7
#: Rows of text work that one task is to have at most.
TASK_ROWS = 50_000
LONG_BULLET = "repeat('long text ', 60)"

_BULLET = f"""
CASE WHEN k % 17 = 5 AND b = 0 THEN rtrim({LONG_BULLET})
     ELSE concat('Shipped ', (k * (r + 1) + b * 7) % 90 + 1, ' units for client ', c,
                 IF(b = 1, ' with extra care and planning for every single site', '')) END
"""

_ROLE = f"""
concat(
  array(IF(r = 0, concat(pr, ' lead at Desk#', c, ' - ', m, ' – Present'),
                  concat(pr, ' clerk at Shop at Dock ', r, ' ', m, ' - ', m))),
  transform(filter(array(0L, 1L, 2L), b -> b < (k + r) % 4), b -> concat(sign, ' ', {_BULLET})),
  IF(k % 5 = 0, array('Handled returns'), array())
)
"""

RESUME_LINES = f"""
concat(
  IF(k % 9 = 4, array(), array('Professional Summary')),
  array(concat('Buyer ', c, ' grew ', pr, ' accounts.'),
        concat('Closed ', p, ' in sales.',
               IF(k % 7 = 0, concat(' Write buyer', c, '@mail.example'), ''),
               IF(k % 13 = 0, concat(' Call 415-555-', lpad(CAST(c % 10000 AS STRING), 4, '0')), ''))),
  array(IF(k % 10 = 3, 'WORK EXPERIENCE', 'Experience')),
  CASE WHEN k % 8 = 1 THEN array('- Lost note')
       WHEN k % 8 = 2 THEN array('Worked freelance', concat(sign, 'Built ', k, ' boards'))
       ELSE array() END,
  flatten(transform(filter(array(0L, 1L, 2L), r -> r < k % 4), r -> {_ROLE})),
  array('Education', 'BSc'),
  IF(k % 2 = 0, array('MSc Trade'), array()),
  IF(k % 11 = 0, array(), concat(
    array('Skills'),
    CASE k % 4 WHEN 0 THEN array('SQL', 'Python') WHEN 1 THEN array('Python', 'Excel', 'SQL')
               WHEN 2 THEN array('excel', 'Planning') ELSE array('SQL', 'Rust', 'SQL') END,
    array(concat('Audit ', k % 50, ' depots')))),
  CASE k % 3 WHEN 0 THEN array('Projects', concat('Ledger ', c, ': moved ', p, ' rows'), concat('and kept ', k, ' books'))
             WHEN 1 THEN array('Projects', 'no colon here') ELSE array() END
)
"""

_SEPARATOR = "CASE k % 6 WHEN 1 THEN '\\r\\n' WHEN 2 THEN '\\n \\n  ' ELSE '\\n' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame) -> int:
    """Tasks for text work on each row of a table: all cores, and so many that none has more than ``TASK_ROWS``. The
    count reads the footers of the files only."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table that comes as fewer splits than ``tasks_for`` asks.

    Text work per row is heavy: a file of one row group would keep one core busy, and a split of 128 MB of
    slim rows holds millions of texts to be written and parsed.
    """
    wanted = tasks_for(df)
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def resume_texts(orders: DataFrame, *carried: str) -> DataFrame:
    """(tenantId, jobId, k, jd_key, metadata, text): one resume per order, beside the columns ``carried`` along."""
    base = orders.select(
        *carried,
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.floor("o_totalprice").cast("long").alias("p"),
        F.col("o_orderpriority").alias("pr"),
        F.date_format("o_orderdate", "MMM yyyy").alias("m"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.expr("element_at(array('-', '•', '*'), CAST(o_orderkey % 3 AS INT) + 1)").alias("sign"),
    )
    return base.select(
        F.concat(F.lit("t"), F.col("c") % TENANTS).alias("tenantId"),
        F.concat(F.lit("j"), "k").alias("jobId"),
        "k",
        F.col("c").alias("jd_key"),
        F.create_map(
            F.lit("role"), F.concat("pr", F.lit(" buyer")), F.lit("updatedAt"), F.col("d")
        ).alias("metadata"),
        F.expr(f"array_join({RESUME_LINES}, {_SEPARATOR})").alias("text"),
        *carried,
    )


JD_LINES = """
concat(
  array(IF(pk % 3 = 0, concat(ty, ' ', name, ' planner wanted'), concat('Role: ', ty, ' ', name, ' planner')),
        concat('Team moves ', name, ' stock.'),
        IF(pk % 4 = 1, 'What You''ll Do', 'Responsibilities'),
        concat('Plan ', brand, ' shipments'),
        concat('Audit ', size, ' depots'),
        IF(pk % 4 = 2, 'Key Requirements', 'Qualifications'),
        concat('Knows ', ty, ' stock'),
        concat(size, ' years of ', name, ' trade')),
  IF(pk % 5 = 0, array(), array('Skills & tools', 'SQL', 'Python')),
  IF(pk % 5 <> 0 AND pk % 2 = 0, array('Excel'), array()),
  IF(pk % 5 <> 0 AND pk % 7 = 0, array(brand), array())
)
"""


def jd_texts(part: DataFrame) -> DataFrame:
    """(pk, metadata, text): one job description per part."""
    base = part.select(
        F.col("p_partkey").alias("pk"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("ty"),
        F.col("p_size").alias("size"),
    )
    metadata = F.map_filter(
        F.create_map(
            F.lit("role"), F.when(F.col("pk") % 6 == 0, F.concat(F.lit("Head of "), "name")),
            F.lit("industry"), F.when(F.col("pk") % 2 == 0, F.col("ty")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return base.select("pk", metadata.alias("metadata"), F.expr(f"array_join({JD_LINES}, '\\n')").alias("text"))


def resume_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume_texts(spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def jd_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd_texts(spread(table(spark, sf_dir, "part"), "p_partkey"))


def parsed_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_resumes(resume_corpus(spark, sf_dir)).drop("metadata", "text")


def parsed_jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_job_descriptions(jd_corpus(spark, sf_dir)).drop("metadata", "text")


def jobs(spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(tenantId, jobId, k, jd_key, resume, job): each resume with the description it answers, and with the columns that
    ``prepare`` adds to the descriptions.

    A description shared by very many jobs is parsed once, before the join; Spark broadcasts it while it is small and
    splits hot keys (AQE) when it is not. Resumes are written and parsed behind the join, which thus moves and sorts the
    few columns of an order only; its rows are dealt out again for that work, whatever partitions the join leaves.
    """
    orders = table(spark, sf_dir, "orders")
    descriptions = parsed_jds(spark, sf_dir)
    descriptions = prepare(descriptions) if prepare else descriptions
    joined = orders.join(descriptions, F.col("o_custkey") == F.col("pk"))
    dealt = joined.repartition(tasks_for(orders), "o_orderkey")
    carried = [c for c in descriptions.columns if c != "pk"]
    return parse_resumes(resume_texts(dealt, *carried)).drop("metadata", "text")
