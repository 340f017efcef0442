"""One query through the whole library: question texts to formatted answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions import answers as A
from answerloom.functions import questions as Q
from answerloom.operators import aggregates as G
from catalog import query, table
from catalog.q_aggregates import A9_ANSWERS, stock_answers
from catalog.q_questions import _FORMAT_SQL

_SQL = f"""
WITH {A9_ANSWERS}
SELECT qid, nullif(regexp_extract(text, '(Q\\d+)', 1), '') AS question_id, {_FORMAT_SQL} AS answer_format, metric,
  round(answer + coalesce(length(c_name) % 7, 0), 2) AS number, CASE WHEN metric = 'first' THEN exact END AS "cell"
FROM answered LEFT JOIN customer ON user_key = c_custkey
"""


@query("flagship_answer_sheet", _SQL)
def answer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question is answered: numbers with each user's offset and formatted, first cells as they are."""
    text = F.col("text")
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_key"),
        F.lit("name_length_mod_7").alias("rule"),
        A.personal_offset(F.col("c_name"), F.lit("name_length_mod_7")).alias("offset"),
    )
    answered = stock_answers(spark, sf_dir).withColumn("personalised", F.lit(True))
    moved = G.apply_offset(answered, users, "user_key", "answer", "rule", "personalised")
    plain = F.format_string("%.6f", "answer")  # digits, not an exponent
    formatted = A.format_answer(F.when(F.col("answer").isNotNull(), plain), F.lit("number"))
    return moved.select(
        "qid",
        Q.question_id(text).alias("question_id"),
        Q.answer_format(text).alias("answer_format"),
        "metric",
        formatted["number"].alias("number"),
        F.when(F.col("metric") == "first", F.col("answer_text")).alias("cell"),
    )
