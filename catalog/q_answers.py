"""Queries that format, check and grade tables of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import answers as A
from answerloom.operators.answers import grading_summary
from catalog import query, table, wide_table
from catalog.derived import ANSWERS, RESPONSES, derived
from catalog.q_questions import _UNFENCED

_CLEAN = f"SELECT id, format, {_UNFENCED} AS clean FROM ({ANSWERS})"
_NUMBERS = rf"""
SELECT id, format, clean, digits,
  CASE WHEN digits IS NULL THEN 'text' WHEN contains(digits, '.') THEN 'decimal' ELSE 'integer' END AS kind
FROM (SELECT *, nullif(regexp_extract(replace(clean, ',', ''), '-?\d+\.?\d*'), '') AS digits FROM ({_CLEAN}))
"""
_NUMBER = "CASE kind WHEN 'decimal' THEN round(CAST(digits AS DOUBLE), 2) WHEN 'integer' THEN CAST(digits AS DOUBLE) END"
_NUMBER_TEXT = "CASE kind WHEN 'text' THEN clean WHEN 'integer' THEN CAST(CAST(digits AS BIGINT) AS VARCHAR) END"
_FLAG = "CASE WHEN lower(clean) IN ('true', 'yes') THEN true WHEN lower(clean) IN ('false', 'no') THEN false END"
_INNER = r"nullif(regexp_extract(clean, '(\{.*\}|\[.*\])', 1, 's'), '')"
_JSON = f"CASE WHEN json_valid(clean) THEN clean WHEN json_valid({_INNER}) THEN {_INNER} ELSE clean END"


@query("F1_format_number", f"SELECT id, kind, {_NUMBER} AS number, {_NUMBER_TEXT} AS text FROM ({_NUMBERS})")
def f1(spark, sf_dir):
    return derived(spark, sf_dir, ANSWERS).select("id", A.format_number(F.col("answer")).alias("a")).select("id", "a.*")


@query(
    "F2_format_boolean",
    f"SELECT id, {_FLAG} AS flag, CASE WHEN ({_FLAG}) IS NULL THEN clean END AS text FROM ({_CLEAN})",
)
def f2(spark, sf_dir):
    return derived(spark, sf_dir, ANSWERS).select("id", A.format_boolean(F.col("answer")).alias("a")).select("id", "a.*")


@query("F3_format_json", f"SELECT id, {_JSON} AS text FROM ({_CLEAN})")
def f3(spark, sf_dir):
    return derived(spark, sf_dir, ANSWERS).select("id", A.format_json(F.col("answer")).alias("text"))


@query(
    "F4_format_answer",
    f"""
SELECT id, format, CASE WHEN format = 'number' THEN {_NUMBER} END AS number,
  CASE WHEN format = 'boolean' THEN {_FLAG} END AS flag,
  CASE format WHEN 'number' THEN {_NUMBER_TEXT} WHEN 'boolean' THEN CASE WHEN ({_FLAG}) IS NULL THEN clean END
    WHEN 'json' THEN {_JSON} ELSE clean END AS text
FROM ({_NUMBERS})
""",
)
def f4(spark, sf_dir):
    return (
        derived(spark, sf_dir, ANSWERS)
        .select("id", "format", A.format_answer(F.col("answer"), F.col("format")).alias("a"))
        .select("id", "format", "a.*")
    )


_COLOR = "concat(CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '' END, substring(md5(c_name), 1, 8))"


@query(
    "F5_format_color",
    f"""
SELECT c_custkey, substring(CASE WHEN starts_with(color, '#') THEN color ELSE '#' || color END, 1, 7) AS hex,
  'rgb(' || CAST(('0x' || substring(h, 1, 2))::INT AS VARCHAR) || ',' || CAST(('0x' || substring(h, 3, 2))::INT AS VARCHAR)
    || ',' || CAST(('0x' || substring(h, 5, 2))::INT AS VARCHAR) || ')' AS rgb
FROM (SELECT c_custkey, color, ltrim(color, '#') AS h FROM (SELECT c_custkey, {_COLOR} AS color FROM customer))
""",
)
def f5(spark, sf_dir):
    colors = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_COLOR} AS color")
    return colors.select("c_custkey", A.hex_color(F.col("color")).alias("hex"), A.rgb_color(F.col("color")).alias("rgb"))


@query(
    "F6_check_size",
    """
SELECT doc_id, octet_length(encode(text)) AS bytes,
  CASE WHEN octet_length(encode(text)) > 1000000 THEN 'Answer exceeds 1MB size limit' END AS reason,
  CASE WHEN octet_length(encode(text)) > 2000 THEN 'Answer exceeds 1MB size limit' END AS reason_at_2000
FROM documents
""",
)
def f6(spark, sf_dir):
    text = F.col("text")
    return wide_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("bigint").alias("bytes"),
        A.size_check(text).alias("reason"),
        A.size_check(text, 2000).alias("reason_at_2000"),
    )


_PARSED = rf"""
SELECT id, user_key, answered, status, body,
  CASE WHEN status = 200 AND json_valid(body) THEN coalesce(CAST(json_extract_string(body, '$.correct') AS BOOLEAN), false)
    WHEN status = 200 THEN regexp_matches(body, '\b(correct|success)\b', 'i') ELSE false END AS correct,
  CASE WHEN status <> 200 THEN 'HTTP ' || CAST(status AS VARCHAR)
    WHEN json_valid(body) THEN json_extract_string(body, '$.reason') END AS reason,
  CASE WHEN status = 200 AND json_valid(body) THEN json_extract_string(body, '$.url') END AS url,
  CASE WHEN status = 200 AND json_valid(body) THEN json_extract_string(body, '$.message') ELSE body END AS message
FROM ({RESPONSES})
"""


@query("F7_parse_responses", f"SELECT id, correct, reason, url, message FROM ({_PARSED})")
def f7(spark, sf_dir):
    return (
        derived(spark, sf_dir, RESPONSES)
        .select("id", A.parse_response(F.col("status"), F.col("body")).alias("r"))
        .select("id", "r.*")
    )


@query(
    "F8_grading_summary",
    f"""
SELECT user_key, count(*) AS attempts, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  max_by(body, {{'a': answered, 'b': id}}) AS last_answer,
  round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM ({_PARSED}) GROUP BY user_key
""",
)
def f8(spark, sf_dir):
    graded = derived(spark, sf_dir, RESPONSES).select(
        "*", A.parse_response(F.col("status"), F.col("body"))["correct"].alias("correct")
    )
    summary = grading_summary(graded, ["user_key"], "correct", "body", ["answered", "id"])
    return summary.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "F8_grading_labels",
    """
SELECT d.source, count(*) AS attempts, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  max_by(d.lang, l.doc_id) AS last_answer, round(avg(quality), 6) AS accuracy
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source
""",
)
def f8_labels(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    graded = table(spark, sf_dir, "labels").join(documents, "doc_id").withColumn("correct", F.col("quality") == 1)
    summary = grading_summary(graded, ["source"], "correct", "lang", ["doc_id"])
    return summary.withColumn("accuracy", F.round("accuracy", 6))
