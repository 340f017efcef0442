"""Tables of questions and of answers, as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions import answers as A
from answerloom.functions import questions as Q


def parse_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds every component of the question texts: id, description, sources, addresses, instructions, format."""
    body = F.col(text)
    found = df.withColumn("__urls", Q.extract_urls(body)).withColumn("submit_url", Q.submit_url(F.col("__urls")))
    return found.select(
        *df.columns,
        Q.question_id(body).alias("question_id"),
        Q.description(body).alias("question_description"),
        Q.data_sources(F.col("__urls")).alias("data_sources"),
        Q.relative_urls(body).alias("relative_urls"),
        Q.instruction_snippets(body).alias("instructions"),
        "submit_url",
        Q.relative_submit_url(body, F.col("submit_url")).alias("relative_submit_url"),
        Q.answer_format(body).alias("answer_format"),
    )


def format_answers(df: DataFrame, answer: str = "answer", kind: str = "format") -> DataFrame:
    """Adds ``number``, ``flag`` or ``text`` by the format asked for, and ``rejected`` for an oversized answer."""
    out = A.format_answer(F.col(answer), F.col(kind))
    return df.select("*", out.alias("__out")).select(
        *df.columns, "__out.number", "__out.flag", "__out.text", A.size_check(F.col("__out.text")).alias("rejected")
    )
