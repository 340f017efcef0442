"""Queries over a table of question texts and over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions import questions as Q
from catalog import query, table, wide_table
from catalog.derived import ANSWERS, QUESTIONS, derived

_FROM = f"FROM ({QUESTIONS})"
_URLS = r"""list_transform(regexp_extract_all(text, 'https?://[^\s<>"'')\]]+'),
  lambda u: regexp_replace(u, '[.,:;!?)"'']+$', ''))"""
_LOW_HAS_DATA = "regexp_matches(lower(u), '\\.pdf|\\.csv|\\.json|\\.xlsx|\\.txt')"
_LOW_HAS_SUBMIT = "regexp_matches(lower(u), '/submit|/answer')"


def _text(alias: str, fn):
    def run(spark, sf_dir):
        return derived(spark, sf_dir, QUESTIONS).select("qid", fn(F.col("text")).alias(alias))

    return run


query(
    "P1_question_id",
    rf"SELECT qid, nullif(regexp_extract(text, '(Q\d+)', 1), '') AS question_id {_FROM}",
)(_text("question_id", Q.question_id))

query("P2_extract_urls", f"SELECT qid, array_to_string({_URLS}, ' ') AS urls {_FROM}")(
    _text("urls", lambda t: F.array_join(Q.extract_urls(t), " "))
)

query(
    "P3_relative_urls",
    rf"""
SELECT qid, coalesce(string_agg(u, ' ' ORDER BY first_at), '') AS relative_urls FROM (
  SELECT qid, u, min(nr) AS first_at FROM (
    SELECT qid, unnest(all_urls) AS u, generate_subscripts(all_urls, 1) AS nr FROM (
      SELECT qid, list_concat(list_concat(list_concat(list_concat(
        regexp_extract_all(text, '[Ss]crape\s+(/[^\s<>"'']+)', 1),
        regexp_extract_all(text, 'href="(/[^"]+)"', 1)),
        regexp_extract_all(text, 'href=''(/[^'']+)''', 1)),
        regexp_extract_all(text, '[Vv]isit\s+(/[^\s<>"'']+)', 1)),
        regexp_extract_all(text, '[Gg]et\s+(?:data\s+)?from\s+(/[^\s<>"'']+)', 1)) AS all_urls {_FROM}
    )
  ) GROUP BY qid, u
  UNION ALL SELECT qid, NULL, NULL {_FROM}
) GROUP BY qid
""",
)(_text("relative_urls", lambda t: F.array_join(Q.relative_urls(t), " ")))


@query(
    "P4_split_sources_submit",
    f"""
SELECT qid,
  array_to_string(list_filter(urls, lambda u: {_LOW_HAS_DATA} OR NOT {_LOW_HAS_SUBMIT}), ' ') AS data_sources,
  list_filter(urls, lambda u: NOT ({_LOW_HAS_DATA} OR NOT {_LOW_HAS_SUBMIT}))[-1] AS submit_url
FROM (SELECT qid, {_URLS} AS urls {_FROM})
""",
)
def p4(spark, sf_dir):
    urls = Q.extract_urls(F.col("text"))
    return derived(spark, sf_dir, QUESTIONS).select(
        "qid",
        F.array_join(Q.data_sources(urls), " ").alias("data_sources"),
        Q.submit_url(urls).alias("submit_url"),
    )


@query(
    "P5_relative_submit_url",
    rf"""
SELECT qid, CASE WHEN len(list_filter(urls, lambda u: NOT ({_LOW_HAS_DATA} OR NOT {_LOW_HAS_SUBMIT}))) = 0 THEN coalesce(
  nullif(regexp_extract(text, '(?:POST|post)\s+.*?(?:to|back to)\s+(/submit[^\s]*)', 1, 'i'), ''),
  nullif(regexp_extract(text, '(?:submit|Send)\s+.*?(?:to|back to)\s+(/submit[^\s]*)', 1, 'i'), ''),
  nullif(regexp_extract(text, '(?:to|back to)\s+(/submit)\b', 1, 'i'), ''),
  nullif(regexp_extract(text, '(/submit)\s', 1, 'i'), '')) END AS relative_submit_url
FROM (SELECT qid, text, {_URLS} AS urls {_FROM})
""",
)
def p5(spark, sf_dir):
    text = F.col("text")
    return derived(spark, sf_dir, QUESTIONS).select(
        "qid",
        Q.relative_submit_url(text, Q.submit_url(Q.extract_urls(text))).alias("relative_submit_url"),
    )


query(
    "P6_instruction_snippets",
    "SELECT qid, array_to_string(flatten(["
    + ", ".join(
        rf"list_slice(regexp_extract_all(text, '{w}[\s\S]{{0,50}}', 0, 'i'), 1, 2)" for w in V.INSTRUCTION_KEYWORDS
    )
    + f"]), '|') AS instructions {_FROM}",
)(_text("instructions", lambda t: F.array_join(Q.instruction_snippets(t), "|")))

_FORMAT_SQL = """CASE
  WHEN regexp_matches(lower(text), 'what is the sum|what is the total|what is the average|how many|what is the count')
    THEN 'number'
  WHEN regexp_matches(lower(text), 'chart|image|graph|plot|visualization|base64') THEN 'base64_image'
  WHEN contains(lower(text), 'json') AND contains(lower(text), 'answer') THEN 'json'
  ELSE 'string' END"""


@query(
    "P7_answer_format",
    f"""
SELECT origin, answer_format, count(*) AS n FROM (
  SELECT 'questions' AS origin, {_FORMAT_SQL} AS answer_format {_FROM}
  UNION ALL SELECT role, {_FORMAT_SQL} FROM conversations
) GROUP BY ALL
""",
)
def p7(spark, sf_dir):
    texts = derived(spark, sf_dir, QUESTIONS).select(F.lit("questions").alias("origin"), "text")
    talks = wide_table(spark, sf_dir, "conversations").select(F.col("role").alias("origin"), "text")
    return (
        texts.unionByName(talks)
        .groupBy("origin", Q.answer_format(F.col("text")).alias("answer_format"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)"


@query(
    "P8_description",
    f"SELECT doc_id, substring(trim(regexp_extract(text, '^[^.!?]*'), {_WS}), 1, 200) AS description FROM documents",
)
def p8(spark, sf_dir):
    return wide_table(spark, sf_dir, "documents").select("doc_id", Q.description(F.col("text")).alias("description"))


def _hint_sql(hints) -> str:
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + f" THEN '{name}' END"
        for name, words in hints.items()
    )
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ' ')"


@query(
    "P9_task_hints",
    f"SELECT doc_id AS id, {_hint_sql(V.TASK_HINTS)} AS tasks, {_hint_sql(V.FORMAT_HINTS)} AS formats FROM documents "
    f"UNION ALL SELECT qid + 1000000000, {_hint_sql(V.TASK_HINTS)}, {_hint_sql(V.FORMAT_HINTS)} {_FROM}",
)
def p9(spark, sf_dir):
    documents = wide_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = derived(spark, sf_dir, QUESTIONS).select((F.col("qid") + 1000000000).alias("id"), "text")
    return documents.unionByName(asked).select(
        "id",
        F.array_join(Q.hint_tags(F.col("text"), V.TASK_HINTS), " ").alias("tasks"),
        F.array_join(Q.hint_tags(F.col("text"), V.FORMAT_HINTS), " ").alias("formats"),
    )


_TRIM = f"trim(answer, {_WS})"
_UNFENCED = f"""CASE WHEN starts_with({_TRIM}, '```') THEN trim(
  CASE WHEN len(string_split({_TRIM}, chr(10))) > 2 THEN array_to_string(list_slice(string_split({_TRIM}, chr(10)), 2,
    len(string_split({_TRIM}, chr(10))) - CASE WHEN string_split({_TRIM}, chr(10))[-1] = '```' THEN 1 ELSE 0 END), chr(10))
  ELSE {_TRIM} END, {_WS}) ELSE {_TRIM} END"""


def _unprefix(col: str, prefix: str) -> str:
    return (
        f"CASE WHEN starts_with(lower({col}), '{prefix.lower()}') "
        f"THEN trim(substring({col}, {len(prefix) + 1}), {_WS}) ELSE {col} END"
    )


@query(
    "P10_strip_fence_prefix",
    f"""
WITH a AS (SELECT id, {_UNFENCED} AS unfenced FROM ({ANSWERS})),
b AS (SELECT *, {_unprefix("unfenced", "Answer:")} AS p1 FROM a),
c AS (SELECT *, {_unprefix("p1", "The answer is:")} AS p2 FROM b)
SELECT id, unfenced, {_unprefix("p2", "Result:")} AS bare FROM c
""",
)
def p10(spark, sf_dir):
    unfenced = Q.strip_code_fence(F.col("answer"))
    return derived(spark, sf_dir, ANSWERS).select(
        "id", unfenced.alias("unfenced"), Q.strip_answer_prefix(unfenced).alias("bare")
    )


@query(
    "P11_build_context",
    """
SELECT doc_id, md5(array_to_string(list_filter([
  CASE WHEN doc_id % 3 = 0 THEN 'AUDIO TRANSCRIPT:' || chr(10) || lang END,
  'PDF TEXT:' || chr(10) || substring(text, 1, 4000),
  CASE WHEN doc_id % 2 = 0 THEN 'WEBPAGE TEXT:' || chr(10) || substring(text, 1, 3000) END
], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS context_md5 FROM documents
""",
)
def p11(spark, sf_dir):
    documents = wide_table(spark, sf_dir, "documents")
    context = Q.build_context(
        {
            "audio_transcript": F.when(F.col("doc_id") % 3 == 0, F.col("lang")),
            "pdf_text": F.col("text"),
            "webpage_text": F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(""),
        }
    )
    return documents.select("doc_id", F.md5(context).alias("context_md5"))


@query(
    "P12_estimate_tokens",
    """
SELECT source, count(*) AS n, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens
FROM documents GROUP BY source
""",
)
def p12(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(Q.estimate_tokens(F.col("text"))).alias("tokens"))
    )
