from pyspark.sql import functions as F

from answerloom import fixed_values as V
from answerloom.functions import questions as Q


def ask(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    text = F.col("text")
    return df.select(*[fn(text).alias(n) for n, fn in columns.items()], "i").orderBy("i").collect()


def test_question_id(spark):
    rows = ask(spark, ["see Q12 and Q13", "q5", "no", None], qid=Q.question_id)
    assert [r.qid for r in rows] == ["Q12", None, None, None]


def test_urls_lose_closing_punctuation(spark):
    text = "a https://x.org/a.csv., (http://y.org/b?c=1) \"https://z.org/\" https://w.org/q?!"
    rows = ask(spark, [text, "none"], urls=Q.extract_urls)
    assert rows[0].urls == ["https://x.org/a.csv", "http://y.org/b?c=1", "https://z.org/", "https://w.org/q"]
    assert rows[1].urls == []


def test_urls_end_at_any_blank(spark):
    rows = ask(spark, ["https://x.org/a b https://y.org/　c"], urls=Q.extract_urls)
    assert rows[0].urls == ["https://x.org/a", "https://y.org/"]


def test_relative_urls_by_pattern_order(spark):
    text = "Visit /v then scrape /s, <a href=\"/h\"> <a href='/i'> Get data from /g; get from /g2 visit /v"
    assert ask(spark, [text], r=Q.relative_urls)[0].r == ["/s,", "/h", "/i", "/v", "/g;", "/g2"]


def test_sources_and_submit(spark):
    text = "https://a.org/x https://a.org/Submit/1 https://a.org/answer https://a.org/submit/d.CSV"
    rows = ask(
        spark,
        [text, "https://a.org/x"],
        d=lambda t: Q.data_sources(Q.extract_urls(t)),
        s=lambda t: Q.submit_url(Q.extract_urls(t)),
    )
    assert rows[0].d == ["https://a.org/x", "https://a.org/submit/d.CSV"]
    assert rows[0].s == "https://a.org/answer"
    assert rows[1].s is None


def test_relative_submit_url(spark):
    def found(t):
        return Q.relative_submit_url(t, Q.submit_url(Q.extract_urls(t)))

    texts = [
        "POST the result back to /submit/7 now",
        "post it to https://a.org/submit and to /submit",
        "send back to /submit.",
        "use /submit please",
        "nothing",
    ]
    assert [r.s for r in ask(spark, texts, s=found)] == ["/submit/7", None, "/submit.", "/submit", None]


def test_instruction_snippets(spark):
    text = "SUM of column a. sum of column b. sum of column c"
    got = ask(spark, [text], s=Q.instruction_snippets)[0].s
    assert got == ["column a. sum of column b. sum of column c", "SUM of column a. sum of column b. sum of column c"]
    assert len(ask(spark, ["total" + "x" * 80], s=Q.instruction_snippets)[0].s[0]) == 55


def test_answer_format(spark):
    texts = ["How many?", "Plot it in a chart", "answer in JSON", "json", "how many in the chart", "true or false"]
    got = [r.f for r in ask(spark, texts, f=Q.answer_format)]
    assert got == ["number", "base64_image", "json", "string", "number", "string"]


def test_description(spark):
    got = ask(spark, ["\n  Find it! Now.", "x" * 300, ""], d=Q.description)
    assert got[0].d == "Find it" and len(got[1].d) == 200 and got[2].d == ""


def test_hints(spark):
    rows = ask(
        spark, ["Use GIT and md5", "zzz"],
        t=lambda t: Q.hint_tags(t, V.TASK_HINTS), f=lambda t: Q.hint_tags(t, V.FORMAT_HINTS),
    )
    assert rows[0].t == ["command"] and rows[0].f == ["hash"]
    assert rows[1].t == [] and rows[1].f == []


def test_fences_and_prefixes(spark):
    texts = ["```python\na\nb\n```", "```\na\nb", "```x```", " plain ", "```\n```", "```a\nb"]
    assert [r.s for r in ask(spark, texts, s=Q.strip_code_fence)] == ["a\nb", "a\nb", "```x```", "plain", "```\n```", "```a\nb"]
    texts = ["ANSWER: the answer is: 4", "result:x", "Result: Answer: y", "the result: z"]
    assert [r.s for r in ask(spark, texts, s=Q.strip_answer_prefix)] == ["4", "x", "Answer: y", "the result: z"]


def test_context(spark):
    parts = {"pdf_text": F.lit("p" * 5000), "webpage_text": F.lit(""), "dominant_color": F.lit("#fff")}
    got = ask(spark, ["x"], c=lambda t: Q.build_context(parts), e=lambda t: Q.build_context({"pdf_text": F.lit(None)}))
    assert got[0].c == "PDF TEXT:\n" + "p" * 4000 + "\n\nIMAGE DOMINANT COLOR: #fff"
    assert got[0].e == "No context available"


def test_tokens(spark):
    assert [r.n for r in ask(spark, ["", "abcd", "abcde"], n=Q.estimate_tokens)] == [0, 1, 2]


def test_cutoff(spark):
    texts = ["Cutoff: 12", "cutoff\n7", "CUTOFF VALUE is 5", "cutoff value 5", "cutoff: 3 greater than or equal", ">= cutoff 4"]
    rows = ask(spark, texts, c=Q.cutoff, g=Q.cutoff_inclusive)
    assert [r.c for r in rows] == [12, 7, 5, None, 3, 4]
    assert [r.g for r in rows] == [False, False, False, False, True, True]


def test_metric_looks_at_whole_words(spark):
    texts = ["sum above cutoff: 3", "Total discount", "how many discounts", "discount summary", "MEAN", "highest", "lowest max"]
    got = [r.m for r in ask(spark, texts, m=Q.metric)]
    assert got == ["cutoff_sum", "sum", "count", "first", "mean", "max", "max"]


def test_all_components(spark):
    from answerloom.operators.questions import format_answers, parse_questions

    text = "Q7. How many? Scrape /d of https://a.org/x.csv. POST it to /submit now"
    row = parse_questions(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.question_id, row.question_description, row.answer_format) == ("Q7", "Q7", "number")
    assert (row.data_sources, row.relative_urls) == (["https://a.org/x.csv"], ["/d"])
    assert (row.submit_url, row.relative_submit_url, row.instructions) == (None, "/submit", [])
    answers = spark.createDataFrame([("1.239", "number"), ("no", "boolean"), ("x" * 1_000_001, "string")], "answer string, format string")
    got = [(r.number, r.flag, r.rejected is not None) for r in format_answers(answers).collect()]
    assert got == [(1.24, None, False), (None, False, False), (None, None, True)]
