import hashlib
import zlib

from pyspark.sql import functions as F

from answerloom.functions import answers as A
from answerloom.operators import aggregates as G
from answerloom.operators.answers import grading_summary


def each(spark, fn, rows, schema="a string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", fn(df).alias("v")).orderBy("i").collect()]


def test_format_number(spark):
    rows = ["1,234 items", "-5.678", "007", "none", "3.", "```\n42\n```", "12345678901234567890", "-0", "v1.5.2"]
    got = each(spark, lambda d: A.format_number(d.a), rows)
    assert [(r.kind, r.number, r.text) for r in got] == [
        ("integer", 1234.0, "1234"),
        ("decimal", -5.68, None),
        ("integer", 7.0, "7"),
        ("text", None, "none"),
        ("decimal", 3.0, None),
        ("integer", 42.0, "42"),
        ("integer", 12345678901234567890.0, "12345678901234567890"),
        ("integer", 0.0, "0"),
        ("decimal", 1.5, None),
    ]


def test_format_boolean(spark):
    got = each(spark, lambda d: A.format_boolean(d.a), [" YES", "False", "maybe"])
    assert [(r.flag, r.text) for r in got] == [(True, None), (False, None), (None, "maybe")]


def test_format_json(spark):
    rows = ['{"a": 1}', 'x = {"a": [1]} ok', "see [1, 2]", "{bad}", "7", 'a {"b"} [1]']
    assert each(spark, lambda d: A.format_json(d.a), rows) == ['{"a": 1}', '{"a": [1]}', "[1, 2]", "{bad}", "7", 'a {"b"} [1]']


def test_format_answer_by_kind(spark):
    got = each(
        spark, lambda d: A.format_answer(d.a, d.k),
        [("1.239", "number"), ("yes", "boolean"), ("yes", "string"), ("git add .", "command")], "a string, k string",
    )
    assert [(r.number, r.flag, r.text) for r in got] == [
        (1.24, None, None), (None, True, None), (None, None, "yes"), (None, None, "git add ."),
    ]


def test_colors(spark):
    assert each(spark, lambda d: A.hex_color(d.a), ["ff00aa", "#12345678"]) == ["#ff00aa", "#123456"]
    assert each(spark, lambda d: A.rgb_color(d.a), ["#ff00aa", "0a0B0c", "#xyz"]) == ["rgb(255,0,170)", "rgb(10,11,12)", None]


def test_size_counts_bytes(spark):
    rows = ["é" * 500_000, "é" * 500_001]
    assert each(spark, lambda d: A.size_check(d.a), rows) == [None, "Answer exceeds 1MB size limit"]


def test_responses(spark):
    rows = [
        (200, '{"correct": true, "url": "/n"}'),
        (200, '{"reason": "no"}'),
        (200, "Incorrect!"),
        (200, "Success"),
        (404, "gone"),
    ]
    got = each(spark, lambda d: A.parse_response(d.s, d.b), rows, "s int, b string")
    assert [(r.correct, r.reason, r.url, r.message) for r in got] == [
        (True, None, "/n", None),
        (False, "no", None, None),
        (False, None, None, "Incorrect!"),
        (True, None, None, "Success"),
        (False, "HTTP 404", None, "gone"),
    ]


def test_personal_offset(spark):
    user = "ab@cd.efg"  # 9 characters
    rules = ["none", "", None, "email_length_mod_2", "len mod 5", "mod_20", "checksum", "mod_7", "mod_0", "other"]
    got = each(spark, lambda d: A.personal_offset(F.lit(user), d.a), rules)
    assert got == [0, 0, 0, 1, 4, 9, sum(map(ord, user)) % 100, 2, 0, 0]


def test_apply_offset(spark):
    answers = spark.createDataFrame([(1, 10, True), (2, 20, False), (3, None, True), (9, 5, True)], "u int, answer bigint, p boolean")
    users = spark.createDataFrame([(1, "r", 3), (2, "r", 4), (3, "r", 5)], "u int, r string, offset bigint")
    got = G.apply_offset(answers, users, "u", "answer", "r", "p")
    assert {r.u: r.answer for r in got.collect()} == {1: 13, 2: 20, 3: None, 9: 5}
    assert got.schema["answer"].dataType.simpleString() == "bigint"


def test_hashes(spark):
    df = spark.createDataFrame([("héllo",)], "t string")
    row = df.select(*G.hash_columns(F.col("t"))).first()
    data = "héllo".encode()
    assert row.md5 == hashlib.md5(data).hexdigest()
    assert row.sha256 == hashlib.sha256(data).hexdigest()
    assert row.crc32 == zlib.crc32(data)


def test_grading(spark):
    df = spark.createDataFrame(
        [("u", 1, True, "a"), ("u", 3, False, "c"), ("u", 2, False, "b"), ("v", 1, True, "z")],
        "u string, t int, ok boolean, a string",
    )
    got = {r.u: r for r in grading_summary(df, ["u"], "ok", "a", ["t"]).collect()}
    assert (got["u"].attempts, got["u"].correct, got["u"].last_answer) == (3, 1, "c")
    assert got["v"].accuracy == 1.0
