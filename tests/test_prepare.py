import datetime

from pyspark.sql import functions as F

from answerloom.operators import prepare as P


def test_clean_names():
    assert P.clean_names([" A  b ", "a b", "A_B", "a_b_2", "É"]) == ["a_b", "a_b_2", "a_b_3", "a_b_2_2", "é"]


def test_infer_types(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", "x", " ", "1e3"), (" -2.5 ", "2024-01-03 10:00:00", "2", None, ".5"), (None, "", "3", "", "1d")],
        "a string, b string, c string, d string, e string",
    )
    out = P.infer_types(df)
    assert [t for _, t in out.dtypes] == ["double", "timestamp_ntz", "string", "string", "string"]
    rows = out.collect()
    assert [r.a for r in rows] == [1.0, -2.5, None]
    assert rows[1].b == datetime.datetime(2024, 1, 3, 10) and rows[2].b is None
    assert [r.c for r in P.infer_types(df, "coerce").collect()] == [None, 2.0, 3.0]


def test_missing(spark):
    df = spark.createDataFrame([(None, float("nan")), ("a", 1.0), (None, None)], "s string, x double")
    got = {r.column: (r.missing, r.total) for r in P.missing_report(df).collect()}
    assert got == {"s": (2, 4), "x": (2, 4)}
    assert [r.s for r in P.fill_missing(df).collect()] == ["", "a", ""]


def test_payloads(spark):
    texts = {
        "array": '[{"a": 1, "b": {"c": 2}}, {"a": null}]',
        "object": ' {"a": "x"} ',
        "csv": 'a,"b, c"\n1,"two\nlines"\n"q ""q""",\n',
        "ragged": "a,b\n1,2,3",
        "short": "a,b\n1",
        "header": "a,b",
        "blank": " ",
        "windows": "a,b\r\n1,2\r\n",
        "bad": "{a: 1",
        "empty": "[]",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got: dict = {}
    for r in P.coerce_payloads(df, "t").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.kind, r.record))
    assert got["array"] == [("json", {"a": "1", "b": '{"c":2}'}), ("json", {"a": None})]
    assert got["object"] == [("json", {"a": "x"})]
    assert got["csv"] == [("csv", {"a": "1", "b, c": "two\nlines"}), ("csv", {"a": 'q "q"', "b, c": None})]
    assert got["short"] == [("csv", {"a": "1", "b": None})]
    assert got["windows"] == [("csv", {"a": "1", "b": "2"})]
    for k in ("ragged", "header", "blank", "bad", "empty"):
        assert got[k] == [("rejected", None)], k


def test_promote_header(spark):
    df = spark.createDataFrame([(1, [["h", "h"], ["a", "b"], ["c"]]), (2, [["only"]]), (3, [])], "i int, c array<array<string>>")
    got = sorted(tuple(r) for r in P.promote_header(df, "c").where("i = 1").fillna("-").collect())
    assert got == [(1, 0, 0, "h", "a"), (1, 0, 1, "h", "b"), (1, 1, 0, "h", "c"), (1, 1, 1, "h", "-")]
    assert P.promote_header(df, "c").where("i > 1").count() == 0
    assert [tuple(r) for r in P.promoted_table(df, "c", ["x", "y"]).orderBy("row").collect()] == [(1, 0, "a", "b"), (1, 1, "c", None)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (2, "a")], "n int, s string")
    got = {r.column: (r.dtype, r.rows, r.missing, r.distinct, r.minimum, r.maximum) for r in P.profile(df).collect()}
    assert got == {"n": ("int", 3, 0, 2, "1", "2"), "s": ("string", 3, 1, 2, "a", "b")}


def test_exact_profile_counts_column_by_column(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "b", nan), (2, None, nan), (2, "a", 0.0), (3, "a", -0.0)], "n int, `s.t` string, d double")
    made = P.profile(df, exact=True)
    assert {r.column: (r.rows, r.missing, r.distinct) for r in made.collect()} == {"n": (4, 0, 3), "s.t": (4, 1, 2), "d": (4, 0, 2)}
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()  # which holds every row once per column
    assert [(r.rows, r.missing, r.distinct) for r in P.profile(df.limit(0), exact=True).collect()] == [(0, 0, 0)] * 3


def test_transform(spark):
    df = spark.createDataFrame([(" Ab ", "7", "x")], "a string, b string, c string")
    spec = P.RecordSpec(select=["b", "a"], rename={"b": "n"}, trim=["a"], lower=["a"], cast={"b": "int"})
    assert P.transform_records(df, spec).first().asDict() == {"n": 7, "a": "ab"}


def test_paths(spark):
    df = spark.createDataFrame([("d/a.md", "blob"), ("d/b.md", "tree"), ("e/c.md", "blob"), ("d/c.MD", "blob")], "path string, type string")
    assert P.count_paths(df, "d/", ".md").first().answer == 1


def test_merge(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, '{"z": 5}')], "k int, j string").select("k", F.get_json_object("j", "$.z").alias("z"))
    assert {r.k: r.z for r in P.merge_sources(left, right, ["k"]).collect()} == {1: "5", 2: None}
