import pytest
from pyspark.sql import functions as F

from answerloom.operators import aggregates as G


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 13), "x") for i in range(200)]
    return spark.createDataFrame(rows, "id bigint, v double, s string").select("s", "v", "id").cache()


def value(df):
    return df.first().answer


def test_first_numeric_column(numbers):
    assert G.first_numeric_column(numbers) == "v"
    with pytest.raises(ValueError):
        G.first_numeric_column(numbers.select("s"))


def test_plain_metrics(numbers):
    vs = [r.v for r in numbers.collect() if r.v is not None]
    assert value(G.column_sum(numbers)) == sum(vs)
    assert value(G.row_count(numbers)) == 200
    assert value(G.column_mean(numbers)) == pytest.approx(sum(vs) / len(vs))
    assert (value(G.column_max(numbers)), value(G.column_min(numbers))) == (max(vs), min(vs))
    assert value(G.column_sum(numbers.where("false"))) == 0


def test_first_value_keeps_null(numbers):
    assert value(G.first_value(numbers, "v", ["id"])) is None


def test_cutoff_sum_is_cut_to_a_whole_number(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (-7.9,)], "v double")
    assert value(G.cutoff_sum(df, "v", 1.5, False)) == 2
    assert value(G.cutoff_sum(df, "v", 1.5, True)) == 4
    assert value(G.cutoff_sum(df, "v", -100, True)) == -3
    assert value(G.cutoff_sum(df, "v", 100, True)) == 0


@pytest.mark.parametrize("ranges", [1, 6])
def test_cutoff_sums_against_brute_force(spark, numbers, ranges):
    asked = [(i, c, g) for i, (c, g) in enumerate((c, g) for c in [*range(-1, 15), 3, None] for g in (True, False))]
    questions = spark.createDataFrame(asked, "q int, cutoff bigint, inclusive boolean")
    got = {r.q: r.answer for r in G.cutoff_sums(questions, numbers, "v", ranges=ranges).collect()}
    vs = [r.v for r in numbers.collect() if r.v is not None]
    for q, c, g in asked:
        want = None if c is None else int(sum(v for v in vs if (v >= c if g else v > c)))
        assert got[q] == want, (c, g)


def test_cutoff_sums_ignore_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (4.0,)], "v double")
    questions = spark.createDataFrame([(1, True)], "cutoff bigint, inclusive boolean")
    assert value(G.cutoff_sums(questions, df, "v")) == 4


def test_answer_questions(spark, numbers):
    texts = ["sum over cutoff: 5", "sum with cutoff 5 at >= it", "total", "how many", "average", "max", "minimum", "hm"]
    questions = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    got = {r.q: r.answer for r in G.answer_questions(questions, numbers, ["id"], column="v").collect()}
    vs = [r.v for r in numbers.collect() if r.v is not None]
    assert got[0] == sum(v for v in vs if v > 5)
    assert got[1] == sum(v for v in vs if v >= 5)
    assert (got[2], got[3], got[5], got[6], got[7]) == (sum(vs), 200, 12, 0, None)


def test_share(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 3, False), ("b", 4, True)], "k string, n int, c boolean")
    got = {r.k: r for r in G.share(df, ["k"], F.col("c"), "n").collect()}
    assert got["a"].ratio == 0.25 and got["b"].percentage == 50.0
    assert G.share(df, ["k"], F.col("c")).where("k = 'a'").first().ratio == 0.5


def test_statistics_without_keys(numbers):
    row = G.statistics(numbers, [], "v").first()
    want = numbers.agg(F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.5).alias("m")).first()
    assert (row.q1, row.median, row.n) == (want.q1, want.m, 171)


def test_value_frequencies(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in G.value_frequencies(df, "v").collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert value(G.column_sum(df)) == 4 and value(G.column_mean(df)) == 2
    assert (value(G.column_max(df)), value(G.column_min(df))) == (3, 1)
    assert value(G.cutoff_sum(df, "v", 0, True)) == 4
    row = G.statistics(df, [], "v").first()
    assert (row.n, row.mean, row["median"], row.maximum) == (2, 2, 2, 3)


def test_questions_name_their_column(spark):
    df = spark.createDataFrame([("x", 2**53 + 1, 0.5), ("y", 2, float("nan"))], "name string, a long, b double")
    texts = ["What is the sum of b?", "What is the sum?", "first cell", "sum of a over cutoff: 1", "maximum of B", "sum of abc"]
    got = {r.q: r for r in G.answer_questions(spark.createDataFrame(list(enumerate(texts)), "q int, text string"), df, ["a"]).collect()}
    assert (got[0].column, got[0].answer) == ("b", 0.5)
    assert got[1].answer_text == str(2**53 + 3) and got[2].answer_text == "y" and got[2].answer is None
    assert got[4].answer == 0.5 and got[5].column == "a"
    assert (got[3].metric, got[3].column) == ("cutoff_sum", "a")


@pytest.mark.parametrize("ranges", [1, 4])
@pytest.mark.parametrize("kind", ["bigint", "decimal(25,3)"])
def test_cutoff_sums_are_exact(spark, ranges, kind):
    """Whole numbers and decimals beyond 2 ** 53 add up to the last digit."""
    from decimal import Decimal

    values = [2**53 + k for k in range(1, 400, 2)] + [k for k in range(-50, 50)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("v", F.col("v").cast(kind))
    if kind != "bigint":
        df = df.withColumn("v", F.expr("v + 0.001").cast(kind))
    cells = [r.v for r in df.collect() if r.v is not None]
    asked = [(k, c, bool(k % 2)) for k, c in enumerate([0, 0, 49, 2**53, 2**53 + 7, 2**53 + 7, 2**53 + 500, None])]
    questions = spark.createDataFrame(asked, "q int, cutoff bigint, inclusive boolean")
    got = {r.q: r.answer for r in G.cutoff_sums(questions, df, "v", ranges=ranges).collect()}
    want = {q: None if c is None else int(sum((v for v in cells if (v >= c if inc else v > c)), Decimal(0))) for q, c, inc in asked}
    assert got == want
    texts = spark.createDataFrame([(1, f"What is the sum of values greater than or equal to cutoff: {2**53 + 7}?")], "q int, text string")
    answer = G.answer_questions(texts, df, ["v"]).first()
    assert answer.metric == "cutoff_sum" and answer.answer_text == str(int(sum((v for v in cells if v >= 2**53 + 7), Decimal(0))))
