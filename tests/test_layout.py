"""Tables in partitions: what is read, what is replaced, nulls and clashing types."""

from collections import Counter

import pytest

from answerloom.sources import layout as L

ROWS = [(k, "2024-0%d" % (k % 6 + 1) if k % 7 else None, k % 3) for k in range(200)]
SCHEMA = "v long, month string, k int"


@pytest.fixture()
def written(spark, tmp_path):
    path = str(tmp_path / "t")
    return L.write_partitioned(spark.createDataFrame(ROWS, SCHEMA), path, ["month"]), path


def test_round_trip(spark, tmp_path, written):
    df, path = written
    assert df.columns == ["v", "k", "month"] and df.schema["month"].dataType.simpleString() == "string"
    assert Counter((r.v, r.month, r.k) for r in df.collect()) == Counter(ROWS)
    numbers = spark.createDataFrame([("007", 1), ("07", 2), (None, 3)], "code string, v int")
    again = L.write_partitioned(numbers, str(tmp_path / "n"), ["code"])
    assert sorted((r.v, r.code) for r in again.collect()) == [(1, "007"), (2, "07"), (3, None)]
    with pytest.raises(Exception, match="(?i)exist"):
        L.write_partitioned(df, path, ["month"])
    none = L.write_partitioned(numbers.where("v > 9"), str(tmp_path / "e"), ["code"])
    assert none.collect() == []


def test_join_prunes_partitions(spark, written):
    df, _ = written
    chosen = spark.createDataFrame([("2024-01", 1), ("2024-03", 5), ("2024-05", 9), (None, 9), ("2030-01", 9)], "month string, n int")
    met = L.pruned_join(df, chosen, ["month"], "n >= 5")
    want = Counter((v, m) for v, m, _ in ROWS if m in ("2024-03", "2024-05"))
    assert Counter((r.v, r.month) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    todo, scanned = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet") and "dynamicpruning" in node.toString():
            scanned.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert scanned == [2]


def test_replaced_partitions(written):
    df, path = written
    changed = df.where("month IN ('2024-02', '2024-04')").where("v % 4 = 1").selectExpr("v + 1000 AS v", "month", "k")
    after = L.replace_partitions(changed, path, ["month"])
    want = Counter((v, m, k) for v, m, k in ROWS if m not in ("2024-02", "2024-04"))
    want += Counter((v + 1000, m, k) for v, m, k in ROWS if m in ("2024-02", "2024-04") and v % 4 == 1)
    assert Counter((r.v, r.month, r.k) for r in after.collect()) == want
