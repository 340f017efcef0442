"""The Merkle manifest against a plain build of its trees."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerloom.llm import merkle
from answerloom.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The root, and per leaf its (left, right) steps."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // fanout * fanout : place // fanout * fanout + fanout]
            paths[k].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], paths


def plain(rows, fanout=3):
    """rows: (doc_id, source, leaf, changed leaf) to (doc_id, leaf, subroot, root, proof, folded, verified)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = (mine, *climb([r[2] for r in mine], fanout))
    root, above = climb([trees[s][1] for s in sources], fanout)
    out = []
    for s, more in zip(sources, above):
        for (i, _, leaf, changed), path in zip(trees[s][0], trees[s][2]):
            folded = changed
            for left, right in path + more:
                folded = H(left, folded, right)
            out.append((i, leaf, trees[s][1], root, H(*(x for step in path + more for x in step)), folded, folded == root))
    return Counter(out)


def expected(df):
    rows = []
    for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect():
        leaf = lambda t: H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, t)))  # noqa: B023, E731
        odd = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2
        rows.append((r.doc_id, r.source, leaf(r.text), leaf(r.text if odd or r.text is None else r.text.replace("\n", ""))))
    return plain(rows)


@pytest.mark.parametrize("rows", ["odd", "none", "one"])
def test_query(spark, table, tmp_path, odd_texts, rows):
    texts = {"odd": odd_texts + [(k, f"line {k}\nline") for k in range(100, 160)], "none": [], "one": [(4, "a\nb")]}[rows]
    df = table(texts, extra={"root": F.lit("own"), "path": F.lit(1), "subroot": F.lit(2.0)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_merkle_slot_pivot"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == (expected(df) if texts else Counter())
    if rows == "odd":
        assert {r.verified for r in found} == {True, False}


def test_given(spark, sf):
    found = QUERIES["op11_merkle_slot_pivot"](spark, sf)
    assert Counter(map(tuple, found.collect())) == expected(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("fanout,span", [(3, 1), (2, 2), (5, 6)])
def test_many_rounds_and_sources(spark, fanout, span):
    """Trees of several rounds, over the leaves and over the sources."""
    rows = [(k % 90, f"s{(k * k) % 31}" if k % 3 else None, H(str(k % 170)), H("other" if k % 4 == 0 else str(k % 170))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, kind string, leaf string, changed string")
    out = merkle.prove(df, "kind", ["id"], "leaf", fanout=fanout, span=span)
    out = out.select(
        "id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")), merkle.fold(F.col("changed"), F.col("path")).alias("f"), F.expr("true")
    )
    assert Counter((*r[:6], r.f == r.root) for r in out.collect()) == plain(rows, fanout)


def test_other_columns_and_any_layout(spark):
    rows = [(k, "a" if k % 2 else "b", H(str(k)), k * 10) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, s string, leaf string, range int")
    one, many = (merkle.prove(df.repartition(n), "s", ["id"], "leaf") for n in (1, 7))
    assert one.columns == ["id", "s", "range", "leaf", "subroot", "root", "path"]
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
