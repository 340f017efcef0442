"""SimHash fingerprints and links against plain versions."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from answerloom.llm import simhash
from answerloom.llm.components import components
from answerloom.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius):
    """The smallest place each fingerprint is linked to, all pairs compared."""
    top = list(range(len(prints)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            top[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    top, least = roots(prints, 2), {}
    for (i, _), r in zip(rows, top):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, top))


@pytest.mark.parametrize("given", ["odd", "none", "blank"])
def test_query(spark, table, tmp_path, odd_texts, given):
    edited = odd_texts[0][1].split()
    more = [(200 + k, " ".join(edited[:k] + ["new"] + edited[k + 1 :])) for k in range(0, 300, 7)]
    rows = {"odd": odd_texts + more, "none": [], "blank": [(5, " "), (None, None), (4, "\n"), (9, "a b"), (8, "A  B")]}[given]
    df = table(rows, extra={"print": F.lit(1), "component_id": F.lit("x"), "root": F.lit(2.0)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op12_covering_simhash"](spark, str(tmp_path)).collect())) == expected(rows)


def test_given(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op12_covering_simhash"](spark, sf).collect())) == expected(rows)


def test_hash_is_the_library_s():
    pick = random.Random(3)
    parts = [bytes(pick.randrange(256) for _ in range(pick.choice([0, 1, 3, 4, 7, 8, 9, 15, 16, 23, 24, 31, 32, 33, 100]))) for _ in range(600)]
    size = np.array([len(p) for p in parts])
    found = simhash.xxh64(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)
    assert found.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), min(radius, 2)):
        assert any(all(not m >> b & 1 for b in bits) for m in masks)
    pick = random.Random(1)
    assert all(any(not any(m >> b & 1 for b in bits) for m in masks) for bits in (pick.sample(range(64), radius) for _ in range(3000)))


@pytest.mark.parametrize("few,radius", [(1, 2), (10_000, 2), (5, 0), (5, 4)])
def test_links_lose_nothing(spark, few, radius):
    """Crowds, chains and strangers: the same components however large a bucket may be before it is split."""
    pick = random.Random(radius)
    prints = {pick.getrandbits(64) for _ in range(60)}
    for _ in range(2):
        centre = pick.getrandbits(64)
        prints |= {centre ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(60)}
    walk = pick.getrandbits(64)
    for _ in range(40):
        walk ^= sum(1 << b for b in pick.sample(range(64), pick.choice([1, 2, 3, 4, 5])))
        prints.add(walk)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    found = {r.node % 2**64: r.root for r in components(simhash.links(df, radius, few)).collect()}
    want, got = {}, {}
    for p, r in zip(prints, roots(prints, radius)):
        want.setdefault(r, set()).add(p)
        got.setdefault(found.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_odd_radius_raises(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 3)
