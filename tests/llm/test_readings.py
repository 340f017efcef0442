"""Tables read twice: their splits stay, also when the number of cores changes in between."""

from collections import Counter

import numpy as np
import pytest

from answerloom.llm import exchange, jaccard, katz, repeats

KEYS = ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")


@pytest.fixture()
def cores(spark):
    """Sets the number of cores that Spark plans scans by; the settings are gone afterwards."""
    for key in KEYS:
        spark.conf.unset(key)
    yield lambda n: spark.conf.set(KEYS[1], n)
    for key in KEYS:
        spark.conf.unset(key)


def test_splits_stay(spark, table, odd_texts, cores):
    df = table(odd_texts, files=6)
    splits = lambda: df.select("text").rdd.getNumPartitions()
    cores(8)
    many = splits()
    cores(2)
    assert splits() < many  # unpinned
    cores(8)
    exchange.pin_splits(spark)
    cores(2)
    assert splits() == many
    exchange.pin_splits(spark)
    assert spark.conf.get(KEYS[0]) == "8"


@pytest.mark.parametrize("module,run", [(katz, katz.score), (jaccard, jaccard.join), (repeats, repeats.remove_repeats)])
def test_cores_change_between_readings(table, odd_texts, cores, monkeypatch, module, run):
    df = table(odd_texts, files=6)
    rows = lambda x: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect())
    cores(8)
    want = rows(run(df))
    name = "cut_lineage" if hasattr(module, "cut_lineage") else "back_to_blocks"
    step = getattr(module, name)

    def fewer(*args, **kwargs):
        out = step(*args, **kwargs)
        cores(2)
        return out

    monkeypatch.setattr(module, name, fewer)
    assert rows(run(df)) == want


def test_another_block_raises():
    name = np.array([5, 9], np.uint64)
    answer = lambda mark: np.int64([0, 0, mark]).tobytes()
    with pytest.raises(ValueError, match="differ"):
        katz._known(name, [answer(1)], 1, 2)


@pytest.mark.parametrize("seed", range(6))
def test_search_across_sides(seed):
    pick = np.random.default_rng(seed)
    base = np.sort(pick.choice(10_000, 60, replace=False))
    sets = []
    for _ in range(40):
        own = base if pick.random() < 0.7 else pick.choice(10_000, 60, replace=False)
        sets.append(np.unique(np.concatenate((pick.choice(own, pick.integers(45, 60), replace=False), pick.choice(10_000, pick.integers(0, 6))))).astype(np.uint64))
    sets.sort(key=len)
    side = pick.integers(0, 2, len(sets)) if seed else np.zeros(len(sets), np.int64)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for sides in (None, side):
        got = {(i, int(j)) for i, found in jaccard.t_occurrence(np.concatenate(sets), at, 70, 100, side=sides) for j in found}
        common = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
        want = {
            (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if 100 * (c := common(sets[i], sets[j])) >= 70 * (len(sets[i]) + len(sets[j]) - c) and (sides is None or side[i] != side[j])
        }
        assert got == want


@pytest.mark.parametrize("share", [2_000, 20_000])
def test_shares_of_a_bucket(odd_texts, monkeypatch, share):
    """A bucket worked off in shares of triggers gives the spans that it gives at once."""
    import pyarrow as pa

    rows = [(i, t) for i, t in odd_texts if i != 23] * 2
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})

    def numbered(batches, text, most):
        for place, table in enumerate(exchange.blocks(batches, text, most)):
            yield (place, table, *exchange.flat(table[text]))

    monkeypatch.setattr(repeats, "numbered", numbered)
    sent = pa.Table.from_batches(list(repeats._send("doc_id", "text", 50, 20, 1, 2_000)(iter([batch]))))
    whole = repeats._answer(50, 20)(sent)
    monkeypatch.setattr(repeats, "SHARE", share)
    assert whole.num_rows > 3 and repeats._answer(50, 20)(sent).equals(whole)
