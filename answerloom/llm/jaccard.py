"""Jaccard join of documents on word n-grams by T-occurrence search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.components import components
from answerloom.llm.exchange import (
    DIFFER, ROW_BITS, back_to_blocks, bucket_count, fingerprint, numbered, pin_splits, press, press_planes, press_steps, signed, unpress, unpress_planes,
    unpress_steps,
)
from answerloom.llm.texts import flat, grams, hashes, lower_ascii, mix, ranges, release, words
from answerloom.plans.staging import cut_lineage

BLOCK = 4 << 20
PART = 500_000  # shingles of a slice; a task compares two slices at most
_S32 = np.uint64(32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each document as sorted 64-bit hashes, end to end, and where each set begins.

    A document of 1 to n - 1 words has one shingle, its whole sequence.
    """
    found = words(lower_ascii(data), offsets)
    hashed = hashes(found.names)[found.code] if len(found.code) else np.zeros(0, np.uint64)
    count = np.diff(found.first)
    value = grams(hashed, n)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    value = value[ranges(found.first[:-1], np.maximum(count - n + 1, 0))]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for size in range(1, n):
            same = count[short] == size
            at = found.first[:-1][short[same]]
            total = np.full(len(at), np.uint64(size))
            for i in range(size):
                total = mix(total + hashed[at + i]) + np.uint64(0x632BE59BD9B4E019)
            whole[same] = mix(total)
        value, doc = np.concatenate((value, whole)), np.concatenate((doc, short))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def _digest(value: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit digest of each set (the sum of its hashes, mixed)."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.diff(at) > 0
    if full.any():
        out[full] = np.add.reduceat(mix(value + np.uint64(salt)), at[:-1][full])
    return mix(out).view(np.int64)


def _least(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The overlap that a set of this size needs with any partner."""
    return -(-size * num // den)


_INFO, _SHARED = 0, 1


def _send(id_column: str, text: str, n: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
        for block, table, data, offsets in numbered(batches, text, most):
            value, at = shingles(data, offsets, n)
            size = np.diff(at)
            first, second = _digest(value, at, 1), _digest(value, at, 2)
            keys = np.stack((size, first, second))
            _, lead, own = np.unique(keys, axis=1, return_index=True, return_inverse=True)
            lead = lead[own.reshape(-1)]  # the first document of the block with the same set
            ids = table[id_column].combine_chunks().cast(pa.int64())
            info = np.stack((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid()).astype(np.int64), size, first, second, lead))
            packed = np.int64([fingerprint(data, offsets), len(size)]).tobytes() + press(info.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([buckets + block % buckets], pa.int32()), pa.array([block], pa.int64()), pa.array([packed], pa.binary()), pa.array([None], pa.binary())], schema=schema)
            sent = np.repeat(lead == np.arange(len(size)), size)
            doc, value = np.repeat(np.arange(len(size)), size)[sent], value[sent]
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            short = value >> _S32
            order = np.lexsort((short, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[b] : cuts[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([press_steps(short[part].astype(np.int64))]), pa.array([press_planes(doc[part])])], schema=schema)

    return run


def _shared(buckets: int):
    """In a bucket: which hashes stand in two sets or more; these go back with the number of sets."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["bucket"] >= buckets:
            return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([_INFO] * len(rows), pa.int32()), pa.array([r["hashes"] for r in rows], pa.binary())], names=["block", "kind", "answer"])
        lists = [unpress_steps(r["hashes"]) for r in rows]
        _, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        blocks_, out = [], []
        for i, row in enumerate(rows):
            sets = count[code[at[i] : at[i + 1]]]
            keep = sets > 1
            if keep.any():
                parts = [press_steps(lists[i][keep]), press_planes(unpress_planes(row["docs"])[keep]), press(np.minimum(sets[keep], 255).astype(np.uint8))]
                out.append(np.int64([row["bucket"], len(parts[0]), len(parts[1])]).tobytes() + b"".join(parts))
                blocks_.append(row["block"])
        return pa.table([pa.array(blocks_, pa.int64()), pa.array([_SHARED] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "kind", "answer"])

    return run


_PREFIX = "node long, id long, size long, first long, second long, bucket int, hashes binary, nodes binary, print long"


def _prefixes(buckets: int, num: int, den: int):
    """In a block: every document, and the prefixes of those that can have a partner.

    A partner shares T = ceil(num / den * size) shingles, so T shingles must stand in other sets
    too, and in the order (number of sets, bucket, hash) the first shared one is among the first size - T + 1.
    """

    def run(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        kinds, answers = group["kind"].to_pylist(), group["answer"].to_pylist()
        (info,) = [a for k, a in zip(kinds, answers) if k == _INFO]
        ids, valid, size, first, second, lead = unpress(info[16:], np.int64).reshape(6, -1)
        docs, lists, counts, where = [], [], [], []
        for kind, answer in zip(kinds, answers):
            if kind == _SHARED:
                bucket, a, b = np.frombuffer(answer, np.int64, 3)
                rest = answer[24:]
                lists.append(unpress_steps(rest[:a]))
                docs.append(unpress_planes(rest[a : a + b]).astype(np.int64))
                counts.append(unpress(rest[a + b :], np.uint8))
                where.append(np.full(len(lists[-1]), bucket))
        prints = pa.array([int(np.frombuffer(info, np.int64, 1)[0]), *[None] * (len(size) - 1)], pa.int64())  # with the first row
        columns = {"node": (block << ROW_BITS) + np.arange(len(size)), "id": ids, "size": size, "first": first, "second": second}
        out = [pa.table({**{c: pa.array(v, pa.int64(), mask=(valid == 0) if c == "id" else None) for c, v in columns.items()}, "bucket": pa.nulls(len(size), pa.int32()), "hashes": pa.nulls(len(size), pa.binary()), "nodes": pa.nulls(len(size), pa.binary()), "print": prints})]
        if lists:
            doc, value, count, where = map(np.concatenate, (docs, lists, counts, where))
            shared = np.bincount(doc, minlength=len(size))
            wanted = shared - _least(size, num, den) + 1  # of the shared ones, how many begin the order
            order = np.lexsort((value, where, count, doc))
            doc, value, where = doc[order], value[order], where[order]
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = nth < wanted[doc]
            doc, value, where = doc[keep], value[keep], where[keep]
            order = np.lexsort((value, where))
            doc, value, where = doc[order], value[order], where[order]
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            none = pa.nulls(len(full), pa.int64())
            out.append(
                pa.table(
                    {
                        "node": none, "id": none, "size": none, "first": none, "second": none, "bucket": pa.array(full, pa.int32()),
                        "hashes": pa.array([press_steps(value[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                        "nodes": pa.array([press_planes((block << ROW_BITS) + doc[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                        "print": none,
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def _neighbours(group: pa.Table) -> pa.Table:
    """In a bucket: each list of sets as a star around its first; every pair once."""
    value = np.concatenate([unpress_steps(x) for x in group["hashes"].to_pylist()])
    node = np.concatenate([unpress_planes(x) for x in group["nodes"].to_pylist()]).astype(np.int64)
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    head = node[np.searchsorted(value, value)]
    pairs = np.unique(np.stack((head, node), 1)[head != node], axis=0)
    return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def t_occurrence(value: np.ndarray, at: np.ndarray, num: int, den: int, mu: float = 0.0085, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its partners among the later ones, sets being sorted by size: den * |common| >= num * |either|.

    DivideSkip: of a query's inverted lists the L longest are set aside, L = T / (mu log2(longest) + 1)
    and at most T - 1, T the least overlap for the query's size. The short lists are merged; sets met T - L times or more
    stay, and are looked up by binary search in the long lists. The overlap is then exact. With ``side`` (0 or 1 for each set)
    a shingle has a list a side, and sets meet only those of the other.
    """
    size = np.diff(at)
    _, code = np.unique(value, return_inverse=True)
    doc = np.repeat(np.arange(len(size)), size)
    if side is not None:
        code = 2 * code + side[doc]
    order = np.argsort(code, kind="stable")
    posting = doc[order]
    begin = np.searchsorted(code[order], np.arange((int(code.max()) | 1) + 2 if len(code) else 1))
    place = begin[:-1].copy()  # the part of each list behind the current query
    end = begin[1:]
    own = [code[a:b] for a, b in zip(at[:-1], at[1:])]  # sorted, as hashes are
    for i, codes in enumerate(own):
        place[codes] += 1
        asked = codes if side is None else codes ^ 1
        long_enough = asked[end[asked] > place[asked]]
        least = int(_least(np.int64(len(codes)), num, den))
        if len(long_enough) < least or least == 0:
            continue
        length = end[long_enough] - place[long_enough]
        lists = long_enough[np.argsort(length, kind="stable")]
        aside = min(least - 1, int(least / (mu * np.log2(max(2, int(length.max()))) + 1)))
        brief, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        met = posting[ranges(place[brief], end[brief] - place[brief])]
        candidate, count = np.unique(met, return_counts=True)
        keep = (count >= least - aside) & (size[candidate] * num <= den * len(codes))
        candidate, count = candidate[keep], count[keep].astype(np.int64)
        if not len(candidate):
            continue
        if len(candidate) > len(long):
            for c in long.tolist():
                tail = posting[place[c] : end[c]]
                spot = np.minimum(np.searchsorted(tail, candidate), len(tail) - 1)
                count += tail[spot] == candidate
        elif len(long):
            for k, j in enumerate(candidate.tolist()):
                spot = np.minimum(np.searchsorted(own[j], long), len(own[j]) - 1)
                count[k] += int((own[j][spot] == long).sum())
        linked = den * count >= num * (len(codes) + size[candidate] - count)
        if linked.any():
            yield i, candidate[linked]


def _compare(num: int, den: int):
    """In a part: links of every set (weighted by copies) and the root of its tree of links.

    In a part of two slices of one large group only pairs across the slices are searched, none if one of them has no
    sets; pairs within a slice count in that slice's own part.
    """

    def run(group: pa.Table) -> pa.Table:
        release()
        sets = [unpress_planes(x) for x in group["sets"].to_pylist()]
        node = group["node"].to_numpy()
        side = group["slice"].to_numpy()
        _, *slices = group["part"][0].as_py().split(":")
        both = len(set(slices)) > 1
        size = np.array([len(s) for s in sets])
        order = np.lexsort((node, size))
        at = np.concatenate(([0], np.cumsum(size[order])))
        node, side, weight = node[order], side[order], group["copies"].to_numpy()[order]
        links = np.zeros(len(node), np.int64)
        root = np.arange(len(node))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = int(root[i])
            return i

        across = (side != side[0]).astype(np.int64) if both else None
        for i, found in t_occurrence(np.concatenate([sets[k] for k in order]), at, num, den, side=across):
            links[i] += weight[found].sum()
            links[found] += weight[i]
            for j in found.tolist():
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        tops = np.array([top(i) for i in range(len(node))])
        return pa.table([pa.array(node), pa.array(node[tops]), pa.array(links)], names=["node", "root", "links"])

    return run


def _linked(df: DataFrame, id_column: str, text: str, n: int, num: int, den: int, most: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Per row: node (block and place), id, size, root (a node of its component), component_id, n_links. And per block its fingerprint.

    1. Blocks send each distinct set's hashes to buckets, which return those that two sets or more
       have. A document with fewer of these than its least overlap has no partner.
    2. The others send the prefix of their set, rarest shingles first, to buckets again: partners share a prefix
       shingle. Lists become stars, not pairs, and their components the groups to search.
    3. Equal sets count once. Each group is searched by T-occurrence (``t_occurrence``); small groups share parts of about
       ``part`` shingles, a group of more is cut in slices of about that and its slices meet two at a time.
    """
    spark = df.sparkSession
    pin_splits(spark)
    buckets = bucket_count(spark)
    sent = df.select(id_column, text).mapInArrow(_send(id_column, text, n, buckets, most), "bucket int, block long, hashes binary, docs binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared(buckets), "block long, kind int, answer binary")
    told = cut_lineage(shared.groupBy("block").applyInArrow(_prefixes(buckets, num, den), _PREFIX))
    docs = told.where("node is not null").select("node", "id", "size", "first", "second")
    marks = told.where("print is not null").select(F.shiftright("node", ROW_BITS).alias("block"), "print")
    stars = told.where("bucket is not null").groupBy("bucket").applyInArrow(_neighbours, "a long, b long")
    groups = cut_lineage(components(stars))
    key = ["size", "first", "second"]
    classes = docs.where("size > 0").groupBy(*key).agg(F.min("node").alias("lead"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = cut_lineage(classes)
    wanted = classes.join(groups.withColumnRenamed("node", "lead"), "lead").select("lead", "copies", "size", "root")
    sizes = wanted.groupBy("root").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles")).where("sets > 1")
    wanted = wanted.join(sizes, "root").withColumn("slices", F.least("sets", F.ceil(F.col("shingles") / part)).cast("int"))
    wanted = wanted.withColumn("slice", F.pmod(F.xxhash64("lead"), F.col("slices")).cast("int"))
    wanted = cut_lineage(wanted.withColumn("block", F.shiftright("lead", ROW_BITS)))

    def ask(group: pa.Table) -> pa.Table:
        columns = [np.asarray(group[c], np.int64) for c in ("lead", "copies", "root", "slices", "slice")]
        return pa.table([group["block"].slice(0, 1), pa.array([np.int64(group["print"][0].as_py()).tobytes() + press(np.stack(columns))], pa.binary())], names=["block", "answer"])

    def sets_of(_: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        out = []
        if answers:
            data, offsets = flat(table[text])
            lead, copies, root, slices, slice_ = unpress(signed(data, offsets, answers[0]), np.int64).reshape(5, -1)
            value, at = shingles(data, offsets, n)
            for i, doc in enumerate((lead & ((1 << ROW_BITS) - 1)).tolist()):
                out.append((lead[i], copies[i], root[i], slices[i], slice_[i], press_planes(value[at[doc] : at[doc + 1]])))
        columns = list(zip(*out)) or [()] * 6
        names = ["node", "copies", "root", "slices", "slice", "sets"]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=names)

    answers = wanted.join(marks, "block").groupBy("block").applyInArrow(ask, "block long, answer binary")
    sets = back_to_blocks(df.select(id_column, text), answers, sets_of, "node long, copies long, root long, slices long, slice long, sets binary", text, most)
    whole = F.col("slices") == 1
    held = wanted.agg(F.sum(F.when(whole, F.col("size"))).alias("small"), F.max("slices").alias("most")).first()
    shares = max(4 * buckets, -(-(held.small or 0) // part))
    one = F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(shares)).cast("string")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("slices") - 1),
        lambda t: F.concat_ws(":", F.col("root"), F.least(t, F.col("slice")), F.greatest(t, F.col("slice"))),
    )
    parts = sets.withColumn("part", F.explode(F.when(whole, one).otherwise(pairs)))
    parts = parts.withColumn("slice", F.when(whole, F.lit(0).cast("long")).otherwise(F.col("slice")))
    found = cut_lineage(parts.groupBy("part").applyInArrow(_compare(num, den), "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    if (held.most or 0) > 1:
        tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    else:
        tied = found.select("node", "root")
    tied = tied.join(links, "node").withColumnRenamed("node", "lead")
    known = classes.join(tied, "lead", "left").withColumn("root", F.coalesce("root", "lead"))
    known = known.withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(*key, "root", "component_id", F.col("links").alias("n_links"))
    rows = docs.join(known, key, "left")
    alone = F.col("size") == 0
    rows = rows.select(
        "node", "id", "size", F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )
    return rows, marks


def join(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, most: int = BLOCK, part: int = PART) -> DataFrame:
    """Per row: its id, n_shingles, component_id and n_links.

    A-Z are lower-cased and words are runs of bytes other than space and 0x09-0x0D. A document's set holds its distinct
    ``n``-word shingles (fewer words: the whole sequence; none, or a null text: an empty set, linked with nothing).
    Two documents link when den * |common| >= num * |either|; component_id is the smallest id reachable
    by links (its own id included; null ids are passed over), n_links the number of other rows linked to.
    Shingles are compared by 64-bit hash, sets by 128 bits. Repeated rows and equal texts are rows each and
    link; other columns are not carried; an empty table gives none. ``df`` is read twice and must be a plain scan;
    blocks that differ raise.
    """
    kind = df.schema[id_column].dataType
    rows, _ = _linked(df, id_column, text, n, num, den, most, part)
    return rows.select(F.col("id").cast(kind).alias(id_column), F.col("size").alias("n_shingles"), "component_id", "n_links")


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, most: int = BLOCK, part: int = PART) -> DataFrame:
    """The rows of ``df``, of every component of ``join`` the one with the smallest id (of equal ids the first).

    All columns are kept as they are. Rows without words, or alone, all stay. A null id comes after all others.
    """
    rows, marks = _linked(df, id_column, text, n, num, den, most, part)
    order = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("node"))
    kept = rows.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.node").alias("node"))

    def ask(group: pa.Table) -> pa.Table:
        nodes = np.sort(group["node"].drop_null().to_numpy())
        return pa.table([group["block"].slice(0, 1), pa.array([np.int64(group["print"][0].as_py()).tobytes() + press(nodes)], pa.binary())], names=["block", "answer"])

    def pick(_: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        if len(answers) != 1:
            raise ValueError(DIFFER)
        nodes = unpress(signed(*flat(table[text]), answers[0]), np.int64)
        return table.take(pa.array(nodes & ((1 << ROW_BITS) - 1)))

    answers = marks.join(kept.withColumn("block", F.shiftright("node", ROW_BITS)), "block", "left").groupBy("block").applyInArrow(ask, "block long, answer binary")
    return back_to_blocks(df, answers, pick, df.schema, text, most)
