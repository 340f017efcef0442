"""Katz backoff scoring: Good-Turing discounted bigrams with exactly normalised backoff weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.exchange import (
    DIFFER, back_to_blocks, bucket_count, fingerprint, numbered, pin_splits, press, press_planes, press_steps, unpress, unpress_planes, unpress_steps,
)
from answerloom.llm.texts import Words, flat, hashes, lower_ascii, release, words
from answerloom.plans.staging import cut_lineage

BLOCK = 6 << 20
DISCOUNTED = 5  # counts up to this are discounted
FOLDS, HELD_OUT = 7, 2
BEGIN = 0  # the history at a text's begin; a word's number is its id + 1


@dataclass(frozen=True)
class Discounts:
    """Good-Turing ratios of counts 1 to k; other counts keep their value."""

    ratio: tuple[float, ...]

    @classmethod
    def of(cls, counts_of_counts: list[int]) -> Discounts:
        """From the numbers of n-grams seen 1, 2, ..., k + 1 times.

        Katz: r* / r with r* = (r + 1) n[r + 1] / n[r], stretched so that counts over k stay and the mass of those
        seen once goes to the unseen. Where sparse counts give no ratio in (0, 1), r loses half a count.
        """
        n = [0, *counts_of_counts]
        k = len(counts_of_counts) - 1
        out = []
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            ratio = -1.0
            if n[r] and common < 1:
                ratio = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            out.append(ratio if 0 < ratio < 1 else (r - 0.5) / r)
        return cls(tuple(out))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """count times its ratio."""
        table = np.array([0.0, *(r * x for r, x in zip(range(1, len(self.ratio) + 1), self.ratio))])
        count = np.asarray(count)
        return np.where(count < len(table), table[np.minimum(count, len(table) - 1)], count.astype(np.float64))


@dataclass(frozen=True)
class Totals:
    """What every task knows of the training texts: tokens, distinct tokens, texts, discounts of single tokens."""

    tokens: int
    types: int
    texts: int
    single: Discounts
    seen: float  # sum of the discounted counts of all types

    def probability(self, count: np.ndarray) -> np.ndarray:
        """Of a token by its training count alone; all unknown tokens together are one type. Sums to 1 over types and that one."""
        if not self.tokens:
            return np.ones(len(count))
        # With nothing discounted, one token's worth goes to the unknown.
        total = float(self.tokens) if self.seen < self.tokens else self.tokens + 1.0
        unknown = (total - self.seen) / total
        return np.where(np.asarray(count) > 0, self.single.kept(count) / total, unknown)

    def spread(self, history_count: np.ndarray, buckets: int) -> np.ndarray:
        """Over how many buckets a history's pairs are dealt: one, but for those with over a quarter of a bucket's tokens."""
        return np.maximum(1, -(-4 * buckets * history_count.astype(np.int64) // max(1, self.tokens))) if buckets > 1 else np.ones(len(history_count), np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a block, the codes of its tokens (an end after each text's words) and where each text's begin."""
    found = words(lower_ascii(data), offsets)
    texts = len(offsets) - 1
    first = found.first + np.arange(texts + 1)
    code = np.full(int(first[-1]), len(found.names), np.int64)
    inner = np.ones(len(code), bool)
    inner[first[1:] - 1] = False
    code[inner] = found.code
    return found, code, first


def _name_hashes(found: Words) -> np.ndarray:
    return np.append(hashes(found.names), np.uint64(0x5EED0FE11D))  # the last: the end


def _held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % FOLDS == HELD_OUT for i in ids], bool)


def _ask_words(id_column: str, text: str, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, data, offsets in numbered(batches, text, most):
            held = _held_out(table[id_column].to_pylist())
            found, code, first = _tokens(data, offsets)
            trained = np.bincount(code[np.repeat(~held, np.diff(first))], minlength=len(found.names) + 1)
            name = _name_hashes(found)
            bucket = (name % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((name, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            mark = fingerprint(data, offsets)
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([mark], pa.int64()),
                        pa.array([press_steps(name[own].view(np.int64))]), pa.array([press_planes(trained[own])]),
                    ],
                    names=["bucket", "block", "print", "names", "counts"],
                )

    return run


_ASKED = "bucket int, block long, print long, names binary, counts binary"
_WORDS = "block long, answer binary, tokens long, types long, single array<long>"


def _number_words(buckets: int):
    """In a bucket: the training count and a number for every distinct token; both go back to the blocks."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bucket = rows[0]["bucket"]
        lists = [unpress_steps(r["names"]).view(np.uint64) for r in rows]
        name, code = np.unique(np.concatenate(lists), return_inverse=True)
        count = np.zeros(len(name), np.int64)
        np.add.at(count, code, np.concatenate([unpress_planes(r["counts"]) for r in rows]).astype(np.int64))
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        answers = []
        for i in range(len(rows)):
            own = code[at[i] : at[i + 1]]
            parts = press_steps(own * buckets + bucket), press_planes(count[own])
            answers.append(np.int64([bucket, len(parts[0]), rows[i]["print"]]).tobytes() + b"".join(parts))
        single = np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        none = [None] * (len(rows) - 1)
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int64()), "answer": pa.array(answers, pa.binary()),
                "tokens": pa.array([int(count.sum()), *none], pa.int64()), "types": pa.array([int((count > 0).sum()), *none], pa.int64()),
                "single": pa.array([single.tolist(), *none], pa.list_(pa.int64())),
            }
        )

    return run


def _known(name: np.ndarray, answers: list[bytes], buckets: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each of a block's distinct tokens, from the buckets' answers.

    ``mark`` is the block's fingerprint; answers to another reading of it raise.
    """
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((name, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    number, count = np.full(len(name), -1), np.zeros(len(name), np.int64)
    for answer in answers:
        b, size, was = np.frombuffer(answer, np.int64, 3)
        if was != mark:
            raise ValueError(DIFFER)
        own = order[cuts[b] : cuts[b + 1]]
        number[own], count[own] = unpress_steps(answer[24 : 24 + size]), unpress_planes(answer[24 + size :])
    if (number < 0).any():
        raise ValueError(DIFFER)
    return number, count


_PACKED = ("ids", "sums", "state", "histories", "spans", "words", "singles", "counts", "frequent")
_PAIRS = "bucket int, block long, " + ", ".join(f"{c} binary" for c in _PACKED)


def _in_order(bucket: np.ndarray, history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Sorts by bucket, history and word; as one number where that fits in 63 bits."""
    bits = int(max(history.max(initial=0), word.max(initial=0)) + 1).bit_length()
    if 2 * bits + int(bucket.max(initial=0) + 1).bit_length() <= 63:
        return np.argsort((bucket << (2 * bits)) | (history << bits) | (word + 1), kind="stable")
    return np.lexsort((word, history, bucket))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _ask_pairs(id_column: str, text: str, totals: Totals, buckets: int):
    """For a block's rows and its words' counts: its distinct pairs for the buckets, and what scoring needs of its texts.

    An unknown word is number -1; with a known history it is asked for like any pair (and never found), so that the
    history's backoff weight comes back. A history that training never saw backs off with weight 1, at once.
    """

    def run(block: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
        data, offsets = flat(table[text])
        ids = table[id_column].to_pylist()
        held = _held_out(ids)
        found, code, first = _tokens(data, offsets)
        number, count = _known(_name_hashes(found), answers, buckets, fingerprint(data, offsets))
        lengths = np.diff(first)
        text_of = np.repeat(np.arange(len(ids)), lengths)
        token_count = count[code]
        history, of_history = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        history[1:], of_history[1:] = number[code[:-1]] + 1, token_count[:-1]
        history[first[:-1]], of_history[first[:-1]] = BEGIN, totals.texts
        word = np.where(token_count > 0, number[code], -1)
        place = np.flatnonzero(of_history > 0)
        spread = totals.spread(of_history[place], buckets)
        salt = ((word[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % spread
        bucket = (history[place] * 2654435761 + salt) % buckets
        order = _in_order(bucket, history[place], word[place])
        place, bucket, spread = place[order], bucket[order], spread[order]
        new = np.flatnonzero(_changes(word[place], history[place])) if len(place) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(place)))
        lead, bucket, spread = place[new], bucket[new], spread[new]
        trains = np.add.reduceat((~held)[text_of[place]].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
        single = totals.probability(token_count)
        rest = of_history == 0
        base = np.log10((token_count + 1) / (totals.tokens + totals.types + 1))
        per_text = lambda values, of=text_of: np.bincount(of, values, len(ids))
        sums = np.stack((per_text(base), per_text(token_count > 0), lengths.astype(np.float64), per_text(np.log10(single[rest]), text_of[rest])))
        unseen = trains == 0  # here; whether anywhere, the buckets tell
        parts = press_planes(times), press_planes(text_of[place]), press_steps(history[lead]), press_planes(unseen), press_planes(token_count[lead][unseen])
        flags = held.astype(np.int64) + 2 * np.array([i is None for i in ids], np.int64)
        packed_ids = press(np.stack((np.array([0 if i is None else i for i in ids], np.int64), flags)))
        columns: dict[str, list] = {c: [None] for c in _PACKED}
        columns |= {"ids": [packed_ids], "sums": [press(sums)], "state": [np.int64([len(x) for x in parts]).tobytes() + b"".join(parts)]}
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        for b in full:
            own = slice(cuts[b], cuts[b + 1])
            past = history[lead[own]]
            heads = np.flatnonzero(np.diff(past, prepend=-1))
            for name, value in (
                ("histories", press_steps(past[heads])), ("spans", press_planes(np.diff(np.append(heads, len(past))))),
                ("words", press_planes(word[lead[own]] + 1)), ("singles", press_planes(token_count[lead[own]])),
                ("counts", press_planes(trains[own])), ("frequent", press(np.packbits(spread[own][heads] > 1))),
            ):
                columns[name].append(value)
        size = 1 + len(full)
        keys = {"bucket": pa.array([buckets + block % buckets, *full], pa.int32()), "block": pa.array([block] * size, pa.int64())}
        return pa.table(keys | {c: pa.array(v + [None] * (size - len(v)), pa.binary()) for c, v in columns.items()})

    return run


_SUMS = DISCOUNTED + 2  # of a history: its count, how many words follow it 1 to k times, their summed single probabilities
_COUNTED = "block long, ids binary, sums binary, state binary, answer binary, pairs array<long>, hot array<struct<history: long, sums: array<double>>>"


def _count_pairs(totals: Totals, buckets: int):
    """In a bucket: the count of every pair, and what the backoff weights of its histories need; these go back to the blocks.

    The sums of a frequent history, whose pairs are dealt over several buckets, are parts, listed to be added up.
    """

    def run(group: pa.Table) -> pa.Table:
        release()
        rows = group.to_pylist()
        empty = {c: [None] * len(rows) for c in ("ids", "sums", "state", "answer", "pairs", "hot")}
        if rows[0]["bucket"] >= buckets:
            out = empty | {c: [r[c] for r in rows] for c in ("ids", "sums", "state")}
        else:
            out = empty
            lists, flags = [], []
            for r in rows:
                past, spans = unpress_steps(r["histories"]), unpress_planes(r["spans"]).astype(np.int64)
                flags.append(past[np.unpackbits(unpress(r["frequent"], np.uint8), count=len(past)).astype(bool)])
                lists.append((np.repeat(past, spans), *(unpress_planes(r[c]).astype(np.int64) for c in ("words", "singles", "counts"))))
            history, word, single, count = (np.concatenate(x) for x in zip(*lists))
            order = _in_order(np.zeros(len(history), np.int64), history, word)
            new = _changes(history[order], word[order])
            code = np.empty(len(order), np.int64)
            code[order] = np.cumsum(new) - 1
            lead = order[new]
            total = np.bincount(code, weights=count, minlength=len(lead)).astype(np.int64)  # exact below 2^53
            head = _changes(history[lead])
            owner, nth = history[lead][head], np.cumsum(head) - 1
            sums = np.stack(
                [
                    np.bincount(nth, total, len(owner)),
                    *(np.bincount(nth, total == r, len(owner)) for r in range(1, DISCOUNTED + 1)),
                    np.bincount(nth, np.where(total > 0, totals.probability(single[lead]), 0.0), len(owner)),
                ]
            )
            at = np.cumsum([0, *(len(x[0]) for x in lists)])
            for i, r in enumerate(rows):
                asked = np.searchsorted(owner, unpress_steps(r["histories"]))
                packed = [press_planes(total[code[at[i] : at[i + 1]]]), *(press_planes(sums[j][asked].astype(np.int64)) for j in range(_SUMS - 1)), press(sums[-1][asked])]
                out["answer"][i] = np.int64([r["bucket"], *map(len, packed)]).tobytes() + b"".join(packed)
            out["pairs"][0] = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()
            hot = np.searchsorted(owner, np.unique(np.concatenate(flags)))
            out["hot"][0] = [{"history": int(owner[i]), "sums": sums[:, i].tolist()} for i in hot]
        kinds = {"pairs": pa.list_(pa.int64()), "hot": pa.list_(pa.struct([("history", pa.int64()), ("sums", pa.list_(pa.float64()))]))}
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64())} | {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    return run


def weights(sums: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Per history the divisor of its kept counts and its backoff weight; together its probabilities sum to 1 exactly.

    Where no follower is discounted, one count is added to the divisor, so that the unseen keep a share.
    """
    count, times, alone = sums[0], sums[1:-1], sums[-1]
    r = np.arange(1, len(times) + 1)
    kept = count + (times * (r * (np.array(discounts.ratio) - 1))[:, None]).sum(0)
    nothing = (times.sum(0) == 0) | (kept >= count)
    total = np.where(nothing, count + 1.0, count)
    kept = np.where(nothing, count, kept)
    safe = np.maximum(total, 1.0)
    return total, np.where(count > 0, (1 - kept / safe) / (1 - alone), 1.0)


def _score(totals: Totals, discounts: Discounts, hot: dict[int, list[float]]):
    """In a block: the probability of every distinct pair, by its count or by backing off, added up over the texts."""

    def run(group: pa.Table) -> pa.Table:
        (mine,) = [r for r in group.select(["ids", "sums", "state"]).to_pylist() if r["ids"] is not None]
        answers = [a for a in group["answer"].to_pylist() if a is not None]
        ids, flags = unpress(mine["ids"], np.int64).reshape(2, -1)
        base, known, tokens, score = unpress(mine["sums"], np.float64).reshape(4, -1)
        size = np.frombuffer(mine["state"], np.int64, 5)
        cuts = 40 + np.cumsum([0, *size])
        part = [mine["state"][a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        times, text_of = unpress_planes(part[0]).astype(np.int64), unpress_planes(part[1]).astype(np.int64)
        history, unseen, count_alone = unpress_steps(part[2]), unpress_planes(part[3]).astype(bool), unpress_planes(part[4])
        counts, sums, heads, at = [], [], [], 0
        for answer in sorted(answers, key=lambda a: int(np.frombuffer(a, np.int64, 1)[0])):
            sizes = np.frombuffer(answer, np.int64, _SUMS + 2)
            edge = 8 * (_SUMS + 2) + np.cumsum([0, *sizes[1:]])
            pieces = [answer[a:b] for a, b in zip(edge[:-1], edge[1:])]
            counts.append(unpress_planes(pieces[0]).astype(np.int64))
            sums.append(np.stack([*(unpress_planes(p).astype(np.float64) for p in pieces[1:-1]), unpress(pieces[-1], np.float64)]))
            own = history[at : at + len(counts[-1])]
            heads.append(np.diff(own, prepend=-1) != 0)
            at += len(own)
        if counts:
            count, sums, head = np.concatenate(counts), np.concatenate(sums, 1), np.concatenate(heads)
            nth = np.cumsum(head) - 1
            listed = history[head]
            for i in np.flatnonzero(np.isin(listed, list(hot))).tolist():
                sums[:, i] = hot[int(listed[i])]
            total, backoff = weights(sums, discounts)
            alone = np.zeros(len(count))
            alone[unseen] = totals.probability(count_alone)
            chance = np.where(count > 0, discounts.kept(count) / total[nth], backoff[nth] * alone)
            score = score + np.bincount(text_of, np.repeat(np.log10(chance), times), len(ids))
        arrays = [pa.array(ids, pa.int64(), mask=flags >= 2), pa.array(flags % 2 == 1), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64))]
        arrays += [pa.array(np.full(len(ids), totals.tokens)), pa.array(base), pa.array(score)]
        return pa.table(arrays, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """Per row the log10 probability of its text under bigrams with Katz backoff, trained on the rows not held out.

    Tokens are words (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased) and an end; a text begins with a history
    of its own. Held out: crc32 of the id as text, modulo 7, is 2. P(w | h) is the Good-Turing discounted
    count over the history's count if the pair was seen, else the history's backoff weight times P(w), itself
    discounted, the unknown words being one type; a history without training backs off with weight 1. Base score: add-one
    single tokens. A null or empty text is its end alone; a null id counts as the empty text; repeated rows train
    and are scored each. An empty table gives none. With no training text every probability of a token is 1.

    Words are compared by 64-bit hash. Blocks of texts send distinct words, then distinct pairs, to buckets, which add up, write
    their n-gram tables and send the counts back; a history with more than a quarter of a bucket's tokens is dealt by its
    words as well. To the driver come the totals, counts of counts, and the sums of those fewer than 4 * buckets histories.
    ``df`` is read twice and must be a plain scan; its splits are pinned, and blocks that differ raise.
    """
    spark = df.sparkSession
    pin_splits(spark)
    buckets = bucket_count(spark)
    narrow = df.select(id_column, text)
    asked = narrow.mapInArrow(_ask_words(id_column, text, buckets, most), _ASKED)
    numbers = cut_lineage(asked.groupBy("bucket").applyInArrow(_number_words(buckets), _WORDS))
    add = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    held = F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    texts = df.where(~held).count()
    row = numbers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), add("single", DISCOUNTED + 1).alias("single")).first()
    tokens, types = int(row.tokens or 0), int(row.types or 0)
    single = [int(x or 0) for x in row.single]
    first = Discounts.of(single)
    lost = sum(r * n * (1 - ratio) for r, n, ratio in zip(range(1, DISCOUNTED + 1), single, first.ratio))
    totals = Totals(tokens, types, texts, first, tokens - lost)
    pairs = back_to_blocks(narrow, numbers.select("block", "answer"), _ask_pairs(id_column, text, totals, buckets), _PAIRS, text, most)
    counted = cut_lineage(pairs.groupBy("bucket").applyInArrow(_count_pairs(totals, buckets), _COUNTED))
    double = [int(x or 0) for x in counted.agg(add("pairs", DISCOUNTED + 1).alias("n")).first().n]
    parts = counted.where("hot is not null").select(F.explode("hot").alias("h")).groupBy("h.history")
    hot = {r.history: [r[f"s{i}"] for i in range(_SUMS)] for r in parts.agg(*(F.sum(F.col("h.sums")[i]).alias(f"s{i}") for i in range(_SUMS))).collect()}
    blocks = counted.select("block", "ids", "sums", "state", "answer")
    scored = blocks.groupBy("block").applyInArrow(_score(totals, Discounts.of(double), hot), SCORES)
    return scored.withColumnRenamed("id", id_column)
