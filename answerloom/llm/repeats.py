"""Suffix-array deduplication of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from answerloom.llm.exchange import (
    DIFFER, back_to_blocks, bucket_count, fingerprint, numbered, pin_splits, press, press_planes, press_steps, unpress, unpress_planes, unpress_steps,
)
from answerloom.llm.texts import flat, mix, ranges, release, strings

LENGTH = 50  # bytes of a repeated string
TRIGGER = 20  # bytes hashed to place phrase borders
BLOCK = 4 << 20
SHARE = 16 << 20  # bytes of phrases of a bucket that are unpacked at a time
SORTED = 1 << 19  # bytes of phrases whose suffixes are sorted at a time
SPREAD = 1 << 19  # strings of occurrences looked at at a time

_CODES = np.random.default_rng(50).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every k consecutive bytes, by doubling the span."""
    piece, size, out, done = _CODES[data], 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, done = piece, size
            else:
                count = len(out) - size
                out, done = out[:count] * np.uint64(pow(_BASE, size, 2**64)) + piece[done : done + count], done + size
        k >>= 1
        if k:
            count = len(piece) - size
            piece, size = piece[:count] * np.uint64(pow(_BASE, size, 2**64)) + piece[size : size + count], 2 * size
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def parse(data: np.ndarray, offsets: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the texts of a block in phrases: begin, length, place of the trigger in it, its hash, and document of each.

    The trigger of an n-byte string is the place in it whose k bytes hash lowest (the first of
    equals). Neighbouring strings with one trigger make a phrase; phrases overlap by n - 1
    bytes, so every n-byte string lies whole in exactly one, and equal strings have equal triggers wherever they stand.
    """
    size = np.diff(offsets)
    starts = ranges(offsets[:-1], np.maximum(size - n + 1, 0))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    hashed = rolling(data, k)
    place = np.arange(len(hashed), dtype=np.uint64)
    low = np.uint64((1 << int(bits)) - 1)
    least = sliding_least((hashed & ~low) | place, n - k + 1)
    trigger = (least[starts] & low).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    begin = starts[first]
    doc = np.searchsorted(offsets, begin, "right") - 1
    return begin, starts[last] - begin + n, trigger[first] - begin, hashed[trigger[first]], doc


def runs_of(data: np.ndarray, begin: np.ndarray, length: np.ndarray, trigger: np.ndarray, hashed: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases of ``parse`` to send, and how many times each stands there in a row, one step of its own strings apart.

    In a text of a short period (one byte again and again) every phrase equals the next one, a
    step on: one entry stands for all of them, and nothing is expanded to tell.
    """
    step = length - n + 1  # strings in the phrase
    like = (np.diff(begin) == step[:-1]) & (doc[1:] == doc[:-1]) & (length[1:] == length[:-1]) & (trigger[1:] == trigger[:-1]) & (hashed[1:] == hashed[:-1])
    for p in np.unique(step[:-1][like]).tolist():
        of = np.flatnonzero(like & (step[:-1] == p))
        differ = np.concatenate(([0], np.cumsum(data[:-p] != data[p:], dtype=np.int32)))
        like[of] = differ[begin[of] + length[of]] == differ[begin[of]]
    first = np.flatnonzero(np.concatenate(([True], ~like))) if len(begin) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(begin)))


def suffix_ranks(data: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """Ranks, in suffix order to depth n, of the suffixes of ``data`` at ``places``; equal ranks share n bytes.

    Prefix doubling: a rank to depth 2 d orders pairs of ranks to depth d.
    """
    depth = min(8, 1 << (n.bit_length() - 1))
    padded = np.concatenate((data, np.zeros(n + 8, np.uint8))).astype(np.uint64)
    key = np.zeros(len(data) + n, np.uint64)
    for i in range(depth):
        key = (key << np.uint64(8)) | padded[i : i + len(key)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while 2 * depth <= n:
        rank = np.append(rank, np.zeros(depth, np.uint64))
        key = (rank[:-depth] << np.uint64(32)) | rank[depth:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    key = (rank[places] << np.uint64(32)) | rank[places + n - depth]
    return np.unique(key, return_inverse=True)[1]


_SENT = "bucket int, block long, print long, docs binary, begins binary, lengths binary, times binary, triggers binary, fresh binary, again binary, text binary"


_PARTS = ("docs", "begins", "lengths", "times", "triggers", "fresh", "again", "text")


def _send(id_column: str, text: str, n: int, k: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table, data, offsets in numbered(batches, text, most):
            ids = table[id_column].combine_chunks().cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            begin, length, trigger, hashed, doc = parse(data, offsets, n, k)
            if not len(begin):
                continue
            lead, times = runs_of(data, begin, length, trigger, hashed, doc, n)
            begin, length, trigger, hashed, doc = (x[lead] for x in (begin, length, trigger, hashed, doc))
            bucket = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            mark = fingerprint(data, offsets)
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                at = np.concatenate(([0], np.cumsum(length[own])))
                coded = strings(data[ranges(begin[own], length[own])], at).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)  # numbered as they first appear
                fresh = np.diff(np.maximum.accumulate(code), prepend=-1) > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b], pa.int32()), "block": [block], "print": [mark], "docs": [press_steps(ids[doc[own]])],
                        "begins": [press_steps(begin[own])], "lengths": [press(length[own].astype(np.uint8))],
                        "times": [press_planes(times[own])],
                        "triggers": [press(trigger[own].astype(np.uint8))], "fresh": [press(np.packbits(fresh))],
                        "again": [press_planes(code[~fresh])], "text": [press(flat(coded.dictionary)[0])],
                    }
                )

    return run


def repeated_strings(doc: np.ndarray, phrase: np.ndarray, data: np.ndarray, at: np.ndarray, trigger: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which n-byte strings also start in an earlier document: (occurrence, first string, one past the last) of every run.

    ``doc`` and ``phrase`` are the parse (document and phrase of each occurrence), ``data`` and ``at``
    the dictionary, ``trigger`` each phrase's trigger place. Phrases with a trigger that only one document has are
    dropped. A phrase alone with its trigger belongs to the smallest document in its parse; the strings of
    the others are put in corpus order by the suffix array of the dictionary, and the parse gives
    each run of equal strings its smallest document.
    """
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, none, none
    length = np.diff(at)
    _, group = np.unique(_trigger_keys(data, at[:-1] + trigger, k), return_inverse=True)
    low, high = np.full(len(length), _NO_ID), np.full(len(length), np.iinfo(np.int64).min)
    np.minimum.at(low, phrase, doc)
    np.maximum.at(high, phrase, doc)
    groups = int(group.max()) + 1
    least, most = np.full(groups, _NO_ID), np.full(groups, np.iinfo(np.int64).min)
    np.minimum.at(least, group, low)
    np.maximum.at(most, group, high)
    members = np.bincount(group, minlength=groups)
    shared = least < most
    several = shared[group] & (members[group] > 1)
    alone = shared[group] & (members[group] == 1)
    # phrases alone with their trigger: whole
    occurrence = np.flatnonzero(alone[phrase] & (doc > low[phrase]))
    out = [(occurrence, np.zeros(len(occurrence), np.int64), length[phrase[occurrence]] - n + 1)]
    # the others: equal strings have equal triggers, so groups are sorted some MB at a time
    picked = np.flatnonzero(several)
    picked = picked[np.argsort(group[picked], kind="stable")]
    occurrence = np.flatnonzero(several[phrase])
    occurrence = occurrence[np.argsort(group[phrase[occurrence]], kind="stable")]
    ends = np.flatnonzero(np.diff(group[picked], append=groups)) + 1
    done = np.cumsum(length[picked])[ends - 1] if len(ends) else ends
    begin, low_at = 0, 0
    while begin < len(picked):
        last = max(int(np.searchsorted(done, low_at + SORTED, "right")) - 1, int(np.searchsorted(ends, begin, "right")))
        some = picked[begin : ends[last]]
        inside = slice(*np.searchsorted(group[phrase[occurrence]], [group[some[0]], group[some[-1]] + 1]))
        found = _sorted_strings(doc, phrase, occurrence[inside], data, at, low, some, n)
        if found is not None:
            out.append(found)
        begin, low_at = int(ends[last]), int(done[last])
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _sorted_strings(doc, phrase, occurrence, data, at, low, picked, n) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``repeated_strings`` for the ``picked`` phrases and their occurrences, by a suffix array of these phrases."""
    size = np.diff(at)[picked]
    sub = np.concatenate(([0], np.cumsum(size)))
    text = data[ranges(at[picked], size)]
    count = size - n + 1
    rank = suffix_ranks(text, n, ranges(sub[:-1], count))
    first = np.full(int(rank.max()) + 1, _NO_ID)
    np.minimum.at(first, rank, np.repeat(low[picked], count))
    smallest = first[rank]
    string_at = np.cumsum(count) - count
    order = np.argsort(picked)
    nth_phrase = order[np.searchsorted(picked, phrase[occurrence], sorter=order)]
    many = count[nth_phrase]
    out = []
    ends = np.cumsum(many)
    begin = 0
    while begin < len(occurrence):  # some million strings at a time
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - many[begin] + SPREAD, "right")))
        some = slice(begin, stop)
        own = np.repeat(occurrence[some], many[some])
        nth = ranges(np.zeros(stop - begin, np.int64), many[some])
        gone = np.flatnonzero(doc[own] > smallest[np.repeat(string_at[nth_phrase[some]], many[some]) + nth])
        if len(gone):
            fresh = np.ones(len(gone), bool)
            fresh[1:] = (np.diff(gone) != 1) | (own[gone[1:]] != own[gone[:-1]])
            at_first = np.flatnonzero(fresh)
            at_last = np.append(at_first[1:], len(gone)) - 1
            out.append((own[gone[at_first]], nth[gone[at_first]], nth[gone[at_last]] + 1))
        begin = stop
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else None


def _trigger_keys(data: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    key = np.zeros(len(begin), np.uint64)
    for i in range(k):
        key = key * np.uint64(_BASE) + _CODES[data[begin + i]]
    return key


class _Sent:
    """One row of ``_send``, unpacked anew for every share of a bucket, so that a task holds it packed meanwhile."""

    def __init__(self, row: dict):
        self.row, self.share = row, None

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, lengths and trigger places of its phrases, each once."""
        fresh = self._fresh()
        return unpress(self.row["text"], np.uint8), unpress(self.row["lengths"], np.uint8)[fresh], unpress(self.row["triggers"], np.uint8)[fresh]

    def _fresh(self) -> np.ndarray:
        count = len(unpress(self.row["lengths"], np.uint8))
        return np.unpackbits(unpress(self.row["fresh"], np.uint8), count=count).astype(bool)

    def deal(self, shares: int, k: int) -> None:
        text, length, trigger = self.phrases()
        begin = np.cumsum(length, dtype=np.int64) - length + trigger
        self.share = ((mix(_trigger_keys(text, begin, k)) >> np.uint64(32)) % np.uint64(shares)).astype(np.uint16)

    def part(self, nth: int, n: int) -> tuple[np.ndarray, ...]:
        """Of share ``nth``: bytes, lengths, trigger places of its phrases; phrase, document, begin and further bytes of its occurrences."""
        text, length, trigger = self.phrases()
        fresh = self._fresh()
        code = np.empty(len(fresh), np.int64)
        code[fresh] = np.arange(len(length))
        code[~fresh] = unpress_planes(self.row["again"])
        doc, begin = unpress_steps(self.row["docs"]), unpress_steps(self.row["begins"])
        more = (unpress_planes(self.row["times"]).astype(np.int64) - 1) * (length[code].astype(np.int64) - n + 1)
        if self.share is not None:
            own = self.share == nth
            at = np.cumsum(length, dtype=np.int64) - length
            some = own[code]
            code = (np.cumsum(own) - 1)[code[some]]
            doc, begin, more = doc[some], begin[some], more[some]
            text, length, trigger = text[ranges(at[own], length[own])], length[own], trigger[own]
        return text, length, trigger, code, doc, begin, more


def _answer(n: int, k: int):
    """In a bucket: the spans to remove, for every block that sent to it.

    Equal phrases have equal triggers, so the bucket is worked off in shares of triggers, some MB of phrases at a time.
    """

    def run(group: pa.Table) -> pa.Table:
        release()
        rows = [_Sent({c: group[c][i].as_buffer() for c in _PARTS}) for i in range(group.num_rows)]
        shares = min(1 << 16, -(-sum(zstandard.frame_content_size(r.row["text"]) for r in rows) // SHARE))
        if shares > 1:
            for r in rows:
                r.deal(shares, k)
        spans = [_share(rows, nth, n, k) for nth in range(max(1, shares))]
        start, stop, owner = (np.concatenate(x) for x in zip(*spans))
        order = np.lexsort((stop, start, owner))
        start, stop, owner = start[order], stop[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        marks, numbers, out = group["print"].to_pylist(), group["block"].to_pylist(), []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[i], cuts[i + 1])
            packed = (press_steps(start[own]), press_steps(stop[own]))
            out.append((numbers[i], np.int64([marks[i], len(packed[0])]).tobytes() + packed[0] + packed[1]))
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([a for _, a in out], pa.binary())], names=["block", "answer"])

    return run


def _share(rows: list[_Sent], nth: int, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every span to remove that the triggers of a share tell of."""
    texts, lengths, triggers, phrases, docs, begins, further, owner, known = [], [], [], [], [], [], [], [], 0
    for i, row in enumerate(rows):
        text, length, trigger, code, doc, begin, more = row.part(nth, n)
        texts.append(text)
        lengths.append(length)
        triggers.append(trigger)
        phrases.append(code + known)
        docs.append(doc)
        begins.append(begin)
        further.append(more)
        owner.append(np.full(len(doc), i, np.int32))
        known += len(length)
    data = np.concatenate(texts)
    texts.clear()
    doc, begin, phrase, length, trigger, owner, more = map(np.concatenate, (docs, begins, phrases, lengths, triggers, owner, further))
    del docs, begins, phrases, lengths, triggers, further
    at = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    coded = strings(data, at).dictionary_encode()  # one dictionary over all blocks
    del data
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, at = flat(coded.dictionary)
    places = np.zeros(len(at) - 1, np.int64)
    places[code] = trigger
    occurrence, first, last = repeated_strings(doc, code[phrase], data, at, places, n, k)
    release()
    # the strings of a run's phrases overlap, as a phrase has fewer than n: one span to the last of them
    return begin[occurrence] + first, begin[occurrence] + more[occurrence] + last - 1 + n, owner[occurrence]


def _covered(answers: list[bytes], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the bytes of a block that the spans in the answers cover."""
    change = np.zeros(len(data) + 1, np.int32)
    for answer in answers:
        mark, size = np.frombuffer(answer, np.int64, 2)
        if mark != fingerprint(data, offsets):
            raise ValueError(DIFFER)
        np.add.at(change, unpress_steps(answer[16 : 16 + size]), 1)
        np.add.at(change, unpress_steps(answer[16 + size :]), -1)
    return np.cumsum(change[:-1]) > 0


COUNTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = LENGTH, k: int = TRIGGER, columns: list[str] | None = None,
    most: int = BLOCK,
) -> DataFrame:
    """``df`` (or its ``columns``) without the bytes that an ``n``-byte string covers which also starts in a document with a smaller id.

    ``text`` becomes what is left (a character that loses some of its bytes goes whole), and n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes) are added, in place of
    columns of those names. Strings never cross documents, overlap freely and are judged on
    the input. Null or empty texts lose nothing (a null stays null). Rows under one id never cost
    each other anything; rows without an id come after all others. An empty table gives none.

    Two exchanges: phrases go to the bucket of their trigger's hash, each distinct phrase once per
    block however often it stands there and once for a run of it in a row, and spans come back to their blocks. ``df`` is read twice and
    must be a plain scan of a table, whose splits are pinned; blocks that differ raise. A phrase with many occurrences costs its
    bucket only numbers, and a bucket is unpacked some MB at a time.
    """
    if not k <= n <= 150:
        raise ValueError("the trigger must fit in the string, and a phrase in a byte's count")
    pin_splits(df.sparkSession)
    buckets = bucket_count(df.sparkSession)
    sent = df.select(id_column, text).mapInArrow(_send(id_column, text, n, k, buckets, most), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answer(n, k), "block long, answer binary")
    new = T._parse_datatype_string(COUNTS).fields
    names = {f.name for f in new}
    held = [f for f in df.schema.fields if (columns is None or f.name in columns) and f.name not in names]
    need = list(dict.fromkeys([*(f.name for f in held), text]))

    def finish(_: int, table: pa.Table, got: list[bytes]) -> pa.Table:
        data, offsets = flat(table[text])
        gone = _covered(got, data, offsets)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        edge[begins] = gone[begins]
        sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
        kept = data[~gone]
        removed = sums(gone)
        at = offsets - np.concatenate(([0], np.cumsum(removed)))
        left = [kept[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        out = table.select([f.name for f in held])
        if text in out.column_names:
            was = table[text].to_pylist()
            texts = [x.decode("utf-8", "ignore") if r else w for x, w, r in zip(left, was, removed.tolist())]
            out = out.set_column(out.schema.get_field_index(text), text, pa.array(texts, pa.string()))
        added = (np.diff(offsets), removed, sums(edge), [hashlib.sha256(x).hexdigest() for x in left])
        for field, values in zip(new, added):
            out = out.append_column(field.name, pa.array(values))
        return out

    return back_to_blocks(df.select(*need), answers, finish, T.StructType([*held, *new]), text, most)
