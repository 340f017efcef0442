"""Hierarchical packing of documents into token windows of several sizes."""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from answerloom.llm.bpe import byte_names
from answerloom.llm.texts import blocks, flat, ranges, strings

WINDOW = 4096
TIERS = (4096, 2048, 1024, 512, 256)  # context sizes; smaller leftovers use the powers of two below
STEP_TOKENS = 64 * WINDOW  # tokens of a training step

PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, window int, step_group long, attention long"
)


class Encoder:
    """Ids of words of a vocabulary with word ends, as its tokenizers file gives them.

    The library spends most of its time on one word around the merges, so distinct words, already
    normalised and split as the file says, are merged in one call by the same merge ranks: a NUL byte marks
    the end of each word. Words with a NUL of their own, and files of another kind, take the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.pattern = spec["model"], None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != "</w>" or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            return
        ids, names = model["vocab"], byte_names()
        back = {name: b for b, name in enumerate(names)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [a + b for a, b in merges]
        token = lambda name: bytes(back[c] for c in name.removesuffix("</w>")) + b"\0" * name.endswith("</w>")
        ordered = [*names, *(n + "</w>" for n in names), *made]
        ranks = {token(name): i for i, name in enumerate(ordered)}
        ranks |= {bytes([b]): b for b in range(256)}
        if len(ranks) != len(ordered):
            return
        self.pattern = regex.compile("\n|" + splits[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger = tiktoken.Encoding("words", pat_str="[^\n]+", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array([ids[name] for name in ordered], np.int64)
        self.ends = np.array([t.endswith(b"\0") for t in ranks], bool)

    def words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(self.merger.encode_ordinary("\0\n".join(names) + "\0"), np.int64) if names else np.zeros(0, np.int64)
        found = found[found != 10]  # the line breaks between words
        return self.ids[found], np.diff(np.concatenate(([0], np.flatnonzero(self.ends[found]) + 1)))

    def by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.int64), np.array([len(x) for x in found], np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without line breaks, end to end, and how many each has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = "\n".join(pieces)
        # Which characters are letters changes with the Unicode version; those unknown here are left to the library.
        unknown = set() if joined.isascii() else {c for c in set(joined) if unicodedata.category(c) == "Cn"}
        if self.pattern is None or "\0" in joined or unknown or any(s in joined for s in self.special):
            odd = [i for i, p in enumerate(pieces) if self.pattern is None or "\0" in p or not unknown.isdisjoint(p) or any(s in p for s in self.special)]
            ids, size = self.by_library([pieces[i] for i in odd])
            if len(odd) == len(pieces):
                return ids, size
            plain = sorted(set(range(len(pieces))) - set(odd))
            more, sizes = self.pieces([pieces[i] for i in plain])
            both, total = np.concatenate((ids, more)), np.concatenate((size, sizes))
            order = np.argsort(np.array(odd + plain))
            first = np.cumsum(total) - total
            return both[ranges(first[order], total[order])], total[order]
        # Lower case is taken character by character, so a last sigma is no special case.
        joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3").lower()
        found = self.pattern.findall(joined)
        names = dict.fromkeys(found)
        names.pop("\n", None)
        ids, size = self.words(list(names))
        first = np.cumsum(size) - size
        numbers = dict(zip(names, range(len(names))))
        numbers["\n"] = -1
        code = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        mark = code < 0
        size = np.append(size, 0)
        first = np.append(first, 0)
        ends = np.cumsum(size[code])
        borders = np.concatenate(([0], ends[mark], [ends[-1] if len(ends) else 0]))
        return ids[ranges(first[code], size[code])], np.diff(borders)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every text, each followed by ``end_id``, end to end, and where each text's begin.

    The vocabulary must drop white space and never join over it: a text's ids are then those of its pieces
    between spaces and line breaks, and each distinct piece of a block is encoded once.
    """
    docs = len(offsets) - 1
    gap = (data == 0x20) | (data == 0x0A)
    begins = ~gap
    begins[1:] &= gap[:-1]
    cuts = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[cuts] = ~gap[cuts]
    starts = np.flatnonzero(begins)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~gap, out=kept[1:])
    coded = strings(data[~gap], np.append(kept[starts], kept[-1])).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    pieces = [x.decode() for x in coded.dictionary.to_pylist()]
    ids, size = encoder(path).pieces(pieces)
    first = np.cumsum(size) - size
    of_doc = np.searchsorted(starts, offsets)
    sizes = size[code] if len(code) else np.zeros(0, np.int64)
    ends = np.zeros(len(code) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    at = ends[of_doc] + np.arange(docs + 1)  # one end id before each later document
    out = np.full(int(at[-1]), end_id, np.int64)
    if len(code):
        body = np.ones(len(out), bool)
        body[at[1:] - 1] = False
        out[body] = ids[ranges(first[code], sizes)]
    return out, at


class _Waiting:
    """Remainders by length, with a bit per length that has some, so that finding, adding and taking one costs the same for any number."""

    def __init__(self) -> None:
        self.of: dict[int, deque[tuple[int, int]]] = {}
        self.lengths = 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.of.setdefault(length, deque()).append((doc, start))
        self.lengths |= 1 << length

    def longest(self, limit: int) -> int:
        """The largest length in use up to ``limit``, else -1."""
        return (self.lengths & ((2 << limit) - 1)).bit_length() - 1

    def shortest(self) -> int:
        return (self.lengths & -self.lengths).bit_length() - 1

    def take(self, length: int) -> tuple[int, int]:
        found = self.of[length].popleft()
        if not self.of[length]:
            self.lengths &= ~(1 << length)
        return found


def plan(lengths: np.ndarray, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple]:
    """(document, start, length, sequence, offset, window, step group, attention) of every piece.

    1. A document's full windows are sequences; what is left is routed to the smallest tier that holds it.
    2. In each tier, from the longest, a remainder opens a window of the tier. The gap is filled by the longest
       waiting remainder that fits, of the tier or a shorter one; where none fits, the shortest waiting
       one is cut to fill it and its rest waits in its own tier.
    3. What no longer fills a window of its tier goes down a tier, in the end to powers of two
       below the smallest, so nothing is padded.
    4. Sequences of one window size are sorted by attention cost (sum of squared piece lengths) and
       dealt to step groups of ``step_tokens`` tokens in turn, back and forth, so that groups cost about the same.
    """
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting, total = _Waiting(), 0
    for doc, length in enumerate(lengths.tolist()):
        full = length // window
        sequences += [(window, [(doc, i * window, window)]) for i in range(full)]
        if length % window:
            waiting.add(length % window, doc, full * window)
            total += length % window
    sizes = list(tiers) + [1 << i for i in range((tiers[-1]).bit_length() - 2, -1, -1)]
    for k, size in enumerate(sizes):
        low = sizes[k + 1] if k + 1 < len(sizes) else 0
        while total >= size and waiting.longest(window) > low:
            pieces, gap = [], size
            while gap:
                length = waiting.longest(gap)
                if length > 0:
                    doc, start = waiting.take(length)
                    pieces.append((doc, start, length))
                    gap -= length
                else:
                    length = waiting.shortest()
                    doc, start = waiting.take(length)
                    pieces.append((doc, start, gap))
                    waiting.add(length - gap, doc, start + gap)
                    gap = 0
            total -= size
            sequences.append((size, pieces))
    out = []
    cost = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    group_base = 0
    group = [0] * len(sequences)
    by_size: dict[int, list[int]] = {}
    for i, (size, _) in enumerate(sequences):
        by_size.setdefault(size, []).append(i)
    for size in sorted(by_size, reverse=True):
        order = sorted(by_size[size], key=lambda i: (-cost[i], i))
        groups = max(1, round(len(order) * size / step_tokens))
        for place, i in enumerate(order):
            turn, at = divmod(place, groups)
            group[i] = group_base + (at if turn % 2 == 0 else groups - 1 - at)
        group_base += groups
    for i, (size, pieces) in enumerate(sequences):
        offset = 0
        for doc, start, length in pieces:
            out.append((doc, start, length, i, offset, size, group[i], cost[i]))
            offset += length
    return out


def pack(
    df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", end_id: int = 2, window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    Columns: the id, start (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset (in the sequence), window (its size), step_group, attention, and with ``with_ids`` the ids. A null or
    empty text is its end id alone; repeated rows are documents each; a document longer than a
    window fills windows of its own. An empty table gives no rows; other columns are not carried.

    Packing is local to blocks of texts: a block of 4 MB fills some hundred windows, each exactly, and its
    leftover of under one window goes to powers of two, so larger blocks would save nothing. No shuffle, and a
    lost task repeats its block alone.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {PIECES}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, table in enumerate(blocks(batches, text)):
            data, offsets = flat(table[text])
            ids, at = token_ids(path, data, offsets, end_id)
            ids = ids.astype("<u4")
            lengths = np.diff(at)
            rows = plan(lengths, window, tiers)
            if not rows:
                continue
            doc, start, length, seq, offset, size, group, cost = (np.array(c, np.int64) for c in zip(*rows))
            base = (part << 40) + (number << 24)
            first = at[doc] + start
            columns = [
                table[id_column].combine_chunks().take(pa.array(doc)),
                pa.array(start), pa.array(length),
                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())], pa.int64()),
                pa.array(lengths[doc]), pa.array(base + seq), pa.array(offset), pa.array(size, pa.int32()), pa.array(base + group), pa.array(cost),
            ]
            names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "attention"]
            if with_ids:
                whole = ids[ranges(first, length)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(whole)))
                names.append("ids")
            yield from pa.table(columns, names=names).to_batches()

    return df.select(id_column, text).mapInArrow(run, schema)
