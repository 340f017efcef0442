"""BPE encoding and decoding by a pair occurrence index over all distinct words of a block."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from answerloom.llm.texts import blocks, flat, ranges, strings

# The splitting pattern of byte-level vocabularies and the printable stand-ins of bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: A text may be cut before a space if a byte follows that begins no white space.
_STARTS = np.zeros(256, bool)
_STARTS[0x21:0x7F] = True
_STARTS[[b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)]] = True


def byte_names() -> list[str]:
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in PRINTABLE else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges by rank, and the bytes of every id, from a public tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        ids = model["vocab"]
        names = byte_names()
        self.byte_id = np.array([ids[name] for name in names], np.int32)
        back = {name: b for b, name in enumerate(names)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.size = max(ids.values()) + 1
        born = np.full(self.size, -1)
        born[self.made] = np.arange(len(merges))
        if len(set(self.made.tolist())) != len(merges) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge must come after those that make its parts")
        keys = self.left * self.size + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        token = [b""] * max(self.size, *(i + 1 for i in self.special.values()))
        for name, i in ids.items():
            if name not in self.special:
                token[i] = bytes(back[c] for c in name)
        for name, i in self.special.items():
            token[i] = name.encode()
        self.token_at = np.cumsum([0, *map(len, token)])
        self.token_data = np.frombuffer(b"".join(token), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(vocab: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word, end to end, and where each word's begin. ``data``: bytes of the words, ``at``: their starts.

    The index maps a rank to all the places in the block where its pair stands. Ranks are taken
    in ascending order from a heap; each merges all its places at once, and the pairs this makes
    with the neighbours go to the lists of their ranks. Lists keep places whose pair has
    gone meanwhile; these are dropped when their rank's turn comes. A merge makes only pairs of
    higher rank, so every word gets its merges in the order it would get alone.
    """
    n = len(data)
    symbol = vocab.byte_id[data]
    none = len(vocab.keys)
    after = np.arange(1, n + 1, dtype=np.int32)  # next live place, n at the end
    before = np.arange(-1, n - 1, dtype=np.int32)
    last = np.zeros(n + 1, bool)  # no pair crosses words
    ends = at[1:][np.diff(at) > 0]
    last[ends - 1] = True
    last[n] = True
    after[ends - 1] = n
    starts = at[:-1][np.diff(at) > 0]
    before[starts] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks < none
        places, ranks = places[keep], ranks[keep]
        if not len(places):
            return
        if len(places) == 1:
            groups = [(int(ranks[0]), places)]
        else:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = np.concatenate(([0], cuts))
            stops = np.concatenate((cuts, [len(ranks)]))
            groups = [(r, places[a:b]) for r, a, b in zip(ranks[firsts].tolist(), firsts.tolist(), stops.tolist())]
        for rank, chunk in groups:
            held = index.get(rank)
            if held is None:
                index[rank] = [chunk]
                heapq.heappush(heap, rank)
            else:
                held.append(chunk)

    inner = np.flatnonzero(~last[:n]).astype(np.int32)
    if len(inner):
        add(inner, vocab.rank(symbol[inner], symbol[inner + 1]))
    while heap:
        rank = heapq.heappop(heap)
        chunks = index.pop(rank)
        place = chunks[0] if len(chunks) == 1 else np.unique(np.concatenate(chunks))
        left, right, made = int(vocab.left[rank]), int(vocab.right[rank]), int(vocab.made[rank])
        place = place[symbol[place] == left]
        other = after[place]
        fits = other < n
        place, other = place[fits], other[fits]
        fits = symbol[other] == right
        place, other = place[fits], other[fits]
        if not len(place):
            continue
        if left == right and len(place) > 1:  # in a run of equal symbols every second pair, from the left
            place = np.unique(place)
            other = after[place]
            chained = np.zeros(len(place), bool)
            chained[1:] = other[:-1] == place[1:]
            number = np.arange(len(place))
            head = np.maximum.accumulate(np.where(chained, 0, number))
            odd = (number - head) % 2 == 0
            place, other = place[odd], other[odd]
        symbol[place] = made
        symbol[other] = -1
        beyond = after[other]
        after[place] = beyond
        onward = beyond < n
        before[beyond[onward]] = place[onward]
        ahead = before[place]
        back = ahead >= 0
        lefts = ahead[back]
        pairs = np.concatenate((lefts, place[onward]))
        if len(pairs):
            add(pairs, vocab.rank(symbol[pairs], symbol[after[pairs]]))
    live = symbol >= 0
    count = np.zeros(n + 1, np.int64)
    np.cumsum(live, out=count[1:])
    return symbol[live], count[at]


def _pieces(pattern, special, chunk: str) -> list[str]:
    """A chunk's words; special tokens stand alone, marked by a leading NUL pair."""
    if special is None or not special.search(chunk):
        return pattern.findall(chunk)
    out, at = [], 0
    for m in special.finditer(chunk):
        out += pattern.findall(chunk[at : m.start()]) + ["\0\0" + m.group()]
        at = m.end()
    return out + pattern.findall(chunk[at:])


def encode_block(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block end to end, and where each text's begin.

    Texts are first cut before single spaces that begin a word (no word reaches over such a
    cut), so the pattern runs over the distinct chunks only, and BPE over their distinct words.
    """
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & _STARTS[data[2:]]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    cut[begins] = True
    ahead = begins[begins > 0] - 1
    cut[ahead[data[ahead] == 0x20]] = False  # a last space belongs to the text before
    cut[begins] = True
    at = np.flatnonzero(cut)
    chunks = strings(data, np.append(at, len(data))).dictionary_encode()
    pattern = regex.compile(PATTERN)
    special = re.compile("|".join(map(re.escape, vocab.special))) if vocab.special else None
    numbers: dict[str, int] = {}
    listed: list[int] = []
    counts = np.zeros(len(chunks.dictionary), np.int64)
    for i, chunk in enumerate(chunks.dictionary.to_pylist()):
        found = _pieces(pattern, special, chunk.decode())
        counts[i] = len(found)
        for word in found:
            listed.append(numbers.setdefault(word, len(numbers)))
    names = list(numbers)
    marked = {i: vocab.special[w[2:]] for i, w in enumerate(names) if w.startswith("\0\0") and w[2:] in vocab.special} if vocab.special else {}
    packed = [b"" if i in marked else w.encode() for i, w in enumerate(names)]
    word_at = np.zeros(len(packed) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)), out=word_at[1:])
    ids, first = encode_words(vocab, np.frombuffer(b"".join(packed), np.uint8), word_at)
    if marked:
        places = np.array(sorted(marked))
        ids = np.insert(ids, first[places], [marked[i] for i in sorted(marked)])
        first = first + np.searchsorted(places, np.arange(len(first)), "left")
    words = np.array(listed, np.int64)
    length = np.diff(first)
    chunk_first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=chunk_first[1:])
    chunk_ids = ids[ranges(first[words], length[words])]
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(length[words], out=ends[1:])
    chunk_at = ends[chunk_first]
    code = chunks.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(chunk_at)[code]
    total = np.zeros(len(code) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return chunk_ids[ranges(chunk_at[code], sizes)], total[np.searchsorted(at, offsets)]


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    size = np.diff(vocab.token_at)[ids]
    return vocab.token_data[ranges(vocab.token_at[ids], size)].tobytes()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", most: int = 4 << 20) -> DataFrame:
    """``df`` with the ids of every whole text (array<int>) and the text decoded from them.

    ``path`` names a byte-level BPE file; special tokens found in a text become their ids.
    Null and empty texts give no ids and an empty text. Repeated rows and very long texts are
    treated as any other; columns of ``df`` called like the two results are replaced. An empty table
    gives none. Work is per block of ``most`` bytes of text, without a shuffle.
    """
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for table in blocks(batches, text, most):
            data, offsets = flat(table[text])
            found, first = encode_block(vocab, data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))
            back = [decode(vocab, found[a:b]).decode("utf-8", "replace") for a, b in zip(first[:-1], first[1:])]
            out = table.select([f.name for f in kept]).append_column(ids, lists).append_column(decoded, pa.array(back, pa.string()))
            yield from out.to_batches()

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids, and the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for table in blocks(batches, text):
            data, offsets = flat(table[text])
            found, first = encode_block(vocab, data, offsets)
            found = found.astype("<u4")
            spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    table[id_column].combine_chunks() if table[id_column].num_chunks != 1 else table[id_column].chunk(0),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(found[a:b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(decode(vocab, found[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in spans]),
                ],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(id_column, text).mapInArrow(run, schema)
