"""Quality rules: word and line counts, and tokenizer fertility with rejection bands per language."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from answerloom.llm.texts import Words, blocks, flat, grams, hashes, mix, ranges, strings, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """What a text of a language may measure, whatever its length.

    Entropy is in bits, divided by log2 of the text's number of tokens, so a short text is not low for being
    short. Leaving a hard limit rejects; ``chars_per_token`` holds for both vocabularies. So does entropy below
    ``low_entropy`` together with few characters per token by either vocabulary, below ``low_chars`` (pieces) or
    ``low_byte_chars`` (byte level): text broken up by marks. Few characters per token alone may be names or
    keys, low entropy alone a long text.
    """

    chars_per_token: tuple[float, float]
    most_byte_fallback: float
    least_entropy: float
    low_chars: float = 0.0
    low_byte_chars: float = 0.0
    low_entropy: float = 0.0


#: By language, else by script ("Latn" for mostly Latin letters, "" for any other).
BANDS: Mapping[str, Band] = {
    "en": Band((1.2, 6.5), 0.10, 0.40, 2.08, 2.12, 0.70),
    "de": Band((1.2, 6.5), 0.10, 0.40, 2.08, 1.94, 0.70),
    "fr": Band((1.2, 6.5), 0.10, 0.40, 1.86, 1.76, 0.70),
    "es": Band((1.2, 6.5), 0.10, 0.40, 1.82, 1.68, 0.68),
    "Latn": Band((1.1, 8.0), 0.20, 0.35),
    "": Band((0.2, 8.0), 0.95, 0.30),
}
_OTHER_SPACE = re.compile(r"[^\S ]")
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "band string, n_tokens long, chars_per_token double, byte_chars_per_token double, byte_fallback double, token_entropy double"
)


@functools.lru_cache(maxsize=2)
def _piece_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return model, fallback


@functools.lru_cache(maxsize=2)
def _byte_model(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), spaced


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _spans(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marked bytes in every stretch from one start to the next."""
    out = np.zeros(len(at) - 1, np.int64)
    full = np.diff(at) > 0
    if full.any():
        out[full] = np.add.reduceat(marks, at[:-1][full], dtype=np.int64)
    return out


def _repeated(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which (document, value) pairs are equal to an earlier one, and which occur at all twice: two masks."""
    key = mix(values + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return later, twice


def _dup_lines(data: np.ndarray, offsets: np.ndarray, found: Words) -> np.ndarray:
    docs = len(offsets) - 1
    cut = data == 0x0A
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(cut) + 1)))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(docs, np.int64)
    kept = data[~cut]
    at = np.append(starts, len(data))
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(cut, out=breaks[1:])
    coded = strings(kept, at - breaks[at]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    has_word = np.diff(np.searchsorted(found.start, at)) > 0
    doc = np.searchsorted(offsets, starts, "right") - 1
    later, _ = _repeated(doc[has_word], code[has_word])
    return np.bincount(doc[has_word][later], minlength=docs).astype(np.int64)


def _repeat_words(found: Words, hashed: np.ndarray, n: int) -> np.ndarray:
    docs = len(found.first) - 1
    window = grams(hashed[found.code] if len(found.code) else np.zeros(0, np.uint64), n)
    if not len(window):
        return np.zeros(docs, np.int64)
    doc = found.doc
    inside = doc[: len(window)] == doc[n - 1 :]
    place = np.flatnonzero(inside)
    _, twice = _repeated(doc[place], window[place])
    mark = np.zeros(len(doc) + 1, np.int64)
    np.add.at(mark, place[twice], 1)
    np.add.at(mark, place[twice] + n, -1)
    return _sums(np.cumsum(mark)[:-1] > 0, found.first)


def _entropy(doc: np.ndarray, token: np.ndarray, docs: int, width: int) -> np.ndarray:
    """Entropy in bits of each document's tokens."""
    out = np.zeros(docs)
    total = np.bincount(doc, minlength=docs)
    if len(token):
        pairs, count = np.unique(doc * np.int64(width) + token, return_counts=True)
        owner = pairs // width
        share = count / total[owner]
        np.subtract.at(out, owner, share * np.log2(share))
    return out


def _byte_sizes(names: list[str], path: str, pattern: str) -> np.ndarray:
    """Tokens of each word with a space before it, by the byte-level vocabulary.

    Words with white space of their own (U+00A0) are encoded alone: next to each other the vocabulary joins them.
    """
    size = np.zeros(len(names), np.int64)
    alone = np.fromiter((bool(_OTHER_SPACE.search(n)) for n in names), bool, len(names))
    encoder, spaced = _byte_model(path, pattern)
    if not alone.all():  # in the joined words every word's first token, and no other, begins with the space
        joined = " " + " ".join(n for n, a in zip(names, alone) if not a)
        ids = np.array(encoder.encode_ordinary(joined), np.int64)
        size[~alone] = np.diff(np.append(np.flatnonzero(spaced[ids]), len(ids)))
    for k in np.flatnonzero(alone):
        size[k] = len(encoder.encode_ordinary(" " + names[k]))
    return size


def measures(data: np.ndarray, offsets: np.ndarray, languages: list, pieces: str, ranks: str, pattern: str, bands: Mapping[str, Band], window: int = 5) -> dict:
    docs = len(offsets) - 1
    found = words(data, offsets)
    n_words = np.diff(found.first)
    name_data, name_at = flat(found.names)
    name_chars = _spans((name_data & 0xC0) != 0x80, name_at)
    word_chars = _sums(name_chars[found.code], found.first)
    repeats = _repeat_words(found, hashes(found.names), window)
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)

    # Fertility: both vocabularies never join words, so they run over the block's distinct words.
    model, fallback = _piece_model(pieces)
    names = [w.decode() for w in found.names.to_pylist()]
    lists = model.encode(names, num_threads=1) if names else []
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat_ids = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    byte_size = _byte_sizes(names, ranks, pattern)
    code = found.code
    tokens = _sums(size[code], found.first) if len(code) else np.zeros(docs, np.int64)
    byte_tokens = _sums(byte_size[code], found.first) if len(code) else np.zeros(docs, np.int64)
    ids = flat_ids[ranges(first[code], size[code])] if len(code) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(docs), tokens)
    share = np.bincount(doc, weights=fallback[ids], minlength=docs) / np.maximum(tokens, 1)
    entropy = _entropy(doc, ids, docs, len(fallback))
    relative = entropy / np.log2(np.maximum(tokens, 2))
    per_token = word_chars / np.maximum(tokens, 1)
    per_byte_token = word_chars / np.maximum(byte_tokens, 1)
    letter = data | 0x20  # ASCII letters, and the lead bytes of Latin with accents
    latin = _spans(((letter >= 0x61) & (letter <= 0x7A)) | ((data >= 0xC3) & (data <= 0xC9)), offsets)
    is_latin = 2 * latin >= word_chars
    band = [lang if lang in bands else "Latn" if ok else "" for lang, ok in zip(languages, is_latin)]
    rules = [bands[b] for b in band]
    low, high = (np.array([r.chars_per_token[k] for r in rules]) for k in (0, 1))
    few = (per_token < np.array([r.low_chars for r in rules])) | (per_byte_token < np.array([r.low_byte_chars for r in rules]))
    fits = (
        (np.minimum(per_token, per_byte_token) >= low)
        & (np.maximum(per_token, per_byte_token) <= high)
        & (share <= np.array([r.most_byte_fallback for r in rules]))
        & (relative >= np.array([r.least_entropy for r in rules]))
        & ~(few & (relative < np.array([r.low_entropy for r in rules])))
    )
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _spans(_SYMBOLS[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, found), "n_repeat_words": repeats, "base_failed": failed,
        "kept": ~failed & fits, "band": band, "n_tokens": tokens, "chars_per_token": per_token,
        "byte_chars_per_token": per_byte_token, "byte_fallback": share, "token_entropy": entropy,
    }


def judge(
    df: DataFrame, pieces: str, ranks: str, pattern: str, text: str = "text", language: str = "lang",
    bands: Mapping[str, Band] = BANDS, columns: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its ``columns``) with the measures of every whole text and whether it is ``kept``.

    Words are runs of bytes other than space and 0x09-0x0D. ``base_failed``: fewer than 10 words, or
    over 20 % of them in 5-word windows found twice or more (windows compared by 64-bit hash). A text that passes
    is rejected if, by the public vocabularies ``pieces`` (with byte fallback) or ``ranks`` (byte-level),
    its characters per token, or by the first its byte-fallback share or token entropy, leave the band of its
    language, or for other languages (or null) that of its script. Fertility counts tokens word by word.

    A null or empty text has no words and fails. Repeated rows get the same verdict each. Very
    long texts are whole blocks of their own. Columns called like a measure are replaced. An empty
    table gives none. No shuffle.
    """
    new = T._parse_datatype_string(MEASURES).fields
    held = [f for f in df.schema.fields if (columns is None or f.name in columns) and f.name not in {n.name for n in new}]
    schema = T.StructType([*held, *new])
    need = list(dict.fromkeys([*(f.name for f in held), text, *([language] if language in df.columns else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text):
            data, offsets = flat(table[text])
            languages = table[language].to_pylist() if language in table.column_names else [None] * table.num_rows
            got = measures(data, offsets, languages, pieces, ranks, pattern, bands)
            out = table.select([f.name for f in held])
            for name, values in got.items():
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    return df.select(*need).mapInArrow(run, schema)
