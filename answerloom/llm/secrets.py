"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.plans.staging import cut_lineage

# The base patterns, and how long a match (for assign: its second group) must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # equals the runs of [0-9a-f]+ that have 32 or more
KINDS = ("assign", "access", "hex", "markov")
_CUE = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
_LONG_HEX, _KEY = re.compile(rb"[0-9a-f]{32,}"), re.compile(rb"AKIA")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(_ALPHABET.encode()):
    _CODE[_c] = _i + 1  # 0: begin, end or any other
_STATES = len(_ALPHABET) + 1
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(_ALPHABET.encode())] = True


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches in code points, leftmost and non-overlapping per kind."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio, random against ordinary, of each pair of neighbouring characters."""

    ratio: np.ndarray  # states x states
    threshold: float  # summed ratio per character from which a string counts as random
    least: int = 20  # shortest string judged

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean ratio over the steps of each run of bytes, the steps from and to its border included."""
        if not len(start):
            return np.zeros(0)
        length = end - start
        step = length + 1
        at = np.cumsum(step) - step
        before = np.zeros(int(step.sum()), np.int64)
        after = np.zeros(len(before), np.int64)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        chars = _CODE[data[np.repeat(start, length) + place]]
        own = np.repeat(at, length) + place
        after[own] = chars
        before[own + 1] = chars
        return np.add.reduceat(self.ratio[before, after], at) / step


def fit(random: list[bytes], ordinary: list[bytes], threshold: float = 0.6, least: int = 20, prior: float = 0.5) -> Markov:
    """Character models of the two labelled samples, smoothed by adding ``prior`` to every count."""

    def model(sample: list[bytes]) -> np.ndarray:
        count = np.full((_STATES, _STATES), prior)
        for word in sample:
            code = np.concatenate(([0], _CODE[np.frombuffer(word, np.uint8)], [0]))
            np.add.at(count, (code[:-1], code[1:]), 1)
        return np.log(count / count.sum(1, keepdims=True))

    return Markov(model(random) - model(ordinary), threshold, least)


def random_samples(n: int = 3000, seed: int = 11) -> list[bytes]:
    """Random strings as keys are drawn: hex, base 62, base 64 and capitals with digits, 20 to 64 long."""
    rng = np.random.default_rng(seed)
    sets = [b"0123456789abcdef", _ALPHABET[:62].encode(), _ALPHABET[:64].encode(), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    out = []
    for i in range(n):
        letters = np.frombuffer(sets[i % len(sets)], np.uint8)
        out.append(letters[rng.integers(0, len(letters), rng.integers(20, 65))].tobytes())
    return out


def _sample(df: DataFrame, text: str, id_column: str, most: int) -> DataFrame:
    """Column t: the texts of the ``most`` distinct rows (id, text) with the smallest md5 of their id, ties by that of the text.

    Rows are chosen by their md5s alone, from a share of the md5s that should hold four times as many; where it holds too
    few (ids that are few, or null) all are looked at, which chooses the same rows. Only chosen texts move.
    """
    order = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    rows = df.select(order.alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total, near = df.count(), rows
    if total > 4 * most:
        near = rows.where(F.col("o") < f"{int(2**32 * 4 * most / total):08x}")
        if near.select("o").distinct().count() < most:
            near = rows
    chosen = cut_lineage(near.select("o", F.md5("t").alias("h")).distinct().orderBy("o", "h").limit(most))
    met = rows.join(F.broadcast(chosen), "o").where(F.md5("t") == F.col("h"))  # at most ``most`` pairs of md5s
    return met.groupBy("o", "h").agg(F.first("t").alias("t")).select("t")


def train(df: DataFrame, text: str = "text", id_column: str = "doc_id", most_documents: int = 2000, drawn: int = 3000) -> Markov:
    """The model from labelled samples of bounded size.

    From ``most_documents`` distinct rows (the smallest md5 of their ids): values of base matches are
    random strings, words outside all matches are ordinary identifiers, as they are and joined by
    ``_``, ``-`` or in camel case. ``drawn`` generated keys join the random side, so that a corpus
    without secrets trains as well. Only the fit is bounded; scanning covers every text.
    """
    pieces = _sample(df, text, id_column, most_documents).mapInArrow(_label_batches, "random boolean, word string")
    words = pieces.distinct().orderBy(F.md5("word"), "random").limit(20 * most_documents).collect()  # bounded, as said above
    random = [w.word.encode() for w in words if w.random]
    ordinary = [w.word.encode() for w in words if not w.random]
    return fit(random + random_samples(drawn), ordinary + list(_join(ordinary)))


def _join(words: list[bytes]) -> Iterator[bytes]:
    for i in range(0, len(words) - 2, 3):
        a, b, c = words[i : i + 3]
        yield (a + b"_" + b + b"_" + c, a + b"-" + b, a + b.capitalize() + c.capitalize())[(i // 3) % 3]


def _labelled(text: str) -> Iterator[tuple[bool, str]]:
    at = 0
    spans = sorted((s, e, k) for s, k, e in base_spans(text))
    for start, end, kind in spans:
        yield from ((False, w) for w in re.findall(r"[A-Za-z0-9_+/=-]{3,}", text[at:start]))
        value = re.search(r"[A-Za-z0-9+/_.=-]+$", text[start:end]) if kind == "assign" else None
        word = value.group() if value else text[start:end]
        if len(word) >= 16 and any(c.isdigit() for c in word):
            yield True, word
        at = max(at, end)
    yield from ((False, w) for w in re.findall(r"[A-Za-z0-9_+/=-]{3,}", text[at:]))


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [x for t in batch.column("t").to_pylist() for x in dict.fromkeys(_labelled(t))]
        yield pa.RecordBatch.from_pydict({"random": pa.array([r for r, _ in pairs], pa.bool_()), "word": pa.array([w for _, w in pairs], pa.string())})


def _markov_spans(data: np.ndarray, offsets: np.ndarray, model: Markov) -> list[tuple[int, int, int]]:
    """(document, first byte, end) of runs of key characters, long enough, mixed and scored as random."""
    inside = np.concatenate(([False], _CANDIDATE[data], [False]))
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= model.least  # a run over a border between documents is cut below
    start, end = start[long], end[long]
    cut = np.searchsorted(offsets, start, "right") != np.searchsorted(offsets, end, "left")
    if cut.any():
        pieces = []
        for a, b in zip(start[cut], end[cut]):
            marks = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]
            pieces += [(x, y) for x, y in zip([a, *marks], [*marks, b]) if y - x >= model.least]
        start = np.concatenate((start[~cut], np.array([p[0] for p in pieces], np.int64)))
        end = np.concatenate((end[~cut], np.array([p[1] for p in pieces], np.int64)))
        order = np.argsort(start)
        start, end = start[order], end[order]
    if not len(start):
        return []
    digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    has_digit = digits[end] > digits[start]
    start, end = start[has_digit], end[has_digit]
    random = model.scores(data, start, end) >= model.threshold
    doc = np.searchsorted(offsets, start, "right") - 1
    return [(int(d), int(a), int(b)) for d, a, b in zip(doc[random], start[random], end[random])]


def spans_of(texts: list[str], data: np.ndarray, offsets: np.ndarray, model: Markov) -> list[list[tuple[int, str, int]]]:
    """All spans of every text in order: base ones, and those that only the models find (no byte shared with a base span)."""
    found: list[list[tuple[int, str, int]]] = []
    size = np.diff(offsets)
    joined = np.full(len(data) + len(size), 0x0A, np.uint8)  # a newline after each text: no match of the prefilter crosses it
    joined[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    raw = joined.tobytes()
    begins = offsets[:-1] + np.arange(len(size))
    hot: set[int] = set()
    for pattern in (_CUE, _LONG_HEX, _KEY):
        places = np.array([m.start() for m in pattern.finditer(raw)], np.int64)
        hot.update((np.searchsorted(begins, places, "right") - 1).tolist())
    for i, text in enumerate(texts):
        found.append(base_spans(text) if i in hot else [])
    for doc, a, b in _markov_spans(data, offsets, model):
        lo = int(offsets[doc])
        start = len(data[lo:a].tobytes().decode())
        end = start + b - a
        if not any(s < end and start < e for s, _, e in found[doc]):
            found[doc].append((start, "markov", end))
    return [_order(s) for s in found]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, model: Markov, text: str = "text", spans: str = "secrets", columns: list[str] | None = None, mask: str | None = None) -> DataFrame:
    """``df`` (or its ``columns``) with an array of the secrets in every whole text: start, kind, end (code points).

    Base patterns first; then runs of 20 or more key characters with a digit whose mean
    log-likelihood ratio (random against ordinary, per character step) reaches the model's
    threshold, as kind ``markov``, where no base span is touched. With ``mask`` each secret (overlapping ones as one) is
    replaced by it in ``text``. Null and empty texts have none and stay. Repeated rows, long texts
    and other columns are kept; a column called like ``spans`` is replaced. No shuffle.
    """
    from answerloom.llm.texts import blocks, flat

    held = [f for f in df.schema.fields if (columns is None or f.name in columns) and f.name != spans]
    schema = T.StructType([*held, T.StructField(spans, SPANS)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    need = list(dict.fromkeys([*(f.name for f in held), text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text):
            data, offsets = flat(table[text])
            texts = table[text].to_pylist()
            found = spans_of([t or "" for t in texts], data, offsets, model)
            out = table.select([f.name for f in held])
            if mask is not None:
                new = [masked(t, s, mask) if s else t for t, s in zip(texts, found)]
                out = out.set_column(out.schema.get_field_index(text), text, pa.array(new, pa.string()))
            listed = [[{"start": s, "kind": k, "end": e} for s, k, e in spans_] for spans_ in found]
            yield from out.append_column(spans, pa.array(listed, arrow)).to_batches()

    return df.select(*need).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, str, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]
