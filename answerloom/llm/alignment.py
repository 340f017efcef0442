"""Alignment of two tokenizers' tokens over the same texts, each distinct text worked through once."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.exchange import block_number, from_ipc, press_steps, to_ipc, unpress_steps
from answerloom.llm.texts import blocks, flat, ranges, release
from answerloom.plans.staging import cut_lineage

BLOCK = 3 << 20
_COMMA, _BAR, _SEMICOLON = b",|;"


@dataclass
class Vocabulary:
    """The bytes of every token, end to end, and where each begins."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.first[ids], self.size[ids])]


@functools.lru_cache(maxsize=2)
def byte_tokens(path: str, pattern: str):
    """A byte-level BPE from its ranks, and its tokens' bytes."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Vocabulary.of(tokens)


@functools.lru_cache(maxsize=2)
def piece_tokens(path: str):
    """A sentencepiece model, and its pieces' bytes: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = lambda i, p: bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
    return model, Vocabulary.of([spell(i, model.id_to_piece(i)) for i in range(model.get_piece_size())])


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    count = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)]), count


def _of_docs(ids: np.ndarray, count: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the kept texts alone."""
    return ids[np.repeat(keep, count)], count[keep]


def _decimal(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its separator, as bytes, and how many bytes each takes."""
    width = len(str(int(ids.max()))) if len(ids) else 1
    digits = np.zeros((len(ids), width + 1), np.uint8)
    size = np.ones(len(ids), np.int64)
    for k in range(1, width):
        size += ids >= 10**k
    place = np.arange(width + 1)
    for k in range(width):  # the k-th digit from the left
        power = np.maximum(size - 1 - k, 0)
        digits[:, k] = 48 + ids // np.array([10**p for p in range(width)])[power] % 10
    digits[np.arange(len(ids)), size] = after
    return digits[place <= size[:, None]], size + 1


@dataclass
class Aligned:
    """Alignment of a block of texts: per text its counts and digest, and the links of all texts end to end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    sha256: list[str]
    a: np.ndarray
    b: np.ndarray


def align_block(data: np.ndarray, offsets: np.ndarray, texts: list[str], a_of, a_vocabulary: Vocabulary, b_of, b_vocabulary: Vocabulary) -> Aligned:
    """Tokens of " " + text by both sides, cut into groups at the bytes where a token of each ends.

    A text whose tokens of either side do not spell it out has none.
    """
    docs = len(texts)
    a, a_count = _joined([a_of(" " + t) for t in texts])
    b, b_count = _joined(b_of(texts))
    release()
    size = np.diff(offsets) + 1
    keep = np.diff(offsets) > 0
    for ids, count, vocabulary in ((a, a_count, a_vocabulary), (b, b_count, b_vocabulary)):
        upto = np.concatenate(([0], np.cumsum(vocabulary.size[ids])))[np.concatenate(([0], np.cumsum(count)))]
        keep &= np.diff(upto) == size
    own = np.flatnonzero(keep)
    spelled = np.full(int(size[own].sum()), 0x20, np.uint8)
    begin = np.cumsum(size[own]) - size[own]
    spelled[ranges(begin + 1, size[own] - 1)] = data[ranges(offsets[:-1][own], size[own] - 1)]
    (a, a_count), (b, b_count) = _of_docs(a, a_count, keep), _of_docs(b, b_count, keep)
    wrong = np.unique(np.searchsorted(begin, np.flatnonzero((a_vocabulary.spell(a) != spelled) | (b_vocabulary.spell(b) != spelled)), "right") - 1)
    if len(wrong):
        right = np.ones(len(own), bool)
        right[wrong] = False
        (a, a_count), (b, b_count), own = _of_docs(a, a_count, right), _of_docs(b, b_count, right), own[right]
    a_end, b_end = np.cumsum(a_vocabulary.size[a]), np.cumsum(b_vocabulary.size[b])
    total = int(a_end[-1]) if len(a_end) else 0
    ends = np.zeros((2, total + 1), bool)
    ends[0, a_end], ends[1, b_end] = True, True
    a_cut, b_cut = ends[1, a_end], ends[0, b_end]  # tokens that end a group
    del ends
    a_group, b_group = (np.cumsum(c) - c for c in (a_cut, b_cut))
    groups = int(a_cut.sum())
    a_upto = np.concatenate(([0], np.cumsum(np.bincount(a_group, minlength=groups))))
    b_upto = np.concatenate(([0], np.cumsum(np.bincount(b_group, minlength=groups))))
    listed, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    at_a, at_b = np.arange(len(a)) + b_upto[a_group], np.arange(len(b)) + a_upto[b_group + 1]
    listed[at_a], after[at_a] = a, np.where(a_cut, _BAR, _COMMA)
    listed[at_b], after[at_b] = b, np.where(b_cut, _SEMICOLON, _COMMA)
    written, width = _decimal(listed, after)
    upto = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(a_count + b_count)))]
    whole = memoryview(np.ascontiguousarray(written))
    out = Aligned(*(np.zeros(docs, np.int64) for _ in range(3)), [""] * docs, a[a_cut], b[b_cut])
    out.n_a[own], out.n_b[own] = a_count, b_count
    out.n_groups[own] = np.diff(np.concatenate(([0], np.cumsum(a_cut)))[np.concatenate(([0], np.cumsum(a_count)))])
    for k, d in enumerate(own.tolist()):
        out.sha256[d] = hashlib.sha256(whole[int(upto[k]) : int(upto[k + 1]) - 1]).hexdigest()
    return out


_BLOCKS = "block long, pairs array<long>, counts array<long>, texts binary, links binary"
_MEASURES = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
B_BITS = 31  # of a pair: the id of side A lies above that of side B


def _align(ranks: str, pattern: str, pieces: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        (coder, a_vocabulary), (model, b_vocabulary) = byte_tokens(ranks, pattern), piece_tokens(pieces)
        for place, table in enumerate(blocks(batches, "text", most)):
            found = align_block(
                *flat(table["text"]), table["text"].to_pylist(),
                lambda t: coder.encode_to_numpy(t, disallowed_special=()), a_vocabulary,
                lambda t: model.encode(t, num_threads=1) if t else [], b_vocabulary,
            )
            pairs, code = np.unique((found.a << B_BITS) | found.b, return_inverse=True)
            doc = np.repeat(np.arange(table.num_rows), found.n_groups)
            weight = table["copies"].to_numpy()[doc]
            by_code = np.argsort(code, kind="stable")
            counts = np.add.reduceat(weight[by_code], np.searchsorted(code[by_code], np.arange(len(pairs)))) if len(pairs) else np.zeros(0, np.int64)
            kept = table.select(["text_key"])
            for name in ("n_a", "n_b", "n_groups"):
                kept = kept.append_column(name, pa.array(getattr(found, name)))
            kept = kept.append_column("groups_sha256", pa.array(found.sha256, pa.string()))
            links = press_steps(np.sort(doc * len(pairs) + code))  # a link is its text and the place of its pair
            arrays = [pa.array([block_number(part, place)]), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([to_ipc(kept)], pa.binary()), pa.array([links], pa.binary())], names=["block", "pairs", "counts", "texts", "links"])
            release()

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            texts, told = from_ipc(row["texts"]), row["told"] or []
            count, best = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
            for t in told:
                count[t["place"]], best[t["place"]] = t["n"], t["best"]
            link = unpress_steps(row["links"])
            doc, code = np.divmod(link, max(1, len(told)))
            n_links = np.bincount(doc, minlength=texts.num_rows)
            sums = [np.concatenate(([0], np.cumsum(v[code]))) for v in (best, count)]
            upto = np.concatenate(([0], np.cumsum(n_links)))
            n_best, count_sum = (np.diff(s[upto]) for s in sums)
            out = [texts["text_key"], texts["n_a"], texts["n_b"], texts["n_groups"], *(pa.array(x.astype(np.int64)) for x in (n_links, n_best, count_sum)), texts["groups_sha256"]]
            yield from pa.table(out, names=[f.partition(" ")[0] for f in _MEASURES.split(", ")]).to_batches()


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (text, copies, text_key) of the texts that are not null or empty: one shuffle by the full text, copies counted before it."""
    return df.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).withColumn("text_key", _key(F.col("text")))


def _key(text):
    return F.unhex(F.sha2(text, 256))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best): how many links of the corpus hold each id pair, and whether its B id has no more frequent one."""
    listed = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counted = cut_lineage(listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    top = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, ranks: str, pattern: str, pieces: str, id_column: str = "doc_id", text: str = "text", most: int = BLOCK) -> DataFrame:
    """Per row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Side A is the byte-level BPE of the file ``ranks``, split by ``pattern``, side B the sentencepiece model ``pieces``; both
    take a space and the text, without special tokens. Where a token of each ends at the same byte a group ends,
    and the two tokens are a link. A pair's count is the number of links in all rows that hold it; n_best counts a row's links
    whose pair is the most frequent of its B id (ties too), count_sum adds up their counts. The digest is that of
    ``a1,a2|b1;a3|b2,b3``.

    The texts are shuffled whole and each distinct one is encoded and aligned once, so a text that a third of all rows share
    costs as much as any other; its copies weigh in the counts. Blocks of some MB add up their pairs
    before they are exchanged, so the most common pair is one row per block; counts come back to the blocks in the same way, and
    measures to the rows by the sha256 of the text. Null and empty texts, and those that either side does not
    spell out byte by byte (a text with U+2581, say), have zeros and an empty digest. Null ids and repeated rows are rows
    each; other columns are not carried; an empty table gives no rows. A single text is one task's work, however long.
    """
    texts = distinct_texts(df, text)
    aligned = cut_lineage(texts.mapInArrow(_align(ranks, pattern, pieces, most), _BLOCKS))
    known = cut_lineage(pair_counts(aligned))
    asked = aligned.select("block", F.posexplode("pairs").alias("place", "pair")).join(known, "pair")
    told = asked.groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))  # no more than a block's pairs
    measures = cut_lineage(aligned.select("block", "texts", "links").join(told, "block", "left").mapInArrow(_measure, _MEASURES))
    rows = df.select(F.col(id_column), _key(F.when(F.col(text) != "", F.col(text))).alias("text_key")).join(measures, "text_key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.select(id_column, *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
