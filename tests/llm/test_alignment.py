"""Cross-tokenizer alignment against a plain version with the tokenizers library."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from answerloom.llm import alignment
from answerloom.llm.queries import QUERIES

LETTERS = {}  # of byte-level tokens: printable bytes stand for themselves, the others for letters from U+0100 on
for _b in range(256):
    if 33 <= _b <= 126 or 161 <= _b <= 172 or _b >= 174:
        LETTERS[chr(_b)] = _b
for _b in [b for b in range(256) if b not in LETTERS.values()]:
    LETTERS[chr(256 + sum(v >= 256 for v in map(ord, LETTERS)))] = _b


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    names = {i: bytes(LETTERS[c] for c in t) for t, i in a.get_vocab().items() if i != 50256}

    def tokens(text):
        left = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if text and all(b"".join(t for _, t in side) == whole for side in (left, right)) else ([], [])

    return tokens


def plain(rows, tokens):
    per, counts = {}, Counter()
    for text in {t for _, t in rows}:
        left, right = tokens(text or "")
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, done = [], [], [0, 0]
        for cut in cuts:
            upto = [e.index(cut, d) + 1 for e, d in zip(ends, done)]
            own = [[i for i, _ in side[d:u]] for side, d, u in zip((left, right), done, upto)]
            groups.append("|".join(",".join(map(str, x)) for x in own))
            links.append((own[0][-1], own[1][-1]))
            done = upto
        per[text] = (len(left), len(right), groups, links)
    for _, text in rows:
        counts.update(per[text][3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, text in rows:
        n_a, n_b, groups, links = per[text]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return Counter(out)


ODD = [
    (50, "a ▁ b"), (51, "<0x41> <unk> <s> </s> ▁"), (52, "<|endoftext|> and <0x0A> <unk> </s>"), (53, "\0 nul \x01"), (54, " "), (55, "  lead and  gaps   "),
    (56, "näive ﬁ ÅÅ"), (57, "\U0001f600\U0001f468‍\U0001f469 ﻿ x"), (58, "กำ क्ष ՘ Ᲊ"), (59, "\r\n\t\n"), (60, "12345 67,890.12 0x7f"),
]


@pytest.mark.parametrize("given", ["odd", "none", "nothing"])
def test_query(spark, table, tmp_path, odd_texts, sides, given):
    rows = {"odd": odd_texts + ODD + ODD[5:8] * 3, "none": [], "nothing": [(1, None), (2, ""), (None, "▁")]}[given]
    table(rows, extra={"n_a": F.lit(1), "text_key": F.lit("x"), "copies": F.lit(2.0), "block": F.lit(7)}).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op13_cross_tokenizer_alignment"](spark, str(tmp_path)).collect())) == plain(rows, sides)


def test_blocks_of_any_size_and_order(spark, table, odd_texts, sides):
    rows = odd_texts[:20] + ODD
    found = alignment.align(table(rows, files=7), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"), most=100)
    assert Counter(map(tuple, found.collect())) == plain(rows, sides)


def test_given(spark, sf, sides):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op13_cross_tokenizer_alignment"](spark, sf).collect())) == plain(rows, sides)


def test_ranks_give_the_library_s_ids(sides):
    """Every code point, beside letters, digits, blanks and itself."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    coder, _ = alignment.byte_tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}b {c}1 {c}{c}2  {c}\n" for c in points[:0x3400] + points[0x3400::37]]
    for k in range(0, len(texts), 20_000):
        part = texts[k : k + 20_000]
        assert [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)] == [coder.encode_to_numpy(t, disallowed_special=()).tolist() for t in part]
