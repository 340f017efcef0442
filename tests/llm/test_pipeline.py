"""The pipeline's rows against a plain version of all its stages."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from answerloom.llm import quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def plain_quality(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by_bytes = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d in docs:
        w = words(d["text"])
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        if len(w) < 10 or 100 * len(marked) > 20 * len(w):
            continue
        tokens = [p for x in w for p in model.encode(x)]
        letters = sum(c.isascii() and c.isalpha() or "À" <= c <= "ɏ" for c in d["text"])
        band = quality.BANDS.get(d["lang"]) or quality.BANDS["Latn" if 2 * letters >= sum(map(len, w)) else ""]
        per = sum(map(len, w)) / len(tokens)
        entropy = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in Counter(tokens).values()) / math.log2(max(2, len(tokens)))
        share = sum(map(model.is_byte, tokens)) / len(tokens)
        low, high = band.chars_per_token
        byte_per = sum(map(len, w)) / sum(len(by_bytes.encode(" " + x, add_special_tokens=False).ids) for x in w)
        few = per < band.low_chars or byte_per < band.low_byte_chars
        fits = low <= min(per, byte_per) and max(per, byte_per) <= high and share <= band.most_byte_fallback and entropy >= band.least_entropy
        if fits and not (few and entropy < band.low_entropy):
            out.append(d)
    return out


def plain_near_duplicates(docs, n=5, num=80):
    sets = []
    for d in docs:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), d["text"] or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    lists, root = defaultdict(list), list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in lists[x]).items():
            if 100 * o >= num * (len(s) + len(sets[j]) - o):
                root[max(top(k), top(j))] = min(top(k), top(j))
        for x in s:
            lists[x].append(k)
    return [d for k, d in enumerate(docs) if root[k] == k]  # in order of ids


def plain_repeats(docs):
    first, out = {}, []
    for d in docs:
        b = (d["text"] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], d["doc_id"])
    for d in docs:
        b = (d["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d["doc_id"]:
                gone[k : k + 50] = b"\1" * 50
        if any(gone):
            text = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
            if not words(text):
                continue
            d = d | {"text": text, "n_chars": len(text)}
        out.append(d)
    return out


def plain_secrets(docs, model):
    out = []
    for d in docs:
        t = d["text"] or ""
        spans = [(s, e) for s, _, e in secrets.base_spans(t)]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            codes = [0, *(secrets._CODE[ord(c)] for c in m.group()), 0]
            ratio = np.mean([model.ratio[a, b] for a, b in zip(codes, codes[1:])])
            if ratio >= model.threshold and re.search("[0-9]", m.group()) and not any(s < m.end() and m.start() < e for s, e in spans):
                spans.append((m.start(), m.end()))
        if spans:
            hit = np.zeros(len(t) + 1, bool)
            for s, e in spans:
                hit[s:e] = True
            edges = [k for k in range(len(t)) if hit[k] and (k == 0 or not hit[k - 1])]
            text = "".join((corpus_pipeline.MASK if k in edges else "") + ("" if hit[k] else c) for k, c in enumerate(t))
            d = d | {"text": text, "n_chars": len(text)}
        out.append(d)
    return out


def as_rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("name", ["given", "odd"])
def test_pipeline_against_a_plain_version(spark, sf, table, odd_texts, tmp_path, name):
    if name == "given":
        folder = sf
    else:
        folder = str(tmp_path / "sf")
        table([(i, t) for n, (i, t) in enumerate(odd_texts) if i is not None and n != 2]).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = sorted((r.asDict() for r in docs.collect()), key=lambda d: d["doc_id"])
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for number, (stage, function) in enumerate(corpus_pipeline.STAGES):
        got = function(spark, docs, folder)
        if number == 4:
            break
        model = secrets.train(docs) if number == 3 else None
        plain = (plain_quality, plain_near_duplicates, plain_repeats, lambda d: plain_secrets(d, model))[number](plain)
        path = str(tmp_path / str(number))
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert as_rows(docs) == sorted(map(str, plain)), stage
    want = {d["doc_id"]: len(encoder.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in plain}
    for pieces in (got.collect(), corpus_pipeline.run(spark, folder).collect()):
        held = Counter()
        for r in pieces:
            held[r.doc_id] += r.length
        assert held == want and all(r.doc_tokens == want[r.doc_id] for r in pieces)


def test_stages_on_an_empty_table(spark, table, tmp_path):
    docs = table([])
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, "")
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count() == 0
