"""Rows that earlier versions got wrong."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from answerloom.llm import jaccard, packing, secrets, warc
from answerloom.llm.queries import QUERIES


@pytest.mark.parametrize("part", [1, 2, 3, 100])
def test_links_of_sliced_groups(table, part):
    """Six mutually linked sets: five links each, however many slices are empty."""
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[: 100 + k] + ["other"] + base[101 + k :])) for k in range(6)]
    found = jaccard.join(table(rows), n=5, num=80, part=part).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in found) == [(k, 0, 5) for k in range(6)]


def test_revisits_of_repeated_and_missing_ids(spark):
    pages = [(1, "y" * 1200), (1, "z" * 1500), (0, "y" * 1200), (-1, "z" * 1500), (None, "y" * 1200), (None, "q"), (5, None), (5, None)]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages], "page_id long, url string, html string")
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    refers = lambda i, h: 1 if i in (0, -1) else None
    want = Counter((i, len(h or ""), sha(h), "revisit" if refers(i, h) else "response", refers(i, h)) for i, h in pages)
    assert Counter(map(tuple, warc.report(warc.archive(df)).collect())) == want


def test_ids_of_new_letters():
    """Every code point, also those that one of the letter tables does not know yet."""
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    points = [chr(c) for c in [*range(1, 0x3400), *range(0xA000, 0xABFF), *range(0xFB00, 0x1F000, 3)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1" for c in points]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, at = packing.token_ids(path, np.frombuffer(b"".join(raw), np.uint8), offsets, 2)
    want = [e.ids + [2] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def plain_spans(text):
    """Base spans as (start, kind, end), kinds in their order at one start."""
    cue = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in cue.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@pytest.mark.parametrize("given", ["odd", "given", "none"])
def test_secret_query(spark, sf, table, tmp_path, odd_texts, given):
    """Every column of the query, of odd, given and no rows."""
    more = [
        (60, "API_KEY = 'abcDEF12345'; ApiKey:short passwd\"=\"aaaaaaaa"), (61, "é日 token=" + "a1" * 20 + " AKIA" + "Z9" * 8), (62, "deadbeef" * 4 + "AKIAABCDEFGHIJKLM"),
        (63, "f" * 31), (64, "secret = token=abcdefgh"), (65, "PASSWORD:" + "0" * 32), (65, "PASSWORD:" + "0" * 32), (None, "toKen=abcdefgh"),
    ]
    if given == "given":
        path, rows = sf, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    else:
        path, rows = str(tmp_path), odd_texts + more if given == "odd" else []
        table(rows).write.parquet(f"{path}/documents.parquet")
    names = ("assign", "access", "hex")
    want, got = Counter(), Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want[(i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed)] += 1
    for r in QUERIES["op1_secret_scans"](spark, path).collect():
        spans = r.spans.split(",") if r.spans else []
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and r.n_markov == sum(s.startswith("markov") for s in spans)
        got[(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in spans if not s.startswith("markov")))] += 1
    assert got == want


@pytest.mark.parametrize("rows,share", [(400, True), (400, False)])
def test_training_sample(spark, rows, share):
    """The chosen rows are those of the smallest md5s, whether ids are many or few."""
    data = [(k if share else k % 3, f"text {k % 200}") for k in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    want = sorted({(md5(i), md5(t), t) for i, t in data})[:20]
    assert sorted(r.t for r in secrets._sample(df, "text", "doc_id", 20).collect()) == sorted(t for _, _, t in want)


def test_plan_of_many_short_documents():
    """A million documents of one token, and as many of three, take seconds."""
    start = time.process_time()
    for length in (1, 3):
        rows = packing.plan(np.full(1_000_000, length))
        assert len(rows) >= 1_000_000 and sum(r[2] for r in rows) == length * 1_000_000
    assert time.process_time() - start < 120
