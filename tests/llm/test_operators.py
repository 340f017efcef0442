"""Each operator against a plain version of its contract, over odd rows and over documents of the test data."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from answerloom.llm import bpe, jaccard, katz, packing, quality, queries, repeats, secrets, sharding, top_k, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def inputs(spark, sf, table, odd_texts):
    clash = {"root": F.lit("x"), "block": F.lit(1), "bucket": F.lit("b"), "node": F.lit(2), "answer": F.lit(None).cast("string"), "rows": F.lit(3), "kept": F.lit("y")}
    return {"odd": table(odd_texts, extra=clash), "given": spark.read.parquet(f"{sf}/documents.parquet"), "empty": table([])}


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_secrets(inputs, name):
    df = inputs[name]
    model = secrets.train(df)
    want = Counter()
    for i, t in rows_of(df):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(1)) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
        want[(i, tuple((s, secrets.KINDS[k], e) for s, k, e in sorted(found)))] += 1
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.secrets if s.kind != "markov")) for r in secrets.scan(df, model).collect())
    assert got == want


def test_markov_model_on_held_out_samples(spark, sf):
    model = secrets.train(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = [w for w in secrets.random_samples(400, seed=77)]
    ends = np.cumsum([len(w) for w in kept])
    scores = model.scores(np.frombuffer(b"".join(kept), np.uint8), ends - [len(w) for w in kept], ends)
    assert (scores >= model.threshold).mean() > 0.97
    plain = [b"some_ordinary_identifier_name_2", b"getUserAccountSettings2", b"the-quick-brown-fox-2024", b"internationalization18n"]
    ends = np.cumsum([len(w) for w in plain])
    assert (model.scores(np.frombuffer(b"".join(plain), np.uint8), ends - [len(w) for w in plain], ends) < model.threshold).all()


def test_markov_spans_and_mask(inputs):
    df = inputs["odd"]
    found = {r.doc_id: r for r in secrets.scan(df, secrets.train(inputs["given"]), mask="[secret]").collect()}
    assert [s.kind for s in found[25].secrets] == ["markov"] and "gH7kQ2pX9vLmZ4tR8wYb" not in found[25].text
    assert "some_ordinary_identifier_name_2" in found[25].text
    assert "04dbebab" not in found[24].text and found[24].text.count("[secret]") == 2
    assert found[12].text is None and set(found[12].asDict()) == {*df.columns, "secrets"}


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_shards(inputs, name):
    df = inputs[name].select("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    got = sharding.interleave(df, F.col("source"), F.col("doc_id"), shards=7, ties=["doc_id", "crc"]).collect()
    assert len(got) == df.count()
    size = Counter(r.shard for r in got)
    assert not got or max(size.values()) - min(size.get(s, 0) for s in range(7)) <= 1
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size[s]))
    for source in {r.source for r in got}:
        held = Counter(r.shard for r in got if r.source == source)
        assert max(held.values()) - min(held.get(s, 0) for s in range(7)) <= 2


@pytest.mark.parametrize("payloads", [[], ["x" * 1200, "x" * 1200, "y" * 999, "y" * 999, None, "", "é" * 600, "x" * 1200, "é" * 600]])
def test_warc(spark, payloads):
    pages = spark.createDataFrame([(i, f"http://a/{i}é" if i % 2 else None, p, "more") for i, p in enumerate(payloads)], "page_id long, url string, html string, file string")
    index = warc.archive(pages, files=2)
    back = {r.record_id: r for r in warc.read_records(index).collect()}
    got = {r.page_id: r for r in warc.report(index).collect()}
    assert len(got) == len(back) == len(payloads)
    for i, p in enumerate(payloads):
        raw = (p or "").encode()
        same = [j for j, q in enumerate(payloads) if (q or "").encode() == raw]
        refers = max(same) if len(raw) >= 1000 and max(same) != i else None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers)
        assert refers is not None or back[str(i)].payload == raw


def test_warc_inflates_one_stream_and_several_members():
    import gzip
    import io

    one, two = warc.record("1", "http://a", b"p" * 3_000_000, None), warc.record("2", "http://b", b"", "1")
    for data in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        assert [whole for _, whole in warc.records(warc.inflate(io.BytesIO(data).read))] == [one, two]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(one)[:-200]).read)))


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_packing(inputs, name):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    df = inputs[name]
    want = Counter()
    for i, t in rows_of(df):
        want[(i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    got = packing.pack(df, path, with_ids=True).collect()
    whole, open_ = Counter(), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        open_[r.doc_id].append(r)
    for i, pieces in open_.items():
        docs = [d for (j, d), n in want.items() if j == i for _ in range(n)]
        assert sum(r.length for r in pieces) == sum(map(len, docs))
        if len(docs) == 1:
            assert tuple(x for r in pieces for x in r.ids) == docs[0] and {r.doc_tokens for r in pieces} == {len(docs[0])}
    for seq in {r.sequence_id for r in got}:
        inside = sorted((r.offset, r.length, r.window) for r in got if r.sequence_id == seq)
        total = 0
        for offset, length, window in inside:
            assert offset == total
            total += length
        assert total == window <= 4096 and window & (window - 1) == 0


def test_packing_tiers_and_step_balance():
    lengths = np.random.default_rng(3).lognormal(6.2, 1.2, 4000).astype(np.int64) + 1
    rows = packing.plan(lengths, step_tokens=16 * 4096)
    size, held = {}, Counter()
    for _, _, length, seq, _, window, group, cost in rows:
        size[seq] = (window, group, cost)
        held[seq] += length
    assert all(held[s] == w for s, (w, _, _) in size.items())
    assert {w for w, _, _ in size.values()} >= {4096, 2048, 1024, 512}
    costs = defaultdict(lambda: defaultdict(int))
    for window, group, cost in size.values():
        costs[window][group] += cost
    for window in (4096, 2048):
        values = list(costs[window].values())
        assert max(values) < 1.25 * min(values)


@pytest.mark.parametrize("name,n,num,part", [("odd", 4, 85, 20_000), ("given", 4, 85, 20_000), ("given", 3, 30, 3), ("odd", 5, 80, 1), ("empty", 4, 85, 9)])
def test_jaccard(inputs, name, n, num, part):
    df = inputs[name]
    rows = rows_of(df)
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    root, links = list(range(len(sets))), Counter()

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in lists[x] if j > k).items():
            if 100 * o >= num * (len(s) + len(sets[j]) - o):
                links[k] += 1
                links[j] += 1
                root[max(top(k), top(j))] = min(top(k), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min((x for x in (least.get(top(k)), i) if x is not None), default=None)
    want = Counter((i, len(sets[k]), least[top(k)], links[k]) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, jaccard.join(df, n=n, num=num, most=100_000, part=part).collect())) == want
    kept = jaccard.one_of_each(df, n=n, num=num, most=100_000, part=part).collect()
    groups = {top(k) for k in range(len(sets))}
    assert len(kept) == len(groups)
    assert Counter(r.doc_id for r in kept) == Counter(least[g] for g in groups)


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_bpe(inputs, name):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    df = inputs[name]
    want = Counter()
    for i, t in rows_of(df):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(df, path).collect())) == want
    encoded = bpe.encode(df, path)
    assert encoded.columns == [*df.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in encoded.collect())


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_katz(inputs, name):
    import math

    df = inputs[name]
    docs = [(i, words(lower(t)) + [None]) for i, t in rows_of(df)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [d for i, d in docs if not held(i)]
    single = Counter(w for d in train for w in d)
    double = Counter(p for d in train for p in zip(["<begin>", *d[:-1]], d))
    total, types = sum(single.values()), len(single)
    times = lambda c: katz.Discounts.of([sum(1 for x in c.values() if x == r) for r in range(1, 7)]).ratio
    d1, d2 = times(single), times(double)
    kept = lambda d, n: n * (d[n - 1] if n <= 5 else 1)
    seen = sum(kept(d1, n) for n in single.values())
    whole = total if seen < total else total + 1
    alone = lambda w: kept(d1, single[w]) / whole if w in single else (whole - seen) / whole
    follow = defaultdict(list)
    for (h, w), n in double.items():
        follow[h].append((w, n))

    def weight(h):
        count = sum(n for _, n in follow[h])
        mass = sum(kept(d2, n) for _, n in follow[h])
        if mass >= count:
            count, mass = count + 1, count
        return count, (1 - mass / count) / (1 - sum(alone(w) for w, _ in follow[h]))

    def chance(w, h):
        if h not in follow:
            return alone(w)
        count, back = weight(h)
        return kept(d2, double[h, w]) / count if (h, w) in double else back * alone(w)

    for h in list(follow)[:5]:
        assert sum(chance(w, h) for w in single) + chance("never seen", h) == pytest.approx(1)
    got = defaultdict(list)
    for r in katz.score(df, most=100_000).collect():
        got[r.doc_id].append(r)
    for i, d in docs:
        base = sum(math.log10((single[w] + 1) / (total + types + 1)) for w in d)
        score = sum(math.log10(chance(w, h)) for w, h in zip(d, ["<begin>", *d[:-1]]))
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(d), sum(w in single for w in d), total)
            and r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
            for r in got[i]
        )
    assert sum(map(len, got.values())) == len(docs)


def test_katz_frequent_histories_are_dealt_out_alike(spark, inputs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = {r.doc_id: r.score for r in katz.score(inputs["given"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        many = {r.doc_id: r.score for r in katz.score(inputs["given"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == pytest.approx(one)


def brute_top(vectors, k, every):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in clean:
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_top_k(spark, sf):
    pick = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(0, 0.2 * (1 + i % 5), 8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [0.0] * 8), (None, [1.0] * 8), (500, rows[7][1]), (501, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    for bucket, block in ((4096, 512), (16, 4)):
        got = top_k.top_k(df, F.col("vec_id") % 10 == 0, k=5, bucket=bucket, query_block=block)
        assert {tuple(r) for r in got.collect()} == brute_top(rows, 5, 10)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in top_k.top_k(few, F.col("vec_id") % 10 == 0).collect()} == brute_top(rows[:3], 10, 10)


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_repeats(inputs, name):
    df = inputs[name]
    rows = sorted(((i if i is not None else 2**62, (t or "").encode()) for i, t in rows_of(df)), key=lambda r: r[0])
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())] += 1
    out = repeats.remove_repeats(df, most=100_000)
    assert out.columns == [*df.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = out.collect()
    assert Counter((r.doc_id if r.doc_id is not None else 2**62, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(r.text is None or r.n_removed or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_ranks_are_suffix_order():
    data = np.frombuffer(b"abracadabra abracadabra banana", np.uint8)
    for n in (5, 8, 11):
        places = np.arange(len(data) - n + 1)
        strings = [data[p : p + n].tobytes() for p in places]
        order = sorted(set(strings))
        assert repeats.suffix_ranks(data, n, places).tolist() == [order.index(s) for s in strings]


def judged(df, **more):
    pieces, ranks = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return quality.judge(df, pieces, ranks, public_tokenizers.PATTERN, **more)


@pytest.mark.parametrize("name", ["odd", "given", "empty"])
def test_quality(inputs, name):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = inputs[name]
    want = Counter()
    for i, t in rows_of(df):
        w = words(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        pieces = [model.encode(x) for x in w]
        share = sum(model.is_byte(p) for x in pieces for p in x) / max(1, sum(map(len, pieces)))
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w), sum(map(len, pieces)), round(share, 9))] += 1
    out = judged(df)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens, round(r.byte_fallback, 9)) for r in out.collect())
    assert got == want
    assert not out.where("base_failed and kept").count()


def test_both_vocabularies_decide_and_short_texts_are_judged(spark):
    nbsp = "\u00a0"
    texts = [
        "one two three four five six seven eight nine ten",
        " ".join(chr(0x4E00 + 37 * k) for k in range(12)),  # 12 tokens or so a script: bands of the other scripts
        f"{nbsp} {nbsp}{nbsp} a{nbsp} {nbsp}b {nbsp}{nbsp}{nbsp} c d e f g h i",
    ]
    rows = [(k, t, "en" if k != 1 else None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    plain = quality.Band((0.0, 100.0), 1.0, 0.0)
    got = {r.doc_id: r for r in judged(df, bands={"en": plain, "Latn": plain, "": plain}).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        count = sum(len(library.encode(" " + w, add_special_tokens=False).ids) for w in words(t))
        assert round(got[k].word_chars / got[k].byte_chars_per_token) == count and got[k].kept
    first = got[0]
    assert first.n_tokens < 40  # short, and still held to each limit alone
    byte, piece = first.byte_chars_per_token, first.chars_per_token
    for band in (
        quality.Band((0.0, 100.0), 1.0, 0.0, low_byte_chars=byte + 0.01, low_entropy=1.1),
        quality.Band((0.0, 100.0), 1.0, 0.0, low_chars=piece + 0.01, low_entropy=1.1),
        quality.Band((0.0, max(byte, piece) - 0.01), 1.0, 0.0),
        quality.Band((min(byte, piece) + 0.01, 100.0), 1.0, 0.0),
    ):
        rows = judged(df, bands={"en": band, "Latn": band, "": plain}).collect()
        assert not next(r for r in rows if r.doc_id == 0).kept
    low = quality.Band((0.0, 100.0), 1.0, 0.0, low_byte_chars=byte - 0.01, low_chars=piece - 0.01, low_entropy=1.1)
    assert next(r for r in judged(df, bands={"en": low, "Latn": low, "": plain}).collect() if r.doc_id == 0).kept


def test_quality_keeps_clean_documents_and_drops_broken_ones(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = [r for r in judged(docs).collect() if not r.base_failed]
    clean, broken = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(broken) < 0.6


def test_queries_cover_the_thirteen_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
