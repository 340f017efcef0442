"""The registered queries of this subpackage, one per operator, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import alignment, bpe, jaccard, katz, merkle, packing, quality, repeats, secrets, sharding, simhash, top_k, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs), columns=["doc_id"])
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"), of_kind("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), of_kind("markov").alias("n_markov"),
    )


@_query(
    "op2_proportional_interleaving",
    """
    WITH tab AS (  -- CRC-32 by bytes, with its table made here
        SELECT list_transform(range(256), lambda i:
            list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
    ),
    bytes AS (
        SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda y: ('0x' || y)::BIGINT) AS b
        FROM documents
    ),
    sized AS (
        SELECT doc_id, source, size,
            xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab.t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
            coalesce('=' || source, '') AS stratum, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS k
        FROM bytes, tab
    ),
    placed AS (
        SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, size, text_crc32)
                - ('0x' || substr(md5(stratum), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS place
        FROM sized
    ),
    numbered AS (
        SELECT *, row_number() OVER (ORDER BY place, stratum, k, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n
        FROM placed
    )
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 40 // n)::INTEGER AS shard,
        pos - ((pos * 40 // n) * n + 39) // 40 AS slot, NULL::INTEGER AS grown_shard, source
    FROM numbered
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = sharding.interleave(docs, F.col("source"), F.col("doc_id"), shards=40, ties=["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@_query(
    "op3_warc_normaliser",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN kept END AS refers_to
    FROM g
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.archive(_table(spark, sf_dir, "pages")))


@_query("op4_hierarchical_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op5_jaccard_t_occurrence")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), n=4, num=85)


@_query("op6_pair_index_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op7_katz_backoff")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


@_query(
    "op8_norm_bucketed_top_k",
    """
    WITH parts AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
        FROM parts q JOIN parts c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs
    )
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE n <= 10
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query("op9_repeated_strings")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), columns=["doc_id"])


@_query("op10_tokeniser_fertility")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces, ranks = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return quality.judge(docs, pieces, ranks, public_tokenizers.PATTERN, columns=["doc_id"])


@_query(
    "op11_merkle_slot_pivot",
    """
    WITH RECURSIVE tab AS (  -- CRC-32 by bytes, with its table made here
        SELECT list_transform(range(256), lambda i:
            list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
    ),
    named AS (
        SELECT *, coalesce('=' || source, '') AS k,
            list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda y: ('0x' || y)::BIGINT) AS b
        FROM documents
    ),
    fields AS (
        SELECT doc_id, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab.t[xor(c & 255, x) + 1])), 4294967295) % 2 = 0 AS tampered,
            coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
            text, replace(text, chr(10), '') AS flat
        FROM named, tab
    ),
    hashed AS (
        SELECT doc_id, k, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            sha256(head || CASE WHEN tampered THEN coalesce(octet_length(encode(flat)) || ':' || flat, '-') ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS changed
        FROM fields
    ),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM hashed
    ),
    low AS (
        SELECT 0 AS level, k, pos, leaf AS h, n FROM leaves
        UNION ALL
        SELECT level + 1, k, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY level, k, pos // 3
    ),
    tops AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS level, pos, h, n FROM tops
        UNION ALL
        SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3
    ),
    steps AS (  -- the run of a node on every level, its own place and the others'
        SELECT l.k, l.pos AS own, x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos // (3 ** x.level)::BIGINT), '') AS l,
            coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos // (3 ** x.level)::BIGINT), '') AS r
        FROM leaves l JOIN low x ON x.k = l.k AND x.n > 1 AND x.pos // 3 = l.pos // (3 ** (x.level + 1))::BIGINT
        GROUP BY l.k, l.pos, x.level
    ),
    above AS (
        SELECT t.k, x.level, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < t.pos // (3 ** x.level)::BIGINT), '') AS l,
            coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > t.pos // (3 ** x.level)::BIGINT), '') AS r
        FROM tops t JOIN high x ON x.n > 1 AND x.pos // 3 = t.pos // (3 ** (x.level + 1))::BIGINT
        GROUP BY t.k, x.level
    ),
    path AS (SELECT k, own, list(l || '|' || r ORDER BY level) AS p FROM steps GROUP BY k, own),
    path_above AS (SELECT k, list(l || '|' || r ORDER BY level) AS p FROM above GROUP BY k),
    whole AS (
        SELECT l.doc_id, l.leaf, l.changed, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, list_concat(coalesce(a.p, []), coalesce(b.p, [])) AS p
        FROM leaves l JOIN tops t ON t.k = l.k LEFT JOIN path a ON a.k = l.k AND a.own = l.pos LEFT JOIN path_above b ON b.k = l.k
    ),
    folded AS (
        SELECT *, list_reduce(list_prepend(changed, p), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root FROM whole
    )
    SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM folded
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    flat = F.when(tampered, F.replace("text", F.lit("\n"), F.lit("")))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", merkle.leaf(*fields(F.col("text"))).alias("leaf"), F.when(flat != F.col("text"), F.unhex(merkle.leaf(*fields(flat)))).alias("changed")
    )
    rows = merkle.prove(docs, "source", ["doc_id"], "leaf").withColumn("changed", F.coalesce(F.lower(F.hex("changed")), "leaf"))
    rows = rows.withColumns({"proof_sha256": merkle.siblings_digest(F.col("path")), "folded_root": merkle.fold(F.col("changed"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query("op12_covering_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, pieces)
