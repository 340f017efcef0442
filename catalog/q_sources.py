"""Queries through the readers and sinks.

Each writes a given table in the reader's format to the shared folder, reads it
back, and must give the table's rows again.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from answerloom.operators import images as I
from answerloom.plans.staging import stage_path
from answerloom.sources import logs, manifest, readers, sinks
from catalog import query, table, wide_table


@query(
    "S2_read_csv_auto",
    """
SELECT 'header' AS form, o_orderkey AS a, o_custkey AS b, o_totalprice AS c, o_orderpriority AS d FROM orders
UNION ALL SELECT 'no header', o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
""",
)
def s2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    out = None
    for form, header in (("header", True), ("no header", False)):
        path = stage_path(spark, "orders.csv")
        orders.write.option("header", header).csv(path)
        part = readers.read_csv_auto(spark, path).toDF("a", "b", "c", "d")
        part = part.select(
            F.lit(form).alias("form"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "c", "d"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "S3_read_json_records",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def s3(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    path = stage_path(spark, "customer.json")
    # One array of records per file, as written by hand or by other tools.
    arrays = (
        customer.groupBy((F.col("c_custkey") % 500 == 0).alias("one"), F.floor(F.col("c_custkey") / 500).alias("part"))
        .agg(F.collect_list(F.struct(*customer.columns)).alias("rows"))
        .select(
            F.when(F.col("one"), F.to_json(F.get("rows", F.lit(0)))).otherwise(F.to_json("rows")).alias("value"), "part", "one"
        )
    )
    arrays.repartition("part", "one").write.partitionBy("part", "one").text(path)
    read = readers.read_json_records(spark, path)
    return read.select(*customer.columns)


_HALVES = """
SELECT o_orderkey AS a, o_custkey AS b, o_totalprice AS c, o_orderpriority AS d FROM orders
"""


@query("S2_mixed_headers", _HALVES)
def s2_mixed(spark, sf_dir):
    """One folder of files with and without a header."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS a", "o_custkey AS b", "o_totalprice AS c", "o_orderpriority AS d")
    path = stage_path(spark, "mixed.csv")
    orders.where("a % 2 = 0").write.option("header", True).csv(f"{path}/half=0")
    orders.where("a % 2 = 1").write.option("header", False).csv(f"{path}/half=1")
    read = readers.read_csv_auto(spark, path + "/*/*.csv")
    return read.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "c", "d")


@query("S3_mixed_json", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s3_mixed(spark, sf_dir):
    """One folder of array files and files of lines, the latter with a blank and a broken second line."""
    customer = table(spark, sf_dir, "customer")
    path = stage_path(spark, "mixed.json")
    row = F.struct(*customer.columns)
    grouped = customer.groupBy(F.floor(F.col("c_custkey") / 200).alias("part")).agg(F.collect_list(row).alias("rows"))
    lines = F.transform("rows", lambda r: F.to_json(r))
    parted = F.concat(F.get(lines, F.lit(0)), F.lit("\n\nbroken\n"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), "\n"))
    texts = grouped.select(F.when(F.col("part") % 2 == 0, F.to_json("rows")).otherwise(parted).alias("value"), "part")
    texts.repartition(spark.sparkContext.defaultParallelism, "part").write.partitionBy("part").text(path)
    read = readers.read_json_records(spark, path + "/*/*.txt").where("c_custkey IS NOT NULL")
    return read.select(*customer.columns)


@query(
    "S4_any_record_tag",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier",
)
def s4_tags(spark, sf_dir):
    """Records of two tags, the tags not given."""
    supplier = table(spark, sf_dir, "supplier")
    path = stage_path(spark, "tags.xml")
    even = supplier.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_nationkey")
    even.write.format("xml").option("rootTag", "all").option("rowTag", "supplier").save(f"{path}/kind=0")
    odd = supplier.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name")
    odd.write.format("xml").option("rootTag", "all").option("rowTag", "vendor").save(f"{path}/kind=1")
    return readers.read_xml_records(spark, path + "/*/*").select("s_suppkey", "s_name", "s_nationkey")


@query("S4_read_xml_records", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier")
def s4(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey")
    )
    path = stage_path(spark, "supplier.xml")
    supplier.write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path)
    return readers.read_xml_records(spark, path, "supplier").select("s_suppkey", "s_name", "s_nationkey")


@query(
    "S5_read_text_files",
    "SELECT CAST(r AS VARCHAR) AS part, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY line)) AS text_md5 FROM "
    "(SELECT c_custkey // 500 AS r, c_name || ' ' || c_mktsegment AS line FROM customer) GROUP BY r",
)
def s5(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    path = stage_path(spark, "notes")
    lines = customer.select(F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"), F.floor(F.col("c_custkey") / 500).alias("part"))
    lines.repartition("part").write.partitionBy("part").text(path)
    files = readers.read_text_files(spark, path + "/*/*.txt")
    found = files.select(
        F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), F.split(F.btrim("text", F.lit("\n")), "\n").alias("lines")
    )
    return found.select(
        "part",
        F.size("lines").cast("bigint").alias("lines"),
        F.md5(F.array_join(F.array_sort("lines"), "\n")).alias("text_md5"),
    )


@query(
    "S6_read_zip_jsonl",
    """
SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 2 = 0 THEN value END AS value
FROM events WHERE event_id % 10 <> 3
""",
)
def s6(spark, sf_dir):
    # Archives of a thousand events each; some lines are blank or broken.
    events = table(spark, sf_dir, "events")
    record = F.to_json(
        F.struct(
            "event_id",
            "user_id",
            "event_type",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"),
        )
    )
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"broken": '), F.col("event_id"))).otherwise(record)
    lines = events.select(F.floor(F.col("event_id") / 1000).alias("archive"), "event_id", line.alias("line"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        rows = part.sort_values("event_id")["line"].tolist()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as packed:
            packed.writestr("first.jsonl", "\n".join(rows[::2]) + "\n\n")
            packed.writestr("logs/second.jsonl", "\n \n".join(rows[1::2]))
        return pd.DataFrame({"path": [f"{part['archive'].iloc[0]}.zip"], "content": [held.getvalue()]})

    archives = lines.groupBy("archive").applyInPandas(pack, "path string, content binary")
    records = readers.parse_json_lines(readers.zip_lines(archives))
    return records.select("event_id", "user_id", "event_type", "k", "value")


@query(
    "S6_zip_status",
    """
SELECT concat(part, '.zip') AS archive, CASE WHEN part % 3 <> 0 THEN 'rows.jsonl' END AS member,
  CASE WHEN part % 3 = 1 THEN 'success' ELSE 'failed' END AS status, CASE WHEN part % 3 = 0 THEN 0 ELSE n END AS lines
FROM (SELECT event_id // 1000 AS part, count(*) AS n FROM events GROUP BY 1)
""",
)
def s6_status(spark, sf_dir):
    """Sound archives, archives with a line that is not UTF-8, and files that are no archive."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("part"), "event_id")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        part, held = int(rows["part"].iloc[0]), io.BytesIO()
        lines = [b'{"id": %d}' % i for i in rows["event_id"]]
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as packed:
            packed.writestr("rows.jsonl", b"\n".join(lines + [b"\xff\xfe"] * (part % 3 == 2)))
        return pd.DataFrame({"path": [f"{part}.zip"], "content": [held.getvalue() if part % 3 else held.getvalue()[:40]]})

    archives = events.groupBy("part").applyInPandas(pack, "path string, content binary")
    return readers.zip_status(archives).drop("error")


_LOG = """concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' - app - ',
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END, ' - ', event_type, ' WARNING ',
  cast(event_id as string))"""


def _log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS line_no", f"{_LOG} AS line")


@query(
    "S7_parse_log_lines",
    """
SELECT event_id AS line_no, date_trunc('second', ts) AS "at", 'app' AS name,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
  event_type || ' WARNING ' || event_id AS message
FROM events
""",
)
def s7(spark, sf_dir):
    return logs.parse_log_lines(_log_lines(spark, sf_dir)).drop("line")


@query(
    "S7_log_tail",
    """
SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - app - WARNING - ' || event_type || ' WARNING ' || event_id
  AS line FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 100
""",
)
def s7_tail(spark, sf_dir):
    tail = logs.log_tail(logs.parse_log_lines(_log_lines(spark, sf_dir)), ["line_no"], "warning")
    return tail.select("line_no", "line")


@query(
    "S7_log_files",
    """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - app - ERROR - ' || event_type || ' WARNING ' || event_id AS line
FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 250
""",
)
def s7_files(spark, sf_dir):
    path = stage_path(spark, "app.log")
    lines = _log_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select("line").write.text(path)
    parsed = logs.parse_log_lines(logs.read_log_lines(spark, path))
    return logs.log_tail(parsed, ["file", "block", "nr"], "error", 250).select("line")


@query(
    "S8_ingest_manifest",
    """
SELECT 'orders.csv' AS source, 'file' AS kind, 'success' AS status, count(*) AS rows FROM orders
UNION ALL SELECT 'customer.json', 'file', 'success', count(*) FROM customer
UNION ALL SELECT 'supplier.xml', 'file', 'success', count(*) FROM supplier
UNION ALL SELECT 'missing.csv', 'file', 'failed', NULL
UNION ALL SELECT 'report.pdf', 'pdf', 'failed', NULL
""",
)
def s8(spark, sf_dir):
    base = stage_path(spark, "sources")
    table(spark, sf_dir, "orders").drop("o_orderdate").write.option("header", True).csv(f"{base}/orders.csv")
    table(spark, sf_dir, "customer").write.json(f"{base}/customer.json")
    supplier = table(spark, sf_dir, "supplier")
    supplier.write.format("xml").option("rootTag", "records").option("rowTag", "record").save(f"{base}/supplier.xml")
    names = ["orders.csv", "customer.json", "supplier.xml", "missing.csv", "report.pdf"]
    _, status = manifest.ingest_manifest(spark, [f"{base}/{n}" for n in names])
    return status.select(F.regexp_extract("source", "([^/]+)$", 1).alias("source"), "kind", "status", "rows")


@query(
    "S9_to_json_records",
    """
SELECT row_number() OVER (ORDER BY n_nationkey) AS record_no, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name
  || '","region":' || coalesce(CAST(CASE WHEN n_regionkey > 0 THEN n_regionkey END AS VARCHAR), 'null') || '}' AS record
FROM nation
""",
)
def s9(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region")
    )
    return sinks.to_json_records(nation, ["n_nationkey"])


@query(
    "S9_json_answer",
    """
SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_name) || ']'
  AS answer FROM nation
""",
)
def s9_answer(spark, sf_dir):
    return sinks.json_answer(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name"])


@query(
    "S9_write_json",
    "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders",
)
def s9_write(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    path = stage_path(spark, "orders.jsonl")
    sinks.write_json(orders, path, ["o_orderkey"])
    return spark.read.schema(orders.schema).json(path)


# Images of 8 by 8 pixels made from the vectors: a pixel's colour follows its value.

def _images(spark, sf_dir, shift: int):
    pixel = F.transform(
        "embedding",
        lambda x: F.floor((x.cast("double") + 2) * 8).cast("int") - (8 + shift),
    )
    byte = F.transform(pixel, lambda p: F.lpad(F.hex(p), 2, "0"))
    data = F.unhex(F.array_join(F.transform(byte, lambda b: F.concat(b, F.lit("10"), b)), ""))
    return wide_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("origin"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(3).alias("nChannels"),
        data.alias("data"),
    )


_PIXELS = """
SELECT vec_id, unnest(range(64)) AS i, CAST(floor((unnest(CAST(embedding AS DOUBLE[])) + 2) * 8) AS INT) - 8 AS p
FROM embeddings
"""


@query(
    "I1_dominant_colors",
    f"""
SELECT vec_id AS origin, '#' || lpad(lower(hex(p)), 2, '0') || '10' || lpad(lower(hex(p)), 2, '0') AS color FROM (
  SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, min(i)) AS r FROM ({_PIXELS})
  GROUP BY vec_id, p) WHERE r = 1
""",
)
def i1(spark, sf_dir):
    return I.dominant_colors(_images(spark, sf_dir, 0))


@query(
    "I2_pixel_diff",
    f"""
SELECT a.vec_id AS origin, count(*) FILTER (WHERE a.p <> b.p) AS differing
FROM ({_PIXELS}) a JOIN ({_PIXELS}) b ON a.vec_id = b.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id
""",
)
def i2(spark, sf_dir):
    images = _images(spark, sf_dir, 0)
    before = images.withColumn("origin", F.col("origin") + 1)
    return I.pixel_diff(images, before, "origin")
