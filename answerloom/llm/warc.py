"""WARC archives: monolithic gzip files, their normaliser, and reading back by offset index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.plans.staging import cut_lineage, stage_path

CHUNK = 1 << 20
LEAST_REVISIT = 1000  # bytes of payload from which equal payloads are stored once
FILES = "file string, records long"
INDEX = "file string, `offset` long, length long, record_id string, target string, kind string"


def _filesystem(uri: str):
    """The file system and path of a URI or local path, for any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def record(page_id: str, url: str, payload: bytes, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One response or revisit record. A revisit holds no payload, only its digest and the response it points to."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>")]
    fields += [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)]
    if refers_to is None:
        body = _http(payload)
        fields.append(("Content-Type", "application/http;msgtype=response"))
    else:
        body = b""
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _header([*fields, ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, each inflated once, in pieces."""
    engine, data = zlib.decompressobj(31), read(CHUNK)
    while data:
        out = engine.decompress(data, CHUNK)
        if out:
            yield out
        if engine.eof:
            data = engine.unused_data or read(CHUNK)
            if data:
                engine = zlib.decompressobj(31)
        else:
            data = engine.unconsumed_tail or read(CHUNK)
    if not engine.eof:
        while out := engine.decompress(engine.unconsumed_tail, CHUNK):
            yield out
        if not engine.eof:
            raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and whole bytes of every record in an inflated stream."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                if held.strip():
                    raise ValueError("a record ends early")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one must begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record ends early")
        yield fields, bytes(held[:size])
        del held[:size]


def _named(value: str) -> str:
    return value.removeprefix("<urn:page:").removesuffix(">")


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, payload binary, refers_to) to one monolithic gzip file per partition; returns the files written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(f"{folder}/mono-{uuid.uuid4().hex}.warc.gz")  # a repeated task writes another file
        count, engine, sink = 0, zlib.compressobj(6, zlib.DEFLATED, 31), None
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path, compression=None)
                sink.write(engine.compress(record(str(row["page_id"]), row["url"] or "", row["payload"], None if row["refers_to"] is None else str(row["refers_to"]))))
                count += 1
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{path.rpartition('/')[2]}"], "records": pa.array([count], pa.int64())})

    return df.select("page_id", "url", "payload", "refers_to").mapInArrow(run, FILES)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each gzip archive with every record as a member of its own, and a sidecar index beside it.

    A stream is inflated once, from front to end, in pieces of 1 MB; no more than one record is held. The sidecar
    (``.idx``, tab-separated: offset, length, record id, target, type) is returned as rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, path = _filesystem(name)
                out_name = f"{folder}/norm-{uuid.uuid4().hex}.warc.gz"
                _, out = _filesystem(out_name)
                system.create_dir(out.rpartition("/")[0], recursive=True)
                rows, at = [], 0
                with system.open_input_stream(path, compression=None) as source, system.open_output_stream(out, compression=None) as sink:
                    for fields, whole in records(inflate(source.read)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(whole) + engine.flush()
                        sink.write(member)
                        rows.append((at, len(member), _named(fields["warc-record-id"]), fields.get("warc-target-uri", ""), fields["warc-type"]))
                        at += len(member)
                with system.open_output_stream(out + ".idx", compression=None) as sink:
                    sink.write("".join("\t".join(map(str, r)) + "\n" for r in rows).encode())
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([out_name] * len(rows)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["file", "offset", "length", "record_id", "target", "kind"])

    return files.mapInArrow(run, INDEX)


READ_BYTES = 8 << 20
READ = "record_id string, record_type string, target string, refers_to string, payload binary, digest string"


def read_records(index: DataFrame) -> DataFrame:
    """The records an index points to, each inflated from its own member: ids, type, target, payload, and hex digest as stated.

    Some MB of payloads are held at a time.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, object] = ("", None)
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
                if held[0] != row["file"]:
                    if held[1] is not None:
                        held[1].close()
                    system, path = _filesystem(row["file"])
                    held = (row["file"], system.open_input_file(path))
                held[1].seek(row["offset"])
                member = held[1].read(row["length"])
                ((fields, whole),) = records(iter([zlib.decompress(member, 31)]))
                body = whole.partition(b"\r\n\r\n")[2][: int(fields["content-length"])]
                size += len(body)
                is_response = fields["warc-type"] == "response"
                refers = fields.get("warc-refers-to")
                out.append(
                    {
                        "record_id": _named(fields["warc-record-id"]), "record_type": fields["warc-type"], "target": fields.get("warc-target-uri"),
                        "refers_to": _named(refers) if refers else None, "payload": body.partition(b"\r\n\r\n")[2] if is_response else None,
                        "digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)
        if held[1] is not None:
            held[1].close()

    return index.mapInArrow(run, READ)


def deduplicated(pages: DataFrame, html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Pages as (page_id, url, payload, refers_to): of equal payloads of ``least`` bytes or more, the largest id is kept, others refer to it.

    Groups are found on ids, digests and lengths alone; a group of any size is one maximum, added up before the
    shuffle, and its pages meet it in a join that AQE may split. Payloads meet only what they refer to, by page.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"_sha": F.sha1("payload"), "_size": F.octet_length("payload")})
    marks = rows.select("page_id", "_sha", "_size").where(F.col("_size") >= least)
    kept = marks.groupBy("_sha", "_size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    kept = kept.where("_n > 1").drop("_n")  # only payloads that occur twice need the join
    revisits = marks.join(kept, ["_sha", "_size"]).where("page_id <> refers_to").distinct()
    joined = rows.join(revisits, ["page_id", "_sha", "_size"], "left")
    return joined.select("page_id", "url", "payload", "refers_to")


def archive(pages: DataFrame, files: int | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives, normalises them, and returns the index of the records.

    A null html is an empty payload, a null url an empty target; pages without an id are written under the id "None" and come
    back with a null id. Rows repeated under one id are records each; those with the largest id and equal payloads are
    all responses. Other columns are not archived. An empty table writes nothing. Archives are in the shared
    folder of the session; tables in between are written there too, so no lost executor repeats a finished step.
    """
    spark = pages.sparkSession
    folder = stage_path(spark, "warc")
    parts = files or max(1, 2 * spark.sparkContext.defaultParallelism)
    rows = deduplicated(pages)
    mono = cut_lineage(write_archives(rows if files is None else rows.repartition(files), folder))
    return cut_lineage(normalise(mono.repartition(parts), folder))


def report(index: DataFrame) -> DataFrame:
    """Per record what reading it back gives: payload size and digest, type, and what it refers to.

    A revisit's payload is that of a response with the id it refers to and the digest it states, as an id may have several.
    """
    back = read_records(index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset"))
    back = cut_lineage(
        back.select(
            F.col("record_id").try_cast("long").alias("page_id"), "record_type", F.col("refers_to").try_cast("long").alias("refers_to"),
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("read_digest"), "digest",
        )
    )
    own = back.where("record_type = 'response'")
    wanted = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    stored = own.join(wanted, ["page_id", "digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(
        F.max("payload_bytes").alias("_bytes"), F.max("read_digest").alias("_digest")
    )
    again = back.where("record_type = 'revisit'").join(stored, ["refers_to", "digest"], "left")
    columns = lambda d, size, digest: d.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    return columns(own, F.col("payload_bytes"), F.col("read_digest")).unionByName(columns(again, F.col("_bytes"), F.col("_digest")))
