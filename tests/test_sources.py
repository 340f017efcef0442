import io
import json
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from answerloom.operators import images as I
from answerloom.sources import logs, manifest, readers, sinks


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content.encode() if isinstance(content, str) else content)
    return path


def png(width, height, pixels, alpha=False):
    """A PNG of the given (r, g, b[, a]) pixels."""

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(v for p in pixels[y * width : (y + 1) * width] for v in p) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize(
    "cell,want", [("12", True), ("1.5", True), ("1.5.2", False), ("-3", False), ("id", False), ("", False), (None, False)]
)
def test_header_cell(cell, want):
    assert readers.looks_like_data(cell) is want


def test_csv(spark, folder):
    named = readers.read_csv_auto(spark, put(folder, "a.csv", 'id,name\n1,"x, y"\n2,\n'))
    assert named.columns == ["id", "name"] and named.dtypes[0][1] == "int"
    assert sorted(map(tuple, named.collect())) == [(1, "x, y"), (2, None)]
    bare = readers.read_csv_auto(spark, put(folder, "b.csv", "10,20.5\n30,40\n"))
    assert bare.columns == ["value_0", "value_1"] and bare.count() == 2
    typed = readers.read_csv_auto(spark, os.path.join(folder, "b.csv"), "p int, q string")
    assert typed.columns == ["p", "q"] and typed.agg(F.sum("p")).first()[0] == 40


def test_json(spark, folder):
    array = put(folder, "a.json", '[\n{"a": 1},\n {"a": 2, "b": [1]}]')
    assert readers.read_json_records(spark, array).count() == 2
    one = readers.read_json_records(spark, put(folder, "b.json", '{\n"a": {"b": 1}\n}'))
    assert one.first().a.b == 1
    assert readers.read_json_records(spark, put(folder, "c.json", '{"a": 1}\n{"a": 2}\n\n{"a": 3}\n')).count() == 3
    assert readers.read_json_records(spark, put(folder, "d.json", '{"a": 1}')).count() == 1


def test_xml(spark, folder):
    records = put(folder, "a.xml", "<r><item><a>1</a><b>x</b></item><item><a>02</a></item></r>")
    got = readers.read_xml_records(spark, records, "item").orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [("02", None), ("1", "x")]
    prose = readers.read_xml_records(spark, put(folder, "b.xml", "<r>only text</r>"), "item")
    assert prose.first().xml_text == "<r>only text</r>"


def test_text(spark, folder):
    put(folder, "note.txt", "é\nb")
    put(folder, "blob.bin", b"\xff\xfe\x00")
    got = {os.path.basename(r.path): (r.text, r.content) for r in readers.read_text_files(spark, folder).collect()}
    assert got["note.txt"] == ("é\nb", None)
    assert got["blob.bin"][0] is None and bytes(got["blob.bin"][1]) == b"\xff\xfe\x00"


def test_zip(spark, folder, monkeypatch):
    monkeypatch.setattr(readers, "_LINES_PER_BATCH", 2)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.jsonl", '{"x": 1, "n": {"k": "v"}}\n\n  {"y": 2.50}  \r\n{bad\n[1]\n5')
        z.writestr("d/b.jsonl", '{"x": 3, "y": null}')
    put(folder, "logs.zip", held.getvalue())
    put(folder, "broken.zip", "nothing")
    df = readers.read_zip_jsonl(spark, folder)
    assert dict(df.dtypes)["y"] == "double"
    got = sorted((r.member, r.line_no, r.x, r.y) for r in df.collect())
    assert got == [("a.jsonl", 0, 1, None), ("a.jsonl", 2, None, 2.5), ("d/b.jsonl", 0, 3, None)]
    assert readers.read_zip_jsonl(spark, folder, "x string").where("x = '3'").count() == 1
    empty = readers.parse_json_lines(spark.createDataFrame([("no",)], "line string"))
    assert empty.count() == 0


def test_logs(spark, folder):
    text = "\n".join(
        f"2024-01-01 00:00:{i:02d} - app - {'ERROR' if i % 4 == 0 else 'INFO'} - step {i} - ERROR? {i}" for i in range(40)
    )
    lines = logs.read_log_lines(spark, put(folder, "app.log", text + "\nTraceback ERROR\n"))
    parsed = logs.parse_log_lines(lines)
    assert parsed.where("level IS NULL").count() == 1
    first = parsed.orderBy("nr").first()
    assert (first.name, first.level, first.message) == ("app", "ERROR", "step 0 - ERROR? 0")
    order = ["file", "block", "nr"]
    assert [r.message[:7].strip() for r in logs.log_tail(parsed, order, "error", 3).collect()] == ["step 28", "step 32", "step 36"]
    assert logs.log_tail(parsed, order, n=2).collect()[-1].line == "Traceback ERROR"
    with pytest.raises(ValueError):
        logs.log_tail(parsed, order, n=5001)


def test_manifest(spark, folder):
    paths = [
        put(folder, "a.csv", "k,v\n1,2\n3,4\n"),
        put(folder, "b.json", '[{"a": 1}]'),
        put(folder, "c.xml", "<r><record><a>1</a></record></r>"),
        put(folder, "d.txt", "hi"),
        put(folder, "e.png", png(1, 1, [(1, 2, 3)])),
        put(folder, "page.html", "<p>x"),
        os.path.join(folder, "missing.csv"),
        put(folder, "f.pdf", "x"),
        put(folder, "g.mp3", "x"),
    ]
    frames, status = manifest.ingest_manifest(spark, paths)
    got = {os.path.basename(r.source): (r.kind, r.status, r.rows) for r in status.collect()}
    assert got == {
        "a.csv": ("file", "success", 2), "b.json": ("file", "success", 1), "c.xml": ("file", "success", 1),
        "d.txt": ("file", "success", 1), "e.png": ("image", "success", 1), "page.html": ("page", "success", 1),
        "missing.csv": ("file", "failed", None), "f.pdf": ("pdf", "failed", None), "g.mp3": ("audio", "failed", None),
    }
    assert len(frames) == 6 and frames[paths[0]].columns == ["k", "v"]
    assert status.where("status = 'failed' AND error IS NULL").count() == 0


def test_json_records(spark, folder):
    df = spark.createDataFrame([(2, None), (1, 'q"')], "id int, s string")
    got = [tuple(r) for r in sinks.to_json_records(df, ["id"], ranges=2).orderBy("record_no").collect()]
    assert got == [(1, '{"id":1,"s":"q\\""}'), (2, '{"id":2,"s":null}')]
    assert json.loads(sinks.json_answer(df, ["id"]).first().answer) == [{"id": 1, "s": 'q"'}, {"id": 2, "s": None}]
    with pytest.raises(ValueError, match="size limit"):
        sinks.json_answer(df, ["id"], limit=10)
    out = os.path.join(folder, "out")
    sinks.write_json(spark.range(100).withColumn("n", F.lit(None).cast("int")), out, ["id"])
    lines = []
    for name in sorted(f for f in os.listdir(out) if f.endswith(".json")):
        lines += [json.loads(line) for line in open(os.path.join(out, name))]
    assert [r["id"] for r in lines] == list(range(100)) and "n" in lines[0]


def test_dominant_color(spark, folder):
    red, blue, green = (255, 0, 0), (0, 0, 255), (0, 128, 7)
    put(folder, "a.png", png(3, 2, [red, blue, blue, green, blue, red]))
    put(folder, "tie.png", png(2, 2, [green, red, red, green]))
    put(folder, "alpha.png", png(2, 1, [(9, 8, 7, 0), (9, 8, 7, 255)], alpha=True))
    put(folder, "none.png", "not an image")
    got = {os.path.basename(r.origin): r.color for r in I.dominant_colors(I.read_images(spark, folder)).collect()}
    assert got == {"a.png": "#0000ff", "tie.png": "#008007", "alpha.png": "#090807"}


def test_pixel_diff(spark, tmp_path):
    for side, pixels in (("x", [(1, 1, 1), (2, 2, 2), (3, 3, 3)]), ("y", [(1, 1, 1), (2, 2, 9), (3, 0, 3)])):
        os.mkdir(tmp_path / side)
        put(str(tmp_path / side), "a.png", png(3, 1, pixels))
        put(str(tmp_path / side), "b.png", png(1, 1 if side == "x" else 2, [(0, 0, 0)] * 2))

    def load(side):
        return I.read_images(spark, str(tmp_path / side)).withColumn("name", F.substring_index("origin", "/", -1))

    assert {r.name: r.differing for r in I.pixel_diff(load("x"), load("y"), "name").collect()} == {"a.png": 2, "b.png": None}


def test_json_files_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('[\n  {"a": 4, "b": "x"},\n  {"a": 5.5}\n]')
    (tmp_path / "c.json").write_text('{\n  "a": 6,\n  "list": [\n{"x": 1}\n]\n}')
    (tmp_path / "d.json").write_text('{"a": 7}\nnot an object\n')
    got = readers.read_json_records(spark, str(tmp_path / "*.json"))
    assert sorted(r.a for r in got.collect() if r.a is not None) == [1, 2, 3, 4, 5.5, 6, 7]
    assert got.where("b = 'x'").count() == 1


def test_csv_files_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("5,6\n7,8\n")
    got = readers.read_csv_auto(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, got.select("x", "y").collect())) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    (tmp_path / "c.csv").write_text("z\nw\n")
    got = readers.read_csv_auto(spark, str(tmp_path / "*.csv"))
    assert got.count() == 5 and {"x", "y", "z", "value_0", "value_1"} == set(got.columns)


def test_xml_records_are_children_of_any_tag(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<root><item><n>1</n></item><thing><n>2</n><m>x</m></thing></root>")
    got = readers.read_xml_records(spark, str(tmp_path / "a.xml"))
    assert sorted((r.n, r.m) for r in got.collect()) == [("1", None), ("2", "x")]


def test_broken_archives_and_lines_are_told(spark):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as packed:
        packed.writestr("good", '{"a": 1}\n')
        packed.writestr("odd", b'{"a": 2}\n\xff\n')
    rows = [("a.zip", held.getvalue()), ("b.zip", b"no archive"), ("c.zip", held.getvalue()[:60])]
    archives = spark.createDataFrame(rows, "path string, content binary")
    got = {(r.archive, r.member): (r.status, r.lines) for r in readers.zip_status(archives).collect()}
    assert got == {("a.zip", "good"): ("success", 1), ("a.zip", "odd"): ("failed", 1), ("b.zip", None): ("failed", 0), ("c.zip", None): ("failed", 0)}
    assert readers.zip_members(archives).where("raw IS NOT NULL").first().raw == b"\xff\n"


def test_errors_without_text_stop_no_other_source(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("x")

    def fail(spark, path, row_tag=None):
        raise ValueError

    monkeypatch.setattr(manifest, "read_source", fail)
    _, status = manifest.ingest_manifest(spark, [str(tmp_path / "a.txt")])
    assert [(r.status, r.error) for r in status.collect()] == [("failed", "ValueError")]


def test_json_of_one_schema_is_listed_once_per_form(spark, tmp_path, monkeypatch):
    """Files of both forms with the same columns: what their schema was found on is what is read."""
    for n in range(3):
        put(tmp_path, f"a{n}.json", '[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
        put(tmp_path, f"l{n}.json", '{"a": 3, "b": "y"}\n{"a": 4, "b": "z"}\n')
    calls, own = [], type(spark.read).json
    monkeypatch.setattr(type(spark.read), "json", lambda self, *a, **k: calls.append(1) or own(self, *a, **k))
    got = readers.read_json_records(spark, str(tmp_path / "*.json"))
    assert sorted((r.a, r.b or "") for r in got.collect()) == sorted([(1, "x"), (2, ""), (3, "y"), (4, "z")] * 3)
    assert len(calls) == 2
