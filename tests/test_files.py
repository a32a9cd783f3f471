"""Files in any file system: listing, orientation marks, order, exact result files."""

import codecs
import csv
import io
import json
import os
import random
import struct

import numpy as np
import pytest
from helpers import block_mask, solid, write_bmp
from pyspark.sql import functions as F

from maskmetrics.config import ModelSpec, RunConfig
from maskmetrics.functions.expressions import path_parts
from maskmetrics.operators.kernel import orientation_mark, pixels_of, upright
from maskmetrics.operators.selection import row_numbers
from maskmetrics.plans.pipeline import Analysis
from maskmetrics.sources.images import find_images, read_images, scan_images
from maskmetrics.sources.predictors import Box, FixedPredictor, Mask
from maskmetrics.sources.sinks import cell, write_csv, write_documents

PREDICTOR = FixedPredictor([Mask(block_mask(), 0.9, "floc")], [Box("rotifers", (1, 2, 7, 8), 0.8)])
NAMES = ["a b", "a!b", "a%b", "a%20b", "aéb", "a+b", "a-b", "a", "b", "A", "a.b", "日本", "a#b", "z z/é", "z!z/b", "z z/a", "zz/a"]


def run(spark, tmp_path, source, out):
    return Analysis(spark, RunConfig(ModelSpec(tmp_path / "a.pt"), ModelSpec(tmp_path / "b.pt"), classes=("rotifers",)), PREDICTOR).run(source, out)


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


@pytest.fixture
def mounted(spark, tmp_path):
    """A folder under a scheme that only Hadoop knows."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name.replace('_', '')}.link./data", tmp_path.as_uri())
    return f"viewfs://{tmp_path.name.replace('_', '')}/data"


def test_rows_come_in_the_order_of_real_names(spark, tmp_path):
    for name in NAMES:
        path = tmp_path / "in" / f"{name}.bmp"
        path.parent.mkdir(parents=True, exist_ok=True)
        write_bmp(path, solid())
    want = [p.stem for p in find_images(tmp_path / "in")]
    assert want == [p.stem for p in sorted((tmp_path / "in").rglob("*.bmp"))] and len(want) == len(NAMES)
    run(spark, tmp_path, tmp_path / "in", tmp_path / "out")
    for name in ("combined_analysis.csv", "microorganism_counts.csv"):
        assert [r["image_id"] for r in read(tmp_path / "out" / name)] == want
    assert [r["image_id"] for r in read(tmp_path / "out" / "floc_features.csv") if r["row_type"] == "instance"] == want
    assert [r["image_id"] for r in json.loads((tmp_path / "out" / "microorganism_detections.json").read_text("utf-8"))] == want
    images = read_images(spark, tmp_path / "in")
    numbered = row_numbers(images.select("origin", "image_id"), [path_parts(F.col("origin"))]).collect()
    assert [r["image_id"] for r in sorted(numbered, key=lambda r: r["row_number"])] == want


def test_row_numbers(spark):
    r = random.Random(1)
    values = r.sample(range(10**6), 5000)
    rows = spark.createDataFrame([(v % 7, v) for v in values], "k long, v long").repartition(9)
    got = {x["v"]: x["n"] for x in row_numbers(rows, [F.desc("k"), "v"], "n").collect()}
    assert got == {v: n for n, v in enumerate(sorted(values, key=lambda v: (-(v % 7), v)), 1)}
    plan = row_numbers(rows, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert row_numbers(rows.limit(0), ["v"]).count() == 0


def test_sources_and_results_under_another_scheme(spark, tmp_path, mounted):
    (tmp_path / "in" / "_sub dir").mkdir(parents=True)
    for name in ("b é.bmp", ".hidden.bmp", "_sub dir/x+y.BMP", "_a=b.bmp", "note.txt"):
        write_bmp(tmp_path / "in" / name, solid())
    os.utime(tmp_path / "in" / ".hidden.bmp", (10**9, 10**9))
    found = scan_images(spark, f"{mounted}/in")
    assert found.count == 4 and sorted(f.name for f in found.hidden) == [".hidden.bmp", "x+y.BMP"]
    far, near = (run(spark, tmp_path, source, out) for source, out in ((f"{mounted}/in", f"{mounted}/far"), (tmp_path / "in", tmp_path / "near")))
    assert far == near and far["images_processed"] == 4
    for name in os.listdir(tmp_path / "near"):
        assert (tmp_path / "far" / name).read_bytes() == (tmp_path / "near" / name).read_bytes()
    left = [n for n in os.listdir(tmp_path / "far") if not n.endswith(".crc")]  # that scheme keeps checksums beside local files
    assert sorted(left) == sorted(os.listdir(tmp_path / "near")) == sorted([*far["outputs"], "run_summary.json"])
    rows = {r["image_id"]: r["captured_at"] for r in read(tmp_path / "far" / "combined_analysis.csv")}
    assert rows[".hidden"].startswith("2001-09-09T01:46:40") and set(rows) == {".hidden", "b é", "x+y", "_a=b"}
    with pytest.raises(FileNotFoundError):
        scan_images(spark, f"{mounted}/none")
    with pytest.raises(ValueError):
        scan_images(spark, f"{mounted}/in/note.txt")
    assert run(spark, tmp_path, f"{mounted}/in/.hidden.bmp", tmp_path / "one")["images_processed"] == 1


def exif(mark, order=">"):
    tiff = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "IHHHII", 8, 2, 0x0100, 4, 1, 7) + struct.pack(order + "HHIHH", 0x0112, 3, 1, mark, 0) + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def write_jpeg(spark, path, image, extra=b""):
    jvm = spark.sparkContext._jvm
    height, width, _ = image.shape
    picture = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            b, g, r = map(int, image[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(path)))
    raw = path.read_bytes()
    path.write_bytes(raw[:2] + extra + raw[2:])


def test_marks_are_found():
    head = b"\xff\xd8"
    assert [orientation_mark(head + exif(k, o) + b"\xff\xda") for k in range(1, 9) for o in "<>"] == [k for k in range(1, 9) for _ in "<>"]
    comment = b"\xff\xfe" + struct.pack(">H", 6) + b"abcd"
    assert orientation_mark(head + comment + b"\xff" + exif(6)) == 6
    for bad in (b"", b"\xff\xd8", b"BM" + exif(6), head + exif(9), head + exif(0), head + b"\xff\xda\0\x04" + exif(6), (head + exif(6))[:20], head + b"\xff\xe1\0\x10Exif\0\0XX*\0\0\0"):
        assert orientation_mark(bad) == 1


def test_images_are_turned_upright(spark, tmp_path):
    """A picture stored turned by its mark comes out as it is to be seen; the marks' meaning by where the first row and column lie."""
    image = np.repeat(np.repeat(np.random.default_rng(1).integers(0, 2, (3, 5, 1)) * 255, 16, 0), 16, 1).repeat(3, 2).astype(np.uint8)
    first = {1: ("top", "left"), 2: ("top", "right"), 3: ("bottom", "right"), 4: ("bottom", "left"), 5: ("left", "top"), 6: ("right", "top"), 7: ("right", "bottom"), 8: ("left", "bottom")}
    for mark, (row, column) in first.items():
        small = np.arange(6).reshape(2, 3)
        seen = upright(small, mark)
        side = {"top": seen[0], "bottom": seen[-1], "left": seen[:, 0], "right": seen[:, -1]}
        assert set(side[row]) == set(small[0]) and set(side[column]) == set(small[:, 0]), mark
    undo = {6: 8, 8: 6}
    (tmp_path / "in").mkdir()
    for mark in range(1, 9):
        write_jpeg(spark, tmp_path / "in" / f"m{mark}.jpg", upright(image, undo.get(mark, mark)), exif(mark))
    write_jpeg(spark, tmp_path / "in" / "_plain.JPEG", image)
    write_jpeg(spark, tmp_path / "in" / "_turned.JPEG", upright(image, 8), exif(6))
    rows = read_images(spark, tmp_path / "in").collect()
    assert {r["image_id"]: r["orientation"] for r in rows} == {**{f"m{k}": k for k in range(1, 9)}, "_plain": 1, "_turned": 6}
    for r in rows:
        got = pixels_of(r["data"], r["height"], r["width"], r["channels"], r["orientation"])
        assert got.shape == image.shape and np.abs(got.astype(int) - image).max() < 60, r["image_id"]


def driver_csv(rows, columns):
    out = io.StringIO(newline="")
    lines = csv.writer(out)
    lines.writerow(columns)
    lines.writerows([cell(r[c]) for c in columns] for r in rows)
    return codecs.BOM_UTF8 + out.getvalue().encode()


def test_csv_from_executors_is_byte_equal(spark, tmp_path):
    odd = [float("nan"), float("inf"), None, 1e-5, 1e16, 1e22, 0.1, -0.0, 123456789.123, 5e-324, 1 / 3]
    texts = ["a,b", 'q"q', "line\nend", "cr\rlf\r\n", "", " x ", "é日", None, "'", "a;b"]
    rows = [(k, texts[k % len(texts)], odd[k % len(odd)], k % 2 == 0, "left out") for k in range(500)]
    table = spark.createDataFrame(rows, "k long, `te xt` string, x double, yes boolean, more string").repartition(7).orderBy("k")
    write_csv(table, tmp_path / "out" / "a b.csv", ["k", "te xt", "x", "yes"])
    assert (tmp_path / "out" / "a b.csv").read_bytes() == driver_csv(table.collect(), ["k", "te xt", "x", "yes"])
    write_csv(table.limit(0), tmp_path / "out" / "a b.csv", ["k"])
    assert (tmp_path / "out" / "a b.csv").read_bytes() == codecs.BOM_UTF8 + b"k\r\n"
    with pytest.raises(Exception, match="no more"):
        write_csv(table.withColumn("k", F.when(F.col("k") > 400, F.raise_error(F.lit("no more"))).otherwise(F.col("k"))), tmp_path / "out" / "a b.csv", ["k"])
    assert (tmp_path / "out" / "a b.csv").read_bytes() == codecs.BOM_UTF8 + b"k\r\n" and os.listdir(tmp_path / "out") == ["a b.csv"]


def test_documents_are_one_json_array(spark, tmp_path):
    kind = "image_id string, file_name string, objects array<struct<class: string, bbox_xyxy: array<double>, confidence: double>>"
    rows = [(f"i{k}é", "f\n.bmp", [("a", [1.005, 2.0, 3.14159, k / 3], 0.12345678)] * (k % 3)) for k in range(50)]
    table = spark.createDataFrame(rows, kind).repartition(5).orderBy("image_id")
    write_documents(table, tmp_path / "a.json")
    want = [{"image_id": r["image_id"], "file_name": r["file_name"], "objects": [{"class": o["class"], "bbox_xyxy": [round(v, 2) for v in o["bbox_xyxy"]], "confidence": round(o["confidence"], 6)} for o in r["objects"]]} for r in table.collect()]
    assert (tmp_path / "a.json").read_text("utf-8") == json.dumps(want, ensure_ascii=False, indent=2)
    write_documents(table.limit(0), tmp_path / "a.json")
    assert (tmp_path / "a.json").read_text() == "[]"
