import csv
import json
import sys
from contextlib import nullcontext
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest
from helpers import block_mask, solid, write_bmp

from maskmetrics import cli
from maskmetrics.config import ModelSpec, RunConfig, override, read_config
from maskmetrics.plans.pipeline import Analysis, name_errors
from maskmetrics.schemas import INSTANCE_COLUMNS
from maskmetrics.sources.images import find_images, read_categories
from maskmetrics.sources.predictors import Box, FixedPredictor, Mask, Task, TorchvisionModel, UltralyticsModel
from maskmetrics.sources.sinks import cell

PREDICTOR = FixedPredictor([Mask(block_mask(), 0.9, "floc")], [Box("rotifers", (1.005, 2, 7, 8), 0.8), Box("other", (0, 0, 1, 1), 0.1234567)])


def config(tmp_path, **more):
    return RunConfig(ModelSpec(tmp_path / "a.pt"), ModelSpec(tmp_path / "b.pt"), classes=("rotifers", "nematoda"), **more)


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


def test_folder_to_files(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    write_bmp(source / "b c+é.bmp", solid())
    write_bmp(source / "sub" / "same.BMP", solid())
    write_bmp(source / "same.bmp", solid(bgr=(0, 0, 0)))
    (source / "note.txt").write_text("x")
    summary = Analysis(spark, config(tmp_path), PREDICTOR).run(source, out)
    assert (summary["images_processed"], summary["flocs_detected"], summary["microorganisms_detected"]) == (3, 3, 6)
    assert json.loads((out / "run_summary.json").read_text()) == summary
    raw = (out / "floc_features.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfimage_id,annotation_id") and b"\r\n" in raw
    rows = read(out / "floc_features.csv")
    assert list(rows[0]) == list(INSTANCE_COLUMNS)
    assert [(r["image_id"], r["row_type"], r["floc_count"]) for r in rows] == [
        ("b c+é", "instance", "1"), ("same", "instance", "1"), ("same", "instance", "1"), ("b c+é", "mean", "1"), ("b c+é", "median", "1"), ("same", "mean", "2"), ("same", "median", "2"),
    ]
    assert float(rows[5]["mean_r"]) == 15.0 and rows[5]["annotation_id"] == ""
    combined = read(out / "combined_analysis.csv")
    assert [(r["image_id"], r["floc_count"], r["rotifers"], r["nematoda"]) for r in combined] == [("b c+é", "1", "1", "0"), ("same", "1", "1", "0"), ("same", "1", "1", "0")]
    assert combined[0]["captured_at"][10] == "T" and combined[0]["captured_at"].endswith("+00:00")
    documents = json.loads((out / "microorganism_detections.json").read_text("utf-8"))
    assert documents[0]["file_name"] == "b c+é.bmp" and documents[0]["objects"][1]["confidence"] == 0.123457
    assert documents[0]["objects"][0] == {"class": "rotifers", "bbox_xyxy": [round(1.005, 2), 2.0, 7.0, 8.0], "confidence": 0.8}


def test_images_without_results(spark, tmp_path):
    write_bmp(tmp_path / "x.bmp", solid())
    out = tmp_path / "out"
    summary = Analysis(spark, config(tmp_path), FixedPredictor()).run(tmp_path / "x.bmp", out)
    assert summary["flocs_detected"] == 0
    assert [r["floc_count"] for r in read(out / "floc_features.csv")] == ["0", "0"]
    assert read(out / "combined_analysis.csv")[0]["mean_floc_area_px"] == ""
    assert json.loads((out / "microorganism_detections.json").read_text())[0]["objects"] == []


def test_names_that_readers_hide(spark, tmp_path):
    """Files and folders whose names begin with a dot or underscore count like any others."""
    source = tmp_path / "in"
    for k, name in enumerate(("plain.bmp", "_low.bmp", ".dot.BMP", "_folder/a.bmp", ".x/_y/b.jpeg.bmp")):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        write_bmp(source / name, solid(bgr=(k, k, k)))
    assert Analysis(spark, config(tmp_path), PREDICTOR).run(source, tmp_path / "out")["images_processed"] == 5
    rows = [r for r in read(tmp_path / "out" / "floc_features.csv") if r["row_type"] == "instance"]
    assert {r["image_id"]: float(r["mean_r"]) for r in rows} == {"plain": 0, "_low": 1, ".dot": 2, "a": 3, "b.jpeg": 4}
    assert [r["image_id"] for r in read(tmp_path / "out" / "combined_analysis.csv")] == [p.name.rsplit(".", 1)[0] for p in find_images(source)]
    assert Analysis(spark, config(tmp_path), PREDICTOR).run(source / "_low.bmp", tmp_path / "one")["images_processed"] == 1


def test_jpeg(spark, tmp_path):
    """A gray JPEG image, written by Java: all its pixels are 100."""
    java = spark.sparkContext._jvm.java
    image = java.awt.image.BufferedImage(20, 10, 1)
    for x in range(20):
        for y in range(10):
            image.setRGB(x, y, 0x646464)
    (tmp_path / "in").mkdir()
    assert spark.sparkContext._jvm.javax.imageio.ImageIO.write(image, "jpg", java.io.File(str(tmp_path / "in" / "sample.jpg")))
    predictor = FixedPredictor([Mask(block_mask(), 0.9, "floc")], [Box("rotifers", (1, 2, 7, 8), 0.8)])
    assert Analysis(spark, config(tmp_path), predictor).run(tmp_path / "in", tmp_path / "out")["images_processed"] == 1
    first = read(tmp_path / "out" / "floc_features.csv")[0]
    assert (float(first["area_px"]), float(first["elongation"]), float(first["area_fraction"]), float(first["mean_r"]), float(first["mean_b"])) == (32, 2, 0.16, 100, 100)
    row = read(tmp_path / "out" / "combined_analysis.csv")[0]
    assert (row["image_id"], row["floc_count"], row["rotifers"], row["nematoda"]) == ("sample", "1", "1", "0")


def test_sources_that_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        find_images(tmp_path / "none")
    with pytest.raises(ValueError):
        find_images(tmp_path)
    (tmp_path / "x.png").write_bytes(b"x")
    with pytest.raises(ValueError):
        find_images(tmp_path / "x.png")
    write_bmp(tmp_path / "good.bmp", solid())
    for name, content in (("bad.jpg", b"no image"), ("empty.jpg", b""), ("_bad.bmp", b"BM")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError):
            Analysis(spark, config(tmp_path), PREDICTOR).run(tmp_path, tmp_path / "out")
        (tmp_path / name).unlink()
    assert list((tmp_path / "out").iterdir()) == []


class Tensor(np.ndarray):
    """An array with the few methods of a tensor that the adapters use."""

    def cpu(self):
        return self

    def numpy(self):
        return np.asarray(self)

    def to(self, device):
        return self


def tensor(values, kind=float):
    return np.array(values, kind).view(Tensor)


def fake_ultralytics(monkeypatch, seen):
    class YOLO:
        names = {0: "Floc", 1: "rotifers"}

        def __init__(self, weights):
            seen["weights"] = weights

        def predict(self, image, **settings):
            seen.update(settings)
            boxes = SimpleNamespace(cls=tensor([0, 1, 0]), conf=tensor([0.9, 0.8, 0.7]), xyxy=tensor([[0, 0, 4, 4], [1, 2, 3, 4], [5, 5, 6, 6]]))
            masks = SimpleNamespace(data=tensor([np.ones((5, 10)), np.ones((5, 10)), np.zeros((5, 10))]))
            return [SimpleNamespace(masks=None if seen.get("empty") else masks, boxes=None if seen.get("empty") else boxes, names=self.names)]

    monkeypatch.setitem(sys.modules, "ultralytics", SimpleNamespace(YOLO=YOLO))


def test_ultralytics_adapter(monkeypatch):
    seen = {}
    fake_ultralytics(monkeypatch, seen)
    model = UltralyticsModel(Task(ModelSpec("w.pt"), "cpu", 0.3, 7, 320, 0.6))
    masks = model.masks(solid(), "floc")  # class in any case, empty masks go, masks get the image's size
    assert [(m.class_name, m.confidence, m.pixels.shape, m.pixels.all()) for m in masks] == [("Floc", 0.9, (10, 20), True)]
    assert [(b.class_name, b.bbox_xyxy, b.confidence) for b in model.boxes(solid())] == [("Floc", (0, 0, 4, 4), 0.9), ("rotifers", (1, 2, 3, 4), 0.8), ("Floc", (5, 5, 6, 6), 0.7)]
    assert (seen["weights"], seen["imgsz"], seen["conf"], seen["iou"], seen["max_det"], seen["device"]) == ("w.pt", 320, 0.3, 0.6, 7, "cpu") and model.names() == {"Floc", "rotifers"}
    seen["empty"] = True
    assert model.masks(solid(), "floc") == [] and model.boxes(solid()) == []


def fake_torchvision(monkeypatch, saved, found):
    class Model:
        def load_state_dict(self, state):
            if "wrong" in state:
                raise RuntimeError("size mismatch")
            self.state = state

        def to(self, device):
            return self

        def eval(self):
            return self

        def __call__(self, images):
            self.image = images[0]
            return [found]

    made = {}

    def build(weights, weights_backbone, num_classes, **sizes):
        made.update(sizes, num_classes=num_classes, model=Model())
        return made["model"]

    torch = ModuleType("torch")
    torch.device, torch.load, torch.inference_mode, torch.from_numpy = str, lambda *_, **__: saved, nullcontext, lambda a: a.view(Tensor)
    detection = SimpleNamespace(maskrcnn_resnet50_fpn=build, fasterrcnn_resnet50_fpn=build)
    for name, module in (("torch", torch), ("torchvision", ModuleType("torchvision")), ("torchvision.models", SimpleNamespace(detection=detection))):
        monkeypatch.setitem(sys.modules, name, module)
    return made


def test_torchvision_adapter(monkeypatch):
    found = {
        "labels": tensor([2, 1, 1, 1, 1], int), "scores": tensor([0.9, 0.8, 0.7, 0.6, 0.1]), "boxes": tensor([[k, 0, 9, 9] for k in range(5)]),
        "masks": tensor([np.ones((1, 10, 20)), np.full((1, 10, 20), 0.5), *[np.full((1, 10, 20), 0.6)] * 3]),
    }
    saved = {"config": {"min_size": 300, "max_size": None}, "model": {"module.a": 1}}
    made = fake_torchvision(monkeypatch, saved, found)
    spec = ModelSpec("w.pt", "torchvision", "maskrcnn_resnet50_fpn")
    task = Task(spec, "0", 0.5, 2, 640, 0.5, ("floc", "other"))
    model = TorchvisionModel(task)
    assert (made["num_classes"], made["min_size"], "max_size" in made, made["model"].state, model.device) == (3, 300, False, {"a": 1}, "cuda:0")
    # class and threshold first, then masks over one half that have pixels, then the limit
    assert [(m.class_name, m.confidence) for m in model.masks(solid(), "FLOC")] == [("floc", 0.7), ("floc", 0.6)]
    assert [(b.class_name, b.confidence) for b in model.boxes(solid())] == [("other", 0.9), ("floc", 0.8)]
    assert np.allclose(made["model"].image[:, 0, 0], np.array([30, 20, 10]) / 255)  # red, green, blue
    found["labels"][0] = 3
    with pytest.raises(ValueError, match="label 3"):
        model.boxes(solid())
    del found["masks"]
    with pytest.raises(ValueError, match="no masks"):
        model.masks(solid(), "floc")
    for bad in ([1, 2], {"state_dict": {"wrong": 1}}):
        fake_torchvision(monkeypatch, bad, found)
        with pytest.raises(ValueError):
            TorchvisionModel(task)
    with pytest.raises(ValueError, match="architecture"):
        TorchvisionModel(Task(ModelSpec("w.pt", "torchvision", "other"), "cpu", 0.5, 2, 640, 0.5))


def test_settings_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("models:\n  floc_segmentation: {backend: Torchvision, weights: m/a.pt, coco_annotations: c.json}\n  microorganism_detection: b.pt\ninference: {image_size: 640.7, microorganism_confidence: 0.2}\n")
    got = read_config(path)
    assert (got.segmentation.backend, got.segmentation.weights, got.segmentation.annotations) == ("torchvision", tmp_path / "m/a.pt", tmp_path / "c.json")
    assert (got.detection.backend, got.image_size, got.microorganism_confidence, got.floc_confidence) == ("ultralytics", 640, 0.2, 0.25)
    assert len(got.classes) == 7
    with pytest.raises(FileNotFoundError):
        got.check()
    assert override(got, device="0").device == "0" and override(got, segmentation="").segmentation == got.segmentation
    base = "models: {floc_segmentation: a, microorganism_detection: b}\n"
    for bad in ("models: {floc_segmentation: a}\n", base + "microorganism_classes: null\n", base + "microorganism_classes: [a, a]\n", base + "microorganism_classes: [image_id]\n", base + "inference: {floc_confidence: 1.01}\n", base + "inference: {iou_threshold: .nan}\n", base + "inference: {max_detections: 0}\n", "models: {floc_segmentation: {weights: a, backend: x}, microorganism_detection: b}\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            read_config(path)


def test_category_file(spark, tmp_path):
    path = tmp_path / "coco.json"
    path.write_text("﻿" + json.dumps({"categories": [{"id": 7, "name": "rotifers"}, {"id": 2, "name": "nematoda"}]}, indent=1), encoding="utf-8")
    assert [r["name"] for r in read_categories(spark, path).orderBy("label").collect()] == ["nematoda", "rotifers"]


class Named(FixedPredictor):
    def class_names(self):
        return {"floc"}, {"rotifers"}


def test_class_names_and_command_line(spark, tmp_path, capsys):
    assert name_errors(config(tmp_path), PREDICTOR) == []
    assert len(name_errors(config(tmp_path, floc_class_name="Floc"), Named())) == 2
    (tmp_path / "c.yaml").write_text("models: {floc_segmentation: a.pt, microorganism_detection: b.pt}\nmicroorganism_classes: [rotifers]\n")
    given = ["--config", str(tmp_path / "c.yaml"), "--output", str(tmp_path / "out")]
    assert cli.main([*given, "--validate-models"], spark, Named()) == 0
    with pytest.raises(SystemExit):
        cli.main(given, spark, Named())
    write_bmp(tmp_path / "x.bmp", solid())
    cli.main([str(tmp_path / "x.bmp"), *given], spark, PREDICTOR)
    assert '"images_processed": 1' in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        cli.main(given, spark)  # real models need their files


def test_cells():
    assert [cell(v) for v in (None, float("nan"), float("inf"), 1.5, 0, "é")] == ["", "", "", 1.5, 0, "é"]
