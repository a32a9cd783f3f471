"""Where and how often models are called."""

import sys
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import block_mask, solid, write_bmp
from pyspark import cloudpickle

from maskmetrics.config import ModelSpec, RunConfig
from maskmetrics.plans.pipeline import predict
from maskmetrics.schemas import RESULTS
from maskmetrics.sources import predictors
from maskmetrics.sources.images import read_images
from maskmetrics.sources.predictors import Box, FixedPredictor, Mask, ModelPredictor, gpu_profile, own_device

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests
MASKS, BOXES = [Mask(block_mask(), 0.9, "floc")], [Box("rotifers", (1, 2, 7, 8), 0.8)]


class Many(FixedPredictor):
    """Answers by batch; the number of boxes tells how many images came at once."""

    def segment_many(self, images):
        return [MASKS for _ in images]

    def detect_many(self, images):
        return [BOXES * len(images) for _ in images]

    def segment(self, image):
        raise AssertionError("one image at a time")


def test_images_come_in_batches(spark, tmp_path):
    for k in range(7):
        write_bmp(tmp_path / f"{k}.bmp", solid())
    images = read_images(spark, tmp_path).coalesce(1)
    rows = predict(images, Many(), at_once=3).collect()
    assert sorted(sum(r["kind"] == "box" and r["origin"].endswith(f"{k}.bmp") for r in rows) for k in range(7)) == [1, 3, 3, 3, 3, 3, 3]
    single = predict(images, FixedPredictor(MASKS, BOXES)).collect()
    keep = lambda rows: sorted((r for r in map(tuple, rows) if r[5] != "box"), key=repr)
    assert keep(rows) == keep(single) and sum(r["kind"] == "box" for r in single) == 7


class Short(FixedPredictor):
    def segment_many(self, images):
        return []


def test_every_image_needs_an_answer(spark, tmp_path):
    write_bmp(tmp_path / "a.bmp", solid())
    with pytest.raises(Exception, match="answered 0 of 1"):
        predict(read_images(spark, tmp_path), Short()).collect()


def test_stage_profile(spark):
    profile = gpu_profile(0.5)
    assert profile.taskResources["gpu"].amount == 0.5 and profile.taskResources["cpus"].amount == 1
    asked = {}
    images = SimpleNamespace(select=lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema, **more: asked.update(more, schema=schema)))
    predict(images, FixedPredictor(), profile=profile)
    assert asked == {"profile": profile, "schema": RESULTS}


def test_models_use_the_task_s_own_gpu(monkeypatch, tmp_path):
    given = {}
    monkeypatch.setattr(predictors.TaskContext, "get", staticmethod(lambda: SimpleNamespace(resources=lambda: given)))
    config = RunConfig(ModelSpec(tmp_path / "a.pt"), ModelSpec(tmp_path / "b.pt"), classes=("rotifers",), device="cpu")
    seen = []
    monkeypatch.setattr(predictors, "adapter", lambda task: seen.append(task.device) or SimpleNamespace(boxes=lambda image: []))
    for addresses in (["3"], []):
        given["gpu"] = SimpleNamespace(addresses=addresses)
        ModelPredictor(config).detect(np.zeros((2, 2, 3), np.uint8))
    assert seen == ["3", "cpu"] and own_device("cpu") == "cpu"
