"""Run settings and their YAML form."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml

from .schemas import RESERVED

# Names of the model backends and the classes that are counted by default.
BACKENDS = ("torchvision", "ultralytics")
DEFAULT_CLASSES = ("attached_ciliates", "filamentous_bacteria", "rotifers", "testate_amoebae", "free_swimming_ciliates", "nematoda", "gastrotrichs")
# Default architecture of each task's model.
ARCHITECTURES = {"floc_segmentation": "maskrcnn_resnet50_fpn_v2", "microorganism_detection": "fasterrcnn_resnet50_fpn_v2"}


@dataclass(frozen=True)
class ModelSpec:
    """One task's model: its weights, the library that runs it, and for class names its COCO file."""

    weights: Path
    backend: str = "ultralytics"
    architecture: str = ""
    annotations: Path | None = None

    def missing_file(self) -> Path | None:
        """The first file that is needed and not there."""
        if not self.weights.is_file():
            return self.weights
        if self.backend == "torchvision" and not (self.annotations and self.annotations.is_file()):
            return self.annotations or Path("coco_annotations")
        return None


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run.  ``image_size`` and ``iou_threshold`` are used by the ultralytics backend only."""

    segmentation: ModelSpec
    detection: ModelSpec
    device: str = "cpu"
    image_size: int = 960
    floc_confidence: float = 0.25
    microorganism_confidence: float = 0.25
    iou_threshold: float = 0.60
    max_detections: int = 300
    floc_class_name: str = "floc"
    classes: tuple[str, ...] = field(default=DEFAULT_CLASSES)

    def check(self, files: bool = True) -> RunConfig:
        """Return self if the settings hold; with ``files`` the model files must exist, which is looked at first."""
        tasks = {"segmentation": self.segmentation, "detection": self.detection}
        for task, spec in tasks.items() if files else ():
            if (path := spec.missing_file()) is not None:
                raise FileNotFoundError(f"{task}: no such file: {path}")
        for task, spec in tasks.items():
            if spec.backend not in BACKENDS:
                raise ValueError(f"{task}: unknown backend {spec.backend!r}, known are {', '.join(BACKENDS)}")
        for name in ("image_size", "max_detections"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("floc_confidence", "microorganism_confidence", "iou_threshold"):
            value = getattr(self, name)
            if math.isnan(value) or value < 0 or value > 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if len(self.classes) > len(set(self.classes)):
            raise ValueError("microorganism_classes names a class twice")
        if clash := RESERVED.intersection(self.classes):
            raise ValueError(f"microorganism_classes uses names of result columns: {sorted(clash)}")
        return self


def _place(value: Any, folder: Path) -> Path | None:
    return (folder / Path(str(value)).expanduser()).resolve() if value else None


def _spec(models: dict[str, Any], task: str, folder: Path) -> ModelSpec:
    block = models.get(task)
    if not isinstance(block, dict):  # the short form is the path of the weights
        block = {"weights": block}
    weights = _place(block.get("weights"), folder)
    if weights is None:
        raise ValueError(f"models.{task} needs weights")
    return ModelSpec(weights, str(block.get("backend", "ultralytics")).lower(), str(block.get("architecture", ARCHITECTURES[task])), _place(block.get("coco_annotations"), folder))


def read_config(path: str | Path) -> RunConfig:
    """Read a YAML file.  Its paths count from its own folder; whether they exist is not looked at."""
    path = Path(path).expanduser().resolve()
    content = yaml.safe_load(path.read_text("utf-8")) or {}
    models, settings = content.get("models") or {}, content.get("inference") or {}
    classes = content.get("microorganism_classes", DEFAULT_CLASSES)
    if not isinstance(classes, (list, tuple)) or any(not isinstance(c, str) for c in classes):
        raise ValueError("microorganism_classes must list names")
    kinds = {"device": str, "image_size": int, "floc_confidence": float, "microorganism_confidence": float, "iou_threshold": float, "max_detections": int, "floc_class_name": str}
    given = {name: kind(settings[name]) for name, kind in kinds.items() if name in settings}
    config = RunConfig(_spec(models, "floc_segmentation", path.parent), _spec(models, "microorganism_detection", path.parent), classes=tuple(classes), **given)
    return config.check(files=False)


def override(config: RunConfig, segmentation: str | None = None, detection: str | None = None, device: str | None = None) -> RunConfig:
    """Replace weights and device; empty values change nothing, paths count from the working directory."""
    changes: dict[str, Any] = {}
    for name, value in (("segmentation", segmentation), ("detection", detection)):
        if value:
            changes[name] = replace(getattr(config, name), weights=Path(value).expanduser().resolve())
    if device:
        changes["device"] = device
    return replace(config, **changes)
