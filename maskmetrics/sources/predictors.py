"""Models: what a predictor is, one that answers from tables, and adapters for model libraries.

A predictor runs inside the tasks that read the images.  ``ModelPredictor`` holds only settings; each Python worker loads the weights once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple, Protocol

import numpy as np
from pyspark import TaskContext
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests

from ..config import ModelSpec, RunConfig
from ..operators.kernel import binary_mask


class Mask(NamedTuple):
    """One instance: set pixels of the whole image, confidence, class."""

    pixels: np.ndarray
    confidence: float
    class_name: str


class Box(NamedTuple):
    """One detection: class, corners, confidence."""

    class_name: str
    bbox_xyxy: tuple[float, float, float, float]
    confidence: float


class Predictor(Protocol):
    """What a run asks of a model; an optional ``class_names()`` gives the two sets of names that it knows, and optional
    ``segment_many`` and ``detect_many`` answer several images at once."""

    def segment(self, image: np.ndarray) -> list[Mask]: ...

    def detect(self, image: np.ndarray) -> list[Box]: ...


def gpu_profile(amount: float = 1.0) -> ResourceProfile:
    """A stage profile by which each task gets ``amount`` of a GPU, so that as many models as slots are loaded, whatever other stages need."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", amount)).build


def own_device(device: str) -> str:
    """The GPU that Spark gave to the running task; without one, the configured device."""
    task = TaskContext.get()
    given = task.resources().get("gpu") if task else None
    return given.addresses[0] if given and given.addresses else device


@dataclass(frozen=True)
class Task:
    """Everything that an adapter needs to know of one task."""

    spec: ModelSpec
    device: str
    confidence: float
    limit: int
    image_size: int
    iou: float
    names: tuple[str, ...] = ()


class UltralyticsModel:
    """Adapter for the ``ultralytics`` package; it applies confidence, suppression and limit itself, before any class is looked at."""

    def __init__(self, task: Task):
        try:
            from ultralytics import YOLO
        except ImportError as missing:
            raise RuntimeError("this backend needs the ultralytics package") from missing
        self.task, self.model = task, YOLO(str(task.spec.weights))

    def names(self) -> set[str]:
        return {str(n) for n in dict(self.model.names).values()}

    def _predict(self, image: np.ndarray) -> Any:
        t = self.task
        return self.model.predict(image, imgsz=t.image_size, conf=t.confidence, iou=t.iou, max_det=t.limit, device=t.device, verbose=False)[0]

    def masks(self, image: np.ndarray, wanted: str) -> list[Mask]:
        result = self._predict(image)
        if result.masks is None:
            return []
        rows = zip(result.masks.data.cpu().numpy(), result.boxes.cls.tolist(), result.boxes.conf.tolist())
        named = ((binary_mask(m, *image.shape[:2]), float(c), str(result.names[int(k)])) for m, k, c in rows)
        return [Mask(m, c, n) for m, c, n in named if n.casefold() == wanted.casefold() and m.any()]

    def boxes(self, image: np.ndarray) -> list[Box]:
        found = self._predict(image).boxes
        if found is None:
            return []
        rows = zip(found.cls.tolist(), found.xyxy.tolist(), found.conf.tolist())
        return [Box(str(self.model.names[int(k)]), tuple(map(float, xy)), float(c)) for k, xy, c in rows]


class TorchvisionModel:
    """Adapter for ``torchvision`` detection models; classes are ranks of a COCO file's categories, the limit counts what passed the filters."""

    # The architectures that can be asked for.
    ARCHITECTURES = ("fasterrcnn_resnet50_fpn", "fasterrcnn_resnet50_fpn_v2", "maskrcnn_resnet50_fpn", "maskrcnn_resnet50_fpn_v2")

    def __init__(self, task: Task):
        try:
            import torch
            from torchvision.models import detection
        except ImportError as missing:
            raise RuntimeError("this backend needs torch and torchvision") from missing
        if task.spec.architecture not in self.ARCHITECTURES:
            raise ValueError(f"unknown architecture {task.spec.architecture!r}, known are {', '.join(self.ARCHITECTURES)}")
        self.torch, self.task = torch, task
        self.device = torch.device(f"cuda:{task.device}" if task.device.isdigit() else task.device)
        saved = torch.load(str(task.spec.weights), map_location="cpu", weights_only=True)  # runs no code from the file
        settings = saved.get("config") or {} if isinstance(saved, dict) else {}
        for key in ("model", "model_state_dict", "state_dict"):
            if isinstance(saved, dict) and isinstance(saved.get(key), dict):
                saved = saved[key]
                break
        sizes = {k: int(settings[k]) for k in ("min_size", "max_size") if isinstance(settings, dict) and settings.get(k) is not None}
        if not isinstance(saved, dict):
            raise ValueError(f"{task.spec.weights} holds no weights by name")
        self.model = getattr(detection, task.spec.architecture)(weights=None, weights_backbone=None, num_classes=len(task.names) + 1, **sizes)
        try:
            self.model.load_state_dict({str(k).removeprefix("module."): v for k, v in saved.items()})
        except RuntimeError as differ:
            raise ValueError(f"{task.spec.weights} does not fit {task.spec.architecture} with {len(task.names)} classes") from differ
        self.model.to(self.device).eval()

    def names(self) -> set[str]:
        return set(self.task.names)

    def _name(self, label: int) -> str:
        if not 1 <= label <= len(self.task.names):
            raise ValueError(f"no category for label {label}")
        return self.task.names[label - 1]

    def _predict(self, image: np.ndarray) -> dict[str, np.ndarray]:
        planes = np.ascontiguousarray(image[..., ::-1].transpose(2, 0, 1), np.float32) / 255
        with self.torch.inference_mode():
            (found,) = self.model([self.torch.from_numpy(planes).to(self.device)])
        return {k: v.cpu().numpy() for k, v in found.items()}

    def masks(self, image: np.ndarray, wanted: str) -> list[Mask]:
        found, out = self._predict(image), []
        if "masks" not in found:
            raise ValueError(f"{self.task.spec.architecture} gives no masks")
        for values, label, score in zip(found["masks"], found["labels"], found["scores"]):
            name = self._name(int(label))
            if score < self.task.confidence or name.casefold() != wanted.casefold():
                continue
            pixels = np.asarray(values).reshape(values.shape[-2:]) > 0.5
            if pixels.any():
                out.append(Mask(pixels, float(score), name))
            if len(out) == self.task.limit:
                break
        return out

    def boxes(self, image: np.ndarray) -> list[Box]:
        found = self._predict(image)
        rows = [(int(k), xy, float(s)) for k, xy, s in zip(found["labels"], found["boxes"], found["scores"]) if s >= self.task.confidence]
        return [Box(self._name(k), tuple(map(float, xy)), s) for k, xy, s in rows[: self.task.limit]]


ADAPTERS = {"ultralytics": UltralyticsModel, "torchvision": TorchvisionModel}


@lru_cache(maxsize=2)
def adapter(task: Task) -> Any:
    """One loaded model per task and Python process."""
    return ADAPTERS[task.spec.backend](task)


@dataclass(frozen=True)
class ModelPredictor:
    """A predictor over the two configured models."""

    config: RunConfig
    floc_names: tuple[str, ...] = ()
    detection_names: tuple[str, ...] = ()

    def _task(self, spec: ModelSpec, confidence: float, names: tuple[str, ...]) -> Task:
        c = self.config
        return Task(spec, own_device(c.device), confidence, c.max_detections, c.image_size, c.iou_threshold, names)

    def _segmentation(self) -> Any:
        return adapter(self._task(self.config.segmentation, self.config.floc_confidence, self.floc_names))

    def _detection(self) -> Any:
        return adapter(self._task(self.config.detection, self.config.microorganism_confidence, self.detection_names))

    def segment(self, image: np.ndarray) -> list[Mask]:
        return self._segmentation().masks(image, self.config.floc_class_name)

    def detect(self, image: np.ndarray) -> list[Box]:
        return self._detection().boxes(image)

    def class_names(self) -> tuple[set[str], set[str]]:
        return self._segmentation().names(), self._detection().names()


@dataclass(frozen=True)
class FixedPredictor:
    """Gives the same answer for every image; for tests and dry runs."""

    masks: list[Mask] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=list)

    def segment(self, image: np.ndarray) -> list[Mask]:
        return list(self.masks)

    def detect(self, image: np.ndarray) -> list[Box]:
        return list(self.boxes)
