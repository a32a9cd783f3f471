"""The analysis of a folder of images, from files to result files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import RunConfig, read_config
from ..functions.expressions import path_parts
from ..operators import aggregates
from ..operators.kernel import mask_features, pixels_of
from ..schemas import COMBINED_KEYS, FEATURES, HEADS, INSTANCE_COLUMNS, RESULTS
from ..sources.hadoop import address_of, delete, make_folder
from ..sources.images import check_images, read_categories, read_images, scan_images
from ..sources.predictors import ModelPredictor, Predictor
from ..sources.sinks import write_csv, write_documents, write_json
from ..sources.storage import Written

# Names of the result files.
OUTPUTS = ("floc_features.csv", "microorganism_detections.json", "microorganism_counts.csv", "combined_analysis.csv")
SUMMARY = "run_summary.json"


def predict(images: DataFrame, predictor: Predictor, at_once: int = 8, profile: ResourceProfile | None = None) -> DataFrame:
    """Run both models on every image and measure the masks, in one pass: only results leave the task, no pixels are shuffled.

    Every image also gives a row of its own, so that nothing else has to decode it again; one that could not be decoded gives that row alone.
    A predictor with ``segment_many`` and ``detect_many`` gets up to ``at_once`` images a call, others one.  ``profile`` asks for the
    resources of the stage's tasks, see :func:`predictors.gpu_profile`.
    """

    kind = to_arrow_schema(RESULTS)

    def answers(name: str, batch: list[np.ndarray]) -> list[list[Any]]:
        many = getattr(predictor, f"{name}_many", None)
        found = many(batch) if many else [getattr(predictor, name)(image) for image in batch]
        if len(found) != len(batch):
            raise ValueError(f"the model answered {len(found)} of {len(batch)} images")
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):  # as many decoded images are held
                rows: list[dict[str, Any]] = []
                origins, decoded = [], []
                for *head, width, channels, data, orientation in zip(*(c.to_pylist() for c in batch.slice(lo, at_once).columns), strict=True):
                    rows.append({**dict(zip(HEADS, head, strict=True)), "kind": "image"})
                    if head[-1] >= 1:
                        origins.append(head[0])
                        decoded.append(pixels_of(data, head[-1], width, channels, orientation))
                for origin, image, masks, boxes in zip(origins, decoded, answers("segment", decoded), answers("detect", decoded), strict=True):
                    for pos, m in enumerate(masks):
                        rows.append({"origin": origin, "kind": "mask", "pos": pos, "class_name": m.class_name, "confidence": float(m.confidence), **mask_features(image, m.pixels)})
                    for pos, b in enumerate(boxes):
                        rows.append({"origin": origin, "kind": "box", "pos": pos, "class_name": b.class_name, "confidence": float(b.confidence), "bbox_xyxy": [float(v) for v in b.bbox_xyxy]})
                yield pa.RecordBatch.from_pylist([{name: row.get(name) for name in kind.names} for row in rows], schema=kind)

    return images.select(*HEADS, "width", "channels", "data", "orientation").mapInArrow(run, RESULTS, profile=profile)


def name_errors(config: RunConfig, predictor: Predictor) -> list[str]:
    """What the models lack of the configured classes; nothing if the predictor does not tell its classes."""
    if not hasattr(predictor, "class_names"):
        return []
    masks, boxes = predictor.class_names()
    out = []
    if config.floc_class_name not in masks:
        out.append(f"the segmentation model has no class {config.floc_class_name!r} but {sorted(masks)}")
    if missing := sorted(set(config.classes) - boxes):
        out.append(f"the detection model has no classes {missing}")
    return out


class Analysis:
    """One configured analysis.  ``tables`` gives its results as DataFrames, ``run`` writes them as files."""

    def __init__(self, spark: SparkSession, config: RunConfig, predictor: Predictor | None = None, at_once: int = 8, profile: ResourceProfile | None = None):
        self.spark, self.config, self.at_once, self.profile = spark, config, at_once, profile
        self.predictor = predictor or self._from_models()

    def _from_models(self) -> ModelPredictor:
        self.config.check()
        names = {}
        for task in ("segmentation", "detection"):
            spec = getattr(self.config, task)
            known = read_categories(self.spark, spec.annotations).orderBy("label").collect() if spec.annotations else []
            names[task] = tuple(r["name"] for r in known)
        return ModelPredictor(self.config, names["segmentation"], names["detection"])

    def name_errors(self) -> list[str]:
        return name_errors(self.config, self.predictor)

    def tables(self, images: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
        """All result tables from images and the rows of :func:`predict`, whatever made them."""
        classes = list(self.config.classes)
        heads = images.select("origin", "image_id", "file_name", "captured_at")
        masks = results.where("kind = 'mask'").select("origin", (F.col("pos") + 1).cast("bigint").alias("annotation_id"), *FEATURES)
        masks = masks.join(heads.select("origin", "image_id"), "origin").select("origin", "image_id", "annotation_id", *FEATURES)
        boxes = results.where("kind = 'box'").select("origin", "pos", "class_name", "bbox_xyxy", "confidence")
        counts = aggregates.class_counts(boxes, heads, classes)
        by_path = path_parts(F.col("origin"))
        return {
            "floc_features": aggregates.instance_table(masks, heads).orderBy("sort_key").drop("sort_key"),
            "microorganism_counts": heads.select("origin", "image_id").join(counts, "origin").orderBy(by_path),
            "combined_analysis": aggregates.combined(heads, masks, counts, classes).orderBy(by_path),
            "microorganism_detections": aggregates.documents(boxes, heads).orderBy(by_path),
            "run_summary": aggregates.manifest(heads, masks, boxes),
        }

    def run(self, source: str | Path, output: str | Path) -> dict[str, Any]:
        """Analyse a file or folder and write the five result files, in any file system; returns the summary.

        No file is written if an image or a model fails.  What the models say is written to the shared folder once, so that a lost
        executor does not make them run again.
        """
        found, made = scan_images(self.spark, source), []
        target = address_of(output).rstrip("/")
        make_folder(self.spark, target)
        try:
            images = read_images(self.spark, source, found, made)
            results = Written(predict(images, self.predictor, self.at_once, self.profile), "results")  # a failing model fails here
            made.append(results.path)
            heads = results.rows.where("kind = 'image'").select(*HEADS)
            check_images(heads, found.count)
            tables = self.tables(heads, results.rows)
            write_csv(tables["floc_features"], f"{target}/{OUTPUTS[0]}", INSTANCE_COLUMNS)
            write_csv(tables["microorganism_counts"], f"{target}/{OUTPUTS[2]}", ("image_id", *self.config.classes))
            write_csv(tables["combined_analysis"], f"{target}/{OUTPUTS[3]}", (*COMBINED_KEYS, *self.config.classes))
            write_documents(tables["microorganism_detections"], f"{target}/{OUTPUTS[1]}")
            summary = {**tables["run_summary"].first().asDict(), "outputs": list(OUTPUTS)}
            write_json(self.spark, summary, f"{target}/{SUMMARY}")
            return summary
        finally:
            for path in made:
                delete(self.spark, path)


def analyze(spark: SparkSession, config: str | Path | RunConfig, source: str | Path, output: str | Path) -> dict[str, Any]:
    """Analyse a file or folder with the configured models.  Class names are not compared; see :meth:`Analysis.name_errors`."""
    config = config if isinstance(config, RunConfig) else read_config(config)
    return Analysis(spark, config).run(source, output)
