"""Per-image and per-run results from instances and detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite, path_parts
from ..schemas import COMBINED_MEANS, FEATURES, INSTANCE_COLUMNS


def statistic_rows(instances: DataFrame, images: DataFrame, values: Sequence[str] = FEATURES, key: str = "image_id") -> DataFrame:
    """One mean and one median row per image id, with the number of its instances; images without instances have 0 and nulls.

    Null, NaN and infinite values count as missing.  One aggregation computes both; each image's two rows are made from its one.
    """
    ids = images.select(key).distinct()
    clean = instances.select(key, *[finite(F.col(v)).alias(v) for v in values])
    both = [f(v).alias(f"{name}_{v}") for name, f in (("mean", F.avg), ("median", F.median)) for v in values]
    found = clean.groupBy(key).agg(F.count("*").alias("floc_count"), *both)
    rows = ids.join(found, key, "left")
    kinds = F.array(*[F.struct(F.lit(name).alias("row_type"), *[F.col(f"{name}_{v}").alias(v) for v in values]) for name in ("mean", "median")])
    spread = rows.select(key, F.coalesce("floc_count", F.lit(0)).cast("bigint").alias("floc_count"), F.explode(kinds).alias("row"))
    return spread.select(key, "row.row_type", "floc_count", *[f"row.{v}" for v in values])


def instance_table(instances: DataFrame, images: DataFrame) -> DataFrame:
    """The instance rows followed by the mean and median rows, with an explicit order.

    ``instances(origin, image_id, annotation_id, <features>)``, ``images(origin, image_id)``.  ``sort_key`` orders the rows: instances by the names along their image's path and
    number, then the ids in the order of their first image, mean before median.
    """
    parts = path_parts(F.col("origin"))
    rank = images.groupBy("image_id").agg(F.min(parts).alias("rank"))
    own = instances.select(
        "image_id", F.col("annotation_id").cast("bigint").alias("annotation_id"), F.lit("instance").alias("row_type"), F.lit(1).cast("bigint").alias("floc_count"), *FEATURES,
        F.struct(F.lit(0).alias("block"), parts.alias("rank"), F.col("annotation_id").cast("bigint").alias("number")).alias("sort_key"),
    )
    stats = statistic_rows(instances, images).join(rank, "image_id").select(
        "image_id", F.lit(None).cast("bigint").alias("annotation_id"), "row_type", "floc_count", *FEATURES,
        F.struct(F.lit(1).alias("block"), F.col("rank"), F.when(F.col("row_type") == "mean", 0).otherwise(1).cast("bigint").alias("number")).alias("sort_key"),
    )
    return own.unionByName(stats).select(*INSTANCE_COLUMNS, "sort_key")


def class_counts(detections: DataFrame, images: DataFrame, classes: Sequence[str], key: str = "origin") -> DataFrame:
    """One row per image with a count for each configured class, 0 where there is none; other classes are not counted."""
    counted = detections.where(F.col("class_name").isin(list(classes))) if classes else detections.limit(0)
    found = counted.groupBy(key).agg(F.lit(1).alias("_any"), *[F.count_if(F.col("class_name") == c).alias(c) for c in classes])
    zeros = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(c) for c in classes]
    return images.select(key).join(found, key, "left").select(key, *zeros)


def combined(images: DataFrame, instances: DataFrame, counts: DataFrame, classes: Sequence[str], means: dict[str, str] = COMBINED_MEANS, key: str = "origin") -> DataFrame:
    """One row per image: the number of its instances, means of some features (null without instances) and its class counts."""
    stats = instances.groupBy(key).agg(F.count("*").alias("floc_count"), *[F.avg(finite(F.col(v))).alias(name) for name, v in means.items()])
    joined = images.join(stats, key, "left").join(counts, key, "left")
    kept = [c for c in images.columns]
    return joined.select(*kept, F.coalesce("floc_count", F.lit(0)).cast("bigint").alias("floc_count"), *means, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(c) for c in classes])


def documents(detections: DataFrame, images: DataFrame, key: str = "origin") -> DataFrame:
    """All detections of an image, also of classes that are not counted, as one array in model order; empty where there are none."""
    item = F.struct("pos", F.col("class_name").alias("class"), "bbox_xyxy", "confidence")
    found = detections.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("objects"))
    joined = images.join(found, key, "left")
    return joined.withColumn("objects", F.transform(F.coalesce("objects", F.array().cast(found.schema["objects"].dataType)), lambda o: o.dropFields("pos")))


def manifest(images: DataFrame, instances: DataFrame, detections: DataFrame) -> DataFrame:
    """One row of totals; every detection counts, whatever its class."""
    parts = [df.agg(F.count("*").cast("bigint").alias(name)) for df, name in ((images, "images_processed"), (instances, "flocs_detected"), (detections, "microorganisms_detected"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
