"""Rows of model output to instances: pairing by place, labels, filters, top-k, numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import same_name, strip
from ..sources.storage import Written


def pair_results(outputs: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays to rows with their place ``pos``; as many as the shortest array has."""
    n = F.least(*[F.size(a) for a in arrays])
    zipped = F.slice(F.arrays_zip(*[F.col(a) for a in arrays]), F.lit(1), F.greatest(n, F.lit(0)))
    rows = outputs.select(*keys, F.posexplode(zipped).alias("pos", "result"))
    return rows.select(*keys, "pos", *[F.col(f"result.{a}").alias(a) for a in arrays])


def rank_categories(categories: DataFrame) -> DataFrame:
    """``label, name`` of ``categories(id, name)``: names trimmed, labels counted from 1 in the order of id and name.

    The table of a model's classes is small by nature.  Ids under 1, blank names and repeated names are errors; repeated ids are not.
    """
    rows = categories.select(F.col("id").cast("bigint").alias("id"), strip(F.col("name").cast("string")).alias("name"))
    bad = rows.where("id is null or id < 1 or name is null or name = ''").limit(1).collect()
    if bad:
        raise ValueError(f"a category needs an id of at least 1 and a name: {bad[0].asDict()}")
    if twice := rows.groupBy("name").count().where("count > 1").limit(1).collect():
        raise ValueError(f"category name used twice: {twice[0]['name']}")
    if rows.isEmpty():
        raise ValueError("there are no categories")
    return category_labels(rows)


def category_labels(rows: DataFrame) -> DataFrame:
    """The rank of every category by id and name, from 1."""
    return rows.select(F.row_number().over(Window.orderBy("id", "name")).cast("bigint").alias("label"), "name")


def name_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Put ``class_name`` to ``results(label)``; a label that no category has is an error when the row is read."""
    names = labels.select(F.col("label").cast("bigint").alias("_label"), F.col("name").alias("_name"))
    joined = results.join(F.broadcast(names), F.col("label").cast("bigint") == F.col("_label"), "left")
    missing = F.raise_error(F.concat(F.lit("no category for label "), F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    return joined.withColumn("class_name", F.coalesce("_name", missing)).drop("_label", "_name")


def confident(results: DataFrame, threshold: float) -> DataFrame:
    """Rows whose confidence reaches the threshold."""
    return results.where(F.col("confidence") >= threshold)


def of_class(results: DataFrame, name: str) -> DataFrame:
    """Rows of a class, without regard to case."""
    return results.where(same_name(F.col("class_name"), F.lit(name)))


def first_results(results: DataFrame, keys: Sequence[str], k: int, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The first ``k`` rows of each key in model order; ``order`` must leave no ties."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return results.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def numbered(results: DataFrame, keys: Sequence[str], order: Sequence[str] = ("pos",)) -> DataFrame:
    """Add ``annotation_id``, counted from 1 in model order within each key."""
    return results.withColumn("annotation_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def row_numbers(rows: DataFrame, order: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """``rows`` with their place from 1 in an order, over all rows and without a task that sees them all.

    The rows are range-sorted; each task numbers its own, and one number a task, how many rows come before, is carried on.
    ``order`` must leave no ties.
    """
    placed = Written(rows.orderBy(*order).withColumn("_own", F.monotonically_increasing_id()), "ordered").rows  # the task in the upper bits
    task, own = F.shiftright("_own", 33).alias("_task"), F.col("_own").bitwiseAND(F.lit((1 << 33) - 1))
    before, bases = 0, []
    for row in sorted(placed.groupBy(task).count().collect()):
        bases.append((row["_task"], before))
        before += row["count"]
    table = rows.sparkSession.createDataFrame(bases, "_task long, _base long")  # one row a task
    return placed.withColumn("_task", task).join(F.broadcast(table), "_task").select(*rows.columns, (F.col("_base") + own + 1).alias(name))


def missing_classes(configured: DataFrame, offered: DataFrame, column: str = "class_name") -> DataFrame:
    """Configured names that the model does not offer; case matters."""
    return configured.select(column).subtract(offered.select(column))


