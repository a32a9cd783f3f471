"""Result files under exact names, and tables as folders.

The form of the exact files (one file, byte-order mark, line ends) is part of the result.  Executors make their lines and write them
as ordered parts, which the driver joins byte by byte; they go to any file system.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .hadoop import address_of, write_joined


def cell(value: Any) -> Any:
    """A value for a CSV cell: nothing for null and for numbers that are not finite."""
    return "" if value is None or isinstance(value, float) and not math.isfinite(value) else value


def csv_line(values: Iterable[Any]) -> str:
    line = io.StringIO()
    csv.writer(line, lineterminator="").writerow([cell(v) for v in values])
    return line.getvalue()


def _texts(rows: DataFrame, show: Callable[[dict[str, Any]], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([show(row) for row in batch.to_pylist()], pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_csv(rows: DataFrame, path: str | Path, columns: Sequence[str]) -> None:
    """UTF-8 with a byte-order mark, a header, CR LF; rows in the order of the table, other columns left out."""
    names = list(columns)
    lines = _texts(rows.select(*[f"`{c}`" for c in names]), lambda row: csv_line(row[c] for c in names))
    write_joined(lines, address_of(path), codecs.BOM_UTF8 + f"{csv_line(names)}\r\n".encode(), "\r\n")


def write_json(spark: SparkSession, value: Any, path: str | Path) -> None:
    text = json.dumps(value, ensure_ascii=False, indent=2)
    write_joined(spark.createDataFrame([], "value string"), address_of(path), text.encode())


def write_documents(rows: DataFrame, path: str | Path) -> None:
    """Detection documents as one JSON array in the order of the table, indented by 2."""

    def show(row: dict[str, Any]) -> str:
        return "\n".join("  " + line for line in json.dumps(detection_item(row), ensure_ascii=False, indent=2).split("\n"))

    if rows.isEmpty():
        write_json(rows.sparkSession, [], path)
    else:
        write_joined(_texts(rows.select("image_id", "file_name", "objects"), show), address_of(path), b"[\n", ",\n", b"\n]", between=True)


def detection_item(row: Any) -> dict[str, Any]:
    """A detection document as a JSON value; boxes to 2 and confidences to 6 digits."""
    objects = [{"class": o["class"], "bbox_xyxy": [round(v, 2) for v in o["bbox_xyxy"]], "confidence": round(o["confidence"], 6)} for o in row["objects"]]
    return {"image_id": row["image_id"], "file_name": row["file_name"], "objects": objects}


def write_table(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A table as a folder of Parquet files, in any file system."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
