"""Command line: ``python -m maskmetrics.cli SOURCE --config config.yaml --output output``."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import override, read_config
from .plans.pipeline import Analysis


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="maskmetrics", description="Shape and colour of instances in microscope images, on Spark")
    parser.add_argument("source", nargs="?", help="an image, or a folder of images")
    parser.add_argument("--config", default="config.yaml", help="settings in YAML")
    parser.add_argument("--output", default="output", help="folder for the result files")
    parser.add_argument("--floc-model", help="other weights for segmentation")
    parser.add_argument("--microorganism-model", help="other weights for detection")
    parser.add_argument("--device", help="cpu, or the number of a GPU")
    parser.add_argument("--validate-models", action="store_true", help="only load the models and compare their classes with the settings")
    return parser


def host_zone() -> str:
    """The machine's UTC offset, for time stamps of files."""
    offset = time.strftime("%z")
    return f"{offset[:3]}:{offset[3:5]}" if offset else "UTC"


def main(given: Sequence[str] | None = None, spark: SparkSession | None = None, predictor=None) -> int:
    args = arguments().parse_args(given)
    config = override(read_config(args.config), args.floc_model, args.microorganism_model, args.device)
    spark = spark or SparkSession.builder.appName("maskmetrics").config("spark.sql.session.timeZone", host_zone()).getOrCreate()
    analysis = Analysis(spark, config, predictor)
    if errors := analysis.name_errors():
        raise SystemExit("\n".join(["The models do not fit the settings:", *errors]))
    if args.validate_models:
        print("The models can be read and know all configured classes.")
        return 0
    if args.source is None:
        raise SystemExit("a source is needed")
    print(json.dumps(analysis.run(args.source, args.output), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
