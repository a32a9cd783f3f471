"""Column names and row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The ten features and the leading columns of the instance table, in output order.
FEATURES = ("area_px", "compactness", "fractal_dimension", "mean_brightness", "std_brightness", "mean_r", "mean_g", "mean_b", "elongation", "area_fraction")
INSTANCE_KEYS = ("image_id", "annotation_id", "row_type", "floc_count")
INSTANCE_COLUMNS = (*INSTANCE_KEYS, *FEATURES)

# Columns of the combined table and the feature mean that each one shows.
COMBINED_MEANS = {
    "mean_floc_area_px": "area_px",
    "mean_floc_compactness": "compactness",
    "mean_floc_fractal_dimension": "fractal_dimension",
    "mean_floc_brightness": "mean_brightness",
}
COMBINED_KEYS = ("image_id", "captured_at", "floc_count", *COMBINED_MEANS)
#: Columns that a configured class may not be called.
RESERVED = {"image_id", "file_name", "origin", "captured_at", "floc_count", *COMBINED_MEANS}

#: What is kept of one image besides results.
HEADS = ("origin", "image_id", "file_name", "captured_at", "height")
#: What a predictor says of one image, one row per result: ``kind`` is ``mask`` or ``box``, ``pos`` counts from 0 within the kind; and one row ``image`` with what is known of the file.
RESULTS = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in HEADS[:-1]),
        T.StructField(HEADS[-1], T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox_xyxy", T.ArrayType(T.DoubleType())),
        *(T.StructField(c, T.DoubleType()) for c in FEATURES),
    ]
)
