"""Registered queries over the test tables, each with its DuckDB SQL.

The test tables hold no images, so pixel rows, detections and boxes are derived from them: pixels from ``lineitem`` (32 by 24 frame, colours from its
numbers), detections from ``events`` (a user is an image, an event type a class), instances from ``lineitem``.  Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import compactness, folded, path_parts
from ..operators import aggregates, evaluate, runs, selection, shape
from ..schemas import FEATURES

KEYS = ["image_id", "ann"]
HEIGHT, WIDTH = 24, 32
#: Counted classes of the derived detections; one of them never occurs.
CLASSES = ["click", "purchase", "never"]
_FRAME = HEIGHT * WIDTH
#: Folder names of which the escaped forms have another order.
_FOLDERS = ["a b", "a!b", "a%b", "aéb", "a+b", "a"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, never -0; to 11 first, so that a value half-way does not depend on the order of a sum."""
    return df.select(*[(F.round(F.round(F.col(f"`{c}`"), 11), 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured pixel rows: of several values for one pixel the largest counts."""
    rows = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("image_id"),
        (F.col("l_linenumber") % 4).cast("bigint").alias("ann"),
        (F.col("l_partkey") % WIDTH).alias("x"),
        (F.col("l_suppkey") % HEIGHT).alias("y"),
        F.floor(F.col("l_quantity") * 5).alias("b"),
        (F.col("l_linenumber") * 30).cast("bigint").alias("g"),
        F.floor(F.col("l_tax") * 1000 + 0.5).alias("r"),
    )
    return rows.groupBy(*KEYS, "x", "y").agg(*[F.max(c).alias(c) for c in ("b", "g", "r")])


_PX = f"""px AS (
  SELECT l_orderkey % 50 AS image_id, CAST(l_linenumber % 4 AS BIGINT) AS ann, l_partkey % {WIDTH} AS x, l_suppkey % {HEIGHT} AS y,
    CAST(max(floor(l_quantity * 5)) AS BIGINT) AS b, CAST(max(l_linenumber * 30) AS BIGINT) AS g, CAST(max(floor(l_tax * 1000 + 0.5)) AS BIGINT) AS r
  FROM lineitem GROUP BY ALL
)"""
_BOX = """box AS (
  SELECT image_id, ann, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px GROUP BY ALL
)"""
_PERIMETER = """corner AS (
  SELECT image_id, ann, x + dx AS cx, y + dy AS cy, sum(code) AS code
  FROM px, (VALUES (0, 0, 8), (1, 0, 4), (0, 1, 2), (1, 1, 1)) AS v(dx, dy, code) GROUP BY ALL
), per AS (
  SELECT image_id, ann, sum(CASE WHEN code IN (3, 5, 10, 12) THEN 1.0::DOUBLE WHEN code IN (7, 11, 13, 14) THEN sqrt(2) WHEN code IN (6, 9) THEN 2 * sqrt(2) ELSE 0.0 END) AS perimeter
  FROM corner GROUP BY ALL
)"""
_DIMENSION = """cells AS (
  SELECT DISTINCT p.image_id, p.ann, s.scale, (p.x - b.x0) // s.scale AS bx, (p.y - b.y0) // s.scale AS by_
  FROM px p JOIN box b USING (image_id, ann), (VALUES (1), (2), (4), (8), (16), (32)) AS s(scale)
  WHERE b.area >= 8 AND s.scale <= least(b.w, b.h)
), counts AS (
  SELECT image_id, ann, scale, count(*) AS n FROM cells GROUP BY ALL HAVING count(*) >= 2
), fit AS (
  SELECT image_id, ann, CASE WHEN count(*) >= 3 THEN greatest(0.0, least(2.0, regr_slope(ln(n), -ln(scale)))) END AS fractal_dimension FROM counts GROUP BY ALL
)"""
_COLOUR = """gray AS (
  SELECT *, (b * 3735 + g * 19235 + r * 9798 + 16384) // 32768 AS level FROM px
), colour AS (
  SELECT image_id, ann, avg(level) AS mean_brightness, stddev_pop(level) AS std_brightness, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b FROM gray GROUP BY ALL
)"""
_FEATURES = f"""feat AS (
  SELECT b.image_id, b.ann, CAST(b.area AS DOUBLE) AS area_px, CASE WHEN p.perimeter > 0 THEN least(1.0, 4 * pi() * b.area / (p.perimeter * p.perimeter)) END AS compactness, f.fractal_dimension,
    c.mean_brightness, c.std_brightness, c.mean_r, c.mean_g, c.mean_b, b.w / b.h AS elongation, b.area / {_FRAME}.0::DOUBLE AS area_fraction
  FROM box b JOIN per p USING (image_id, ann) LEFT JOIN fit f USING (image_id, ann) JOIN colour c USING (image_id, ann)
)"""
_ALL = ", ".join([_PX, _BOX, _PERIMETER, _DIMENSION, _COLOUR, _FEATURES])


def _r(*names: str) -> str:
    return ", ".join(f"round(round({n}, 11), 6) + 0.0 AS {n}" for n in names)


def mask_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.shape(pixels(spark, sf_dir), KEYS, HEIGHT, WIDTH))


def mask_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.perimeter(pixels(spark, sf_dir), KEYS))


def mask_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.mask_compactness(pixels(spark, sf_dir), KEYS))


def mask_fractal_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.box_dimension(pixels(spark, sf_dir), KEYS))


def colour_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.colour(pixels(spark, sf_dir), KEYS))


def mask_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.features(pixels(spark, sf_dir), KEYS, HEIGHT, WIDTH))


def run_mask_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features from runs; each mask is an image of its own here, black where it has no pixels."""
    own = pixels(spark, sf_dir).withColumn("mask", F.col("image_id") * 4 + F.col("ann"))
    frame = own.select("mask").distinct().select("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))).alias("x"))
    frame = frame.select("mask", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HEIGHT - 1).cast("long"))).alias("y"))
    image = frame.join(own.select("mask", "x", "y", "b", "g", "r"), ["mask", "x", "y"], "left").na.fill(0, ["b", "g", "r"])
    found = runs.features(runs.runs_of_pixels(own, ["mask"]), runs.column_sums(image, "mask"), ["mask"], HEIGHT, WIDTH)
    return _rounded(found.select(F.floor(F.col("mask") / 4).alias("image_id"), (F.col("mask") % 4).alias("ann"), *FEATURES))


def run_mask_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each mask without its image's next one, by run-length codes there and back."""
    own = runs.runs_of_pixels(pixels(spark, sf_dir), KEYS)
    coded = runs.counts_of_runs(own, KEYS, HEIGHT, WIDTH)
    back = runs.runs_of_counts(coded, KEYS)
    rest = runs.combine(back, back.withColumn("ann", (F.col("ann") + 1) % 4), KEYS, "minus")
    return coded.select(*KEYS, F.size("counts").cast("bigint").alias("n_counts")).join(runs.extent(rest, KEYS), KEYS, "left").select(*KEYS, "n_counts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("area", "w", "h")])


def mean_median_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median rows of all ten features; two further images have no masks."""
    feats = shape.features(pixels(spark, sf_dir), KEYS, HEIGHT, WIDTH)
    images = feats.select("image_id").unionByName(spark.range(50, 52).select(F.col("id").alias("image_id")))
    return _rounded(aggregates.statistic_rows(feats, images))


def floc_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instance table with its row numbers; two files share each image id."""
    feats = shape.features(pixels(spark, sf_dir), KEYS, HEIGHT, WIDTH)
    origin = F.format_string("f/%03d.bmp", F.col("image_id"))
    own = feats.select(origin.alias("origin"), (F.col("image_id") % 25).cast("string").alias("image_id"), (F.col("ann") + 1).alias("annotation_id"), *FEATURES)
    images = spark.range(52).select(F.format_string("f/%03d.bmp", F.col("id")).alias("origin"), (F.col("id") % 25).cast("string").alias("image_id"))
    table = aggregates.instance_table(own, images)
    key = F.col("sort_key")
    return _rounded(table.select("image_id", F.coalesce(F.col("annotation_id").cast("string"), F.lit("")).alias("annotation_id"), "row_type", "floc_count", *FEATURES, key["block"].cast("bigint").alias("block"), key["rank"][1].alias("first_file"), key["number"].alias("number")))


_FILES = """files AS (SELECT 'f/' || lpad(CAST(i AS VARCHAR), 3, '0') || '.bmp' AS origin, CAST(i % 25 AS VARCHAR) AS image_id FROM range(52) t(i))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("origin"), F.col("event_id").alias("pos"), F.col("event_type").alias("class_name"), F.round(F.col("value"), 4).alias("confidence"), F.array(F.col("value")).alias("bbox_xyxy"))


def class_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections(spark, sf_dir)
    return aggregates.class_counts(found, found.select("origin").distinct(), CLASSES)


def topk_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.of_class(selection.confident(detections(spark, sf_dir), 0.5), "PURCHASE")
    return selection.first_results(rows, ["origin"], 3).select("origin", "pos", "class_name", "confidence")


def topk_before_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.first_results(detections(spark, sf_dir), ["origin"], 3)
    return selection.of_class(selection.confident(rows, 0.5), "PURCHASE").select("origin", "pos", "class_name", "confidence")


def instance_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.numbered(detections(spark, sf_dir), ["origin"]).select("origin", "pos", "annotation_id")


def paired_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of each order's lines; one is shorter by a line."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("label"), F.array_sort(F.collect_list("l_quantity")).alias("score"))
    short = lines.withColumn("score", F.slice("score", F.lit(1), F.greatest(F.size("score") - 1, F.lit(0))))
    return selection.pair_results(short, ["l_orderkey"], ["label", "score"]).withColumn("pos", F.col("pos").cast("bigint"))


def category_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3 + 2).alias("id"), F.concat(F.lit(" "), "n_name", F.lit("\t")).alias("name"))
    return selection.rank_categories(rows)


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("label"))
    return selection.name_labels(results, category_rank(spark, sf_dir)).select("c_custkey", F.col("label").cast("bigint").alias("label"), "class_name")


def folded_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers joined to names that differ from theirs in case, also where one letter folds to two."""
    name = F.concat("c_mktsegment", F.lit(" straße "), (F.col("c_custkey") % 50).cast("string"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", folded(name).alias("name"))
    offered = _table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" STRASSE "), (F.col("c_custkey") % 40).cast("string")).alias("offered")).distinct()
    return rows.join(offered, F.col("name") == folded(F.col("offered"))).select("c_custkey", "offered")


def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every file in the order of real names; addresses escape them."""
    names = F.array(*[F.lit(n) for n in _FOLDERS])
    folder = F.element_at(names, (F.col("c_custkey") % len(_FOLDERS)).cast("int") + 1)
    escaped = lambda part: F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    origin = F.concat(F.lit("file:/data/"), F.when(F.col("c_custkey") % 7 != 0, F.concat(escaped(folder), F.lit("/"))).otherwise(F.lit("")), escaped(F.replace("c_name", F.lit("#"), F.lit(" "))))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", origin.alias("origin"))
    return selection.row_numbers(rows, [path_parts(F.col("origin"))]).select("c_custkey", F.col("row_number"))


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(c,) for c in [*CLASSES, "Click"]], "class_name string")
    return selection.missing_classes(wanted, detections(spark, sf_dir))


def left_join_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined table: customers as images, their dear orders as instances, so that many have none."""
    images = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("origin"), F.col("c_name").alias("image_id"))
    orders = _table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("origin"), F.col("o_totalprice").alias("area_px"))
    counts = aggregates.class_counts(detections(spark, sf_dir).withColumn("origin", F.col("origin")), images, CLASSES)
    return _rounded(aggregates.combined(images, orders, counts, CLASSES, {"mean_floc_area_px": "area_px"}))


def detection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's detections as one array, shown as text; the first 50 images have none."""
    found = detections(spark, sf_dir).where("origin >= 50")
    docs = aggregates.documents(found, detections(spark, sf_dir).select("origin").distinct())
    shown = F.array_join(F.transform("objects", lambda o: F.concat(o["class"], F.lit("@"), F.round(o["confidence"] * 10000).cast("bigint").cast("string"))), ";")
    return docs.select("origin", F.size("objects").cast("bigint").alias("n"), shown.alias("objects"))


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = pixels(spark, sf_dir).select(*KEYS).distinct()
    return aggregates.manifest(_table(spark, sf_dir, "customer"), masks, detections(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Boxes of every second line; an image holds the lines of 80 orders, so images get more with the data and not fuller."""
    rows = _table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") % 2) == parity)
    ids = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    x, y = (F.col("p") % 40).cast("double"), (F.col("s") % 30).cast("double")
    return ids.select(F.floor(F.col("l_orderkey") / 80).alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x1"), y.alias("y1"), (x + 5 + F.col("q") % 20).alias("x2"), (y + 5 + F.col("q") % 15).alias("y2"))


def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.match_boxes(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 1)))


def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.match_boxes_once(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 1)))


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all lines with a confidence that has ties; two classes."""
    rows = _boxes(spark, sf_dir, 0).unionByName(_boxes(spark, sf_dir, 1))
    rows = rows.withColumn("class_name", F.when(F.col("id") % 3 == 0, "a").otherwise("b")).withColumn("confidence", (F.col("id") % 17) / 17)
    return evaluate.kept_boxes(rows, 0.4).select("image_id", "class_name", "id")


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Masks, and the same without part of their pixels and moved to the right in every other image."""
    own = pixels(spark, sf_dir).withColumn("id", F.col("ann"))
    return own, own.where("g < 180").withColumn("x", F.col("x") + F.col("image_id") % 2 * (F.col("ann") % 2))


def mask_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.match_masks(*_masks(spark, sf_dir), threshold=0.3))


def mask_one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.match_masks_once(*_masks(spark, sf_dir), threshold=0.1))


def run_mask_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks brought to another size, larger down the rows and smaller across."""
    own = runs.runs_of_pixels(pixels(spark, sf_dir), KEYS)
    return runs.extent(runs.resized(own, KEYS, (HEIGHT, WIDTH), (37, 20)), KEYS)


def run_mask_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [runs.runs_of_pixels(m, ["image_id", "id"]) for m in _masks(spark, sf_dir)]
    return _rounded(evaluate.mutual_best(runs.run_pairs(*own, threshold=0.3), "image_id"))


def mask_pixel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pixels(spark, sf_dir)
    image = own.where("x < 30").groupBy("image_id", "x", "y").agg(*[F.max(c).alias(c) for c in ("b", "g", "r")])
    joined = shape.masked_pixels(image, own, KEYS)
    return _rounded(joined.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("b", "g", "r")]))


def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, predicted = _boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 1)
    return _rounded(evaluate.scores(reference, predicted, evaluate.match_boxes(reference, predicted)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("reference"), (F.col("l_extendedprice") * (1 - F.col("l_discount") * 3)).alias("predicted"))
    return evaluate.errors(rows)


def error_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).selectExpr("l_returnflag", "stack(3, 'absolute_error', absolute_error, 'relative_error_pct', relative_error_pct, 'signed_error', signed_error) as (error, value)")
    df = evaluate.statistics(rows, "value", ["l_returnflag", "error"])
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in df.dtypes])


def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_histogram(_pairs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mask_shape, mask_perimeter, mask_compactness, mask_fractal_dimension, colour_brightness, mask_features, run_mask_features, run_mask_codes, run_mask_resize, run_mask_match, mean_median_rows, floc_table_order, class_counts_pivot,
        topk_after_filter, topk_before_filter, instance_number, paired_results, category_rank, label_lookup, folded_name_join, path_order, missing_classes, left_join_coalesce, detection_documents,
        run_manifest, iou_match, one_to_one_match, box_suppression, mask_iou_match, mask_one_to_one_match, mask_pixel_join, precision_recall_f1, error_statistics, error_histogram,
    )
}

_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') AS BIGINT) AS {c}" for c in CLASSES)
_STATS = ", ".join(f"round(round(CASE WHEN s.kind = 'mean' THEN avg({c}) ELSE median({c}) END, 11), 6) + 0.0 AS {c}" for c in FEATURES)


def _box_sql(parity: int) -> str:
    return f"""SELECT l_orderkey // 80 AS image_id, l_orderkey * 10 + l_linenumber AS id, x AS x1, y AS y1, x + 5 + q % 20 AS x2, y + 5 + q % 15 AS y2 FROM (
    SELECT l_orderkey, l_linenumber, CAST(max(l_partkey) % 40 AS DOUBLE) AS x, CAST(max(l_suppkey) % 30 AS DOUBLE) AS y, max(l_quantity) AS q
    FROM lineitem WHERE l_linenumber % 2 = {parity} GROUP BY ALL)"""


_MATCH = f"""ref AS ({_box_sql(0)}), pred AS ({_box_sql(1)}), pairs AS (
  SELECT r.image_id, r.id AS ref_id, p.id AS pred_id, (r.x2 - r.x1) * (r.y2 - r.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS both_areas,
    greatest(least(r.x2, p.x2) - greatest(r.x1, p.x1), 0) * greatest(least(r.y2, p.y2) - greatest(r.y1, p.y1), 0) AS common
  FROM ref r JOIN pred p USING (image_id)
), scored AS (SELECT image_id, ref_id, pred_id, common / (both_areas - common) AS iou FROM pairs WHERE common > 0 AND common / (both_areas - common) >= 0.5
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, ref_id ORDER BY iou DESC, pred_id) AS a, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, ref_id) AS b FROM scored
), matched AS (SELECT image_id, ref_id, pred_id, iou FROM ranked WHERE a = 1 AND b = 1)"""
_MASKS = f"""{_PX}, pred AS (SELECT image_id, ann, x + image_id % 2 * (ann % 2) AS x, y FROM px WHERE g < 180),
sizes AS (SELECT image_id, ann, count(*) AS n FROM px GROUP BY ALL), psizes AS (SELECT image_id, ann, count(*) AS n FROM pred GROUP BY ALL),
common AS (SELECT r.image_id, r.ann AS ref_id, p.ann AS pred_id, count(*) AS n FROM px r JOIN pred p USING (image_id, x, y) GROUP BY ALL),
over AS (SELECT c.image_id, ref_id, pred_id, c.n / (s.n + q.n - c.n) AS iou FROM common c JOIN sizes s ON s.image_id = c.image_id AND s.ann = ref_id JOIN psizes q ON q.image_id = c.image_id AND q.ann = pred_id)"""


def _greedy(scored: str) -> str:
    """Pairs by descending overlap, each instance once: rounds over ``scored(image_id, ref_id, pred_id, iou)``."""
    ranks = "row_number() OVER (PARTITION BY image_id, ref_id ORDER BY iou DESC, pred_id) AS a, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, ref_id) AS b"
    return f"""g AS (
  SELECT image_id, ref_id, pred_id, iou, {ranks} FROM {scored}
  UNION ALL
  SELECT image_id, ref_id, pred_id, iou, {ranks} FROM (
    SELECT *, max(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, ref_id) AS r_out, max(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, pred_id) AS p_out FROM g
  ) WHERE r_out = 0 AND p_out = 0
) SELECT image_id, ref_id, pred_id, round(round(iou, 11), 6) + 0.0 AS iou FROM g WHERE a = 1 AND b = 1"""


_PAIRS = """pairs AS (
  SELECT l_returnflag, abs(p - r) AS absolute_error, 100 * abs(p - r) / nullif(abs(r), 0) AS relative_error_pct, p - r AS signed_error
  FROM (SELECT l_returnflag, l_extendedprice AS r, l_extendedprice * (1 - l_discount * 3) AS p FROM lineitem)
)"""


def _stat_sql(c: str) -> str:
    cuts = ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {n}" for n, p in evaluate.PERCENTILES.items())
    return f"""SELECT l_returnflag, '{c}' AS error, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, {cuts},
    round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM pairs GROUP BY l_returnflag"""


_EDGES = ", ".join(f"({k}, {float(lo)}, {float(hi) if hi is not None else 'CAST(NULL AS DOUBLE)'})" for k, (lo, hi) in enumerate(zip(evaluate.ERROR_EDGES, [*evaluate.ERROR_EDGES[1:], None], strict=True)))
_DET = "det AS (SELECT user_id AS origin, event_id AS pos, event_type AS class_name, round(value, 4) AS confidence FROM events)"

ORACLE_SQL: dict[str, str] = {
    "mask_shape": f"WITH {_PX}, {_BOX} SELECT image_id, ann, CAST(area AS DOUBLE) AS area_px, w, h, round(w / h, 6) AS elongation, round(area / {_FRAME}.0::DOUBLE, 6) AS area_fraction FROM box",
    "mask_perimeter": f"WITH {_PX}, {_PERIMETER} SELECT image_id, ann, {_r('perimeter')} FROM per",
    "mask_compactness": f"WITH {_ALL} SELECT image_id, ann, {_r('compactness')} FROM feat",
    "mask_fractal_dimension": f"WITH {_ALL} SELECT image_id, ann, {_r('fractal_dimension')} FROM feat",
    "colour_brightness": f"WITH {_PX}, {_COLOUR} SELECT image_id, ann, {_r('mean_brightness', 'std_brightness', 'mean_r', 'mean_g', 'mean_b')} FROM colour",
    "mask_features": f"WITH {_ALL} SELECT image_id, ann, {_r(*FEATURES)} FROM feat",
    "run_mask_features": f"WITH {_ALL} SELECT image_id, ann, {_r(*FEATURES)} FROM feat",
    "run_mask_codes": f"""WITH {_PX}, frame AS (
  SELECT m.image_id, m.ann, i, p.x IS NOT NULL AS here FROM (SELECT DISTINCT image_id, ann FROM px) m CROSS JOIN range({_FRAME}) t(i)
  LEFT JOIN px p ON p.image_id = m.image_id AND p.ann = m.ann AND p.x * {HEIGHT} + p.y = i
), turns AS (
  SELECT image_id, ann, count(*) FILTER (WHERE here <> before) + 1 AS n_counts FROM (SELECT *, coalesce(lag(here) OVER (PARTITION BY image_id, ann ORDER BY i), false) AS before FROM frame) GROUP BY ALL
), rest AS (
  SELECT p.image_id, p.ann, count(*) AS area, max(p.x) - min(p.x) + 1 AS w, max(p.y) - min(p.y) + 1 AS h FROM px p
  WHERE NOT EXISTS (SELECT 1 FROM px o WHERE o.image_id = p.image_id AND (o.ann + 1) % 4 = p.ann AND o.x = p.x AND o.y = p.y) GROUP BY ALL
) SELECT t.image_id, t.ann, n_counts, coalesce(area, 0) AS area, coalesce(w, 0) AS w, coalesce(h, 0) AS h FROM turns t LEFT JOIN rest r ON r.image_id = t.image_id AND r.ann = t.ann""",
    "mean_median_rows": f"""WITH {_ALL}, images AS (SELECT DISTINCT image_id FROM feat UNION SELECT i FROM range(50, 52) t(i))
SELECT i.image_id, s.kind AS row_type, count(f.ann) AS floc_count, {_STATS}
FROM images i CROSS JOIN (VALUES ('mean'), ('median')) AS s(kind) LEFT JOIN feat f ON f.image_id = i.image_id GROUP BY i.image_id, s.kind""",
    "floc_table_order": f"""WITH {_ALL}, {_FILES}, own AS (
  SELECT 'f/' || lpad(CAST(image_id AS VARCHAR), 3, '0') || '.bmp' AS origin, CAST(image_id % 25 AS VARCHAR) AS id, ann + 1 AS annotation_id, {', '.join(FEATURES)} FROM feat
), firsts AS (SELECT image_id, min(origin) AS first_file FROM files GROUP BY image_id)
SELECT id AS image_id, CAST(annotation_id AS VARCHAR) AS annotation_id, 'instance' AS row_type, CAST(1 AS BIGINT) AS floc_count, {_r(*FEATURES)}, CAST(0 AS BIGINT) AS block, split_part(origin, '/', 2) AS first_file, annotation_id AS number FROM own
UNION ALL
SELECT i.image_id, '', s.kind, count(f.id), {_STATS}, CAST(1 AS BIGINT), split_part(i.first_file, '/', 2), CAST(CASE s.kind WHEN 'mean' THEN 0 ELSE 1 END AS BIGINT)
FROM firsts i CROSS JOIN (VALUES ('mean'), ('median')) AS s(kind) LEFT JOIN own f ON f.id = i.image_id GROUP BY i.image_id, i.first_file, s.kind""",
    "class_counts_pivot": f"SELECT user_id AS origin, {_COUNTS} FROM events GROUP BY user_id",
    "topk_after_filter": f"WITH {_DET} SELECT origin, pos, class_name, confidence FROM det WHERE confidence >= 0.5 AND lower(class_name) = 'purchase' QUALIFY row_number() OVER (PARTITION BY origin ORDER BY pos) <= 3",
    "topk_before_filter": f"WITH {_DET}, top AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY origin ORDER BY pos) <= 3) SELECT origin, pos, class_name, confidence FROM top WHERE confidence >= 0.5 AND lower(class_name) = 'purchase'",
    "instance_number": "SELECT user_id AS origin, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS annotation_id FROM events",
    "paired_results": """WITH a AS (SELECT l_orderkey, l_partkey AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
b AS (SELECT l_orderkey, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS pos FROM lineitem)
SELECT l_orderkey, pos, label, score FROM a JOIN b USING (l_orderkey, pos) WHERE pos < n - 1""",
    "category_rank": "SELECT row_number() OVER (ORDER BY n_nationkey, n_name) AS label, n_name AS name FROM nation",
    "label_lookup": "SELECT c_custkey, CAST(c_nationkey + 1 AS BIGINT) AS label, n.name AS class_name FROM customer JOIN (SELECT row_number() OVER (ORDER BY n_nationkey, n_name) AS label, n_name AS name FROM nation) n ON n.label = c_nationkey + 1",
    "folded_name_join": """WITH offered AS (SELECT DISTINCT lower(c_mktsegment) || ' STRASSE ' || (c_custkey % 40) AS offered FROM customer)
SELECT c_custkey, offered FROM customer JOIN offered ON lower(c_mktsegment) || ' strasse ' || (c_custkey % 50) = lower(offered)""",
    "path_order": f"""WITH names AS (
  SELECT c_custkey, replace(c_name, '#', ' ') AS name, ({_FOLDERS!r})[CAST(c_custkey % {len(_FOLDERS)} AS INTEGER) + 1] AS folder FROM customer
) SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN [folder, name] ELSE [name] END) AS row_number FROM names""",
    "missing_classes": "SELECT * FROM (VALUES ('click'), ('purchase'), ('never'), ('Click')) AS v(class_name) EXCEPT SELECT event_type FROM events",
    "left_join_coalesce": f"""SELECT c_custkey AS origin, c_name AS image_id, coalesce(o.n, 0) AS floc_count, round(round(o.m, 11), 6) + 0.0 AS mean_floc_area_px, {', '.join(f'coalesce(e.{c}, 0) AS {c}' for c in CLASSES)}
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders WHERE o_totalprice > 250000 GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, {_COUNTS} FROM events GROUP BY 1) e ON e.user_id = c_custkey""",
    "detection_documents": f"""WITH {_DET}, shown AS (SELECT origin, pos, class_name || '@' || CAST(CAST(round(confidence * 10000) AS BIGINT) AS VARCHAR) AS t FROM det WHERE origin >= 50)
SELECT d.origin, count(s.t) AS n, coalesce(string_agg(s.t, ';' ORDER BY s.pos), '') AS objects FROM (SELECT DISTINCT origin FROM det) d LEFT JOIN shown s USING (origin) GROUP BY d.origin""",
    "run_manifest": f"WITH {_PX} SELECT (SELECT count(*) FROM customer) AS images_processed, (SELECT count(*) FROM (SELECT DISTINCT image_id, ann FROM px)) AS flocs_detected, (SELECT count(*) FROM events) AS microorganisms_detected",
    "iou_match": f"WITH {_MATCH} SELECT image_id, ref_id, pred_id, round(round(iou, 11), 6) + 0.0 AS iou FROM matched",
    "one_to_one_match": f"WITH RECURSIVE {_MATCH}, {_greedy('scored')}",
    "box_suppression": f"""WITH RECURSIVE boxes AS (
  SELECT *, CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS class_name, -(id % 17) AS low FROM ({_box_sql(0)} UNION ALL {_box_sql(1)})
), meet AS (
  SELECT a.image_id, a.class_name, a.id AS better, b.id AS worse, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS both_areas,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS common
  FROM boxes a JOIN boxes b USING (image_id, class_name) WHERE (a.low, a.id) < (b.low, b.id)
), over AS (
  SELECT better, worse FROM meet WHERE common > 0 AND common / (both_areas - common) > 0.4
), g AS (
  SELECT better, worse, better NOT IN (SELECT worse FROM over) AS first FROM over
  UNION ALL
  SELECT better, worse, has_better = 0 FROM (
    SELECT *, max(role) OVER (PARTITION BY node) AS has_better FROM (
      SELECT *, max(gone) OVER (PARTITION BY better, worse) AS either_gone FROM (
        SELECT *, max(CASE WHEN role = 1 AND first THEN 1 ELSE 0 END) OVER (PARTITION BY node) AS gone FROM (
          SELECT *, CASE WHEN role = 0 THEN better ELSE worse END AS node FROM (SELECT better, worse, first, unnest([0, 1]) AS role FROM g)))
    ) WHERE either_gone = 0
  ) WHERE role = 0
) SELECT image_id, class_name, id FROM boxes WHERE id NOT IN (SELECT worse FROM g WHERE first)""",
    "mask_one_to_one_match": f"WITH RECURSIVE {_MASKS}, scored AS (SELECT * FROM over WHERE iou >= 0.1), {_greedy('scored')}",
    "mask_iou_match": f"""WITH {_MASKS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, ref_id ORDER BY iou DESC, pred_id) AS a, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, ref_id) AS b FROM over WHERE iou >= 0.3)
SELECT image_id, ref_id, pred_id, round(round(iou, 11), 6) + 0.0 AS iou FROM ranked WHERE a = 1 AND b = 1""",
    "run_mask_resize": f"""WITH {_PX}, shown AS (
  SELECT p.image_id, p.ann, c.x, r.y FROM px p JOIN (SELECT i AS x, i * {WIDTH} // 20 AS old_x FROM range(20) t(i)) c ON c.old_x = p.x JOIN (SELECT i AS y, i * {HEIGHT} // 37 AS old_y FROM range(37) t(i)) r ON r.old_y = p.y
) SELECT image_id, ann, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM shown GROUP BY ALL""",
    "run_mask_match": f"""WITH {_MASKS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, ref_id ORDER BY iou DESC, pred_id) AS a, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, ref_id) AS b FROM over WHERE iou >= 0.3)
SELECT image_id, ref_id, pred_id, round(round(iou, 11), 6) + 0.0 AS iou FROM ranked WHERE a = 1 AND b = 1""",
    "mask_pixel_join": f"""WITH {_PX}, image AS (SELECT image_id, x, y, max(b) AS b, max(g) AS g, max(r) AS r FROM px WHERE x < 30 GROUP BY ALL)
SELECT p.image_id, p.ann, count(*) AS n, round(round(avg(i.b), 11), 6) + 0.0 AS mean_b, round(round(avg(i.g), 11), 6) + 0.0 AS mean_g, round(round(avg(i.r), 11), 6) + 0.0 AS mean_r FROM px p JOIN image i USING (image_id, x, y) GROUP BY ALL""",
    "precision_recall_f1": f"""WITH {_MATCH}, n AS (SELECT (SELECT count(*) FROM ref) AS reference, (SELECT count(*) FROM pred) AS predicted, (SELECT count(*) FROM matched) AS matched),
s AS (SELECT *, reference - matched AS missed, predicted - matched AS false_predictions, matched / predicted AS precision, matched / reference AS recall FROM n)
SELECT reference, predicted, matched, missed, false_predictions, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s""",
    "error_statistics": f"WITH {_PAIRS} " + " UNION ALL ".join(_stat_sql(c) for c in ("absolute_error", "relative_error_pct", "signed_error")),
    "error_histogram": f"""WITH {_PAIRS}, bins AS (SELECT * FROM (VALUES {_EDGES}) AS v(bin, low, high))
SELECT CAST(b.bin AS BIGINT) AS bin, CAST(b.low AS DOUBLE) AS low, CAST(b.high AS DOUBLE) AS high, count(p.relative_error_pct) AS n
FROM bins b LEFT JOIN pairs p ON round(p.relative_error_pct, 9) >= b.low AND (b.high IS NULL OR round(p.relative_error_pct, 9) < b.high) GROUP BY b.bin, b.low, b.high""",
}
