"""Case folding, and ranks by narrowing."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmetrics.functions.expressions import folded, same_name
from maskmetrics.operators.evaluate import PERCENTILES, ranked_values, statistics


def test_folding_of_every_character(spark):
    letters = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or chr(c) != chr(c).casefold() or chr(c) != chr(c).lower())]
    texts = ["".join(letters[k : k + 50]) for k in range(0, len(letters), 50)] + ["Straße", "ΑΣΣ ς", "ŉ ǰ ΐ", "İstanbul I ı", "ﬁ ﬃ", "", None, "plain ASCII [\\]^_`{|}"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", folded(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in sorted(got)] == [t.casefold() if t is not None else None for t in texts]


def test_names_are_compared_and_joined_by_folding(spark):
    a = spark.createDataFrame([("STRASSE",), ("Σ",), ("x",), (None,)], "a string")
    b = spark.createDataFrame([("straße",), ("ς",), ("X",), ("y",), (None,)], "b string")
    joined = a.join(b, same_name(F.col("a"), F.col("b")))
    assert sorted(map(tuple, joined.collect())) == [("STRASSE", "straße"), ("x", "X"), ("Σ", "ς")]
    assert "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells, cell_rows", [(64, 1 << 20), (8, 20)])
def test_percentiles_by_narrowing(spark, cells, cell_rows):
    """A hot key, clusters of very different sizes, many equal values, one row, nulls."""
    r = random.Random(1)
    groups = {
        "hot": [r.choice([1e-9, 1e-6, 1, 1e6, 1e300]) * r.random() for _ in range(1500)],
        "equal": [7.0] * 300 + [r.choice([7.0, 8.0]) for _ in range(100)] + [6.5],
        "one": [3.25],
        "signs": [r.uniform(-5, 5) for _ in range(200)] + [0.0, -0.0],
        None: [float(k) for k in range(50)],
        "none": [],
        "nested": [3.0 + s * 10.0 ** -k for k in range(16) for s in (-1, 1) for _ in range(9)] + [s * 2.0**-k for k in range(0, 1070, 7) for s in (-1, 1)],
    }
    rows = [(k, v) for k, own in groups.items() for v in [*own, None]]
    r.shuffle(rows)
    got = {x["k"]: x for x in statistics(spark.createDataFrame(rows, "k string, v double").repartition(5), "v", ["k"], cells, cell_rows).collect()}
    assert got.keys() == groups.keys()
    for k, own in groups.items():
        assert got[k]["n"] == len(own)
        for name, p in PERCENTILES.items():
            want = None if not own else np.percentile(own, 100 * p)
            assert got[k][name] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-12)), (k, name)


def test_no_cell_in_order_is_larger_than_asked(spark):
    """Each round keeps only rows of wanted cells, down to the bound."""
    values = random.Random(2).sample(range(10**6), 3000)
    rows = spark.createDataFrame([("a", float(v)) for v in values], "_key string, _v double")
    wanted = spark.createDataFrame([("a", [0, 17, 1500, 2999], float(min(values)), float(max(values)))], "_key string, ranks array<bigint>, _lo double, _hi double")
    got = {x["rank"]: x["_v"] for x in ranked_values(rows, wanted, 8, 50).collect()}
    assert got == {k: float(sorted(values)[k]) for k in (0, 17, 1500, 2999)}
