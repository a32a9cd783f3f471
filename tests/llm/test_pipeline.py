"""The pipeline and the registered queries on small tables."""

import os

import duckdb
import pytest
from brute import components, edit_distance_inside, edited, pairs, prose, repeated_windows, similar

import corpus_pipeline
from maskmetrics.llm import queries
from maskmetrics.llm.decontamination import allowed_edits, plain

DATA = "/root/testdata/sf0.001"


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, tmp_path):
    items = [(1, prose(500, 25)), (2, prose(501, 25))]
    shared = prose(600, 60)
    rows = [(k, prose(k, 30 + k)) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1]), (102, edited(rows[39][1], 1, 1)), (110, prose(50, 30) + " " + shared), (111, prose(51, 30) + "\n" + shared + " " + prose(52, 9)), (120, prose(53, 40) + " " + items[0][1].upper()), (130, None), (131, ""), (132, "12 34"), (133, "x"), (134, prose(700, 9000))]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    folder = write(spark, tmp_path, docs, items)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(rows)

    left = corpus_pipeline.language_id(spark, table, folder)
    want = {d: t for d, t in rows if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want and left.columns == table.columns

    left = corpus_pipeline.simhash_dedup(spark, table.where("text is not null and length(text) > 6 or doc_id = 133"), folder)
    some = {d: t for d, t in texts.items() if t and (len(t) > 6 or d == 133)}
    classes = components(some, [(a, b) for a, b in pairs(some) if similar(some[a], some[b])])
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(classes.values())) and not {100, 102} & set(classes.values())

    left = corpus_pipeline.substring_dedup(spark, table, folder)
    assert left.columns == table.columns
    after = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert not repeated_windows(after, 50)
    changed = {d for d, t in after if t != texts[d]}
    assert changed == {111} and dict(after)[111].split() == (prose(51, 30) + " " + prose(52, 9)).split()
    assert {r["doc_id"]: r["n_chars"] for r in left.collect()}[111] == len(dict(after)[111])

    left = corpus_pipeline.benchmark_decontamination(spark, table, folder)
    bad = {d for d, t in texts.items() if t and d != 134 for _, i in items if edit_distance_inside(plain(i), plain(t)) <= allowed_edits(len(plain(i)))}
    assert bad == {120} and {r["doc_id"] for r in left.collect()} == texts.keys() - bad


def test_run(spark, tmp_path):
    rows = [(k, prose(k, 100)) for k in range(20)] + [(50, prose(3, 100)), (51, None), (52, "??")]
    folder = write(spark, tmp_path, [(d, t, "en", "s", 0) for d, t in rows], [(1, prose(5, 100))])
    got = queries.QUERIES["pipeline"](spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(range(20)) - {5}
    empty = write(spark, tmp_path / "none", [], [])
    assert queries.QUERIES["pipeline"](spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_sql(spark, name):
    duck = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_query_is_there():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
    assert len(corpus_pipeline.STAGES) == 5
