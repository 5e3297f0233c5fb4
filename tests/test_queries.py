"""Every query runs, and agrees with its SQL where there is any."""

import json
import os
import random
import uuid
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

import __spark_entry__
from sitegrain import tables as written
from sitegrain.functions import html
from sitegrain.operators import grouping

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return connection


def plain(value):
    if pd.isna(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(value, 9) if isinstance(value, float) else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, row))) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_query_agrees_with_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES])
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.columns and rows.collect()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def walked(rows):
    """(prefix, seq, pos) of the leaves of every node, by walking a tree of dictionaries."""
    root = {"urls": [], "children": {}}
    for seq, own in rows:
        node = root
        for s in own:
            node = node["children"].setdefault(s, {"urls": [], "children": {}})
        node["urls"].append(seq)
    out = []

    def visit(node, prefix):
        leaves = list(node["urls"])
        for name, child in node["children"].items():
            leaves += visit(child, [*prefix, name])
        out.extend(("/".join(prefix), seq, pos) for pos, seq in enumerate(leaves))
        return leaves

    visit(root, [])
    return sorted(out)


def test_leaves_below_every_prefix(spark):
    rows = QUERIES["project_wide_url"](spark, SF).select("seq", "segments").collect()
    want = walked((r.seq, r.segments.split("|") if r.segments else []) for r in sorted(rows))
    got = sorted(map(tuple, QUERIES["trie_collect_leaves"](spark, SF).select("prefix", "seq", "pos").collect()))
    assert got == want and any(p.count("/") >= 1 for p, *_ in got)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_random_trees(spark, monkeypatch, seed):
    """Random paths, repeated ones too, with few ranges and small blocks, so that every seam is met; and a node with most children."""
    draw = random.Random(seed)
    monkeypatch.setattr(grouping, "BLOCK", 7), monkeypatch.setattr(grouping, "RANGES", 5), monkeypatch.setattr(written, "HOT_ROWS", 10)
    paths = ["/" + "/".join(draw.choice("abc") for _ in range(draw.randint(0, 4))) for _ in range(120)] + [f"/hot/{i % 50}" for i in range(80)]
    draw.shuffle(paths)
    seqs = draw.sample(range(-500, 500), len(paths))
    rows = sorted(zip(seqs, paths))
    table = spark.createDataFrame(rows, "seq long, path string").repartition(4)
    nodes, leaves = grouping.intervals(table, F.col("path"))
    want = walked((q, [s for s in p.split("/") if s]) for q, p in rows)
    assert sorted(map(tuple, grouping.leaves_below(nodes, leaves).collect())) == want
    assert sorted(r.place for r in leaves.collect()) == list(range(len(rows)))
    assert not grouping.leaves_below(*grouping.intervals(table.limit(0), F.col("path"))).collect()


def test_records_of_cut_titles(spark, tmp_path):
    """A title that was cut within a reference stays cut in the records of an extraction."""
    pages = [(3, "https://a.example.com/en/7", "<title>Of the sea &amp;&amp</title>"), (4, "https://b.example.com/en/8", "<title>Of the land &lt;&quo</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    lines = [json.loads(r.line.lstrip(","))["data"]["page_title"] for r in QUERIES["snk_phase3_json"](spark, str(tmp_path)).where("line like '%page_title%'").orderBy("seq").collect()]
    assert lines == ["Of the sea &&amp", "Of the land <&quo"]


@pytest.mark.parametrize("name", ["snk_phase3_json", "html_metadata", "validate_schema"])
def test_titles_of_null_pages_agree_with_sql(spark, tmp_path, name):
    """A null page has no title, an empty one has an empty title."""
    pages = [(i, f"https://a.example.com/en/{i}", page) for i, page in enumerate([None, "", "<title>Of the sea</title>", None, None, "<title></title>", None, "<p>none</p>"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    made = duckdb.connect()
    made.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(made.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["phase3_counts", "coverage_by_site"])
def test_batches_of_pages_have_a_size(spark, tmp_path, monkeypatch, name):
    """Python meets few bytes of pages at a time, however many rows a task has."""
    met = tmp_path / "met"
    met.mkdir()
    pages = spark.range(900).selectExpr("id AS page_id", "concat('https://h', id % 9, '.example.com/en/', id) AS url", "concat('<title>t', id, '</title>', repeat('x', 20000)) AS html").coalesce(1)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    where = str(met)

    def noted(batch: pa.Array) -> pa.Array:
        (Path(where) / uuid.uuid4().hex).write_text(str(batch.nbytes))
        return html._scanned(batch)

    monkeypatch.setattr(html, "scanned", F.arrow_udf(noted, from_arrow_type(html.FACTS)))
    QUERIES[name](spark, str(tmp_path)).collect()
    sizes = [int(p.read_text()) for p in met.iterdir()]
    assert sum(sizes) >= 900 * 20_000 and max(sizes) < 3 << 20
