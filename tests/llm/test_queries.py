"""The queries of this subpackage against their SQL, and the pipeline stage by stage."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from sitegrain.llm import queries, quality
from sitegrain.llm.tokens import vocabulary_path

from .test_pairs import brute_components, brute_hits
from .test_single import brute_spans, library_counts
from .test_tokens_and_packing import check_packing
from sitegrain.llm.token_counts import pieces_of
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in map(plain, row))) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    tables = duckdb.connect()
    for t in os.listdir(SF):
        tables.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{SF}/{t}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), tables.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_token_count_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library_counts(*pieces_of(vocabulary_path("piece_bpe_32k.model")), docs.values())))
    assert {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, SF).collect()} == want


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = {r.doc_id: r.predicted for r in quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
            assert {r.doc_id for r in rows} == {d for d, p in scores.items() if p == 1}
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in rows} == {d for d, (_, c) in brute_components(before).items() if c == d}
        elif name == "benchmark_decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in rows} == {d for d, hit in brute_hits(list(before.items()), bench).items() if not hit[-1]}
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == set(before)
            assert all(r.text == before[r.doc_id] if not brute_spans(before[r.doc_id]) and "[" not in r.text else not brute_spans(r.text) and r.n_chars == len(r.text) for r in rows)
        else:
            tokenizer = Tokenizer.from_file(vocabulary_path())
            bins, total = check_packing(rows, list(before.items()), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
            assert bins <= -(-total // 2048) + 1
        held[name] = rows
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in held["best_fit_packing"])


def test_pipeline_of_odd_documents(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(d, d % 2) for d in range(0, 13)] + [(None, 1), (4, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "same text here again"), (None, "one"), (2, None)], "item_id long, text string")
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd") and {r.doc_id for r in rows} <= {r.doc_id for r in odd.select("doc_id").collect()}
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.schema == docs.schema, stage_name
            clashing = kept.collect()
            assert {(r.hits, r.spans, r.score, r.component_id, r.c, r.h, r.root) for r in clashing} <= {("a", "b", "c", "d", "f", "g", "h")}
