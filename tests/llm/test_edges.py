"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import decontam, jaccard, langid, line_dedup, mixing, quality, queries, suffix_dedup, token_output, topk, toxicity

from .conftest import COPY, odd_rows, words

N = len(odd_rows())


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def test_language_id(odd, nothing):
    model = langid.fit(odd)
    got = langid.identify(odd, model)
    assert got.count() == N and set(odd.columns) <= set(got.columns)
    rows = by_id(got)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 7, 9))
    assert rows[3]["lang_pred"] == "en" and rows[4]["lang_pred"] == rows[6]["lang_pred"]
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(nothing)).collect()} == {"und"}


def test_many_languages_and_late_letters(spark):
    rows = [(i, " ".join(words(200 - i, i, 30)).replace("w", chr(0x4E00 + i)).translate({48 + j: 97 + (i * 7 + j) % 26 for j in range(10)}), f"l{i:02}") for i in range(70)]
    rows.append((70, "".join(chr(0x20000 + j % 40) for j in range(300)), "ext"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == 71 and all(r["lang_pred"] == r["lang"] for r in got)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, nothing, module, label):
    y = labels(spark, [(3, 0, 0, "x"), (4, 1, 1, "x"), (5, 1, 1, None), (None, 1, 1, None), (2, None, None, None), (8, 0, 0, "x")])
    for some in (y, y.where("doc_id = 4"), y.where("false")):
        got = module.score(odd, module.fit(odd, some, label_col=label))
        assert got.count() == N and got.where("score >= 0 AND score <= 1").count() == N
        rows = by_id(got)
        assert rows[1]["score"] == rows[2]["score"] and rows[4]["score"] == rows[6]["score"]
    assert module.score(nothing, module.fit(nothing, y, label_col=label)).count() == 0


def test_line_dedup(odd, nothing):
    got = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd))
    assert got.count() == N
    rows = by_id(got)
    assert rows[6]["n_dropped"] == 0 and rows[6]["text"] == COPY  # the largest id keeps its lines
    assert rows[5]["text"] == "short" and rows[5]["n_dropped"] == 2 and rows[4]["n_lines"] == 3
    assert rows[1]["text"] == "" and rows[1]["n_lines"] == 1 and rows[9]["n_lines"] == 3
    assert line_dedup.apply_bitmaps(nothing, line_dedup.keep_bitmaps(nothing)).count() == 0


def test_line_dedup_of_runs_over_batches_and_partitions(spark):
    """Lines of one, two, three and very many documents, by a plain count, for small batches and many partitions."""
    r = random.Random(12)
    lines = {f"line number {i} of twenty letters": r.choice((1, 2, 3, 4, 700)) for i in range(60)}
    docs = {d: [] for d in range(900)}
    for line, n in lines.items():
        for d in r.sample(range(900), n):
            docs[d] += [line] * r.choice((1, 1, 2))
    last = {x: max(d for d, own in docs.items() if x in own) for x in lines}
    want = {(d, sum(lines[x] >= 3 and last[x] != d for x in own)) for d, own in docs.items()}
    table = spark.createDataFrame([(d, "\n".join(own)) for d, own in docs.items()], "doc_id long, text string").repartition(6)
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for batch, parts in (("7", "40"), ("512", "3"), ("100000", "1")):
        held = {k: spark.conf.get(k) for k in keys}
        for k, v in zip(keys, (batch, parts, "false"), strict=True):
            spark.conf.set(k, v)
        try:
            got = {(x["doc_id"], x["n_dropped"]) for x in line_dedup.apply_bitmaps(table, line_dedup.keep_bitmaps(table)).collect()}
        finally:
            for k, v in held.items():
                spark.conf.set(k, v)
        assert got == want


def test_decontamination(spark, odd, nothing):
    items = spark.createDataFrame([(1, COPY), (1, COPY), (2, None), (None, COPY), (3, ""), (4, " one ")], "item_id long, text string")
    got = decontam.overlaps(odd, items)
    assert {r["doc_id"] for r in got.collect()} == {None, 4, 5, 6, 8}
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 7, 9]
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == [None]  # the other one holds item 1
    assert decontam.overlaps(nothing, items).count() == 0 and decontam.clean(odd, items.where("false")).count() == N


def test_decontamination_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, COPY, "x"), (1, "clean", "y"), (1, None, "z"), (2, COPY, "x"), (2, "", "y")], "doc_id long, text string, __bad string")
    items = spark.createDataFrame([(1, COPY), (2, "something else in five words")], "item_id long, text string")
    held, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 40  # several blocks
    try:
        kept = decontam.clean(docs, items)
    finally:
        decontam.BLOCK_BYTES = held
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "clean", "y"), (1, None, "z"), (2, "", "y")], key=str)


def test_jaccard(odd, nothing):
    got = jaccard.components_by_jaccard(odd)
    assert got.count() == N
    rows = by_id(got)
    assert {rows[i]["component_id"] for i in (4, 5, 6)} == {4}
    assert all(rows[i]["component_id"] == i and rows[i]["n_shingles"] == 0 for i in (1, 2, 7, 9)) and rows[8]["n_shingles"] == 1
    assert jaccard.components_by_jaccard(nothing).count() == 0
    kept = jaccard.one_of_each(odd, 5, 80)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 4, 7, 8, 9]


def test_suffixes(odd, nothing):
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["match_doc"]) for r in suffix_dedup.repeated_passages(odd).collect()}
    n = len(COPY.split())
    assert got == {(4, 0, n, 5), (5, 0, n, 4), (6, 0, n, 5)} or {x[:3] for x in got} == {(i, 0, n) for i in (4, 5, 6)}
    assert suffix_dedup.repeated_passages(nothing).count() == 0


def test_mixing(odd, nothing):
    got = mixing.mix(odd)
    assert got.count() == N
    for r in got.collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"]
    assert got.select("doc_id", "taken").exceptAll(mixing.mix(odd.repartition(5)).select("doc_id", "taken")).count() == 0
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and rows.count() == got.agg(F.sum("copies")).head()[0]
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0


def test_top_k(spark):
    rows = [(i, [float(i % 7), 0.5, -1.0]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [math.nan, 1.0, 1.0]), (63, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (0, [3.0, 0.5, -1.0]), (64, [9.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(table, lambda i: i % 50 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 50} and all(r["vec_id"] not in (r["query_id"], *range(60, 65)) for r in got)
    best = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50]
    assert best == [6, 13, 20, 27, 34]  # ties to the smaller id
    assert topk.top_k(table.where("false"), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(table.where("vec_id IN (50, 51, 52)"), lambda i: i % 50 == 0).count() == 2


def test_top_k_of_empty_vectors_and_hot_ones(spark):
    rows = [(i, []) for i in (50, 51, 52)] + [(i, [2.0, 1.0]) for i in range(100, 400)] + [(100, [2.0, 1.0]), (100, [2.0, 1.0]), (7, [3.0]), (50, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted(map(tuple, topk.top_k(table, lambda i: i % 50 == 0).collect()))
    assert [x for x in got if x[0] == 50] == [(50, 1, 7, 5 * 3 * 65536), (50, 1, 51, 0), (50, 2, 52, 0)]
    assert [x[:3] for x in got if x[0] == 100] == sorted([(100, r, 100 + r) for r in range(1, 6)] * 3)
    assert [x[2] for x in got if x[0] == 150] == [100, 100, 100, 101, 102]
    assert topk.top_k(table.where("vec_id = 50 AND size(embedding) = 0"), lambda i: i % 50 == 0).count() == 0


def test_top_k_resolves_few_scores(spark):
    """Against all scores, and by the counters: most pairs are never resolved, in any number of slices."""
    r = np.random.default_rng(8)
    v = r.normal(size=(900, 24)).round(3)
    v[:40] -= 9  # scores with these are below zero
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    f = np.floor(256 * v).astype(int)
    want = []
    for q in range(0, 900, 50):
        order = sorted((-int(f[q] @ f[c]), c) for c in range(900) if c != q)[:5]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(order)]
    for slices in (1, 2, 3):
        cutoff, entries, answers = topk.phases(table, lambda i: i % 50 == 0, slices=slices)
        assert sorted(map(tuple, answers.collect())) == want
        assert cutoff.count() == 18 and entries.count() < 18 * 899 / 2


def test_token_output(spark, odd, nothing):
    got = token_output.read(spark, token_output.write(odd, queries.tokenizer_path()))
    assert got.count() == N
    rows = got.orderBy("start").collect()
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(N)]
    assert by_id(got)[1]["n_tokens"] == by_id(got)[2]["n_tokens"] == 1
    assert token_output.read(spark, token_output.write(nothing, queries.tokenizer_path())).count() == 0
