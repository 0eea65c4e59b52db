"""The pipeline's stages, and all of it, on odd rows: nulls, empty and very long texts, repeated rows, clashing names, no rows."""

import pytest

import corpus_pipeline

from .conftest import COPY, SCHEMA, odd_rows, words

BENCHMARK = " ".join(words(60, 77))
TOXIC = "you filthy stupid vermin get out "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables whose documents are the odd rows and a few more, with an empty one beside it."""
    base = tmp_path_factory.mktemp("odd")
    rest = odd_rows()[3][2:]
    rows = [*odd_rows(), (20, BENCHMARK, *rest), (None, BENCHMARK, *rest), (21, " ".join(words(40, 5)) + " " + BENCHMARK, *rest)]
    rows += [(100 + i, TOXIC * 3 + " ".join(words(20, 200 + i)), *rest) for i in range(30)] + [(200 + i, " ".join(words(30, 300 + i)), *rest) for i in range(60)]
    labels = [(i, 1, 1) for i in range(100, 130)] + [(i, 1, 0) for i in range(200, 260)] + [(None, 1, 1), (3, None, None), (99_999, 0, 1)]
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(f"{base}/{name}/documents.parquet")
        spark.createDataFrame(labels if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{base}/{name}/labels.parquet")
        spark.createDataFrame([(1, BENCHMARK), (None, COPY), (2, None), (3, "")] if some else [], "item_id long, text string").write.parquet(f"{base}/{name}/benchmark.parquet")
    return str(base)


def stages(spark, folder):
    """(name, rows read, rows given, columns) of each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        yield name, docs.collect(), out.collect(), (docs.columns, out.columns)
        docs = out


@pytest.fixture(scope="module")
def found(spark, folder):
    return {name: x for name, *x in stages(spark, f"{folder}/full")}


def test_stages_on_odd_rows(found):
    assert list(found) == [name for name, _ in corpus_pipeline.STAGES]
    for name in list(found)[:-1]:
        assert found[name][2][0] == found[name][2][1]  # the columns of documents
    read, left, _ = found["toxicity"]
    gone = [r["text"] for r in read if r["text"] is not None and TOXIC in r["text"]]
    assert len(gone) == 30 and not any(r["text"] and TOXIC in r["text"] for r in left)
    assert len(left) == len(read) - 30  # null, empty and repeated rows and the very long text stay
    read, left, _ = found["n-gram Jaccard join"]
    copies = [r for r in left if r["text"] == COPY]
    assert sorted(r["doc_id"] or 0 for r in copies) == [0, 4, 4]  # the smallest id's rows, and the null id's
    assert len([r for r in read if r["text"] in (None, "")]) == len([r for r in left if r["text"] in (None, "")])
    read, left, _ = found["benchmark decontamination"]
    assert sum(BENCHMARK in (r["text"] or "") for r in read) >= 2 and not any(BENCHMARK in (r["text"] or "") for r in left)
    assert {r["doc_id"] for r in left} >= {1, 2, 3, 7, 8, 9}
    read, left, _ = found["mixing sources to target weights"]
    ids = {r["doc_id"] for r in read}
    assert {r["doc_id"] for r in left} <= ids and all(sum(x == r for x in left) <= 2 * sum(x == r for x in read) for r in left)
    read, rows, _ = found["token-ID / binary output"]
    rows = sorted(rows, key=lambda r: r["start"])
    assert len(rows) == len(read) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_the_whole_on_odd_rows(spark, folder, found):
    """It gives what the stages give one by one, each time."""
    rows = sorted(map(str, corpus_pipeline.run(spark, f"{folder}/full").collect()))
    assert rows == sorted(map(str, found["token-ID / binary output"][1])) and rows


def test_nothing(spark, folder):
    assert all(not given for _, _, given, _ in stages(spark, f"{folder}/none"))
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
