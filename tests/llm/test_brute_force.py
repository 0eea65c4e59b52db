"""Operators that SQL can't express, against brute force, exact round trips or held-out accuracy."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyweave.llm import decontam, mixing, queries, range_coder, suffix_dedup, toxicity

from ..conftest import DATA
from .conftest import words

#: Enough labelled rows to learn from.
LARGER = "/root/testdata/sf0.1"


def tokens(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")


def clean_tokens(text):
    return [x for x in tokens(text) if x]


def passages(texts: dict[int, list[str]], least: int = 50) -> set:
    """Spans whose windows of ``least`` words are also in another document."""
    where = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    out = set()
    for d, w in texts.items():
        held = None
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                if held and i <= held[1]:
                    held = (held[0], i + least)
                else:
                    out |= {(d, *held)} if held else set()
                    held = (i, i + least)
        out |= {(d, *held)} if held else set()
    return out


def test_repeated_passages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in queries.op6_suffix_dedup(spark, DATA).collect()}
    assert got == passages({r["doc_id"]: clean_tokens(r["text"]) for r in docs.collect()})


def test_passages_inside_other_text(spark):
    shared = [words(n, 50 + n) for n in (49, 50, 51, 75, 140)]
    texts = {i: words(100 + i, i) + shared[i % 5] + words(60, 100 + i) + shared[(i + 1) % 5][:60] for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == passages(texts)


def test_passages_behind_a_common_head(spark):
    """Few of the many documents with a common run of words share the words before it or behind it as well."""
    common, n = words(40, 7), 1300
    texts = {i: words(40, 1000 + i) + common + words(40, 5000 + i) for i in range(n)}
    for i in range(0, 200, 2):
        other = n - 1 - i
        texts[other][28 + i % 5 : 40] = texts[i][28 + i % 5 : 40]  # some have less than 50 words in common
        texts[other - 1][80 : 86 + i % 8] = texts[i + 1][80 : 86 + i % 8]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    want = passages(texts)
    assert len(want) > 100
    for rows in (suffix_dedup.repeated_passages(docs).collect(), suffix_dedup.repeated_passages(docs, run=100).collect()):
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} == want


def overlapping(doc: list[str], item: list[str], window: int = decontam.WINDOW) -> float:
    """The largest share of agreeing words of a window of the item at any alignment."""
    best, length = 0.0, min(window, len(item))
    for diagonal in range(-len(item) + 1, len(doc)):
        same = np.array([0 <= diagonal + i < len(doc) and doc[diagonal + i] == x for i, x in enumerate(item)])
        total = np.concatenate(([0], np.cumsum(same)))
        best = max(best, (total[length:] - total[:-length]).max() / length)
    return best


def test_decontamination(spark):
    items = {i: words(n, 900 + i, 3000) for i, n in enumerate((4, 12, 30, 50, 80, 120))}
    docs, r = {}, random.Random(3)
    for i in range(36):
        item = list(items[i % 6])
        if i % 4 == 1:
            item = [f"other{r.random()}" if j % 6 == 3 else x for j, x in enumerate(item)]  # one in six replaced
        if i % 4 == 2:
            item = [f"other{r.random()}" if r.random() < 0.4 else x for x in item]
        docs[i] = words(40, i, 3000) + (item if i % 4 < 3 else []) + words(30, 200 + i, 3000)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(d, b).collect()}
    assert got == {(i, j) for i, w in docs.items() for j, x in items.items() if overlapping(w, x) >= decontam.MIN_MATCH}
    assert {x["doc_id"] for x in decontam.clean(d, b).collect()} == set(docs) - {i for i, _ in got}


def test_decontamination_of_short_items(spark):
    items = {n: words(n, 70 + n, 3000) for n in range(1, 10)}
    docs = [words(9, 10 * n + j, 3000) + [f"other{j}" if i in (j, k) else x for i, x in enumerate(item)] + words(9, 500 + n, 3000) for n, item in items.items() for j in range(n) for k in (j, 0)]
    docs += [words(6, n, 3000) + item[:-1] for n, item in items.items()] + [item[1:] + words(6, n, 3000) for n, item in items.items()]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for least in (decontam.MIN_MATCH, 0.6):
        got = {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(d, b, min_match=least).collect()}
        assert got == {(i, j) for i, w in enumerate(docs) for j, x in items.items() if overlapping(w, x) >= least}


@pytest.mark.parametrize("doc,item", [("buy now " * 10_000, "buy now " * 25), ("one " * 20_000, "one " * 200)])
def test_decontamination_of_repeated_words(doc, item):
    """Every alignment is found, and memory doesn't grow with the pairs of equal seeds."""
    index = decontam._index([(5, item.encode())], decontam.WINDOW, decontam.MIN_MATCH)
    tracemalloc.start()
    got = list(decontam._hits(index, [b"nothing here", doc.encode()], decontam.WINDOW, decontam.MIN_MATCH))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words, mine = doc.split(), item.split()
    step, n = (2 if words[0] != words[1] else 1), len(mine)
    # a window of 50 that agrees in 40 tokens at least: the item's alignments reach over both ends of the text
    reach = [k for k in range(-n, len(words)) if (k % step == 0) and min(n, len(words) - k) - max(0, -k) >= 40]
    assert len(got) == len(reach) and {x[:2] for x in got} == {(1, 5)} and all(x[4] == 50 and x[5] >= 40 for x in got)
    assert peak < 200 << 20


def test_decontamination_ignores_case(spark):
    items = ["ñandú élan ciónmiírr über straße ça où señal", "быстрая лиса прыгает через ленивую собаку", "ο μικρός πρίγκιπας ζει στον αστεροειδή του"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [t for x in items for t in (f"one {x} two", f"one {x.upper()} two", f"one {x.title()} two")]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted((x["doc_id"], x["item_id"], x["n_match"]) for x in decontam.overlaps(d, b).collect()) == [(i, i // 3, len(items[i // 3].split())) for i in range(9)]
    assert decontam.clean(d, b).count() == 0


def test_token_files(spark):
    t = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    got = {r["doc_id"]: r for r in queries.op10_token_output(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[r["doc_id"]])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["", " ", "a", " a  b\n\n c\t", "x<|endoftext|>y", "don't  I'LL 12 345  z\x1cq\x85", "日本語 ñandú 🙂🙂", "word " * 5000])
def test_ids_of_cut_texts(text):
    from skyweave.llm.token_output import token_ids

    for path in (queries.tokenizer_path(), public_tokenizers.path("word_bpe_49k.json")):  # the second can't be cut
        t = Tokenizer.from_file(path)
        ids, counts = token_ids(pa.array([text, None, text[::-1]]), path)
        want = [t.encode(x, add_special_tokens=False).ids for x in (text, "", text[::-1])]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_ids_of_random_texts():
    from skyweave.llm.token_output import token_ids

    path, r = queries.tokenizer_path(), random.Random(4)
    t, signs = Tokenizer.from_file(path), [*"ab c'sdTLlve  \n\t.,!1 2_-(é×ñß÷日本ж\xa0\u3000 ́²½\x1c\x85", "'s", "'ll", "<|endoftext|>", "  ", "\n\n", "🙂", "’", "ǆ"]
    texts = ["".join(r.choices(signs if i % 3 else signs[:24], k=r.randrange(60))) for i in range(4000)]
    ids, counts = token_ids(pa.array(texts), path)
    for x, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_memory_of_pieces_is_bounded(monkeypatch):
    from skyweave.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 1 << 10)
    p, t = pieces.Pieces(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for i in range(12):
        text = " ".join(words(200, i, 100_000))
        ids, _ = p.ids_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and p.parts.n <= 1 << 10


def test_coded_ids_are_smaller_than_deflated_ones(spark):
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate([np.array([*e.ids, 0], np.uint32) for e in t.encode_batch(texts, add_special_tokens=False)])
    assert len(range_coder.pack([0], np.array([len(ids)]), ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
def test_range_coder(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.5, r.integers(0, 30, n), r.integers(0, 1 << 24, n)).astype(np.uint32)
    counts = np.array([n // 3, n - n // 3], np.int64)
    data = range_coder.pack([7, None], counts, ids)
    docs, sizes, back = range_coder.unpack(data)
    assert docs == [7, None] and sizes.tolist() == counts.tolist() and back.tolist() == ids.tolist()
    if n > 1:
        with pytest.raises(ValueError):
            range_coder.unpack(data[:-6] + bytes(x ^ 255 for x in data[-6:-4]) + data[-4:])


def test_held_out_language(spark):
    lang = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op1_language_id(spark, LARGER).join(lang, "doc_id").where("held_out AND lang IS NOT NULL AND length(text) > 50")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.93


@pytest.mark.parametrize("name,label", [("op5_toxicity", "toxic"), ("op9_quality", "quality")])
def test_held_out_labels(spark, name, label):
    y = spark.read.parquet(f"{LARGER}/labels.parquet").where(F.col(label).isNotNull())
    rows = queries.queries()[name](spark, LARGER).join(y, "doc_id").where("held_out").select(label, "predicted", "score").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.9
    pos, neg = ([r[2] for r in rows if r[0] == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.9


def near_groups(texts: dict[int, list[str]], w: int, percent: int) -> dict[int, int]:
    sets = {d: {tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))} if x else set() for d, x in texts.items()}
    group = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    return group


def held(doc: list[str], item: list[str]) -> bool:
    """Whether the document overlaps the item; most pairs share too few words for that."""
    few = decontam.MIN_MATCH * min(decontam.WINDOW, len(item))
    return sum(x in set(doc) for x in item) >= few and overlapping(doc, item) >= decontam.MIN_MATCH


def test_pipeline(spark):
    """Each stage on what a plain version of the stage before has kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(queries.fold(4) != 2))
    kept = {d: clean_tokens(t) for d, t in texts.items() if toxicity.predict(model, [t])[0] < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(texts)
    kept = {d: kept[d] for d, g in near_groups(kept, 5, 80).items() if d == g}
    items = [clean_tokens(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [d for d, w in kept.items() if not any(held(w, i) for i in items)]
    left = docs.where(F.col("doc_id").isin(clean))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    t = Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for d in sorted(copies):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want
