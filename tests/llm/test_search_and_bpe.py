"""Clustering, BPE and lexical search against plain versions, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyweave.llm import lexical, prefix_bpe, queries, yinyang

from ..conftest import DATA
from .conftest import odd_rows, words

N = len(odd_rows())
WORD = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, v string"


# ---------------------------------------------------------------- clustering


def lloyd(rows, k, rounds, dims, seed=2):
    """Plain full scans: {row: (cluster, distance)} and the last centroids."""
    kept = [(i, r[0], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    first = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"{seed}:{r[1]}".encode()).hexdigest() if r[1] is not None else "", r[2]))[:k]
    c = [r[2] for r in first]

    def scan():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for i, _, v in kept}

    for _ in range(rounds):
        near = scan()
        for j in range(len(c)):
            own = [v for i, _, v in kept if near[i][1] == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return scan(), c


def vectors(seed, n, dims, centres=12):
    r = random.Random(seed)
    at = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("seed,k,dims", [(1, 25, 6), (2, 40, 3)])
def test_clusters_are_those_of_full_scans(spark, seed, k, dims):
    rows = vectors(seed, 400, dims)
    rows += [(500 + i, rows[i][1]) for i in range(40)] + [(3, rows[9][1]), (None, rows[5][1])]  # equal vectors, ids twice, a null id
    rows += [(900, None), (901, [1.0]), (902, [None] * dims), (903, [math.nan] * dims), (904, [math.inf] * dims), (905, [])]
    table = spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)
    near, c = lloyd(rows, k, 5, dims)
    got = yinyang.cluster(table, k=k, dims=dims).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got) == sorted((rows[i][0] is None, rows[i][0] or 0, j, d) for i, (d, j) in near.items())
    inertia = Counter()
    for d, j in near.values():
        inertia[j] += d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_bounds_leave_out_centroids():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (40, 16))
    v = centres[r.integers(0, 40, 3000)] + r.integers(-300, 300, (3000, 16))
    c = v[:40].copy()
    group = yinyang.groups_of(c)
    assert len(np.unique(group)) > 1
    state = (np.full(3000, -1), np.zeros(3000), np.zeros((3000, group.max() + 1)))
    moved, share = np.zeros(40), []
    for turn in range(6):
        own, upper, lower, least, scanned = yinyang.assign(v, *state, c, group, moved)
        full = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
        share.append(scanned / full.size)
        state = (own, upper, lower)
        new = np.stack([v[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(40)])
        moved, c = np.sqrt(((new - c).astype(float) ** 2).sum(axis=1)), new
    assert share[0] == 1 and max(share[1:]) < 0.7 and share[-1] < 0.2


def test_odd_clusters(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert yinyang.cluster(empty, dims=2).columns == yinyang.cluster(spark.createDataFrame([(1, [0.5, 0.25], 0, "", "", "")], VECTORS), dims=2).columns
    assert yinyang.cluster(empty).count() == 0
    same = spark.createDataFrame([(i, [0.5, -0.3], 0, "", "", "") for i in range(50)], VECTORS)
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in yinyang.cluster(same, dims=2).collect()} == {(0, 0, 0)}
    with pytest.raises(Exception, match="beyond 64 bits"):
        yinyang.cluster(spark.createDataFrame([(1, [3e30], 0, "", "", ""), (2, [-3e30], 0, "", "", "")], VECTORS), dims=1).collect()


# ---------------------------------------------------------------- BPE


def same_ids(spark, texts, path):
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = prefix_bpe.decode(prefix_bpe.encode(df, path), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == t.decode(want, skip_special_tokens=False)


def test_ids_of_odd_texts(spark):
    r = random.Random(3)
    letters = "aeinrst'l ,.0ÉéİΣςß́  中각🎉🏽<|>_\x1c\x85AZ\n\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(1500)]
    texts += ["".join(r.choice("aehlst") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    texts += [None, "", " \t\n", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|STARTOFTEXT|>", "don't we'll", "ab" * 3000, "ΟΔΟΣ İzmir", " ".join(words(30_000, 4))]
    same_ids(spark, texts, WORD)


def test_ids_of_the_documents(spark):
    same_ids(spark, [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()], WORD)


def test_ids_without_word_ends(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("aeinrst' 0É\n<|>.") for _ in range(r.randrange(80))) for _ in range(300)] + ["x<|endoftext|>y", None, "the " * 500]
    same_ids(spark, texts, public_tokenizers.path("byte_bpe_50k.json"))


def test_digests_of_the_query(spark):
    t = Tokenizer.from_file(WORD)
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op12_bpe(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    for r in rows:
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_apart_is_what_merging_pair_by_pair_gives():
    """Tokens stay apart if merging the lowest pair again and again gives them back."""
    m = prefix_bpe._held(prefix_bpe.Words, WORD).merges
    r = random.Random(6)
    spelled = m.size > 0
    tokens = [t for t in range(m.n) if spelled[t] and m.size[t] < 6]
    symbols = {}

    def spell(t):
        if t not in symbols:
            symbols[t] = [t] if m.rank[t] < 0 else spell(m.left[t]) + spell(m.right[t])
        return symbols[t]

    def merge(seq):
        while len(seq) > 1:
            ranks = m.pair(np.array(seq[:-1], np.int64) * m.n + np.array(seq[1:], np.int64))
            best = np.where(ranks < 0, 2**31 - 1, ranks).argmin()
            if ranks[best] < 0:
                break
            whole = next(t for t in by_rank[ranks[best]])
            seq = [*seq[:best], whole, *seq[best + 2 :]]
        return [int(x) for x in seq]

    by_rank = {int(m.rank[t]): [t] for t in range(m.n) if m.rank[t] >= 0}
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(1500)]
    got = m.apart(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [merge(spell(a) + spell(b)) == [a, b] for a, b in pairs]
    assert got.tolist() == [m._stays(a, b) for a, b in pairs]


def test_odd_rows(odd, nothing):
    rows = prefix_bpe.decode(prefix_bpe.encode(odd, WORD), WORD)
    assert rows.count() == N and set(odd.columns) <= set(rows.columns)
    empty = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in rows.collect()}
    assert all(empty[i] == (0, "") for i in (1, 2, 7, 9)) and empty[3][0] > 60_000
    assert prefix_bpe.decode(prefix_bpe.encode(nothing, WORD), WORD).count() == 0
    clash = odd.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit("y"))
    assert prefix_bpe.decode(prefix_bpe.encode(clash, WORD), WORD).select("n_tokens", "ids", "decoded").dtypes == [("n_tokens", "bigint"), ("ids", "binary"), ("decoded", "string")]
    once = prefix_bpe.encode_and_decode(odd, WORD)
    assert sorted(map(str, once.select("doc_id", "n_tokens", "ids", "decoded").collect())) == sorted(map(str, rows.select("doc_id", "n_tokens", "ids", "decoded").collect()))
    null = odd.select("doc_id", F.lit(None).cast("binary").alias("ids"))
    assert {r["decoded"] for r in prefix_bpe.decode(null, WORD).collect()} == {""}


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by the definition."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out


def check_search(spark, docs, items, **kwargs):
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], "doc_id long, text string, score string, item string, rank string").repartition(3)
    asked = spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, terms string").repartition(2)
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(frame, asked, **kwargs).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(ranked(docs, items, **kwargs), key=key)
    return got


def mixed(seed, n):
    r = random.Random(seed)
    vocabulary = [f"Wort{i}" for i in range(60)] + ["Straße", "ÉCOLE", "école", "中文", "a1", "x" * 40, "x" * 39 + "y", "q"]
    docs = [(i, r.choice([" ", "-", "\n", "\t_"]).join(r.choices(vocabulary, k=r.randrange(40)))) for i in range(n)]
    items = [(i, ", ".join(r.choices(vocabulary, k=r.randrange(1, 9)))) for i in range(15)]
    return docs, items


def test_search_is_that_of_the_definition(spark):
    docs, items = mixed(1, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(25)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "!!"), (2000, None), (2001, "")]  # ties, an id twice, null ids
    docs.append((2002, " ".join(words(60_000, 8)) + " Wort3 " + "x" * 300_000))
    items += [(50, None), (51, ""), (52, "nowhere"), (None, "Wort1 wort1"), (0, "Wort2"), (53, docs[7][1])]
    check_search(spark, docs, items)
    check_search(spark, docs, items, k=3)


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 12)
    check_search(spark, *mixed(2, 120))


def test_few_documents(spark):
    assert check_search(spark, [(1, "alpha")], [(1, "alpha")]) == ranked([(1, "alpha")], [(1, "alpha")])
    assert check_search(spark, [(1, None)], [(1, "alpha")]) == []
    frame, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(frame, asked).count() == 0
    assert lexical.search(frame, spark.createDataFrame([(1, "alpha")], asked.schema)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "alpha")], frame.schema), asked).count() == 0


def test_runs_of_postings():
    """Sums of random postings, in radix order."""
    r = np.random.default_rng(2)
    first = np.array([0, 3, 3, 5, 9])
    items = np.array([0, 2, 70_000, 1, 2, 0, 1, 2, 3])
    doc, number, impact = np.sort(r.integers(0, 4096, 5000)), r.integers(0, 4, 5000), r.integers(0, 10**13, 5000)
    want = Counter()
    for d, t, x in zip(doc.tolist(), number.tolist(), impact.tolist(), strict=True):
        for i in items[first[t] : first[t + 1]].tolist():
            want[i, d] += x
    got = list(zip(*(x.tolist() for x in lexical.accumulate(doc, number, impact, first, items)), strict=True))
    assert got == [(i, d, s) for (i, d), s in sorted(want.items())]


def test_factor_beyond_64_bits():
    n = np.array([3, 10**12])
    assert lexical.length_factor(n, 10**11, 10**15).tolist() == [10 + 90 * x * 10**11 // 10**15 for x in (3, 10**12)]
