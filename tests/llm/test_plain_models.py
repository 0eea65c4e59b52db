"""Language filter, toxicity and quality models against plain versions, and components against a plain walk."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import components, jaccard, langid, mixing, quality, toxicity

from .conftest import words

LANGUAGES = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst"}


def plain_grams(text: str) -> list[str]:
    """Character n-grams of the letters, with a space for all between, at both ends too."""
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    t = f" {' '.join(t)} " if t else ""
    return [t[i : i + k] for k in langid.SIZES for i in range(len(t) - k + 1)]


def test_language_filter_by_plain_sets(spark):
    """The filter holds all n-grams of a plain set, lets few others through, and answers like a count over sets."""
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choices(signs, k=r.randrange(2, 7))) for _ in range(60)), lang) for i, (lang, signs) in enumerate(list(LANGUAGES.items()) * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        counts[lang].update(plain_grams(t))
    sets = {lang: {g for g, n in c.items() if n >= max(2, langid.MIN_SHARE * c.total())} for lang, c in counts.items()}
    model = langid.fit(table)
    asked = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrst" if i % 4 == 0 else LANGUAGES[r.choice("abc") * 2], k=r.randrange(2, 7))) for _ in range(1 + i % 9))) for i in range(600)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    agree = clear = 0
    for i, t in asked:
        grams = plain_grams(t)
        share = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        first, second = sorted(share.values(), reverse=True)[:2]
        if first - second > 0.2:  # what passes by chance can't turn it
            clear += 1
            agree += got[i]["lang_pred"] == max(share, key=share.get)
            if len(grams) > 60:  # one that passes by chance weighs little
                assert abs(got[i]["score"] - first / sum(share.values())) < 0.1
    assert clear > 150 and agree == clear


def plain_features(text: str) -> set[str]:
    t = " ".join((text or "").lower().split())
    t = f" {t} " if t else ""
    return {t[i : i + k] for k in toxicity.SIZES for i in range(len(t) - k + 1)}


def labelled(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(i, " ".join(words(30, seed + i, 60) + r.sample(["grumble", "snarl", "hiss", "spit"], 2 * (i % 3 == 0))), int(i % 3 == 0)) for i in range(n)]


def test_toxicity_by_a_plain_gradient(spark):
    """Log-count ratios of plain sets of n-grams, and plain gradient steps to the same optimum."""
    rows = labelled(90, 3)
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    sets, y = [plain_features(t) for _, t, _ in rows], np.array([x[2] for x in rows])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    with_label = [Counter(g for s, v in zip(sets, y, strict=True) if v == k for g in s) for k in (0, 1)]
    s, ratio = toxicity.SMOOTH, {}
    for g in set(with_label[0]) | set(with_label[1]):
        c0, c1 = with_label[0][g], with_label[1][g]
        p = (c0 + c1 + s) / (n0 + n1 + 2 * s)
        if c0 + c1 > 2 and abs(c1 / n1 - c0 / n0) / math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12) > 3:
            ratio[g] = math.log((c1 + s) / (n1 + 2 * s) / ((c0 + s) / (n0 + 2 * s)))
    assert 10 < len(ratio) <= toxicity.FEATURES
    names = sorted(ratio)
    x = np.array([[ratio[g] * (g in own) for g in names] + [1.0] for own in sets])
    w = np.zeros(len(names) + 1)
    w[-1] = math.log((n1 + s) / (n0 + s))
    ridge = np.array([toxicity.RIDGE] * len(names) + [0.0])
    step = 1 / (0.25 * float((x**2).sum(axis=1).mean()) + toxicity.RIDGE)
    before = w
    for k in range(toxicity.STEPS):
        at = w + max(0, k - 1) / (k + 2) * (w - before)
        before, w = w, at - step * (x.T @ (1 / (1 + np.exp(-x @ at)) - y) / len(y) + ridge * at)
    want = 1 / (1 + np.exp(-x @ w))
    got = toxicity.predict(model, [t for _, t, _ in rows])
    assert np.abs(got - want).max() < 0.02 and ((got >= toxicity.THRESHOLD) == y).all()


def test_quality_by_plain_updates(spark, monkeypatch):
    """One learner's weights against updates of one coordinate at a time in plain dictionaries."""
    monkeypatch.setattr(quality, "LEARNERS", 1)
    rows = labelled(60, 9)
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    order = [r["doc_id"] for r in docs.withColumn("r", F.xxhash64("doc_id", "text")).orderBy("r", "doc_id").collect()]
    of = {i: (t, y) for i, t, y in rows}
    z, n = defaultdict(float), defaultdict(float)

    def leader(i) -> float:
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for i in order:
            text, y = of[i]
            value = defaultdict(float)
            for grams in quality.features([text])[0]:
                for g in grams.tolist():
                    value[g] += quality.SCALE / len(grams)
            value["bias"] = 1.0
            w = {f: leader(f) for f in value}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[f] * v for f, v in value.items())))))
            for f, v in value.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * w[f]
                n[f] += g * g
    want = {f: leader(f) for f in list(z)}
    assert abs(model["bias"] - want.pop("bias")) < 1e-6
    dense = np.zeros(1 << quality.BITS)
    dense[list(want)] = list(want.values())
    assert np.abs(model["w"] - dense).max() < 1e-5


def plain_components(links: list[tuple]) -> dict:
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for first in sorted(near):
        todo = [] if first in out else [first]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = first
                todo += near[x]
    return out


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, 5000) for i in range(3000)] + [(5000, 5000)], [(i, i + 1) for i in range(60)] + [(100, 90), (90, 100)], [(0, i) for i in range(1, 500)] + [(i, 9000 - i) for i in range(400, 900)] + [(9999, 450)]])
def test_components(spark, links):
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(plain := plain_components(links)) and {r["node"]: r["component"] for r in got} == plain


def test_jaccard_of_many_near_copies(spark):
    """One large group around one pivot, copies of its members, and sets just below the bar, by all pairs."""
    base = words(60, 1, 10_000)
    texts = {i: base[: 56 - i % 3] + [f"own{i % 130}", *base[57:]] for i in range(260)}
    texts |= {300 + i: words(40, 400 + i, 10_000) for i in range(20)} | {400 + i: base[: 30 + i] for i in range(30)}
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    plain = plain_components(links)
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components_by_jaccard(table).collect()}
    assert got == {d: (len(s), plain.get(d, d)) for d, s in sets.items()}


def plain_inclusions(sizes: list[int], need: float) -> list[float]:
    """Digits times a level, or 1: the level is raised until the words that are expected are those needed."""
    low, high = 0.0, 1.0
    for _ in range(200):
        level = (low + high) / 2
        expected = sum(min(1.0, level * len(f"{s:b}")) * s for s in sizes)
        low, high = (level, high) if expected < need else (low, level)
    return [min(1.0, low * len(f"{s:b}")) for s in sizes]


@pytest.mark.parametrize("share", [0.3, 0.8, 1.7])
def test_mixing_includes_by_size(spark, share):
    sizes = {"a": [3] * 3000 + [40] * 1500 + [600] * 300, None: [5] * 2000 + [0] * 10 + [90] * 500}
    rows, i = [], 0
    for source, of in sizes.items():
        for s in of:
            rows.append((i, source, "w " * s))
            i += 1
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4), weights=(1,), share=share, keep=["source"]).toPandas()
    assert len(got) == len(rows)
    for source, of in sizes.items():
        own = got[got["source"].isna() if source is None else got["source"] == source].sort_values("doc_id")
        total, target = sum(of), own["target"].iloc[0]
        assert list(own["size"]) == of and (own["source_size"] == total).all()
        whole = int(target // total)
        want = np.array(plain_inclusions(of, target - whole * total))
        more = own["copies"].to_numpy() - whole * (own["size"].to_numpy() > 0)
        assert abs(own["taken"].sum() - target) <= max(of) / 2
        for s in set(of) - {0}:
            at = own["size"].to_numpy() == s
            p = want[at][0]
            assert set(more[at]) <= {0, 1} and (p < 1 or more[at].all())
            assert abs(more[at].mean() - p) < 4 * np.sqrt(p * (1 - p) / at.sum()) + 0.02
        assert (own["copies"][own["size"] == 0] == 0).all()
