"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest.

DataFrame functions only. A source is wanted ``target / source size`` times; every document gets the whole part of that
for certain. The words still missing are shared by documents with an inclusion probability that grows with a document's
size, as the number of its binary digits: it is that number times the source's level, or 1, and those that reach 1 get
one more copy for certain. The others are ranked by their random odds over their inclusion odds, and the source takes
them in that order for as long as its target is not reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: Ranks are summed in so many bins a level; two levels leave 1 in ``BINS ** 2`` of a source for an exact order.
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one small row for each source.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``max_repeat`` times its
    source; the excess goes to the others by weight. Sources are filled in the order of cap over weight, so those
    that stop are a prefix of that order and one pass settles all.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * F.lit(max_repeat)).cast("double")
    t = sizes.withColumn("w", w).withColumn("cap", cap)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_w).withColumn("stops", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    return t.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def digits(size: Column) -> Column:
    """What a document's inclusion grows with: its size's binary digits, at most 63 different numbers."""
    return F.length(F.bin(size))


def inclusions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, level, sure, rest) of every source: how its documents are included.

    ``sizes`` has (source, digits, size): the words of a source's documents of so many digits, one row each. All get
    ``whole`` copies, those of ``sure`` digits or more another one, and the others share the ``rest`` of the words: their
    inclusion probability is ``level`` times their digits. Classes are filled from the most digits, so that those that
    reach 1 are a prefix of that order and one pass over at most 63 rows of a source settles it.
    """
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumn("whole", F.floor(r)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    own = sizes.where("size > 0").withColumnsRenamed({"source": "of"})
    x = own.join(t, F.col("of").eqNullSafe(F.col("source")))
    all_of = Window.partitionBy("source")
    before = all_of.orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
    wide = F.col("digits") * F.col("size")
    left = F.col("need") - F.coalesce(F.sum("size").over(before), F.lit(0)).cast("double")
    open_words = (F.sum(wide).over(all_of) - F.coalesce(F.sum(wide).over(before), F.lit(0))).cast("double")
    x = x.withColumn("level", left / open_words).withColumn("full", F.col("digits") * F.col("level") >= 1)
    full = F.col("full")
    found = x.groupBy(F.col("source").alias("of")).agg(F.max(F.when(~full, F.col("level"))).alias("level"), F.min(F.when(full, F.col("digits"))).alias("sure"), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("given"))
    rest = F.col("need") - F.coalesce(F.col("given"), F.lit(0))
    return t.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "whole", "level", "sure", rest.alias("rest"))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 52 bits of the key's MD5: the same on every run and engine."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row, and the columns named in ``keep``.

    ``copies`` is how often the mix repeats the document. A null text has size 0; a document of size 0 is never
    repeated. A null source is one of its own. A null id is ranked as the empty id. Ties in rank are broken by id
    and then by size; rows equal in both are alike. A very long text is one document like any other, so a source may miss
    its target by half of the longest that is ranked. An empty table gives an empty mix; columns of any name pass in
    ``keep`` but for those of the outputs' names.
    """
    keep = keep or []
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), size.alias("__size"), F.col(source_col).alias("__source"), F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__key"), *[F.col(f"`{c}`") for c in keep])
    # a few numbers for each document, kept: all that follows but the last pass reads these and no text
    slim = cut(rows.select("__id", "__size", "__source", "__key"))
    classes = cut(slim.groupBy(F.col("__source").alias("source"), digits(F.col("__size")).alias("digits")).agg(F.sum("__size").alias("size")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    targets = cut(inclusions(classes, targets))
    targets = targets.select(F.col("source").alias("__of"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "level", "sure", "rest")])
    u = uniform(F.col("__key"))
    odds = (u / (1 - u)) / (F.col("__part") / (1 - F.col("__part")))

    def rated(frame: DataFrame) -> DataFrame:
        """With each document's certain copies, and its odds over odds, brought to [0, 1) without a change of order."""
        x = frame.join(targets, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("__digits", digits(F.col("__size")))
        sure = F.coalesce(F.col("__digits") >= F.col("__sure"), F.lit(False))
        x = x.withColumn("__sure_copies", F.col("__whole") + sure.cast("long")).withColumn("__part", F.when(sure, 0.0).otherwise(F.col("__level") * F.col("__digits")))
        return x.withColumn("__q", F.when((F.col("__part") > 0) & (F.col("__size") > 0), odds / (1 + odds)))

    ranked = rated(slim).where(F.col("__q").isNotNull())

    # Level one: sums of bins; the bin in which a source's rest runs out is opened again, and ranked row by row.
    def crossing(frame: DataFrame, keys: list[str], bin_name: str) -> DataFrame:
        sums = frame.groupBy("__source", *keys, bin_name).agg(F.sum("__size").alias("s"), F.first("__need").alias("need"))
        below = F.coalesce(F.sum("s").over(Window.partitionBy("__source", *keys).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sums.withColumn("below", below).where((F.col("below") < F.col("need")) & (F.col("below") + F.col("s") >= F.col("need"))).select(F.col("__source").alias("of"), F.col(bin_name).alias("cut"), (F.col("need") - F.col("below")).alias("left"))

    b1, b2 = F.floor(F.col("__q") * BINS), F.pmod(F.floor(F.col("__q") * BINS * BINS), F.lit(BINS))
    ranked = ranked.select("__source", "__size", "__id", "__q", F.col("__rest").alias("__need"), b1.alias("__b1"), b2.alias("__b2"))
    c1 = crossing(ranked, [], "__b1")
    inner = ranked.join(c1, F.col("__source").eqNullSafe(F.col("of")) & (F.col("__b1") == F.col("cut"))).withColumn("__need", F.col("left")).drop("of", "cut", "left")
    c2 = crossing(inner, [], "__b2")
    last = inner.join(c2, F.col("__source").eqNullSafe(F.col("of")) & (F.col("__b2") == F.col("cut"))).withColumn("__need", F.col("left")).drop("of", "cut", "left")
    order = Window.partitionBy("__source").orderBy("__q", "__id", "__size")
    last = last.withColumn("upto", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    # the document that crosses the target is taken if that comes nearer to it
    last = last.where(F.col("upto") - F.col("__size") / 2.0 <= F.col("__need"))
    edge = last.groupBy(F.col("__source").alias("e_source")).agg(F.max(F.struct("n", F.col("__q").alias("q"), F.col("__id").alias("id"), F.col("__size").alias("size"))).alias("m"))
    c1 = c1.select(F.col("of").alias("c1_source"), F.col("cut").alias("c1"))
    c2 = c2.select(F.col("of").alias("c2_source"), F.col("cut").alias("c2"))
    cuts = c1.join(c2, F.col("c1_source").eqNullSafe(F.col("c2_source")), "left").join(edge, F.col("c1_source").eqNullSafe(F.col("e_source")), "left").select("c1_source", "c1", "c2", "m")
    y = rated(rows if keep else slim).join(cut(cuts), F.col("__source").eqNullSafe(F.col("c1_source")), "left")
    same = (b1 == F.col("c1")) & (b2 == F.col("c2"))
    at_edge = F.struct(F.col("__q").alias("q"), F.col("__id").alias("id"), F.col("__size").alias("size")) <= F.struct(F.col("m.q").alias("q"), F.col("m.id").alias("id"), F.col("m.size").alias("size"))
    drawn = F.when(F.col("__q").isNull(), False).when(F.col("c1").isNull(), False).otherwise((b1 < F.col("c1")) | ((b1 == F.col("c1")) & (b2 < F.col("c2"))) | F.coalesce(same & at_edge, F.lit(False)))
    copies = F.when(F.col("__size") > 0, F.col("__sure_copies") + drawn.cast("long")).otherwise(F.lit(0)).cast("long")
    out = [F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken")]
    names = {"doc_id", "size", "source_size", "target", "copies", "taken"}
    return y.select(*out, *[F.col(f"`{c}`") for c in keep if c.lower() not in names])


def mixed_rows(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    name = free_name(docs, "__row")
    packed = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    got = mix(packed, keep=[name], **kwargs)
    return got.where(F.col("copies") > 0).select(F.explode(F.array_repeat(name, F.col("copies").cast("int"))).alias("r")).select("r.*")
