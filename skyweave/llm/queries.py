"""The operators as registered queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lexical, line_dedup, mixing, prefix_bpe, quality, suffix_dedup, token_output, topk, toxicity, yinyang
from .common import lean_batches

#: Files of the installed public tokenizers.
TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(3) != 1))
    rows = docs.select("doc_id", "text", (fold(3) == 1).alias("held_out"))
    return langid.identify(rows, model, keep=["doc_id", "held_out"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_by_jaccard(_table(spark, sf_dir, "documents"))


def _classified(spark: SparkSession, sf_dir: str, module, label: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = module.fit(docs, labels.where(fold(4) != 2), label_col=label)
    rows = docs.select("doc_id", "text", (fold(4) == 2).alias("held_out"))
    return module.score(rows, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= module.THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, "quality")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read(spark, token_output.write(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(_table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(WORD_TOKENIZER)
    rows = prefix_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_decontamination, op4_jaccard_join, op5_toxicity, op6_suffix_dedup, op7_mixing, op8_top_k, op9_quality, op10_token_output, op11_centroid_clustering, op12_bpe, op13_lexical_search)}


LINE_DEDUP_SQL = """
WITH blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws),
split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line, blanks),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.last AS dropped FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM word)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM size UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.a = d.doc_id
"""

MIXING_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
  (2 * source_size)::DOUBLE AS cap FROM per),
filled AS (SELECT *, ((1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE) - coalesce(sum(cap) OVER f, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0.0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap / w <= level AS stops FROM filled),
target AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE w * max(CASE WHEN NOT stops THEN level END) OVER () END AS target FROM flagged),
wanted AS (SELECT *, target - whole * source_size AS need
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END AS whole FROM target)),
class AS (SELECT source, length(bin(size))::BIGINT AS digits, sum(size)::BIGINT AS s FROM sized WHERE size > 0 GROUP BY ALL),
levels AS (SELECT c.source, c.digits, c.s, (t.need - (coalesce(sum(c.s) OVER b, 0))::DOUBLE) / (sum(c.digits * c.s) OVER p - coalesce(sum(c.digits * c.s) OVER b, 0))::DOUBLE AS level
  FROM class c JOIN wanted t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW p AS (PARTITION BY c.source), b AS (PARTITION BY c.source ORDER BY c.digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
included AS (SELECT source, max(level) FILTER (WHERE digits * level < 1) AS level, min(digits) FILTER (WHERE digits * level >= 1) AS sure,
  coalesce(sum(s) FILTER (WHERE digits * level >= 1), 0)::BIGINT AS given FROM levels GROUP BY source),
rated AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.whole, t.need - coalesce(i.given, 0) AS rest,
  coalesce(length(bin(s.size)) >= i.sure, false) AS certain, i.level * length(bin(s.size)) AS part,
  (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN wanted t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN included i ON s.source IS NOT DISTINCT FROM i.source),
ratio AS (SELECT *, CASE WHEN NOT certain AND part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS o FROM rated),
ranked AS (SELECT *, o / (1 + o) AS q FROM ratio),
summed AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, target, ((whole + certain::INT + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""

TOP_K_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INT AS rank, vec_id, score FROM placed WHERE place <= 5
"""


_ASSIGN = """d{r} AS MATERIALIZED (SELECT v.rid, v.vec_id, v.v, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept v, c{r} c),
a{r} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{r} GROUP BY rid, vec_id, v),"""
_MOVE = """m{r} AS (SELECT cluster, part, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS part FROM a{r}) GROUP BY cluster, part),
l{r} AS (SELECT cluster, list(x ORDER BY part) AS c FROM m{r} GROUP BY cluster),
c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(l.c, c.c) AS c FROM c{r} c LEFT JOIN l{r} l ON l.cluster = c.cluster),"""


def clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """Full scans, round by round."""
    turns = "\n".join(_ASSIGN.format(r=r) + (_MOVE.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})),
{turns}
i AS (SELECT cluster, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY cluster)
SELECT a.vec_id, a.cluster::INT AS cluster, a.d::BIGINT AS distance, i.s AS cluster_inertia, (SELECT sum(s) FROM i)::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.cluster = a.cluster JOIN c{rounds} c ON c.cluster = a.cluster
"""


LEXICAL_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT (count(*) FILTER (WHERE len(w) > 0))::BIGINT AS big_n, coalesce(sum(len(w)), 0)::BIGINT AS big_l FROM doc),
asked AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
want AS (SELECT DISTINCT item, item_id, unnest(w) AS t FROM asked),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM want) GROUP BY rid, t),
weight AS (SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY t, big_n),
impact AS (SELECT tf.rid, d.doc_id, tf.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * big_n) // big_l))) AS x
  FROM tf JOIN weight USING (t) JOIN doc d USING (rid), total),
scored AS (SELECT item, item_id, rid, doc_id, sum(x)::BIGINT AS score FROM want JOIN impact USING (t) GROUP BY ALL HAVING sum(x) > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": clustering_sql(), "op13_lexical_search": LEXICAL_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op4_jaccard_join": JACCARD_SQL, "op7_mixing": MIXING_SQL, "op8_top_k": TOP_K_SQL}
