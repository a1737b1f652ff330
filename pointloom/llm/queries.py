"""The registry of this subpackage: production queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def toxicity_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, score

    docs = _read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, _read(spark, sf_dir, "labels"), toxicity_held_out()))
    return scored.select("doc_id", toxicity_held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    return digested(pack(pieces(_read(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def digested(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import scores

    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    out = scores(_read(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import assign

    plan = assign(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse, render

    return render(collapse(_read(spark, sf_dir, "conversations")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are sources; their paths are languages, as the first path segment of the pages' addresses is."""
    from .quality import assess

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), held_out)
    return out.select("doc_id", "site", "path", held_out.alias("held_out"), "evidence", "site_rate", "path_rate", "score", "keep")


def quality_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are hosts, paths the first segment of their addresses; evidence is that of the documents' classifier."""
    from .quality import assess_pages

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return assess_pages(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), held_out)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find

    found = find(_read(spark, sf_dir, "documents"))
    number = {k: F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE}
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = joined(F.filter("spans", lambda x: x["kind"].isin(*BASE)))
    return found.select("doc_id", *number.values(), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import COUNTS, assess

    return assess(_read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restore

    made = restore(fill_in_middle(_read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_align import align

    return align(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op11_quality_rules": op11_quality_rules,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality": op9_quality,
    "quality_of_pages": quality_of_pages,
    "op6_lm_scoring": op6_lm_scoring,
    "op3_topk": op3_topk,
    "op5_ann": op5_ann,
    "op2_toxicity": op2_toxicity,
    "op1_ngram_join": op1_ngram_join,
    "op4_packing": op4_packing,
    "op10_pii": op10_pii,
    "op7_mixing": op7_mixing,
}

#: Shingles as lists of words; links by counting shared ones; components by a recursive closure.
_OP1_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT g FROM members GROUP BY g HAVING count(*) > 1),
few AS (SELECT * FROM members WHERE g IN (SELECT g FROM shared)),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""

_OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

_OP8_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
conv AS (
    SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS l FROM turns GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, l FROM conv GROUP BY n, l),
starts AS (SELECT DISTINCT k, l[1:k] AS p FROM (SELECT l, unnest(range(1, n)) AS k FROM one))
SELECT conv_id, n AS n_turns, n_copies, array_to_string(list_transform(l, lambda x:
    '<|' || coalesce(x.r, 'unknown') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), '') AS text
FROM one LEFT JOIN starts ON starts.k = one.n AND starts.p = one.l WHERE starts.k IS NULL
"""

_OP11_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT r, pos FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
again AS (SELECT r, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
c AS (
    SELECT w.r, doc_id, lang, source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN again USING (r)),
m AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END AS word_length, CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars END AS symbol_share,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines END AS line_share, CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words END AS repeat_share FROM c),
e AS (
    SELECT lang, source, unnest(['word_length', 'symbol_share', 'line_share', 'repeat_share']) AS measure, unnest([word_length, symbol_share, line_share, repeat_share]) AS v
    FROM m WHERE NOT base_failed),
b AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 7)::BIGINT) << (length(bin(v)) - 7)::BIGINT END AS lo FROM e WHERE v IS NOT NULL),
of_source AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
of_lang AS (SELECT lang, measure, count(*) AS n, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
of_all AS (SELECT measure, quantile_disc(lo, 0.25) AS q1, quantile_disc(lo, 0.75) AS q3 FROM b GROUP BY ALL),
q AS (
    SELECT s.lang, s.source, s.measure, CASE WHEN s.n >= 100 THEN s.q1 WHEN l.n >= 100 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN s.n >= 100 THEN s.q3 WHEN l.n >= 100 THEN l.q3 ELSE a.q3 END AS q3
    FROM of_source s JOIN of_lang l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure JOIN of_all a ON s.measure = a.measure),
f AS (
    SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN q1 - 4 * greatest(q3 - q1, 100) END AS least,
        q3 + 4 * greatest(q3 - q1, CASE measure WHEN 'word_length' THEN 100 WHEN 'symbol_share' THEN 50 WHEN 'line_share' THEN 1000 ELSE 500 END) AS most FROM q),
outside AS (
    SELECT DISTINCT m.r FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source,
    LATERAL (SELECT CASE measure WHEN 'word_length' THEN word_length WHEN 'symbol_share' THEN symbol_share WHEN 'line_share' THEN line_share ELSE repeat_share END AS v) x
    WHERE x.v < f.least OR x.v > f.most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept FROM m
"""

_OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, length(x) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(x) AS restored_sha256 FROM p
"""

SQL: dict[str, str] = {
    "op11_quality_rules": _OP11_SQL,
    "op12_fill_in_middle": _OP12_SQL,
    "op8_chat_formatting": _OP8_SQL,
    "op3_topk": _OP3_SQL,
    "op1_ngram_join": _OP1_SQL,
}
