"""Thin queries over the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, divergence, isomedia, langid, lm, mixing, neardup, pii, resample, suffixdedup, topk, warczip
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k, of="base": F.size(F.filter(of, lambda s: s["k"] == k)).cast("bigint").alias(f"n_{pii.KINDS[k]}")
    spans = F.array_sort(F.concat("base", "added"))
    n = len(pii.BASE_KINDS)
    more = [count(k, "added") for k in range(n, len(pii.KINDS))]
    return found.select(F.col("id").alias("doc_id"), *map(count, range(n)), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), *more, F.size(spans).cast("bigint").alias("n_spans"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = isomedia.store_media(table(spark, sf_dir, "documents"))
    return isomedia.media_features(media)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), F.col("text"), F.col("lang"), F.col("source"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language operator over web pages, where markup, address suffix and host all speak."""
    return langid.identify(table(spark, sf_dir, "pages"), langid.visible_text(F.col("html")), langid.markup_language(F.col("html")), langid.host_of(F.col("url")), id_col="page_id")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("first", "k")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.corpus_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rounds=1, whole_words=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.archive_roundtrip(table(spark, sf_dir, "pages")).drop("record_offset", "record_bytes")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False, digests=True)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False, passages=True).drop("spans")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.where(F.col("id") % 20 == 0), vectors)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_media, op3_langid, langid_pages, op4_neardup, op5_lm, op6_warc, op7_bpe, op8_mix, op9_repeats, op10_topk, op11_divergence, op12_resample, op13_near_vectors)}

_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * b + 1}, 5))::bigint // {32 ** (3 - i)})::bigint % 32 + 1, 1)" for b in range(8) for i in range(4))

ORACLE: dict[str, str] = {
    "op4_neardup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE r(a, b) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b) SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT h AS th, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t ON h = th""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS n FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n)::hugeint AS a FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.t, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.t = o.t GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n)::hugeint AS a FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(s.a, 0) + 2 * l.v) AS p, 1 + 1000000000::hugeint * (k.n + 2) // (l.a + 2 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON b.lang = a.lang AND b.t = a.t AND b.source <> a.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0)::bigint AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q) // (p + q))::bigint FROM p WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 10""",
    "op12_resample": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
u AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM d UNION ALL SELECT unnest(w) FROM b)),
c AS (SELECT w, flatten(list_transform(range(1, strlen(w) + 1), lambda i: [('0x' || substr(hex(w), 2 * i - 1, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) AS x FROM u),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::bigint, x), lambda h, y: CASE WHEN y >= 0 THEN xor(h, y) ELSE xor(h >> 1, (h & 1) * 3988292384::bigint) END), 4294967295::bigint) % 10000 AS k FROM c),
s AS (SELECT k, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) JOIN k USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN k USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::double + 10000) / ((coalesce(s.n, 0)::double + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::double + 10000))))::bigint AS g FROM s FULL JOIN t USING (k)),
f AS (SELECT r, count(*) AS n, floor(sum(g)::double / count(*))::bigint AS weight FROM (SELECT r, unnest(w) AS w FROM d) JOIN k USING (w) JOIN g USING (k) GROUP BY r),
h AS (SELECT d.r, d.doc_id, len(d.w) AS words, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint AS h FROM d LEFT JOIN f ON f.r = d.r),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint AS score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM x WHERE words >= 20)
SELECT x.doc_id, x.n_features, x.weight, x.score, o.rank FROM x LEFT JOIN o ON o.r = x.r AND o.rank <= 10 * o.n // 100""",
    "op13_near_vectors": """
WITH v AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON b.label = a.label AND b.vec_id <> a.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (WITH RECURSIVE r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.root, v.vec_id) AS component_id, coalesce(r.root, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN r ON r.a = v.vec_id""",
}
