"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import centroids, licenses, mixing, ngram_join, packing, phrases, private, quality, substring, suffix, topk, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"
TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_places").alias("places"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def toxicity_model(spark: SparkSession, sf_dir: str):
    """The model for the table documents: labels whose id's crc32 leaves 2 of 4 stay unseen."""
    labels = _table(spark, sf_dir, "labels")
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels.filter(~toxicity.held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.score(_table(spark, sf_dir, "documents"), *toxicity_model(spark, sf_dir))
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.dedup(_table(spark, sf_dir, "documents"), carry=[])
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.dedup(_table(spark, sf_dir, "documents"), carry=[])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = private.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, private.KINDS), F.sha2(private.listed("spans", lambda s: s["plain"]), 256).alias("base_sha256"), private.listed("spans").alias("spans"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_sql() -> str:
    known = " UNION ALL ".join(f"SELECT {_sql_str(s)} AS s, {_sql_str(i)} AS id" for s, i in licenses.SENTENCES.items())
    line = "line"
    for n, (_, ids, _) in enumerate(licenses.RULES):
        line = f"replace({line}, {_sql_str(' ' + '  '.join(ids) + ' ')}, ' #{n} ')"
    rules = " UNION ALL ".join(f"SELECT '#{n}' AS r, {_sql_str(r[0])} AS license, {_sql_str(r[2])} AS kind" for n, r in enumerate(licenses.RULES))
    return f"""
WITH known AS ({known}), rules AS ({rules}),
parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[.;:!?]+(?:[ \\t-\\r]+|$)|[\\n-\\r]+')) AS s,
                 generate_subscripts(string_split_regex(coalesce(text, ''), '[.;:!?]+(?:[ \\t-\\r]+|$)|[\\n-\\r]+'), 1) AS i FROM documents),
norm AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[,"''()]', '', 'g'), '[ \\t-\\r]+', ' ', 'g'), ' ') AS s FROM parts),
hits AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM norm JOIN known USING (s) GROUP BY doc_id),
lines AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM hits),
matched AS (SELECT doc_id, ids, list_filter(string_split_regex(trim({line}, ' '), ' +'), lambda x: starts_with(x, '#')) AS rs FROM lines),
named AS (SELECT doc_id, list(license ORDER BY i) AS ls, first(license ORDER BY i) AS license, first(kind ORDER BY i) AS kind
          FROM (SELECT doc_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM matched) JOIN rules USING (r) GROUP BY doc_id),
firsts AS (SELECT doc_id, array_to_string(list(license ORDER BY i), ',') AS licenses
           FROM (SELECT doc_id, license, min(i) AS i FROM (SELECT doc_id, unnest(ls) AS license, generate_subscripts(ls, 1) AS i FROM named) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(m.ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(m.ids, ','), '') AS sentence_ids,
       coalesce(f.licenses, '') AS licenses, n.license, n.kind
FROM documents d LEFT JOIN matched m USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN firsts f USING (doc_id)"""


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_B32}',
        ((('0x' || substr(h, (10 * (i // 8) + 1)::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""




def _centroids_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))"""]
    for r in range(rounds + 1):
        # The least pair (distance, number), as one number.
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, vec_id, any_value(v.e) AS e, min(list_sum(list_transform(list_zip(v.e, c.e), lambda p: ((p[1] - p[2]) * (p[1] - p[2]))::HUGEINT)) * {k} + c.c) AS best FROM v, c{r} c GROUP BY row, vec_id)""")
        steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT old.c, coalesce(new.e, old.e) AS e FROM c{r} old LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM (
    SELECT (best % {k})::BIGINT AS c, j, sum(e[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {dims + 1}) t(j) GROUP BY ALL) GROUP BY c) new USING (c))""")
    return "WITH " + ",".join(steps[:-1]) + f""",
f AS (SELECT vec_id, (best % {k})::INT AS cluster, (best // {k})::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = f.cluster"""


_PHRASES_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row, lang, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT row, lang, string_split_regex(t, '[.,;:!?\n-\r]') AS x FROM d)),
w AS (SELECT row, lang, i, unnest(x) AS w1, generate_subscripts(x, 1) AS j FROM (SELECT row, lang, i, regexp_extract_all(piece, '[^ \t]+') AS x FROM p)),
g AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY row, i ORDER BY j)),
f AS MATERIALIZED (SELECT lang, [w1] AS s, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) AS f FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(s) = 1 GROUP BY lang),
c AS (SELECT lang, s, f AS a FROM f WHERE len(s) > 1),
inside AS (SELECT lang, s[x : x + m - 1] AS s, max(f) AS longer FROM c JOIN f USING (lang, s), range(2, 4) t(m), range(1, 4) u(x) WHERE m < len(s) AND x + m - 1 <= len(s) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, s) WHERE longer IS NULL OR 100 * longer < 80 * a),
cut AS (SELECT lang, s, a, k, s[1 : k] AS head, s[k + 1 : len(s)] AS tail FROM kept, range(1, 4) t(k) WHERE k < len(s)),
scored AS (SELECT cut.lang, cut.s, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
           FROM cut JOIN f h ON h.lang = cut.lang AND h.s = head JOIN f t ON t.lang = cut.lang AND t.s = tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, k) AS pick FROM scored),
ranked AS (SELECT lang, array_to_string(s, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(s, ' ')) AS rank FROM best WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_ngram_join": op4_ngram_join,
        "op5_topk": op5_topk,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_licenses": op8_licenses,
        "op9_substring": op9_substring,
        "op10_suffix": op10_suffix,
        "op11_private": op11_private,
        "op12_centroids": op12_centroids,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _WARC_SQL, "op5_topk": _TOPK_SQL, "op8_licenses": _license_sql(), "op12_centroids": _centroids_sql(), "op13_phrases": _PHRASES_SQL}
