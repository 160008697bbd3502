"""Queries of the operators over whole tables, and the SQL that must give the same rows where there is any."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import functions as F

from crawlatlas.llm import (
    bpe, fim, jaccard, langid, lexical, licenses, mixing, packing, pii, spotsigs, topk, trainorder, warc,
)
from crawlatlas.llm.common import materialize, scratch
from crawlatlas.sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    """Three-word shingles, links at 90 %."""
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), 3, Fraction(90, 100))


@query("op2_warc", """
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
    FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                 list_reduce(list_transform(range(0, 32), lambda i:
                     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
                       (('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * CAST(floor(i / 4) AS INTEGER), 5))::BIGINT
                        >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)::INTEGER, 1)), lambda a, b: a || b) AS payload_digest,
                 max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
          FROM pages) p""")
def op2(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write(load(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    digest = warc.base32(F.sha1("payload"))
    stated = F.concat(F.lit("sha1:"), digest) == warc.field("WARC-Payload-Digest")
    checked = F.when(stated, digest).otherwise(F.raise_error(F.lit("a header states another digest")).cast("string"))
    return records.select(
        warc.field("X-Page-Id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        checked.alias("payload_digest"), warc.field("WARC-Type").alias("record_type"),
        warc.field("X-Refers-To-Page-Id").cast("long").alias("refers_to"))


@query("op3_pii")
def op3(spark, sf_dir):
    found = pii.find(load(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS], F.sha2(pii.shown("base"), 256).alias("base_sha256"), pii.shown("spans").alias("spans"))


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = langid.learn(*langid.sample(docs))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op5_spotsigs")
def op5(spark, sf_dir):
    return spotsigs.compare_with_next(load(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    cut = packing.pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return packing.pack(cut, 2048)


@query("op7_training_order")
def op7(spark, sf_dir):
    """Sequences of 512 ids in the order of key 20240101, read back from shards of 2048."""
    docs = load(spark, sf_dir, "documents")
    path = trainorder.materialise(docs, public_tokenizers.path("byte_bpe_50k.json"), 512, 50256, 20240101, 2048)
    return trainorder.digests(spark, path, 512, 2048)


@query("op8_bpe")
def op8(spark, sf_dir):
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP9_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                      CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op9_exact_top_k", OP9_SQL)
def op9(spark, sf_dir):
    return topk.search(load(spark, sf_dir, "embeddings"), 5, lambda vec_id: vec_id % 50 == 0)


@query("op10_license_scan")
def op10(spark, sf_dir):
    return licenses.scan(load(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
         u AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                      ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
         f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
         p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                  ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p""")
def op11(spark, sf_dir):
    rows = fim.restore(fim.transform(load(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = """
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
         s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY 1),
         w AS (SELECT *, list_element([3, 1, 2], CAST((k - 1) % 3 + 1 AS BIGINT)) AS weight FROM s),
         r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS filled FROM w),
         c AS (SELECT *, coalesce(sum(source_size) OVER p, 0)::DOUBLE AS size_before, coalesce(sum(weight) OVER p, 0)::DOUBLE AS weight_before,
                      sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights
               FROM r WINDOW p AS (ORDER BY filled, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         e AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * size_before) / (weights - weight_before) AS level FROM c),
         l AS (SELECT arg_min(level, (filled, k)) FILTER (WHERE level < filled) AS found FROM e),
         t AS (SELECT source, source_size, CASE WHEN found IS NULL THEN 2.0::DOUBLE * source_size
                      ELSE least(2.0::DOUBLE * source_size, weight * found) END AS target FROM e, l),
         n AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, ('0x' || substr(h, 1, 8))::BIGINT AS a,
                      ('0x' || substr(h, 9, 8))::BIGINT AS b, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
         g AS (SELECT n.*, x.draw, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN (a + x.draw * b) % 4294967296 < (rate - floor(rate)) * 4294967296 THEN 1 ELSE 0 END) AS taken
               FROM n, (SELECT unnest(range(0, 32)) AS draw) x),
         o AS (SELECT source, draw, abs(sum(taken) - any_value(target)) AS off FROM g GROUP BY 1, 2),
         b AS (SELECT source, arg_min(draw, (off, draw)) AS draw FROM o GROUP BY 1)
    SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken
    FROM g JOIN b ON g.draw = b.draw AND g.source IS NOT DISTINCT FROM b.source"""


@query("op12_source_mix", OP12_SQL)
def op12(spark, sf_dir):
    """Weights 3, 1, 2 over and over, 150 % of all words, no source more than twice."""
    rows = mixing.measured(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sizes = materialize(rows.select(F.col("doc")["doc_id"].alias("doc_id"), "source", "size", "a", "b"), "sizes")
    plan = mixing.planned(sizes, mixing.targets(sizes))
    return mixing.drawn(sizes, plan).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
         g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
         tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) x GROUP BY ALL),
         q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, g GROUP BY term),
         s AS (SELECT q.item_id, tf.r, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * g.n_docs) // g.n_terms)))) AS BIGINT) AS score
               FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = q.term, g GROUP BY ALL),
         k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark, sf_dir):
    return lexical.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), 50)
