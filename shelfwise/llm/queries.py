"""The operators applied to the given tables: one query per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (conversation_trie, fingerprints, html_extract, jaccard_join, langid, lexical_search, line_dedup, packing, pq_dedup,
                           quality, spm_lattice, toxicity, warc)
from shelfwise.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, as count and checksum, and the decoded text, as digest and comparison."""
    docs = read_table(spark, sf_dir, "documents")
    both = docs.select("doc_id", "text", spm_lattice.code_column()(F.col("text")).alias("c"))
    return both.select("doc_id", (F.length("c.ids") / 4).cast("long").alias("n_pieces"), F.crc32("c.ids").alias("ids_crc32"),
                       F.sha2(F.encode("c.decoded", "UTF-8"), 256).alias("decoded_sha256"),
                       (F.col("c.decoded") == F.col("text")).alias("round_trip"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.shingle_components(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(read_table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             u AS MATERIALIZED (SELECT k, vec_id, e, len(e) AS n FROM v
                   WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                         AND len(list_filter(e, lambda x: x <> 0)) > 0),
             l AS MATERIALIZED (SELECT a.k AS a, b.k AS b, b.vec_id AS id FROM u a JOIN u b ON a.n = b.n AND a.k <> b.k
                                WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
             r(k, id) AS (SELECT k, vec_id FROM v WHERE vec_id IS NOT NULL
                          UNION SELECT l.a, r.id FROM r JOIN l ON l.b = r.k),
             c AS (SELECT k, min(id) AS component_id FROM r GROUP BY k),
             n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v LEFT JOIN n USING (k) LEFT JOIN c USING (k)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
             d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND f.payload_digest = d.payload_digest
    """,
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^ \t\n\x0B\x0C\r]+') AS words FROM documents),
             x AS (SELECT k, len(words) AS size, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
             y AS (SELECT k, size, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5
                   FROM x WINDOW o AS (PARTITION BY k ORDER BY i)),
             z AS (SELECT k, list_sort(list(DISTINCT hash(concat_ws(' ', w1, w2, w3, w4, w5)))) AS shingles FROM y
                   WHERE w5 IS NOT NULL OR (size < 5 AND i = 1) GROUP BY k),
             s AS MATERIALIZED (SELECT w.k, w.doc_id, coalesce(z.shingles, []) AS shingles FROM w LEFT JOIN z USING (k)),
             g AS MATERIALIZED (SELECT row_number() OVER () AS g, min(doc_id) AS id, shingles, CAST(len(shingles) AS BIGINT) AS n
                                FROM s WHERE len(shingles) > 0 GROUP BY shingles),
             t AS MATERIALIZED (SELECT g, n, unnest(shingles) AS shingle FROM g),
             f AS (SELECT shingle, count(*) AS df FROM t GROUP BY shingle),
             o AS (SELECT t.*, row_number() OVER (PARTITION BY g ORDER BY df, shingle) AS place FROM t JOIN f USING (shingle)),
             p AS MATERIALIZED (SELECT g, n, shingle FROM o WHERE place <= n - (75 * n + 99) // 100 + 1),
             h AS (SELECT DISTINCT a.g AS a, b.g AS b FROM p a JOIN p b ON a.shingle = b.shingle AND a.g < b.g
                   AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
             l AS (SELECT h.a, h.b FROM h JOIN g x ON x.g = h.a JOIN g y ON y.g = h.b,
                   LATERAL (SELECT len(list_intersect(x.shingles, y.shingles)) AS shared) WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
             e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(g, id) AS (SELECT g, id FROM g WHERE id IS NOT NULL UNION SELECT e.b, r.id FROM r JOIN e ON e.a = r.g),
             c AS (SELECT g, min(id) AS component_id FROM r GROUP BY g)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
        FROM s LEFT JOIN g ON g.shingles = s.shingles LEFT JOIN c USING (g)
    """,
    "op11_conversation_prefix_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             -- CRC-32 of the decimal id, bit by bit
             i AS (SELECT conv_id, conv_id - conv_id % 5 AS source, xor(list_reduce(flatten([[4294967295]] || list_transform(
                              string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                          lambda s, e: xor(xor(s, e) >> 1, 3988292384 * (xor(s, e) & 1))), 4294967295) % 9 AS h
                   FROM (SELECT DISTINCT conv_id FROM t)),
             b AS (SELECT i.conv_id, pos, role, text FROM i JOIN t ON t.conv_id = i.source AND pos <= h
                   UNION ALL SELECT i.conv_id, pos, role, text FROM i JOIN t ON t.conv_id = i.conv_id AND pos > h),
             l AS (SELECT i.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns
                   FROM i LEFT JOIN b ON b.conv_id = i.conv_id GROUP BY i.conv_id),
             p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM l),
             n AS (SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                          any_value(CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END) AS bytes,
                          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
                   FROM p GROUP BY prefix, depth),
             c AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]),
             k AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
             f AS (SELECT c.*, coalesce(n_children, 0) AS n_children FROM c LEFT JOIN k USING (prefix, depth)),
             s AS (SELECT a.prefix, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
                   FROM f AS d, LATERAL (SELECT d.prefix[1:x] AS prefix FROM (SELECT unnest(range(d.depth + 1)) AS x)) AS a GROUP BY a.prefix)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
        FROM f JOIN s USING (prefix)
    """,
    "op12_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT r, doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             s AS (SELECT key AS repeated, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key
                   HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
             m AS (SELECT r, doc_id, pos, line, repeated IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone
                   FROM k LEFT JOIN s ON key = repeated)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r, doc_id
    """,
    "op13_ranked_lexical_search": """
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
             d AS (SELECT r, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
             c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
             p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
             w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
                   FROM p, c GROUP BY term),
             q AS (SELECT DISTINCT b, item_id, unnest(terms) AS term FROM (
                       SELECT row_number() OVER () AS b, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM benchmark)),
             s AS (SELECT b, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
                   FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY b, item_id, r, doc_id),
             o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS INTEGER) AS rank
                   FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
    """,
}
