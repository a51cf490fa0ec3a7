"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm import audit, bytebpe, debruijn, decontam, fingerprint, hmm, langid, linededup, neardup, segment, toxic, trie, warc
from cleanframe.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.fingerprint_components(table(spark, sf_dir, "documents"), ngram=4, radius=4)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduped_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_rate=0.2, min_words=8)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(langid.learned(docs)))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxic.score(docs, toxic.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeat_digests(table(spark, sf_dir, "documents"), window=20)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def piece_model() -> str:
    """The public piece vocabulary on this machine; the operators take any model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample_digests(table(spark, sf_dir, "documents"), piece_model(), k=2, alpha=0.5)


def byte_vocabulary() -> tuple[str, str]:
    """The public byte vocabulary on this machine and its pattern; the operators take any file and pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_digests(table(spark, sf_dir, "documents"), *byte_vocabulary())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_head_trie(table(spark, sf_dir, "conversations"), every=20, most=4)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_interaction": op13_filter_interaction,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
             r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
             d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             v AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
             f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM v),
             g AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) AS t(j) WHERE r > 1),
             x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
             y AS (SELECT x.doc_id, x.p, x.w[x.p] AS word, g.p IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p),
             z AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(z.n_removed, 0) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256
        FROM d LEFT JOIN z USING (doc_id)""",
    "op9_warc": """
        WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
             b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + (((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest FROM h),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM b)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN origin <> page_id THEN origin END AS refers_to FROM f""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
             k AS (SELECT conv_id, conv_id::VARCHAR AS s, count(*) AS n FROM t GROUP BY conv_id),
             c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS home, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(1, strlen(s) + 1), lambda j: ascii(s[j])::UBIGINT),
                       lambda x, b: list_reduce([xor(x, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)))::BIGINT % 4 AS h FROM k),
             r AS (SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.home AND t.i <= c.h
                   UNION ALL
                   SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN k b ON b.conv_id = c.home),
             p AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
                          list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
                   UNION ALL SELECT conv_id, 0, 0, [] FROM c),
             e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
             n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM e GROUP BY d, key),
             m AS (SELECT key[:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
             x AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN m USING (key)),
             a AS (SELECT key[:j] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
                   FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM x) GROUP BY 1)
        SELECT x.conv_id, x.d::BIGINT AS depth, CASE WHEN x.d > 0 THEN q.conv_id END AS parent_conv_id, x.n_convs, x.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
        FROM x JOIN a USING (key) LEFT JOIN n q ON x.d > 0 AND q.key = x.key[:x.d - 1]""",
    "op13_filter_interaction": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
             f AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS origin FROM d),
             l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
             m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                          CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
                          + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                          + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                          + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                          + CASE WHEN origin < f.doc_id THEN 16 ELSE 0 END AS mask
                   FROM f LEFT JOIN l USING (doc_id)),
             c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
             x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
             o AS (SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits FROM x x1, x x2, x x3, x x4, x x5
                   WHERE len(list_distinct([x1.f, x2.f, x3.f, x4.f, x5.f])) = 5),
             s AS (SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(k)),
             y AS (SELECT *, mask & own <> 0 AS fails, mask & before = 0 AS passed FROM c, s),
             z AS (SELECT part, filter_order, step, own,
                          coalesce(sum(n) FILTER (WHERE NOT fails AND passed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND passed), 0)::BIGINT AS removed,
                          coalesce(sum(n) FILTER (WHERE fails AND NOT passed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
                          coalesce(sum(n) FILTER (WHERE fails AND passed AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE fails AND passed AND toxic), 0)::BIGINT AS toxic_lost
                   FROM y GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM z""",
}
