"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import decontam, html_text, jaccard, mixing, quality, sharding, substring, token_counts, token_files, topk, tries, variants, warc
from spanframe.llm.common import materialize, scratch, word_count


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = materialize(docs, "sizes")  # the texts are read once
    return mixing.mix(docs, "size").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    docs = sharding.interleave(materialize(docs, "sizes"), 16)
    return docs.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_output(spark, docs, tokenizer_path("word_bpe_49k.json"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(tries.ordered_turns(_table(spark, sf_dir, "conversations")), "turns")
    return tries.prefix_trie(*tries.forked(turns))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_text": op4_html_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_interleave_shards": op7_interleave_shards,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_top_k": op11_top_k,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op1_mix_sources": r"""
        WITH RECURSIVE s AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), by_source AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM s GROUP BY source
        ), fill AS (  -- each round caps the sources above 3 times their size
            SELECT 0 AS round, CAST([] AS VARCHAR[]) AS capped,
                   (SELECT sum(source_size) FROM by_source) / (SELECT sum(w) FROM by_source) AS level
            UNION ALL
            SELECT round + 1, c.capped, c.level FROM fill, LATERAL (
                SELECT list(coalesce('s' || source, 'n')) FILTER (WHERE over) AS capped,
                       (sum(source_size) - coalesce(sum(source_size * 3) FILTER (WHERE over), 0)) / sum(w) FILTER (WHERE NOT over) AS level
                FROM (SELECT *, source_size * 3 < w * fill.level AS over FROM by_source)
            ) c WHERE len(coalesce(c.capped, [])) > len(fill.capped) AND c.level IS NOT NULL
        ), t AS (
            SELECT source, source_size, least((source_size * 3)::DOUBLE, w * (SELECT arg_max(level, round) FROM fill)) AS target FROM by_source
        ), h AS (
            SELECT *, greatest(size, 1) AS z, length(bin(greatest(size, 1))) - 1 AS p, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM s
        ), r AS (
            SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
                p * 16 + (((z - (1::BIGINT << p)) * 16) >> p), substr(hash, 1, 2), size, hash, doc_id) AS rank FROM h
        ), c AS (
            SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   ('0x' || substr(md5('0:' || coalesce('s' || r.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, source, size, source_size, target,
               (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT AS copies,
               (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT * size AS taken
        FROM c
    """,
    "op9_warc": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM m
    """,
    "op11_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE t AS (  -- crc32 of each byte
            SELECT i, list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i)
        ), d AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
        ), r AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL
        ), b AS (
            SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM r WHERE length(run) >= 5
        ), h AS (
            SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, (SELECT list(c ORDER BY i) AS tab FROM t)
        ), m AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
        ), w AS (
            SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), cut AS (  -- every word without one of its code points
            SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)
        ), pair AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.rest
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.rest
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS most FROM pair GROUP BY word
        ), form AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN most END AS form_n,
                   CASE WHEN most >= 2 * w.n THEN (SELECT min(encode(p.other)) FROM pair p WHERE p.word = w.word AND p.n = most) END AS form
            FROM w LEFT JOIN best USING (word)
        ), f AS (SELECT * REPLACE (decode(form) AS form) FROM form), chain AS (
            SELECT word, word AS root, form AS next FROM f
            UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN f ON f.word = c.next
        )
        SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
    """,
    "op13_prefix_trie": r"""
        WITH RECURSIVE t AS (  -- crc32 of each byte
            SELECT i, list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i)
        ), c AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), i AS (
            SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS giver, hex(encode(conv_id::VARCHAR)) AS x FROM c GROUP BY conv_id
        ), ids AS (
            SELECT conv_id, n, giver, CASE WHEN conv_id = giver THEN 0 ELSE xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1]), 4294967295::BIGINT), 4294967295) % 4 END AS h
            FROM i, (SELECT list(c ORDER BY i) AS tab FROM t)
        ), turns AS (
            SELECT i.conv_id, c.pos - i.h + least(i.h, coalesce(g.n, 0)) AS pos, role, said
            FROM c JOIN ids i USING (conv_id) LEFT JOIN ids g ON g.conv_id = i.giver WHERE c.pos > i.h
            UNION ALL SELECT i.conv_id, c.pos, role, said FROM ids i JOIN c ON c.conv_id = i.giver AND c.pos <= i.h
        ), pre AS (
            SELECT conv_id, pos, said, max(pos) OVER (PARTITION BY conv_id) AS last,
                   list({'role': role, 'said': said}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM turns
            UNION ALL SELECT conv_id, 0, '', coalesce((SELECT max(pos) FROM turns t WHERE t.conv_id = ids.conv_id), 0), [] FROM ids
        ), node AS (
            SELECT path, pos AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(said), '[^\x20\x09-\x0D]+')) AS own,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE pos = last), '')) AS ends_sha256
            FROM pre GROUP BY path, pos
        ), tree AS (
            SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children
            FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
        ), up AS (
            SELECT path[1:d] AS path, d AS depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM tree) GROUP BY 1, 2
        )
        SELECT conv_id, t.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM tree t JOIN up ON up.depth = t.depth AND up.path = t.path
    """,
}
