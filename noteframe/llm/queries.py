"""The queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cascade,
    chat,
    lexical,
    matrices,
    mixing,
    packing,
    simhash,
    syncmers,
    topk,
    toxicity,
    trie,
    warc,
    wrapper,
)
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op2_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.curriculum_mix(read(spark, folder, "documents"), carry=["doc_id"])
    first = F.floor(F.get("passes", F.lit(0))["position"] * 1_000_000).cast("long")
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "taken",
        first.alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op3_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.document_fingerprints(read(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.derived(warc.responses(read(spark, folder, "pages")))
    return records.select(
        F.col("key").alias("page_id"),
        "type",
        "record_id",
        "refers_to",
        "target_uri",
        "block_digest",
        "source_digest",
        "content_length",
        F.sha2("record", 256).alias("record_sha256"),
    )


def op5_matrices(spark: SparkSession, folder: str) -> DataFrame:
    rows = matrices.token_matrices(read(spark, folder, "documents"), tokenizer_path())
    return matrices.segments(rows).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("positions").alias("positions_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op6_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    texts = wrapper.main_texts(read(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def packed(docs: DataFrame) -> DataFrame:
    """The digest columns of packed documents."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.shared_head_trie(read(spark, folder, "conversations"))


def op12_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.judge_documents(read(spark, folder, "documents"))


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_syncmers": op3_syncmers,
    "op4_warc": op4_warc,
    "op5_matrices": op5_matrices,
    "op6_wrapper": op6_wrapper,
    "op7_chat": op7_chat,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_trie": op11_trie,
    "op12_cascade": op12_cascade,
    "op13_lexical": op13_lexical,
}

MIX_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, place % 3 AS class, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
         ELSE 1.0::DOUBLE END AS weight FROM s
), r AS (SELECT *, 3 * size / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(size) OVER () - 3 * (sum(size) OVER (ORDER BY ratio, place) - size))::BIGINT
            / sum(weight) OVER (ORDER BY ratio DESC, place DESC) AS level
  FROM r
), m AS (
  SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), t AS (
  SELECT source, size AS source_size, class,
         coalesce(least(weight * (SELECT level FROM m), 3.0::DOUBLE * size), 0) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.class,
         floor(t.target + 0.5)::BIGINT AS demand,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING)
          - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(size, demand - before))
            + greatest(0, least(size, demand - before - source_size))
            + greatest(0, least(size, demand - before - 2 * source_size)) AS taken,
         least(size, demand - before) > 0 AS met,
         CASE WHEN demand > 0 THEN before / demand END AS share
  FROM p
), g AS (
  SELECT *, CASE WHEN class = 1 THEN 0.0::DOUBLE
                 WHEN class = 0 THEN if(share < 0.625, 0.0::DOUBLE, 0.625::DOUBLE)
                 ELSE if(share < 0.375, 0.0::DOUBLE, 0.375::DOUBLE) END AS low,
         CASE class WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope
  FROM k
), h AS (
  SELECT *, if(low > 0, 0.5::DOUBLE, 0.0::DOUBLE) AS t0,
         CASE WHEN class = 1 OR low > 0 THEN 1.0::DOUBLE WHEN class = 0 THEN 1.5::DOUBLE
              ELSE 0.5::DOUBLE END AS w0
  FROM g
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN met THEN floor((t0 + 2 * (share - low)
         / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * (share - low), 0)))) * 1000000)::BIGINT
       END AS first_position
FROM h
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), f AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'),
                              chr(10), '\' || chr(10)) || chr(10)
            || replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')
            || '</turn>' || chr(10) AS formatted
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
              ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
              FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row,
         [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT a.vec_id AS query_id, a.row AS query_row, b.vec_id AS vec_id,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row != b.row AND len(a.q) = len(b.q)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id))::INTEGER
       AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""

TRIE_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS base FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, base, (list_reduce(
      [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
      lambda a, x: list_reduce(range(0, 8), lambda v, i:
        xor(v >> 1, 3988292384 * (v & 1)), xor(a, x)),
      4294967295::BIGINT)) AS v
  FROM ids
), h AS (
  SELECT c, base, (xor(v, 4294967295) % 4)::BIGINT AS h FROM crc
), t AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(said ORDER BY place) AS said FROM t GROUP BY c
), r AS (
  SELECT h.c, list_concat(coalesce(b.said, [])[1:h.h], own.said[h.h + 1:]) AS said
  FROM h JOIN own ON own.c = h.c LEFT JOIN own b ON b.c = h.base
), p AS (
  SELECT c, d, said[1:d] AS prefix, d = len(said) AS ends
  FROM (SELECT c, said, unnest(range(0, len(said) + 1)) AS d FROM r)
), n AS (
  SELECT prefix, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY prefix, d
), k AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), w AS (
  SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE
           (n_convs - 1) * len(regexp_extract_all(n.prefix[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON k.prefix = n.prefix
), s AS (
  SELECT prefix[1:d] AS prefix, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves,
         sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
       s.saved_tokens, w.ends_sha256
FROM w JOIN s ON s.prefix = w.prefix
LEFT JOIN n p ON w.depth > 0 AND p.prefix = w.prefix[1:w.depth - 1]
"""

CASCADE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), p AS (
  SELECT row, unnest(range(1, len(words) - 6)) AS place,
         unnest([array_to_string(words[i:i + 7], ' ') FOR i IN range(1, len(words) - 6)]) AS part
  FROM d WHERE len(words) >= 8
), c AS (
  SELECT row, place, count(*) OVER (PARTITION BY row, part) AS times FROM p
), g AS (
  SELECT row, least(8, coalesce(lead(place) OVER (PARTITION BY row ORDER BY place) - place, 8)) AS n
  FROM c WHERE times > 1
), r AS (
  SELECT row, sum(n)::BIGINT AS n_repeat_words FROM g GROUP BY row
), b AS (
  SELECT d.*, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (row)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * len(lines))
    OR 2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars
    OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 20 * (length(text) - length(translate(text, '{}', ''))) > n_words
    OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 6 * n_words
    OR 2 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > n_words
    OR 100 * len(list_filter(lines, lambda x: suffix(rtrim(x), '...') OR suffix(rtrim(x), '…')))
       > 50 * len(lines)
    OR 100 * len(list_filter(lines, lambda x: ltrim(x)[1] IN ('•', '*', '-', '·'))) > 90 * len(lines)
  ) AS kept
FROM f
"""

LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, len(terms)::BIGINT AS size, terms
  FROM (SELECT doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(size)::BIGINT AS words FROM d WHERE size > 0
), p AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, s GROUP BY term, docs
), q AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times
  FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), f AS (
  SELECT item, item_id, d.row, doc_id,
         sum(times * weight * ((1000000000 * tf)
             // (1000 * tf + 8 * (25 + (75 * size * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (row), s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER
       AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 10
"""

#: Hashes, trained models, tokenizers and parsed markup are beyond SQL: the other queries are
#: tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_curriculum_mix": MIX_SQL,
    "op7_chat": CHAT_SQL,
    "op8_topk": TOPK_SQL,
    "op11_trie": TRIE_SQL,
    "op12_cascade": CASCADE_SQL,
    "op13_lexical": LEXICAL_SQL,
}
