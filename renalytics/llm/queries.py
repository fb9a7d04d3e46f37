"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renalytics.llm import binary_records, bpe, factorisation, kdtree, langid, line_dedup, mixing, order_minhash, prefix_trie, quality_rules, syncmers, token_alignment, toxicity
from renalytics.llm.common import documents, fold, labels

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def register(fn: Plan) -> Plan:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_records.token_records(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "n_bytes")


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", fold("doc_id", 4) == 2)
    model = toxicity.train(docs, labels(spark, sf_dir), fold("doc_id", 4) != 2)
    return toxicity.score_documents(docs, model, ["doc_id", "held_out"])


@register
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(documents(spark, sf_dir, "doc_id", "text"))


@register
def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(documents(spark, sf_dir, "doc_id", "text"))


@register
def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"), target_entropy=0.9, max_epochs=4.0)
    return mixing.slots(mixed).select("block", "slot", "doc_id", "source", "epoch", "n_tokens", "start")


@register
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir, "doc_id", "text"), digests=True)


@register
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "n_chars").withColumn("held_out", fold("doc_id", 5) == 0)
    machine = factorisation.train(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    return factorisation.score_documents(docs, machine, ["doc_id", "held_out"])


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op8_line_dedup"] = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), repeated AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NULL OR r.first_id = k.doc_id AS stays
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    model = langid.train(docs, fold("doc_id", 3) != 1)
    return langid.predict_documents(docs, model, ["doc_id", "held_out"])


@register
def op10_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return kdtree.top_k(vectors, F.col("id") % 50 == 0, k=5)


ORACLE["op10_kdtree_topk"] = """
WITH usable AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(documents(spark, sf_dir, "doc_id", "text"))
    return token_alignment.link_counts(found).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations_of(turns)))


# crc32 of the decimal id: a list of its bytes, each followed by eight shift steps (-1).
ORACLE["op12_prefix_trie"] = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} 
         ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), steps AS (
  SELECT conv_id, flatten([[ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]
                           FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')]) AS s FROM own
), crc AS (
  SELECT conv_id, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(x AS BIGINT) FOR x IN s]),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END),
    4294967295::BIGINT) % 4 AS INTEGER) AS h FROM steps
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), coalesce(o.turns[h + 1:], [])) AS turns
  FROM own o JOIN crc c ON c.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), members AS (
  SELECT conv_id, d AS depth, len(turns) AS n, turns[d].text AS last, sha256(CAST(turns[1:d] AS JSON)) AS node,
         CASE WHEN d > 0 THEN sha256(CAST(turns[1:d - 1] AS JSON)) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(last), '[^\\x20\\x09-\\x0D]+')), 0) AS own_saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), childs AS (
  SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), above AS (
  SELECT DISTINCT lower_.node AS node, upper_.node AS top FROM members lower_ JOIN members upper_
  ON lower_.conv_id = upper_.conv_id AND upper_.depth <= lower_.depth
), subtree AS (
  SELECT a.top, sum(n.own_saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM above a JOIN nodes n ON n.node = a.node LEFT JOIN childs c ON c.parent = n.node GROUP BY a.top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree s ON s.top = n.node LEFT JOIN childs c ON c.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
"""


@register
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir, "doc_id", "text"), labels(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


ORACLE["op13_quality_rules"] = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM docs
), pos AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split
), twice AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM pos
), hit AS (
  SELECT r, unnest([i, i + 1, i + 2]) AS i FROM twice WHERE n >= 2
), repeated AS (
  SELECT r, count(DISTINCT i) AS n_repeat_words FROM hit GROUP BY r
), base AS (
  SELECT s.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM split s LEFT JOIN repeated p ON s.r = p.r
), stats AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words >= 600 THEN 2 WHEN n_words >= 200 THEN 1 ELSE 0 END AS stratum,
         md5(CAST(doc_id AS VARCHAR)) < '4' AS learning
  FROM base
), values_of AS (
  SELECT r, unnest([
    {'rule': 'symbols_high', 'bin': least(1000 * n_symbols // greatest(n_words, 1), 1999)},
    {'rule': 'repeats_high', 'bin': least(1000 * n_repeat_words // greatest(n_words, 1), 1999)},
    {'rule': 'dup_lines_high', 'bin': least(1000 * n_dup_lines // greatest(n_lines, 1), 1999)},
    {'rule': 'word_length_high', 'bin': least(100 * word_chars // greatest(n_words, 1), 1999)},
    {'rule': 'word_length_low', 'bin': 1999 - least(100 * word_chars // greatest(n_words, 1), 1999)}], recursive := true)
  FROM stats WHERE NOT base_failed
), mark AS (
  SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), labelled AS (
  SELECT s.r, good, learning, stratum FROM stats s JOIN mark m ON s.doc_id = m.doc_id WHERE NOT base_failed
), bins AS (
  SELECT rule, bin, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad
  FROM values_of v JOIN labelled l ON v.r = l.r WHERE learning GROUP BY rule, bin
), shares AS (
  SELECT rule, bin, sum(good) OVER d / sum(good) OVER a AS good_share, sum(bad) OVER d / sum(bad) OVER a AS bad_share
  FROM bins WINDOW d AS (PARTITION BY rule ORDER BY bin DESC), a AS (PARTITION BY rule)
), path AS (
  SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) AS level,
         unnest([0e0, 0.001e0, 0.002e0, 0.004e0, 0.006e0, 0.008e0, 0.01e0, 0.013e0, 0.016e0, 0.02e0, 0.025e0, 0.03e0]) AS most
), cuts AS (
  SELECT rule, level, min(bin) AS cutoff FROM shares JOIN path ON good_share <= most
  WHERE bad_share >= 2 * good_share AND bad_share > 0 GROUP BY rule, level
), levels AS (
  SELECT v.r, min(level) AS level FROM values_of v JOIN cuts c ON v.rule = c.rule AND v.bin >= c.cutoff GROUP BY v.r
), strata AS (
  SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM labelled WHERE good AND NOT learning GROUP BY stratum
), counted AS (
  SELECT s.stratum, n, strata, p.level,
         (SELECT count(*) FROM labelled l JOIN levels v ON v.r = l.r
          WHERE good AND NOT learning AND l.stratum = s.stratum AND v.level <= p.level) AS x
  FROM strata s CROSS JOIN path p
), tested AS (
  SELECT stratum, level, strata, CASE WHEN x >= n * 0.05e0 THEN 1e0 ELSE list_sum([
    exp(lgamma(n + 1e0) - lgamma(k + 1e0) - lgamma(n - k + 1e0) + k * ln(0.05e0) + (n - k) * ln(0.95e0))
    FOR k IN range(0, x + 1)]) END AS p
  FROM counted
), certified AS (
  SELECT stratum, coalesce(min(level) FILTER (WHERE p > 0.1e0 / strata), 12) - 1 AS certified FROM tested GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(v.level <= c.certified, false) AS kept
FROM stats s LEFT JOIN levels v ON v.r = s.r LEFT JOIN certified c ON c.stratum = s.stratum
"""
