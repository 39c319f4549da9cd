"""The operators applied to their whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from evenreel.llm import (
    chat,
    credentials,
    decontamination,
    doubling,
    language,
    mixing,
    repair,
    sharding,
    simhash,
    suffixes,
    token_counts,
    topk,
    variants,
)

VOCABULARY = "byte_bpe_50k.json"
N_SHARDS = 40
#: Said by the user and the assistant of conversation -1.
INJECTION = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.find_secrets(table(spark, folder, "documents"))


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), k=5, every=50, scale=256)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), N_SHARDS)


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", INJECTION), (-1, 1, "assistant", INJECTION)]
    path = public_tokenizers.path(VOCABULARY)
    return chat.digests(chat.assemble(said.union(spark.createDataFrame(probe, said.schema)), path), path)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous"
    )


def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_ids(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    # no source is taken more than twice, so no document has a third copy
    return mixing.documents_in_order(mixing.mix(table(spark, folder, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies",
        F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("second_position"),
    )


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(table(spark, folder, "conversations"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return doubling.drop_passages(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_exact_topk, op3_sharding, op4_chat_formatting, op5_suffix_dedup, op6_language_id,
        op7_simhash_dedup, op8_decontamination, op9_mixing, op10_token_counts, op11_conversation_repair,
        op12_substring_dedup, op13_spelling_variants,
    )
} | {"pipeline": corpus_pipeline.run}

_ESCAPED = r"""regexp_replace(regexp_replace(coalesce(text, ''),
    '(<)(\\*(?:s>|/s>|<SYS>>|</SYS>>))', '\1\\\2', 'g'),
    '(\[)(\\*(?:INST\]|/INST\]|ANS\]|ROLE\]|/ROLE\]|/TURN\]))', '\1\\\2', 'g')"""

#: Table of the bytes' remainders for CRC-32, and the checksum of a text column ``s``.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(hex(encode(s))) // 2),
  lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _step(path: str, cost: str, letter: str) -> str:
    """A path, eight digits of cost and the letters, with an edit behind."""
    return f"lpad((substr({path}, 1, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({path}, 9) || {letter}"


def _put_out(path: str, role: str) -> str:
    kept = f"CASE WHEN first = '{role}' THEN 'K' ELSE 'R' END"
    return f"CASE WHEN stays THEN {_step(path, f'more + (first <> {role!r})::INTEGER', kept)} END"


def _trained_at(copy: int) -> str:
    """Time at which a copy's first word is due."""
    start = f"starts[{copy}] / target"
    return f"""CASE WHEN len(starts) < {copy} THEN NULL WHEN a = b THEN {start}
    ELSE least(1::DOUBLE, greatest(0::DOUBLE, (sqrt(greatest(0::DOUBLE, a * a + (b - a) * ({start} * (a + b) / 2) * 2)) - a) / (b - a))) END"""


SQL: dict[str, str] = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op4_chat_formatting": f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{INJECTION}' UNION ALL SELECT -1, 1, 'assistant', '{INJECTION}'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED} AS shown,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 15 ELSE 20 + length(role) END AS marks
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks + length(shown)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op9_mixing": rf"""
WITH rows_ AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS w, source_size::DOUBLE AS s FROM placed
), leveled AS (
  SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(s * 2) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT *, first_value(level) OVER (ORDER BY level * w <= s * 2 DESC, s / w, place) AS l,
    max(level * w <= s * 2) OVER () AS any_free FROM leveled
), targets AS (
  SELECT source, source_size, place, CASE WHEN any_free THEN least(s * 2, l * w) ELSE s * 2 END AS target FROM chosen
), streams AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target)::BIGINT AS wanted,
    [1.5, 1.0, 0.5][t.place % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][t.place % 3 + 1]::DOUBLE AS b,
    (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.tie ROWS UNBOUNDED PRECEDING) - r.size)::BIGINT AS begins
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN size = 0 THEN [] ELSE
    list_filter([begins, begins + source_size, begins + 2 * source_size], lambda c: c < wanted) END AS starts FROM streams
)
SELECT doc_id, size, source_size, target,
  coalesce(list_sum(list_transform(starts, lambda c: least(size, wanted - c))), 0)::BIGINT AS taken,
  len(starts)::INTEGER AS copies,
  {_trained_at(1)} AS position, {_trained_at(2)} AS second_position
FROM epochs""",
    # insertions never pay: deleting the row's neighbour instead is cheaper
    "op11_conversation_repair": rf"""
WITH RECURSIVE {_CRC_TABLE}, drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS hit
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations), crc
), said AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE hit <> 0
), ordered AS (
  SELECT *, coalesce('=' || conv_id::VARCHAR, '') AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM said
), spoken AS (
  SELECT *, substr(role, 1, 1) AS first, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again FROM ordered
), faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(first) OVER (PARTITION BY c ORDER BY pos) || first AS pair FROM spoken
), rows_ AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM faults
), paths AS (
  SELECT DISTINCT c, 0::BIGINT AS pos, '00000000' AS p0, NULL::VARCHAR AS p1, NULL::VARCHAR AS p2, NULL::VARCHAR AS p3 FROM rows_
  UNION ALL
  SELECT r.c, r.pos, {_step('p0', '2', "'D'")},
    least({_step('p1', '2', "'D'")}, CASE WHEN stays AND first = 's' THEN {_step('p0', 'more', "'K'")} END),
    least({_step('p2', '2', "'D'")}, {_put_out('p0', 'u')}, {_put_out('p1', 'u')}, {_put_out('p3', 'u')}),
    least({_step('p3', '2', "'D'")}, {_put_out('p2', 'a')})
  FROM paths p JOIN rows_ r ON r.c = p.c AND r.pos = p.pos + 1
), best AS (
  SELECT c, least(arg_max(p0, pos), arg_max(coalesce(p3, '99999999'), pos)) AS path FROM paths GROUP BY c
), edited AS (
  SELECT r.*, substr(path, 8 + pos, 1) AS letter FROM rows_ r JOIN best USING (c)
), put AS (
  SELECT *, row_number() OVER out_ AS j, first_value(letter = 'K' AND first = 's') OVER out_ AS system
  FROM edited WHERE letter <> 'D' WINDOW out_ AS (PARTITION BY c ORDER BY pos)
), repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY pos) AS body FROM put GROUP BY c
), figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c
), all_ AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS c FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(path, 1, 8), '0')::BIGINT AS cost,
  coalesce(substr(path, 9), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM all_ LEFT JOIN figures USING (c) LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)""",
    "op12_substring_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (SELECT u, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs
), hashed AS (
  SELECT u, doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS hs FROM docs
), wins AS (SELECT u, doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM hashed
), low AS (SELECT h, min(doc_id) AS m FROM wins GROUP BY h
), hit AS (
  SELECT u, i FROM wins JOIN low USING (h) WHERE doc_id > m OR (doc_id IS NULL AND m IS NOT NULL)
), marked AS (
  SELECT w.u, w.w, w.i, max(h.i) OVER (PARTITION BY w.u ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN hit h ON w.u = h.u AND w.i = h.i
)
SELECT doc_id, count(w) AS n_words, count_if(gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256, (count(w) - count_if(gone))::BIGINT AS n_kept
FROM docs LEFT JOIN marked USING (u) GROUP BY u, doc_id""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), spoken AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM runs GROUP BY ALL
), drawn AS (SELECT run, n, {_CRC} AS h FROM spoken, crc
), spelt AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
  FROM drawn
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), skips AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS gap, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
), last AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)""",
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
