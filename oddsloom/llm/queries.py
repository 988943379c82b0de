"""One query for each operator, over whole tables, and SQL where it can express one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, bpe, chat, media, mixing, oracles, pii, quality, secret_scan, sharding, simhash, token_file, turn_repair, vector_codes

#: The folder of the public tokenizer files may be given by ODDSLOOM_TOKENIZERS.
def _vocabulary(name: str) -> str:
    if folder := os.environ.get("ODDSLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def WORD_BPE() -> str:  # noqa: N802
    return _vocabulary("word_bpe_49k.json")


def BYTE_BPE() -> str:  # noqa: N802
    return _vocabulary("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), WORD_BPE(), keep_ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source_taken")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_documents(_table(spark, sf_dir, "documents")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_sharding, op3_mixing, op4_top_k, op5_secrets, op6_media, op7_simhash, op8_chat, op9_tokens, op10_quality, op11_pii, op12_vector_codes, op13_turn_repair, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": TOP_K, "op5_secrets": SECRETS, "op8_chat": CHAT, "op11_pii": oracles.PII, "op12_vector_codes": oracles.CODES, "op13_turn_repair": oracles.REPAIR}


#: Brute force over every query and candidate.
TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

#: Each rule's matches with the text before each, whose lengths add up to the places.
_ASSIGN = r"""(?s)(.*?)((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))"""
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, 0 AS k, 'assign' AS kind, 8 AS least, regexp_extract_all(text, '{_ASSIGN}', 1) AS gaps, regexp_extract_all(text, '{_ASSIGN}', 2) AS found, regexp_extract_all(text, '{_ASSIGN}', 3) AS counted FROM d
UNION ALL SELECT doc_id, 1, 'access', 16, regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) FROM d
UNION ALL SELECT doc_id, 2, 'hex', 32, regexp_extract_all(text, '(?s)(.*?)([0-9a-f]{{32,}})', 1), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]{{32,}})', 2), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]{{32,}})', 2) FROM d),
m AS (SELECT doc_id, k, kind, least, unnest(gaps) AS gap, unnest(found) AS hit, unnest(counted) AS counted, generate_subscripts(gaps, 1) AS i FROM e),
p AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM m),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || (stop - length(hit)) || ':' || stop, ',' ORDER BY stop - length(hit), k) AS spans FROM p WHERE length(counted) >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

_MARK = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role: |\|>|<\|end\|>"
#: A text stands as it is unless it holds a mark or two backslashes in a row; else each mark and backslash gets one before it.
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + 2 + CASE WHEN regexp_matches(text, '{_MARK}') OR contains(text, '\\\\') THEN len(regexp_extract_all(text, '\\\\|{_MARK}')) ELSE 0 END
  + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(role) + len(regexp_extract_all(role, '\\\\|{_MARK}')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
