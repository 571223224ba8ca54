"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import anchors, bpe, chat, langid, minhash, mixing, pii, pq, quality, rank, secrets, sql, suffix, whiten

#: Production parameters.
ALPHA, DELTA = 0.01, 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(rows.unionByName(extra))
    out = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '<(/?turn|says|next)>', '<\\\1>', 'g') AS erole,
         regexp_replace(replace(text, '\', '\\'), '<(/?turn|says|next)>', '<\\\1>', 'g') AS etext,
         coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS same
  FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN same THEN 6 ELSE 19 + length(erole) END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = langid.identify(docs, langid.sample(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary())


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_bytes(read(spark, sf_dir, "documents"), length=400, digest=True)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.drop_repeats(read(spark, sf_dir, "documents"), window=20, digest=True)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin("email", "ip", "card", "phone"))
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ALPHA, DELTA)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten.whiten(read(spark, sf_dir, "embeddings"), components=4, scale=256)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[n(k) for k in secrets.BASE], F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_chat_formatting": op1_chat_formatting, "op2_language_id": op2_language_id, "op3_mixing": op3_mixing, "op4_embeddings": op4_embeddings, "op5_bpe": op5_bpe, "op6_suffix_array": op6_suffix_array, "op7_substring": op7_substring, "op8_minhash": op8_minhash, "op9_pii": op9_pii, "op10_quality": op10_quality, "op11_whitening": op11_whitening, "op12_secrets": op12_secrets, "op13_ranked_search": op13_ranked_search}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op3_mixing": sql.OP3, "op4_embeddings": sql.OP4, "op7_substring": sql.OP7, "op8_minhash": sql.OP8, "op10_quality": sql.op10(ALPHA, DELTA), "op13_ranked_search": sql.OP13}
