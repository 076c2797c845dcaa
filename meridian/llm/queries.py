"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meridian.llm import conversations, embeddings, langid, lines, media, merkle, packing, pieces, quality, rules, simhash, substring, warc
from meridian.plans.registry import Registry, table

LLM = Registry()


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@LLM.add("op1_line_dedup", lines.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@LLM.add("op2_media")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.stored_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


@LLM.add("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


@LLM.add("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return parts.select("doc_id", digits.alias("fingerprint"), "component_id")


@LLM.add("op5_merge_dropout")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.segment_digests(docs, path, seed=1)
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "decoded_sha256")


@LLM.add("op6_revisits", warc.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers_merged"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    source = F.coalesce("refers_to", F.lit(-1)).alias("refers_to")
    return out.select("record_id", "canonical_url", "status", source, F.array_join(entries, ";").alias("headers"))


@LLM.add("op7_substring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@LLM.add("op8_embeddings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_components(table(spark, sf_dir, "embeddings"))


@LLM.add("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(4) == 2
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label"))
    out = quality.score(docs.withColumn("held_out", held), quality.train(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@LLM.add("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(5) == 0
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@LLM.add("op11_prefix_trie", conversations.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


@LLM.add("op12_rule_ledger", rules.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, current = rules.POLICIES[0], rules.POLICIES[-1]
    out = rules.apply_policies(rows, rules.POLICIES)
    base_failed, kept = ~rules.kept(base), rules.kept(base) & rules.kept(current)
    return out.select("doc_id", *rules.MEASURES[:5], base_failed.alias("base_failed"), kept.alias("kept"), "failures", "policies")


@LLM.add("op13_merkle", merkle.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(fold(3) == 0, merkle.leaf(columns, text=lower))
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", merkle.leaf(columns).alias("leaf"), tampered.alias("tampered"))
    return merkle.manifest(rows, "lang", "doc_id", "leaf", "tampered", proofs=False).drop("lang")
