"""Registered queries of the corpus operators, with production parameters.

Each applies its operator to a whole table and derives the digest columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import ann, bpe, dac, filter_audit, fim, graph_dedup, langid, neardup, ngram_lm, packing, pii, sharding, topk
from ledgerlens.llm.oracle import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens by best-fit decreasing."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    docs = dac.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the rank file and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # both in one pass, so that a task has one worker and not two
    tokens = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the rows is held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = docs.withColumn("held_out", remainder == 2)
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), usable=~F.col("held_out"))
    return langid.predict(docs, model, carry=["doc_id", "held_out"])


def op2_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every 100th vector, by multiprobe p-stable hashing."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards with the mixture of sources of the whole."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(rows, 8, "interleave")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer products of every 100th vector."""
    return topk.top_k_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by format-preserving pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY, found_col="found").select("doc_id", "text", F.size("found").alias("n_found"), "found")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; a fifth of the rows is held out of the counts."""
    docs = table(spark, sf_dir, "documents")
    held_out = ngram_lm.held_out_split("doc_id", 5, 1)
    model = ngram_lm.fit(docs.where(~held_out))
    return ngram_lm.score(docs, model).withColumn("held_out", held_out)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: shingles of five words, weighted Jaccard similarity of 0.8 or more."""
    return neardup.document_classes(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, a part for each language."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    filters = filter_audit.text_filters(F.coalesce(F.col("text"), F.lit("")))
    return filter_audit.audit(docs, labels, filters, duplicates="E")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in their middle, and restored from that."""
    rows = fim.restore(fim.transform(table(spark, sf_dir, "documents"), seed="1", plain_percent=10, spm_percent=20))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), at_least=0.9)


#: The key of the registered runs; a real run passes its own.
PSEUDONYM_KEY = "pseudonym key of the registered query"

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_multiprobe_ann, op3_interleave, op4_token_store, op5_byte_bpe, op6_exact_top_k, op7_pseudonyms, op8_kneser_ney, op9_language_id, op10_near_duplicates, op11_filter_audit, op12_fill_in_middle, op13_graph_dedup)
}
