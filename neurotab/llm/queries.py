"""The queries opN_<name> over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurotab.llm import clusters, embeddings, hamming, language, licenses, neardup, packing, phrases, pieces, secrets, substrings, tokens, warc


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(_table(spark, sf, "documents")).drop("blocks")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level BPE."""
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_hamming_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 100."""
    codes = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code("embedding").alias("code"))
    return hamming.search(codes, codes.where("id % 100 = 0"))


def op4_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and groups of vectors with a cosine of 0.9 or more."""
    return embeddings.near_duplicates(_table(spark, sf, "embeddings"))


def op5_piece_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every document under the 32k model, and whether they decode to it."""
    import public_tokenizers

    return pieces.encode(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """WARC records of all pages, written into ZIP packages and read back."""
    return warc.round_trip(_table(spark, sf, "pages"))


def op7_length_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of all documents from length buckets of least padding."""
    return packing.pack(_table(spark, sf, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents whose sets of word pairs are alike to 0.8."""
    return neardup.groups(_table(spark, sf, "documents"), size=2)


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    return language.predict(_table(spark, sf, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that stand twice."""
    return substrings.deduplicate(_table(spark, sf, "documents"), keep_text=True)


def op11_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Forty clusters of the integer vectors after five rounds."""
    return clusters.cluster(_table(spark, sf, "embeddings"))


def op12_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.mine(_table(spark, sf, "documents"))


def op13_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document by patterns and by how random strings look."""
    return secrets.scan(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_hamming_topk, op4_embedding_neardup, op5_piece_encoding, op6_warc_round_trip, op7_length_packing, op8_minhash_neardup, op9_language_id, op10_suffix_dedup, op11_centroid_clusters, op12_phrase_mining, op13_secret_scan)}
ORACLES = {"op1_license_scan": licenses.oracle(), "op3_hamming_topk": hamming.ORACLE, "op4_embedding_neardup": embeddings.ORACLE, "op6_warc_round_trip": warc.ORACLE, "op8_minhash_neardup": neardup.ORACLE, "op11_centroid_clusters": clusters.oracle(), "op12_phrase_mining": phrases.oracle()}
