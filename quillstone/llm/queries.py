"""One query per operator, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import context_tree, embedding_dedup, fill_middle, jaccard_join, line_dedup, line_frequency, mixing, oracles, packing, quality_model, secrets, sharding, spelling, warc
from quillstone.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = quality_model.score(docs, quality_model.train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("findings")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.apply(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    return sharding.shuffled(docs).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {
    f.__name__: f
    for f in (
        op1_context_tree,
        op2_line_dedup,
        op3_mixing,
        op4_line_frequency,
        op5_packing,
        op6_quality_classifier,
        op7_warc_reassembly,
        op8_embedding_dedup,
        op9_secret_scan,
        op10_jaccard_join,
        op11_fill_middle,
        op12_spelling_variants,
        op13_sharding,
    )
}
#: The others learn, round at random, tokenize, write files or scan by position; their tests are brute force.
ORACLE_SQL: dict[str, str] = {
    op2_line_dedup.__name__: oracles.LINE_DEDUP,
    op4_line_frequency.__name__: oracles.LINE_FREQUENCY,
    op8_embedding_dedup.__name__: oracles.EMBEDDING_DEDUP,
    op10_jaccard_join.__name__: oracles.JACCARD_JOIN,
    op11_fill_middle.__name__: oracles.FILL_MIDDLE,
    op12_spelling_variants.__name__: oracles.SPELLING_VARIANTS,
}
