"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakebuild.llm import chat_format, exact_dedup, html_extract, k2treap_rank, line_dedup, maxent_lm, maxscore_topk, quality_rules, rns_negatives, simhash_dedup, source_mix, substring_dedup, vector_packing
from lakebuild.llm.common import table, text_of

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), min_chars=1).drop("row_key")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digests(chat_format.windows(turns))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(table(spark, sf_dir, "documents"))


def op6_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore_topk.usable(table(spark, sf_dir, "embeddings"))
    return maxscore_topk.topk(vectors.where(F.col("vec_id") % maxscore_topk.QUERY_EVERY == 0), vectors)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.removed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return vector_packing.pack(vector_packing.pieces(docs, tokenizer_path(), special=True), docs.count())


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extract(table(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op11_k2treap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2treap_rank.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", exact_dedup.text_hash(text_of()))
    return exact_dedup.decisions(docs, carry=["text_sha256"])


def op13_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rns_negatives.usable(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return rns_negatives.mine(rows.where(F.col("vec_id") % rns_negatives.ANCHOR_EVERY == 0), rows)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_format, op3_source_mix, op4_simhash_dedup, op5_maxent_lm, op6_maxscore_topk, op7_substring_dedup, op8_quality_rules, op9_vector_packing, op10_html_extract, op11_k2treap_rank, op12_exact_dedup, op13_rns_negatives)}
ORACLE: dict[str, str] = {"op6_maxscore_topk": maxscore_topk.SQL, "op7_substring_dedup": substring_dedup.SQL, "op8_quality_rules": quality_rules.SQL,
                          "op11_k2treap_rank": k2treap_rank.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_rns_negatives": rns_negatives.SQL}
