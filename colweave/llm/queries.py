"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm import (
    ann,
    centroids,
    conversations,
    decontaminate,
    html_extract,
    jaccard_join,
    language_id,
    oracles,
    packing,
    packing_genes,
    ppm,
    substring_dedup,
    token_counts,
    toxicity,
)
from colweave.llm.common import fold, read_table
from colweave.llm.shipping import ship
from colweave.session import tune


# The identifier of <|endoftext|> in the tokenizer below.
END_OF_TEXT = 50256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_extract.extract(read_table(spark, sf_dir, "pages"), html_extract.train())
    return pages.select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    index = toxicity.train(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, index)
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), predicted, "examples")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ppm.score(docs.withColumn("learned", fold("doc_id", 7) != 2), "learned")
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found in flat files of all documents' identifiers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path(), END_OF_TEXT)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every row whose id is divisible by 50, among all rows."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.build(vectors))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window of 35 words holding them starts elsewhere too."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of Jaccard similarity 0.8 or more on five words connect."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak, with the best passage and the overlap of question and answer."""
    indexes = decontaminate.build_indexes(read_table(spark, sf_dir, "benchmark"))
    leaks = decontaminate.find_leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), indexes)
    return leaks.select("doc_id", F.inline("leaks"))


def op11_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in few sequences of 2048 tokens, only longer documents being cut."""
    return packing_genes.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds, with distances and a digest of its centroid."""
    out = centroids.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after planted damage."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows), rows)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _prepared(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(tune(spark)), sf_dir)

    return run


ALL = (
    op1_html_extraction,
    op2_toxicity,
    op3_lm_scoring,
    op4_token_counts,
    op5_nearest_neighbours,
    op6_substring_dedup,
    op7_packing,
    op8_language_id,
    op9_ngram_jaccard_join,
    op10_decontamination,
    op11_genetic_packing,
    op12_centroid_clustering,
    op13_conversation_repair,
)


def queries() -> dict:
    return {q.__name__: _prepared(q) for q in ALL} | {"pipeline": _prepared(_pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express on whole tables; tests compare the others with brute force."""
    return {"op12_centroid_clustering": oracles.centroid_clustering(), "op13_conversation_repair": oracles.conversation_repair()}
