"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is one operator of `colweave.llm` whose decision takes effect: rows it rejects go, and text it removes is gone
for the stages after it. A stage's result is written as Parquet to the folder all executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm import decontaminate, jaccard_join, language_id, packing, substring_dedup
from colweave.llm.common import fold, quoted, read_table, scratch, stored
from colweave.llm.queries import tokenizer_path
from colweave.llm.shipping import ship
from colweave.session import tune


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns and a struct `others` of the rest, so no column has a name that an operator gives to its own."""
    others = [quoted(c) for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(0)).alias("others"))


def _restored(frame: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of `docs`, the used ones as they are in the frame."""
    return frame.select(*[(F.col(c) if c in used else F.col("others").getField(c)).alias(c) for c in docs.columns])


def _languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; null, empty and letterless texts go."""
    ship(tune(spark))
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    known = language_id.identify(_carried(docs, "doc_id", "text"), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return _restored(known, docs, "doc_id", "text")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates, that of the smallest id; texts without words are in no group and stay.

    The join's nodes are (id, text), not ids: rows without an id, or sharing one, are told apart by their texts. A row
    that repeats id and text is left once, the one whose columns come first as JSON text.
    """
    ship(tune(spark))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text", F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    groups = jaccard_join.join(keyed.select("node", "text"), "node").where("n_shingles > 0")
    groups = groups.groupBy("node").agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = keyed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = stored(groups.join(ids, "node"), "nodes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "node"))
    best = nodes.groupBy("component").agg(first.alias("first")).select("first.node")
    others = nodes.join(best, "node", "left_anti").select("node")
    repeated = stored(nodes.where("n > 1").join(best, "node", "left_semi").select("node"), "repeated")
    rows = keyed.select("node", "row")
    if repeated.isEmpty():
        return rows.join(others, "node", "left_anti").select("row.*")
    once = rows.join(repeated, "node", "left_semi").groupBy("node").agg(F.min_by("row", F.to_json("row")).alias("row"))
    left = rows.join(others.union(repeated), "node", "left_anti")
    return left.unionByName(once).select("row.*")


def _repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words that repeat; a text that loses nothing stays as it is, an emptied one goes."""
    ship(tune(spark))
    used = ("doc_id", "text", "n_chars")
    cut = substring_dedup.remove_repeats(_carried(docs, *used)).where("n_removed = 0 or n_removed < n_words")
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return _restored(cut.withColumn("n_chars", F.length("text").cast("bigint")), docs, *used)


def _benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    ship(tune(spark))
    indexes = decontaminate.build_indexes(read_table(spark, sf_dir, "benchmark"))
    clean = decontaminate.find_leaks(_carried(docs, "doc_id", "text"), indexes).where(F.size("leaks") == 0)
    return _restored(clean, docs, "doc_id", "text")


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 tokens."""
    ship(tune(spark))
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", _languages),
    ("ngram_jaccard_join", _near_duplicates),
    ("substring_dedup", _repeated_passages),
    ("benchmark_decontamination", _benchmark_leaks),
    ("packing", _packed),
]

# No stage can be expressed in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
