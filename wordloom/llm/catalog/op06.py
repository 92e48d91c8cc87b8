"""Quality scores of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.rule_ensemble import in_training, score_quality, train_quality_rules

THRESHOLD = 0.3


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_quality_rules(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_rule_ensemble": op6_rule_ensemble}
ORACLES: dict[str, str] = {}
