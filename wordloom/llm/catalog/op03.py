"""Quality rules over all documents; trusted are those labelled good."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.ngram_llr import quality_rules


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return quality_rules(read_table(spark, sf_dir, "documents"), trusted)


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
