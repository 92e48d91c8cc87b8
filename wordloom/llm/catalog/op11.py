"""Nearest neighbours of a twentieth of the vectors among all."""

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import read_table
from wordloom.llm.nearest import nearest

EVERY = 20


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), EVERY)


QUERIES = {"op11_pruned_graph": op11_pruned_graph}
ORACLES: dict[str, str] = {}
