"""Main text of every page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.text_density import extract_main_text


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_main_text": op2_main_text}
ORACLES: dict[str, str] = {}
