"""Licence notices in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.rare_token_index import scan_licences


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(read_table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform("notices", lambda n: n["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES: dict[str, str] = {}
