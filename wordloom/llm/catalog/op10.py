"""All pages as WARC archives, read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.warc_salvage import read_archives, revisits, write_archives
from wordloom.session import stage, staged_path


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisits(read_table(spark, sf_dir, "pages"))
    archives = stage(write_archives(rows, staged_path(spark, "warc")), "warc-list")
    spread = archives.repartition(max(1, archives.count()), "path")
    # Nothing may be lost in archives of its own: a gap ends the query.
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "start", "stop", "gap")).cast("boolean")
    found = read_archives(spread, with_payload=False).where(F.when(F.col("gap").isNull(), True).otherwise(lost))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages
), g AS (
    SELECT digest, max(page_id) AS last FROM p WHERE bytes >= 1000 GROUP BY digest
)
SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.last IS NULL OR g.last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.last <> page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.bytes >= 1000
"""

QUERIES = {"op10_warc_salvage": op10_warc_salvage}
ORACLES = {"op10_warc_salvage": SQL}
