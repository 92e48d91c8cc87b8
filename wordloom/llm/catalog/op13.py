"""Collocations of all documents."""

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import read_table
from wordloom.llm.stripes import collocations


def op13_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS n
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
    GROUP BY ALL HAVING count(*) >= 100
), total AS (
    SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang
), longer AS (
    SELECT lang, phrase, max(n) AS n
    FROM (SELECT lang, regexp_replace(phrase, '^[^ ]* ', '') AS phrase, n FROM f WHERE m > 2
          UNION ALL SELECT lang, regexp_replace(phrase, ' [^ ]*$', '') AS phrase, n FROM f WHERE m > 2)
    GROUP BY ALL
), cuts AS (
    SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.n AS l, y.n AS r, t.n,
           (1000 * CAST(a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.n AS HUGEINT) * CAST(y.n AS HUGEINT)) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1 : k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1 : len(words)], ' ')
    JOIN total t ON t.lang = c.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.n IS NULL OR g.n < b.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

QUERIES = {"op13_stripes": op13_stripes}
ORACLES = {"op13_stripes": SQL}
