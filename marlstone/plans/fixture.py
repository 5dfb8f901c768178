"""``icd_blocks``: invented document blocks derived from part and lineitem by one SQL text that Spark and DuckDB both run.

It shows that two engines agree on operators; it says nothing about real documents. A block holds at
most one open item. doc is the supplier, rev the return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

SQL = """
    SELECT DISTINCT l_suppkey AS doc, l_returnflag AS rev, CAST(p_partkey % 10 + 1 AS INT) AS page, p_partkey AS ord,
        concat(CAST(l_suppkey AS STRING), '-', l_returnflag, '-', CAST(p_partkey AS STRING)) AS block_id, p_type AS section,
        50.0D0 + (p_size % 3) * 150 AS x0, 20.0D0 + (p_partkey % 40) * 18 AS y0, 180.0D0 + (p_size % 3) * 150 AS x1, 32.0D0 + (p_partkey % 40) * 18 AS y1,
        10.0D0 + (p_size % 3) * 2.5D0 AS font_size, p_size % 7 = 0 AS bold, (p_partkey + l_suppkey) % 13 AS k,
        CASE (p_partkey + l_suppkey) % 13
            WHEN 0 THEN concat('The unit shall provide ', CAST(p_size + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN p_partkey % 2 ELSE p_partkey % 3 END AS STRING), ' W to the heater bus during mode ', CAST(p_partkey % 7 AS STRING), '.')
            WHEN 1 THEN concat('Connector torque value TBD-UCB-', CAST(p_partkey % 50 AS STRING), ' shall be used by the crew.')
            WHEN 2 THEN concat('Mass is TBR pending review of part ', CAST(p_partkey AS STRING), '.')
            WHEN 3 THEN 'TBD means that the value is to be determined later.'
            WHEN 4 THEN concat(CAST(p_partkey % 9 + 1 AS STRING), '.', CAST(p_size % 5 + 1 AS STRING), ' Power Interface ', CAST(p_partkey % 4 AS STRING))
            WHEN 5 THEN 'The flange must hold alignment, tolerance 0.5 mm over the mating interface.'
            WHEN 6 THEN concat('Refer to Section ', CAST(p_partkey % 12 + 1 AS STRING), '.', CAST(p_size % 6 + 1 AS STRING), ' and Table ', CAST(p_size % 8 AS STRING), ' for limits.')
            WHEN 7 THEN concat('The controller should report status within ', CAST(p_size AS STRING), ' ms of request REQ-', CAST(p_partkey AS STRING), '.')
            WHEN 8 THEN concat('Table ', CAST(p_size % 5 AS STRING), ' Limits of the panel')
            WHEN 9 THEN concat('Notes on ', p_name, ' for the interface.')
            WHEN 10 THEN concat('The crew will verify TBC-NASA-', CAST(p_partkey % 20 AS STRING), ' before mating at 28.5 V nominal.')
            WHEN 11 THEN concat(CAST(p_partkey % 9 + 1 AS STRING), ' Scope')
            ELSE concat('Document NAS-', CAST(p_size AS STRING), ' Revision ', chr(CAST(65 + p_size % 6 AS INT)), ' dated 20', CAST(10 + p_size % 15 AS STRING), '-03-0', CAST(1 + p_size % 9 AS STRING), '.') END AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
#: The same as a common table expression for oracles; DuckDB has no D suffix for doubles.
CTE = "icd AS (" + SQL.replace("D0", "::DOUBLE").replace("2.5D0", "2.5::DOUBLE") + "), icdr AS (SELECT * REPLACE (doc * 32 + ascii(rev) - 65 AS doc) FROM icd)"


def icd_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = SQL.replace("D0", "D").replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}")
    return spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def icd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks; each revision of a supplier's document is a document of its own number."""
    return icd_blocks(spark, sf_dir).withColumn("doc", F.col("doc") * 32 + F.ascii("rev") - 65)
