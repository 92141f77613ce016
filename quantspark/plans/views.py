"""Demonstration drawings made of the driver's tables: whole-numbered geometry, so that two engines agree to the last digit.

A drawing stays a drawing at any scale factor: 400 hits, and a supplier's line rows. Each view is one SQL text that both Spark and the oracle run; {table} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """
SELECT l_suppkey AS doc_id, 0 AS page_no,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS seg_seq,
       CAST(l_partkey % 500 AS DOUBLE) AS x1, CAST((l_orderkey % 200) * 5 AS DOUBLE) AS y1,
       CAST(l_partkey % 500 AS DOUBLE) + CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0.0E0 END AS x2,
       CAST((l_orderkey % 200) * 5 AS DOUBLE) + CASE WHEN l_linenumber % 2 = 1 THEN 0.0E0 ELSE l_quantity END AS y2,
       CASE WHEN l_linestatus = 'O' THEN 2.0E0 WHEN l_linenumber < 4 THEN 1.5E0 ELSE 0.5E0 END AS width,
       CAST(l_linenumber % 3 AS DOUBLE) / 4 AS r, 0.0E0 AS g, 0.5E0 AS b,
       CASE l_returnflag WHEN 'R' THEN 'p|V-53BB-FE--S3-' WHEN 'A' THEN 'p|V-52BB-FE--V1-' ELSE 'HUS|K-27B---EI_' END AS layer
FROM {lineitem}
"""

HITS = """
SELECT CAST(floor(event_id / 400) AS BIGINT) AS doc_id, 0 AS page_no, event_id AS hit_seq,
       CASE event_id % 8
         WHEN 0 THEN 'KV' || CAST(user_id % 3 + 1 AS VARCHAR(9)) || '-X31'
         WHEN 1 THEN '2xVV' || CAST(user_id % 2 + 1 AS VARCHAR(9)) || '-X22'
         WHEN 2 THEN 'S3-R8-' || CAST((user_id % 4 + 1) * 25 AS VARCHAR(9))
         WHEN 3 THEN 'VG+1.' || CAST(user_id % 9 AS VARCHAR(9)) || '(L)'
         WHEN 4 THEN CAST((user_id % 4 + 1) * 40 AS VARCHAR(9)) || '(L)'
         WHEN 5 THEN '1:' || CASE user_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '50' WHEN 2 THEN '100' ELSE '3' END
         WHEN 6 THEN CASE user_id % 5 WHEN 0 THEN 'SKALA' WHEN 1 THEN 'PLAN' ELSE upper(event_type) END
         ELSE 'B' || CAST(user_id % 4 + 1 AS VARCHAR(9)) || '-BRUNN' END AS text,
       CAST(event_id * 37 % 300 AS DOUBLE) AS x0, CAST(event_id * 53 % 240 AS DOUBLE) AS y0,
       CAST(event_id * 37 % 300 + 40 AS DOUBLE) AS x1, CAST(event_id * 53 % 240 + 8 AS DOUBLE) AS y1,
       CAST(event_id * 7 % 101 AS DOUBLE) AS conf,
       CASE WHEN event_id % 3 = 0 THEN 'pdftext' ELSE 'ocr' END AS source, CAST(CASE WHEN event_id % 2 = 0 THEN 11 ELSE 6 END AS INT) AS psm
FROM {events}
"""

#: Quantity rows of our own and of a ground truth: a brand is a code, a supplier a drawing.
OURS = """
SELECT l_suppkey % 20 AS doc_id, 0 AS page_no, p_brand AS subject,
       CASE p_type WHEN 'SMALL' THEN 'Rör tappvatten' ELSE 'Spill- dagvatten' END AS lager,
       CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS langd_m,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS BIGINT) END AS antal,
       CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'R' THEN CAST(2 AS BIGINT) END AS antal_vs,
       CAST(CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'R' THEN 6 END AS DOUBLE) AS total_vertikalhojd_m,
       CASE WHEN l_linestatus = 'O' THEN 'okopplad rörsträcka; skala okänd (längd i pt)' ELSE 'okopplad rörsträcka' END AS kommentar,
       CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS part, l_orderkey * 8 + l_linenumber AS no,
       p_brand AS color
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

FACIT = """
SELECT l_suppkey % 20 AS doc_id, p_brand AS "Subject",
       CASE WHEN l_linenumber % 3 <> 0 THEN replace(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || ',0', ' ', '') ELSE '' END AS "Längd",
       CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'R' THEN '2' ELSE '' END AS "Antal_VS",
       'Lager' AS "Lager", l_orderkey * 8 + l_linenumber AS row_no
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
WHERE l_linenumber <= 6 AND p_brand <> 'Brand#7'
"""

LAYERS = "SELECT DISTINCT doc_id, layer FROM ({segments}) AS s"
PAGES = "SELECT DISTINCT doc_id, page_no, CAST(1000 AS DOUBLE) AS width, CAST(1000 AS DOUBLE) AS height FROM ({source}) AS p"

_TABLES = ("lineitem", "events", "part", "documents")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in _TABLES if "{" + t + "}" in sql]
    return spark.sql(sql.replace('"', "`"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def oracle(sql: str) -> str:
    return sql.format(**{t: t for t in _TABLES})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SEGMENTS)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HITS)


def pages(of: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return of.select("doc_id", "page_no").distinct().withColumns({"width": F.lit(1000.0), "height": F.lit(1000.0)})
