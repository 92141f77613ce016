"""Queries over texts, codes, quantities and bills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark.config import CODE_REGEX, DIM_PART_REGEX, DIM_REGEX, Config
from quantspark.functions import codes as C
from quantspark.functions import colors
from quantspark.functions import numbers as N
from quantspark.functions.geometry import Box
from quantspark.operators import codes as K
from quantspark.operators import legend, linking, quantify, validate
from quantspark.operators import scale as S
from quantspark.operators.grid import PAGE
from quantspark.sources import cadpdf

from . import views as V

CFG = Config()
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _clusters_sql(text: str = "text") -> str:
    return f""", cand AS (SELECT * FROM v_hit WHERE regexp_matches(text, '{CODE_REGEX}')),
pr AS (SELECT a.doc_id, a.hit_seq AS a, b.hit_seq AS b FROM cand a JOIN cand b ON a.doc_id = b.doc_id AND a.{text} = b.{text} AND a.hit_seq < b.hit_seq AND abs(a.x0 - b.x0) <= 12 AND abs(a.y0 - b.y0) <= 12),
sy AS (SELECT doc_id, a, b FROM pr UNION SELECT doc_id, b, a FROM pr),
rc(doc_id, n, m) AS (SELECT doc_id, hit_seq, hit_seq FROM cand UNION SELECT r.doc_id, s.b, r.m FROM rc r JOIN sy s ON r.doc_id = s.doc_id AND r.n = s.a WHERE r.m < s.b),
cl AS (SELECT doc_id, n AS hit_seq, min(m) AS cluster FROM rc GROUP BY ALL)"""


@query("f1_code_filter", f"SELECT doc_id, hit_seq, text, regexp_matches(text, '{CODE_REGEX}') AS is_code, regexp_matches(text, '{DIM_REGEX}') AS is_dimension FROM v_hit")
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).select("doc_id", "hit_seq", "text", C.is_code(F.col("text")).alias("is_code"), F.col("text").rlike(DIM_REGEX).alias("is_dimension"))


@query("f1_document_codes", r"""
SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents)
WHERE regexp_matches(token, '^[A-Z]{1,4}[0-9]*[-:][A-Z0-9]+$') GROUP BY ALL""")
def document_codes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = docs.select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("token"))
    return t.filter(C.is_code(F.col("token"), "^[A-Z]{1,4}[0-9]*[-:][A-Z0-9]+$")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("p1_parse_nx", "SELECT doc_id, hit_seq, coalesce(try_cast(nullif(regexp_extract(text, '^([0-9]+)[xX][A-ZÅÄÖ]', 1), '') AS INT), 1) AS n, regexp_replace(text, '^([0-9]+)[xX]([A-ZÅÄÖ])', '\\2') AS base FROM v_hit")
def parse_nx(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).select("doc_id", "hit_seq", C.nx_count(F.col("text")).alias("n"), C.nx_base(F.col("text")).alias("base"))


@query("p2_inline_dimension", f"SELECT doc_id, hit_seq, contains(text, '-') AND regexp_matches(split_part(text, '-', -1), '{DIM_PART_REGEX}') AS inline FROM v_hit")
def inline_dimension(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).select("doc_id", "hit_seq", C.has_inline_dimension(F.col("text")).alias("inline"))


@query("p3_full_code", "SELECT doc_id, hit_seq, CASE WHEN hit_seq % 2 = 0 THEN text || '-' || '160(L)' ELSE text END AS full_code FROM v_hit")
def full_code(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).select("doc_id", "hit_seq", C.full_code(F.col("text"), F.when(F.col("hit_seq") % 2 == 0, "160(L)")).alias("full_code"))


@query("p10_decimal_comma", "SELECT hit_seq, replace(format('{:.1f}', x0 / 8 + y0 / 20), '.', ',') AS said FROM v_hit")
def decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    """Eighths and twentieths: halves that are exact in binary, and some that are not."""
    return V.hits(spark, d).select("hit_seq", N.decimal_comma(F.col("x0") / 8 + F.col("y0") / 20).alias("said"))


@query("p11_round", "SELECT hit_seq, CAST(format('{:.2f}', x0 / 16 + y0 / 200) AS DOUBLE) AS rounded FROM v_hit")
def rounded(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).select("hit_seq", N.round_exact(F.col("x0") / 16 + F.col("y0") / 200, 2).alias("rounded"))


@query("p12_to_number", "SELECT row_no, doc_id, \"Subject\" AS subject, try_cast(nullif(replace(\"Längd\", ',', '.'), '') AS DOUBLE) AS length, try_cast(nullif(\"Antal_VS\", '') AS BIGINT) AS antal_vs FROM v_facit")
def to_number(spark: SparkSession, d: str) -> DataFrame:
    f = V.view(spark, d, V.FACIT)
    return f.select("row_no", "doc_id", F.col("Subject").alias("subject"), N.to_number(F.col("Längd")).alias("length"), N.to_whole(F.col("Antal_VS")).alias("antal_vs"))


@query("p13_prefixes", "SELECT DISTINCT text, split_part(text, '-', 1) AS full_prefix, coalesce(nullif(regexp_extract(split_part(text, '-', 1), '^[A-ZÅÄÖ]+'), ''), split_part(text, '-', 1)) AS letter_prefix FROM v_hit")
def prefixes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return V.hits(spark, d).select("text", C.full_prefix(t).alias("full_prefix"), C.letter_prefix(t).alias("letter_prefix")).distinct()


@query("p14_colors", "SELECT DISTINCT text, CAST(('0x' || substr(sha256(text), 1, 16))::UBIGINT % 20 AS INT) AS slot, list_element([" + ", ".join(f"'{c}'" for c in colors.PALETTE) + "], CAST(('0x' || substr(sha256(text), 1, 16))::UBIGINT % 20 AS INT) + 1) AS color FROM v_hit")
def code_colors(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return V.hits(spark, d).select("text", colors.palette_slot(t).alias("slot"), colors.color_for_code(t).alias("color")).distinct()


@query("p16_rgb", "SELECT DISTINCT text, CAST(('0x' || substr(sha256(text), 1, 2))::INT AS BIGINT) AS red FROM v_hit")
def rgb(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.lit("#"), F.substring(F.sha2("text", 256), 1, 6))
    return V.hits(spark, d).select("text", F.rint(colors.hex_to_rgb01(h)[0] * 255).cast("long").alias("red")).distinct()


@query("s6_text_decision", "SELECT doc_id, count(*) FILTER (WHERE source = 'pdftext') AS native_words, count(*) FILTER (WHERE source = 'pdftext') < 100 AS use_ocr FROM v_hit GROUP BY doc_id")
def text_decision(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d)
    return K.text_decision(V.pages(h), h, CFG).drop("page_no")


@query("s7_collect_hits", "SELECT doc_id, hit_seq, text FROM v_hit WHERE source = 'pdftext' OR (conf >= 30 AND doc_id IN (SELECT doc_id FROM v_hit GROUP BY doc_id HAVING count(*) FILTER (WHERE source = 'pdftext') < 140))")
def collect_hits(spark: SparkSession, d: str) -> DataFrame:
    h, cfg = V.hits(spark, d), Config(native_word_threshold=140)
    native, ocr = h.filter("source = 'pdftext'"), h.filter("source = 'ocr'")
    return K.collect_hits(native, ocr, K.text_decision(V.pages(h), h, cfg), cfg).select("doc_id", "hit_seq", "text")


@query("f2_confidence", "SELECT psm, count(*) AS n, CAST(min(conf) AS BIGINT) AS least FROM v_hit WHERE conf >= 30 GROUP BY psm")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return V.hits(spark, d).filter(F.col("conf") >= CFG.min_conf).groupBy("psm").agg(F.count("*").alias("n"), F.min("conf").cast("long").alias("least"))


@query("f3_exclusion_zones", "SELECT doc_id, hit_seq, (x0+x1)/2 BETWEEN 50 AND 200 AND (y0+y1)/2 BETWEEN 100 AND 300 AS excluded, CASE WHEN (x0+x1)/2 BETWEEN 50 AND 200 AND (y0+y1)/2 BETWEEN 100 AND 300 THEN 'exkluderingszon' END AS excluded_reason FROM v_hit")
def exclusion_zones(spark: SparkSession, d: str) -> DataFrame:
    return K.apply_zones(V.hits(spark, d), Config(exclude_zones=((50.0, 100.0, 200.0, 300.0),))).select("doc_id", "hit_seq", "excluded", "excluded_reason")


@query("j1_duplicate_pairs", _clusters_sql() + " SELECT doc_id, a, b FROM pr")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.duplicate_pairs(K.candidates(V.hits(spark, d), CFG), 12.0).drop("page_no")


@query("c1_dedup_clusters", _clusters_sql() + " SELECT doc_id, hit_seq, cluster FROM cl")
def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.clusters(K.candidates(V.hits(spark, d), CFG), 12.0).select("doc_id", "hit_seq", "cluster")


@query("a7_best_of_cluster", _clusters_sql() + """
, rk AS (SELECT cl.doc_id, cluster, cl.hit_seq, text, count(*) OVER (PARTITION BY cl.doc_id, cluster) AS raw_cluster_size, row_number() OVER (PARTITION BY cl.doc_id, cluster ORDER BY source = 'pdftext' DESC, conf DESC, y0, x0, cl.hit_seq) AS rn FROM cl JOIN cand ON cl.doc_id = cand.doc_id AND cl.hit_seq = cand.hit_seq)
SELECT doc_id, hit_seq, text, raw_cluster_size FROM rk WHERE rn = 1""")
def best_of_cluster(spark: SparkSession, d: str) -> DataFrame:
    return K.best_of_cluster(K.clusters(K.candidates(V.hits(spark, d), CFG), 12.0)).select("doc_id", "hit_seq", "text", "raw_cluster_size")


@query("j2_partial_reads", """
, c AS (SELECT * FROM v_hit WHERE event_id_is_code(text)) SELECT 1""".replace("event_id_is_code(text)", f"regexp_matches(text, '{CODE_REGEX}')").replace("SELECT 1", """
SELECT a.doc_id, a.hit_seq FROM (SELECT doc_id, hit_seq, CASE WHEN hit_seq % 3 = 0 THEN substr(text, 2) ELSE text END AS text, x0, y0, x1, y1 FROM c) a WHERE NOT EXISTS (
 SELECT 1 FROM (SELECT doc_id, CASE WHEN hit_seq % 3 = 0 THEN substr(text, 2) ELSE text END AS text, x0, y0, x1, y1 FROM c) b WHERE a.doc_id = b.doc_id AND length(a.text) < length(b.text) AND contains(b.text, a.text)
 AND (a.x0+a.x1)/2 BETWEEN b.x0-3 AND b.x1+3 AND (a.y0+a.y1)/2 BETWEEN b.y0-3 AND b.y1+3)"""))
def partial_reads(spark: SparkSession, d: str) -> DataFrame:
    c = K.candidates(V.hits(spark, d), CFG)
    c = c.withColumn("text", F.when(F.col("hit_seq") % 3 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text")))
    return K.suppress_partial(c).select("doc_id", "hit_seq")


@query("j3_dimension_pairs", f"""
, c AS (SELECT * FROM v_hit WHERE regexp_matches(text, '{CODE_REGEX}') AND NOT (contains(text, '-') AND regexp_matches(split_part(text, '-', -1), '{DIM_PART_REGEX}'))),
p AS (SELECT c.doc_id, c.hit_seq, h.text AS dimension, row_number() OVER (PARTITION BY c.doc_id, c.hit_seq ORDER BY h.y0 - c.y1, h.hit_seq) AS rn
 FROM c JOIN v_hit h ON c.doc_id = h.doc_id AND h.y0 - c.y1 BETWEEN -2 AND 20 AND regexp_matches(h.text, '{DIM_REGEX}')
 AND greatest(0, least(c.x1, h.x1) - greatest(c.x0, h.x0)) / 40 >= 0.3 AND NOT (c.x0 = h.x0 AND c.y0 = h.y0))
SELECT doc_id, hit_seq, dimension FROM p WHERE rn = 1""")
def dimension_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d)
    c = K.candidates(h, CFG).withColumn("base_code", F.col("text"))
    return K.pair_dimensions(c, h, CFG).filter("dimension is not null").select("doc_id", "hit_seq", "dimension")


@query("extract_codes")
def extract_codes(spark: SparkSession, d: str) -> DataFrame:
    """The whole code table: filter, clusters, best readings, part readings, numbers, dimensions, zones."""
    return K.extract_codes(V.hits(spark, d), CFG).select("doc_id", "code_id", "raw_text", "base_code", "count", "dimension", "full_code", "raw_cluster_size", "excluded")


_SCALE = r"""
, n AS (SELECT doc_id, CAST(regexp_extract(text, '\b1\s*[:;]\s*(\d{1,4})\b', 1) AS INT) AS n, (x0+x1)/2 AS mx, (y0+y1)/2 AS my FROM v_hit WHERE regexp_matches(text, '\b1\s*[:;]\s*(\d{1,4})\b')),
near AS (SELECT n.*, EXISTS (SELECT 1 FROM v_hit s WHERE s.doc_id = n.doc_id AND contains(upper(s.text), 'SKALA') AND mx BETWEEN s.x0 - 150 AND s.x1 + 150 AND my BETWEEN s.y0 - 150 AND s.y1 + 150) AS near FROM n)"""


@query("j15_near_scale_word", _SCALE + " SELECT doc_id, n, near, count(*) AS k FROM near GROUP BY ALL")
def near_scale_word(spark: SparkSession, d: str) -> DataFrame:
    return S.scale_candidates(V.hits(spark, d)).groupBy("doc_id", "n", "near").agg(F.count("*").alias("k"))


@query("a11_title_scale", _SCALE + """
, pool AS (SELECT DISTINCT doc_id, n FROM near WHERE near OR doc_id NOT IN (SELECT doc_id FROM near WHERE near)),
res AS (SELECT p.doc_id, coalesce((SELECT max(q.n) FROM pool q WHERE q.doc_id = p.doc_id AND q.n <> p.n AND starts_with(CAST(q.n AS VARCHAR), CAST(p.n AS VARCHAR))), p.n) AS n FROM pool p)
SELECT doc_id, coalesce(min(n) FILTER (WHERE n IN (20,25,50,100,200,250,400,500,1000,2000)), min(n)) AS n FROM res GROUP BY doc_id""")
def title_scale(spark: SparkSession, d: str) -> DataFrame:
    return S.title_scale(V.hits(spark, d)).select("doc_id", "n")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Scale bars of n+1 numbers, one a page, at a spacing that depends on the page; every third without its unit."""
    docs = V.hits(spark, d).select("doc_id", "page_no").distinct()
    n = (F.col("doc_id") % 5 + 2).cast("int")
    digits = docs.withColumn("v", F.explode(F.sequence(F.lit(0), n))).select("doc_id", "page_no", F.col("v").cast("long").alias("hit_seq"), F.col("v").cast("string").alias("text"), (F.col("v") * (40 + F.col("doc_id"))).cast("double").alias("x0"))
    unit = docs.filter("doc_id % 3 <> 0").select("doc_id", "page_no", F.lit(99).cast("long").alias("hit_seq"), F.lit("m").alias("text"), (n * (40 + F.col("doc_id")) + 20).cast("double").alias("x0"))
    h = digits.unionByName(unit)
    return h.select("*", F.lit(0.0).alias("y0"), (F.col("x0") + 4).alias("x1"), F.lit(4.0).alias("y1"))


@query("j16_scale_bar", "SELECT DISTINCT doc_id, CAST(40 + doc_id AS BIGINT) AS ppm FROM v_hit WHERE doc_id % 3 <> 0")
def scale_bar(spark: SparkSession, d: str) -> DataFrame:
    return S.bar_scale(_bars(spark, d)).select("doc_id", F.rint("bar_ppm").cast("long").alias("ppm"))


@query("q6_determine_scale", _SCALE + """
, pool AS (SELECT DISTINCT doc_id, n FROM near WHERE near OR doc_id NOT IN (SELECT doc_id FROM near WHERE near)),
res AS (SELECT p.doc_id, coalesce((SELECT max(q.n) FROM pool q WHERE q.doc_id = p.doc_id AND q.n <> p.n AND starts_with(CAST(q.n AS VARCHAR), CAST(p.n AS VARCHAR))), p.n) AS n FROM pool p),
t AS (SELECT doc_id, coalesce(min(n) FILTER (WHERE n IN (20,25,50,100,200,250,400,500,1000,2000)), min(n)) AS n FROM res GROUP BY doc_id)
SELECT h.doc_id, CASE WHEN n IS NULL THEN 'okänd' ELSE 'titelblock' END AS method, '1:' || CAST(n AS VARCHAR) AS scale_text, CAST(floor(1000 * (1000.0 / n) / (25.4 / 72) + 0.000001) AS BIGINT) AS milli
FROM (SELECT DISTINCT doc_id FROM v_hit) h LEFT JOIN t USING (doc_id)""")
def determine_scale(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d)
    s = S.determine_scale(V.pages(h), h, CFG)
    return s.select("doc_id", "method", "scale_text", F.floor(F.col("pts_per_meter") * 1000 + 0.000001).cast("long").alias("milli"))


@query("c9_text_lines")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return legend.text_lines(V.hits(spark, d)).select("doc_id", "line_no", "text")


def _legend(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a legend: of every seven hits of a page by number the first is a header, the rest lie under it."""
    h = V.hits(spark, d)
    head = F.col("hit_seq") % 7 == 0
    words = F.when(F.col("hit_seq") % 2 == 0, "SYSTEM TAPPVATTEN").otherwise("SYSTEM SPILLVATTEN")
    text = F.when(head, words).otherwise(F.concat("text", F.lit(" ("), (F.col("hit_seq") % 9).cast("string"), F.lit("st)")))
    return h.select(*PAGE, F.col("hit_seq").alias("line_no"), text.alias("text"), F.col("doc_id").cast("double").alias("x0"), (F.col("hit_seq") * 10).cast("double").alias("y0"), F.lit(0.0).alias("x1"), (F.col("hit_seq") * 10 + 8).cast("double").alias("y1"))


_LEGEND = f"""
, l AS (SELECT doc_id, hit_seq AS line_no, hit_seq % 7 = 0 AS head, text, hit_seq * 10 AS y0, hit_seq * 10 + 8 AS y1 FROM v_hit),
h AS (SELECT doc_id, CASE WHEN line_no % 2 = 0 THEN 'Rör tappvatten' ELSE 'Spill- dagvatten' END AS system, y1, row_number() OVER w AS rank, coalesce(lead(y0) OVER w, y1 + 400) AS until FROM l WHERE head WINDOW w AS (PARTITION BY doc_id ORDER BY y0, line_no)),
u AS (SELECT l.doc_id, l.text, l.line_no, h.system, h.rank FROM l JOIN h ON l.doc_id = h.doc_id AND l.y0 > h.y1 - 2 AND l.y0 < h.until WHERE NOT head AND regexp_matches(text, '{CODE_REGEX}'))"""


@query("j4_legend_prefixes", _LEGEND + """
, f AS (SELECT doc_id, split_part(text, '-', 1) AS prefix, system, rank, line_no, 1 AS whole FROM u UNION ALL
 SELECT doc_id, coalesce(nullif(regexp_extract(split_part(text, '-', 1), '^[A-ZÅÄÖ]+'), ''), split_part(text, '-', 1)), system, rank, line_no, 0 FROM u)
SELECT doc_id, prefix, coalesce(arg_max(system, rank * 1000000000 + line_no) FILTER (WHERE whole = 1), arg_min(system, rank * 1000000000 + line_no) FILTER (WHERE whole = 0)) AS system FROM f GROUP BY ALL""")
def legend_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return legend.prefix_map(_legend(spark, d), CFG).drop("page_no")


@query("w5_legend_headers", _LEGEND + " SELECT doc_id, system, rank, CAST(until AS BIGINT) AS until FROM h")
def legend_headers(spark: SparkSession, d: str) -> DataFrame:
    return legend.headers(_legend(spark, d)).select("doc_id", "system", F.col("rank").cast("long").alias("rank"), F.rint("until").cast("long").alias("until"))


@query("a14_expected_counts", f"SELECT doc_id, text AS code, arg_max(hit_seq % 9, hit_seq) AS expected FROM v_hit WHERE hit_seq % 7 <> 0 AND regexp_matches(text, '{CODE_REGEX}') GROUP BY ALL")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    return legend.expected_counts(_legend(spark, d), CFG).drop("page_no")


@query("j5_system_lookup", f"""
SELECT DISTINCT doc_id, text AS code, CASE WHEN starts_with(text, 'KV') OR starts_with(text, 'VV') THEN 'Rör tappvatten' WHEN starts_with(text, 'S') OR starts_with(text, 'D') THEN 'Spill- dagvatten' ELSE 'Okänt system' END AS system FROM v_hit WHERE regexp_matches(text, '{CODE_REGEX}')""")
def system_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = K.candidates(V.hits(spark, d), CFG).withColumn("base_code", F.col("text"))
    none = h.select(*PAGE, F.lit("x").alias("prefix"), F.lit("y").alias("system")).limit(0)
    return legend.systems_of_codes(h, none, CFG).drop("page_no")


@query("j13_proximity", f"""
, h AS (SELECT doc_id, hit_seq, (x0+x1)/2 AS px, (y0+y1)/2 AS py FROM v_hit WHERE regexp_matches(text, '{CODE_REGEX}')),
m AS (SELECT h.doc_id, h.hit_seq, s.seg_seq, power(px - greatest(x1, least(x2, px)), 2) + power(py - greatest(y1, least(y2, py)), 2) AS d2
      FROM h JOIN v_seg s ON h.doc_id = s.doc_id AND s.width = 2.0 AND px BETWEEN x1 - 25 AND x2 + 25 AND py BETWEEN y1 - 25 AND y2 + 25)
SELECT doc_id, hit_seq, seg_seq AS chain_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, hit_seq ORDER BY d2, seg_seq DESC) AS rn FROM m WHERE d2 <= 625) WHERE rn = 1""")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    """Codes without a leader linked to the nearest run within reach."""
    h = K.candidates(V.hits(spark, d), CFG)
    box = Box.of()
    s = V.segments(spark, d).filter("width = 2.0").select(*PAGE, F.col("seg_seq").alias("chain_id"), F.lit(0).alias("piece_no"), "x1", "y1", "x2", "y2")
    return linking.nearest_chain(h.select(*PAGE, "hit_seq", box.cx.alias("px"), box.cy.alias("py")), s, CFG.proximity_link_pt, "hit_seq").select("doc_id", "hit_seq", "chain_id")


@query("j11_leader_links")
def leader_links(spark: SparkSession, d: str) -> DataFrame:
    """Codes, in order, take the best leader that none took before: greedy, so tested against a brute-force version."""
    h = K.candidates(V.hits(spark, d), CFG).withColumns({"code_id": F.col("hit_seq"), "excluded": F.lit(False)})
    s = V.segments(spark, d)
    lead = s.filter("width < 1").select(*PAGE, F.col("seg_seq").alias("leader_id"), "x1", "y1", (F.col("x2") + 3).alias("x2"), (F.col("y2") + 3).alias("y2"))
    runs = s.filter("width = 2.0").select(*PAGE, F.col("seg_seq").alias("chain_id"), F.lit(0).alias("piece_no"), "x1", "y1", "x2", "y2")
    return linking.take_leaders(linking.leader_pairs(h, lead, runs, CFG)).drop("page_no")


@query("q1_quantity_rows", """
, s AS (SELECT doc_id, seg_seq, CAST((x2-x1)+(y2-y1) AS BIGINT) AS len, CASE WHEN layer LIKE '%V-53%' THEN 'Spill- dagvatten' WHEN layer LIKE '%V-52%' THEN 'Rör tappvatten' END AS system FROM v_seg)
SELECT doc_id, coalesce(system || ' (omärkt sträcka)', 'OKOPPLAD RÖRSTRÄCKA') AS subject, coalesce(system, 'Okänt system') AS lager, len AS langd, NULL::BIGINT AS antal, 'chain:' || CAST(seg_seq AS VARCHAR) AS kalla, 'okopplad rörsträcka; skala okänd (längd i pt)' AS kommentar FROM s
UNION ALL SELECT doc_id, text, CASE WHEN starts_with(text, 'KV') OR starts_with(text, '2xVV') THEN 'Rör tappvatten' WHEN starts_with(text, 'S') THEN 'Spill- dagvatten' ELSE 'Okänt system' END, NULL, 1, 'code:' || CAST(hit_seq AS VARCHAR) || '@(' || CAST(CAST((x0+x1)/2 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST((y0+y1)/2 AS BIGINT) AS VARCHAR) || ')',
 'punktkomponent (ej kopplad till rörsträcka)' || CASE WHEN conf < 60 THEN '; låg OCR-confidence (' || CAST(CAST(conf AS BIGINT) AS VARCHAR) || ')' ELSE '' END FROM v_hit WHERE regexp_matches(text, '^(KV|S3|B)')""")
def quantity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of unlinked runs and of point codes, on pages without a scale."""
    from quantspark.functions import layers as L

    h = V.hits(spark, d).filter(F.col("text").rlike("^(KV|S3|B)"))
    codes = h.select(*PAGE, F.col("hit_seq").alias("code_id"), F.col("text").alias("raw_text"), F.col("text").alias("base_code"), F.col("text").alias("full_code"), F.lit(1).alias("count"), "x0", "y0", "x1", "y1", "conf", F.lit(False).alias("excluded"), F.lit(None).cast("long").alias("linked_chain"))
    s = V.segments(spark, d)
    chains = s.select(*PAGE, F.col("seg_seq").alias("chain_id"), L.system_for_layer(F.col("layer")).alias("system"), (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")).alias("length_pt"), F.lit(0).cast("long").alias("vertical_symbols"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("excluded_reason"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    scale = V.pages(s).select(*PAGE, F.lit(None).cast("double").alias("pts_per_meter"))
    none = codes.select(*PAGE, F.lit("x").alias("prefix"), F.lit("y").alias("system")).limit(0)
    rows = quantify.quantity_rows(codes, chains, scale, legend.systems_of_codes(codes, none, CFG), CFG)
    return rows.select("doc_id", "subject", "lager", F.rint("langd_m").cast("long").alias("langd"), "antal", "kalla", "kommentar")


def _linked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of runs that have a code each: a drawing's hits, in turn, are linked to its runs; some codes count for several
    runs, some runs hold vertical symbols; the scale is two points a metre."""
    from quantspark.functions import layers as L

    h = V.hits(spark, d)
    codes = h.select(*PAGE, F.col("hit_seq").alias("code_id"), F.col("text").alias("raw_text"), F.col("text").alias("base_code"), F.col("text").alias("full_code"), (F.col("hit_seq") % 3 + 1).alias("count"), "x0", "y0", "x1", "y1", "conf", F.lit(False).alias("excluded"), (F.col("hit_seq") % 400 + 1).alias("linked_chain"))
    s = V.segments(spark, d)
    chains = s.select(*PAGE, F.col("seg_seq").cast("long").alias("chain_id"), L.system_for_layer(F.col("layer")).alias("system"), (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")).alias("length_pt"), (F.col("seg_seq") % 4).cast("long").alias("vertical_symbols"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("excluded_reason"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    scale = V.pages(s).select(*PAGE, F.lit(2.0).alias("pts_per_meter"))
    none = codes.select(*PAGE, F.lit("x").alias("prefix"), F.lit("y").alias("system")).limit(0)
    return quantify.quantity_rows(codes, chains, scale, legend.systems_of_codes(codes, none, CFG), CFG)


_LINKED = """
, s AS (SELECT doc_id, seg_seq, (x2-x1)+(y2-y1) AS len, CASE WHEN layer LIKE '%V-53%' THEN 'Spill- dagvatten' WHEN layer LIKE '%V-52%' THEN 'Rör tappvatten' END AS system FROM v_seg),
c AS (SELECT h.doc_id, h.text, h.hit_seq % 3 + 1 AS cnt, h.conf, s.seg_seq, s.len,
 coalesce(s.system, CASE WHEN starts_with(text, 'KV') OR starts_with(text, 'VV') THEN 'Rör tappvatten' WHEN starts_with(text, 'S') OR starts_with(text, 'D') THEN 'Spill- dagvatten' ELSE 'Okänt system' END) AS lager
 FROM v_hit h JOIN s ON s.doc_id = h.doc_id AND s.seg_seq = h.hit_seq % 400 + 1)"""


@query("q2_linked_rows", _LINKED + """
SELECT doc_id, text AS subject, lager, len / 2 AS langd_m, 'chain:' || CAST(seg_seq AS VARCHAR) AS kalla,
 concat_ws('; ', CASE WHEN cnt > 1 THEN CAST(cnt AS VARCHAR) || ' parallella rör (' || text || ') – ritade var för sig, längden ej multiplicerad' END, CASE WHEN conf < 60 THEN 'låg OCR-confidence (' || CAST(CAST(conf AS BIGINT) AS VARCHAR) || ')' END) AS kommentar FROM c""")
def linked_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _linked_rows(spark, d).filter(F.col("langd_m").isNotNull() & ~F.startswith("kommentar", F.lit("okopplad")))
    return rows.select("doc_id", "subject", "lager", "langd_m", "kalla", "kommentar")


@query("q3_vertical_rows", _LINKED + """
SELECT doc_id, text || ' Vertikal' AS subject, lager, CAST((seg_seq % 4) * cnt AS BIGINT) AS antal_vs, CAST(format('{:.2f}', CAST((seg_seq % 4) * cnt AS DOUBLE) * 2.8e0) AS DOUBLE) AS total, 'chain:' || CAST(seg_seq AS VARCHAR) AS kalla FROM c WHERE seg_seq % 4 > 0""")
def vertical_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _linked_rows(spark, d).filter(F.col("antal_vs").isNotNull())
    return rows.select("doc_id", "subject", "lager", "antal_vs", F.col("total_vertikalhojd_m").alias("total"), "kalla")


@query("q8_legend_zone", """
SELECT doc_id, doc_id - 10.0e0 AS x0, CAST(min(hit_seq) * 10 - 5 AS DOUBLE) AS y0, doc_id + 260.0e0 AS x1, 1000.0e0 AS y1 FROM v_hit WHERE hit_seq % 50 = 3 GROUP BY doc_id""")
def legend_zone(spark: SparkSession, d: str) -> DataFrame:
    """The zone under the first heading of each page's legend."""
    lines = _legend(spark, d).withColumn("text", F.when(F.col("line_no") % 50 == 3, F.lit("Förklaringar:")).otherwise(F.col("text")))
    return legend.legend_zone(lines, V.pages(lines)).drop("page_no")


_SUMMARY = """
, a AS (SELECT doc_id, subject, arg_min(lager, part * 100000000000 + no) AS lager, count(*) FILTER (WHERE antal IS NULL AND langd_m IS NOT NULL) AS n_strackor, CAST(coalesce(sum(langd_m) FILTER (WHERE antal IS NULL), 0) AS BIGINT) AS total_langd,
 CAST(coalesce(sum(antal), 0) AS BIGINT) AS n_punkter, CAST(coalesce(sum(antal_vs), 0) AS BIGINT) AS antal_vs, CAST(coalesce(sum(total_vertikalhojd_m), 0) AS BIGINT) AS total_vh FROM v_ours GROUP BY ALL)"""


@query("a9_summary", _SUMMARY + """
SELECT a.doc_id, a.subject, n_strackor, total_langd, n_punkter, antal_vs, total_vh, f.flaggor FROM a JOIN (
 SELECT doc_id, subject, array_to_string(list_sort(list_distinct(list(f))), '|') AS flaggor FROM (SELECT doc_id, subject, unnest(string_split(kommentar, '; ')) AS f FROM v_ours) GROUP BY ALL) f USING (doc_id, subject)""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    s = quantify.summarise(V.view(spark, d, V.OURS))
    return s.select("doc_id", "subject", "n_strackor", F.rint("total_langd_m").cast("long").alias("total_langd"), "n_punkter", "antal_vs", F.rint("total_vertikalhojd_m").cast("long").alias("total_vh"), F.array_join("flaggor", "|").alias("flaggor"))


_FACIT = """
, f AS (SELECT doc_id, "Subject" AS subject, try_cast(nullif(replace("Längd", ',', '.'), '') AS DOUBLE) AS len, try_cast(nullif("Antal_VS", '') AS BIGINT) AS vs FROM v_facit),
fg AS (SELECT doc_id, subject, count(*) AS n_rows, count(len) AS n_length_rows, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_length, count(*) FILTER (WHERE len IS NULL AND coalesce(vs, 0) = 0) AS n_points, count(*) FILTER (WHERE len IS NULL AND coalesce(vs, 0) <> 0) AS n_vertical_rows, CAST(coalesce(sum(vs), 0) AS BIGINT) AS antal_vs FROM f GROUP BY ALL)"""


@query("a10_facit", _FACIT + " SELECT *, 'Lager' AS lager FROM fg")
def facit(spark: SparkSession, d: str) -> DataFrame:
    f = validate.read_facit(V.view(spark, d, V.FACIT), ("doc_id",))
    return f.withColumn("total_length", F.rint("total_length").cast("long"))


@query("j17_reconcile", _SUMMARY + _FACIT + """
SELECT coalesce(f.doc_id, a.doc_id) AS doc_id, coalesce(f.subject, a.subject) AS subject, n_length_rows AS facit_runs, n_strackor AS our_runs, n_points AS facit_points, n_punkter AS our_points,
 CASE WHEN f.subject IS NULL THEN 'extra' WHEN a.subject IS NULL THEN 'missing'
  WHEN (CASE WHEN total_length > 0 THEN abs(total_langd - total_length) * 100.0 / total_length <= 5 ELSE n_strackor = n_length_rows END) AND n_points = n_punkter THEN 'ok' ELSE 'deviates' END AS status
FROM fg f FULL JOIN a ON f.doc_id = a.doc_id AND f.subject = a.subject""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    ours = quantify.summarise(V.view(spark, d, V.OURS))
    f = validate.read_facit(V.view(spark, d, V.FACIT), ("doc_id",))
    r = validate.reconcile(ours, f, ("doc_id",))
    return r.select("doc_id", "subject", "facit_runs", "our_runs", "facit_points", "our_points", "status")


@query("except_ours_only", "SELECT DISTINCT subject FROM v_ours EXCEPT SELECT DISTINCT \"Subject\" FROM v_facit")
def ours_only(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.OURS).select("subject").subtract(V.view(spark, d, V.FACIT).select(F.col("Subject").alias("subject")))


@query("j18_count_checks", _SUMMARY + """
, e AS (SELECT DISTINCT doc_id, subject AS code, CAST(length(subject) AS BIGINT) AS expected FROM v_ours)
SELECT e.doc_id, e.code, e.expected, CAST(coalesce(sum(n_punkter) FILTER (WHERE subject = code OR starts_with(subject, code || '-') OR starts_with(code, subject)), 0) AS BIGINT) AS found FROM e LEFT JOIN a ON e.doc_id = a.doc_id GROUP BY ALL""")
def count_checks(spark: SparkSession, d: str) -> DataFrame:
    ours = V.view(spark, d, V.OURS)
    e = ours.select(*PAGE, F.col("subject").alias("code"), F.length("subject").cast("long").alias("expected")).distinct()
    return quantify.count_checks(quantify.summarise(ours), e).select("doc_id", "code", "expected", "found")


@query("a13_grand_total", "SELECT doc_id, CAST(coalesce(sum(langd_m), 0) AS BIGINT) AS langd, CAST(coalesce(sum(antal), 0) AS BIGINT) AS antal, CAST(coalesce(sum(antal_vs), 0) AS BIGINT) AS antal_vs, grouping(doc_id) = 1 AS is_total FROM v_ours GROUP BY ROLLUP (doc_id)")
def grand_total(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.rint(F.coalesce(F.sum(c), F.lit(0)).cast("double")).cast("long")
    return V.view(spark, d, V.OURS).rollup("doc_id").agg(z("langd_m").alias("langd"), z("antal").alias("antal"), z("antal_vs").alias("antal_vs"), (F.grouping("doc_id") == 1).alias("is_total"))


@query("u6_quantity_parts", "SELECT CASE WHEN antal IS NOT NULL THEN 'points' WHEN antal_vs IS NOT NULL THEN 'verticals' ELSE 'pipes' END AS kind, count(*) AS n FROM v_ours GROUP BY ALL")
def quantity_parts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("antal").isNotNull(), "points").when(F.col("antal_vs").isNotNull(), "verticals").otherwise("pipes")
    return V.view(spark, d, V.OURS).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("s12_result_rows", """
SELECT doc_id, subject, lager, no, CAST(langd_m AS BIGINT) AS langd, antal FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, subject, lager, langd_m, antal, color, kommentar) AS rn FROM v_ours) WHERE rn <= 3000""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each drawing's bill, as many as a result page shows."""
    w = Window.partitionBy("doc_id").orderBy("no", "subject", "lager", F.col("langd_m").asc_nulls_last(), F.col("antal").asc_nulls_last(), "color", "kommentar")
    r = V.view(spark, d, V.OURS).withColumn("rn", F.row_number().over(w)).filter("rn <= 3000")
    return r.select("doc_id", "subject", "lager", "no", F.rint("langd_m").cast("long").alias("langd"), "antal")


@query("j14_primary_code", """
, c AS (SELECT doc_id, hit_seq AS code_id, text, hit_seq % 3 AS linked_chain, (x0+x1)/2 AS mx, (y0+y1)/2 AS my FROM v_hit),
k AS (SELECT doc_id, linked_chain, code_id, text, power(greatest(100 - mx, 0, mx - 160), 2) + power(greatest(100 - my, 0, my - 130), 2) AS d2 FROM c)
SELECT doc_id, linked_chain AS chain_id, text AS full_code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, linked_chain ORDER BY d2, code_id) AS rn FROM k) WHERE rn = 1""")
def primary_code(spark: SparkSession, d: str) -> DataFrame:
    h = V.hits(spark, d)
    codes = h.select(*PAGE, F.col("hit_seq").alias("code_id"), F.col("text").alias("raw_text"), F.col("text").alias("base_code"), F.col("text").alias("full_code"), F.lit(1).alias("count"), "x0", "y0", "x1", "y1", "conf", (F.col("hit_seq") % 3).alias("linked_chain"))
    chains = V.pages(h).withColumn("chain_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).select(*PAGE, "chain_id", F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(160.0).alias("x1"), F.lit(130.0).alias("y1"))
    return quantify.primary_codes(chains, codes).select("doc_id", "chain_id", "full_code")


@query("c10_tiles", """
, p AS (SELECT DISTINCT doc_id, 2000 + doc_id * 100 AS w FROM v_hit)
SELECT doc_id, CAST(tx AS INT) AS tx FROM (SELECT doc_id, unnest(list_distinct(list_append(list_filter(range(0, w, 900), lambda x: x < w - 1200), w - 1200))) AS tx FROM p)""")
def tiles(spark: SparkSession, d: str) -> DataFrame:
    p = V.hits(spark, d).select(*PAGE).distinct().withColumns({"px_width": (2000 + F.col("doc_id") * 100).cast("int"), "px_height": F.lit(1000)})
    return cadpdf.tiles(p, CFG.tile_px, CFG.tile_overlap).select("doc_id", "tx")


@query("p15_distinct_colors")
def distinct_colors(spark: SparkSession, d: str) -> DataFrame:
    """A page's codes and their colours, no two alike while the palette lasts: sequential within a page."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        got = colors.distinct_colors(list(p["text"]))
        return pd.DataFrame([(p["doc_id"].iloc[0], c, v) for c, v in got.items()], columns=["doc_id", "text", "color"])

    return K.candidates(V.hits(spark, d), CFG).select("doc_id", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, text string, color string")


@query("q4_points_anti_join", f"""
SELECT h.doc_id, count(*) AS n FROM v_hit h WHERE regexp_matches(text, '{CODE_REGEX}') AND NOT EXISTS (SELECT 1 FROM v_seg s WHERE s.doc_id = h.doc_id AND s.seg_seq = h.hit_seq) GROUP BY ALL""")
def points_anti_join(spark: SparkSession, d: str) -> DataFrame:
    h = K.candidates(V.hits(spark, d), CFG)
    s = V.segments(spark, d).select("doc_id", F.col("seg_seq").cast("long").alias("hit_seq"))
    return h.join(s, ["doc_id", "hit_seq"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
