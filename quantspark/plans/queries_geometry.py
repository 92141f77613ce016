"""Queries over line work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.config import Config, points_per_meter
from quantspark.functions import geometry as G
from quantspark.functions import layers as L
from quantspark.operators import islands, linking, pipes, quantify
from quantspark.operators.grid import PAGE, at_point, grid_join, over_box
from quantspark.operators.nets import bridge_dashes

from quantspark.shared import stored

from . import views as V

CFG = Config()
_LONG = lambda c: F.rint(F.col(c)).cast("long").alias(c)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_SYSTEM = """CASE WHEN layer LIKE '%V-53%' THEN 'Spill- dagvatten' WHEN layer LIKE '%V-52%' THEN 'Rör tappvatten' END"""
_LEN = "sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"


@query("system_lengths", f"""
SELECT doc_id, {_SYSTEM} AS system, count(*) AS n, CAST(sum({_LEN}) AS BIGINT) AS length_pt
FROM v_seg WHERE layer LIKE '%-FE-%' GROUP BY ALL""")
def system_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Drawn length of each system: pipe layers chosen by name, their system, totals."""
    s = V.segments(spark, d).filter(L.is_pipe_layer(F.col("layer")))
    return s.groupBy("doc_id", L.system_for_layer(F.col("layer")).alias("system")).agg(F.count("*").alias("n"), F.rint(F.sum(pipes.length())).cast("long").alias("length_pt"))


@query("p4_layer_fields", """
SELECT DISTINCT layer, trim(split_part(layer, '|', 2)) AS name, upper(substr(trim(split_part(layer, '|', 2)), 1, 1)) AS discipline,
       layer LIKE '%|V-%-FE-%' AS is_pipe, CASE WHEN layer LIKE '%V-53%' THEN 'Spill- dagvatten' WHEN layer LIKE '%V-52%' THEN 'Rör tappvatten' END AS system,
       CASE WHEN layer LIKE '%-S3-' THEN 'S3' WHEN layer LIKE '%-V1-' THEN 'V1' END AS system_id FROM v_seg""")
def layer_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("layer")
    return V.segments(spark, d).select("layer").distinct().select("layer", L.layer_name(c).alias("name"), L.discipline(c).alias("discipline"), L.is_pipe_layer(c).alias("is_pipe"), L.system_for_layer(c).alias("system"), L.system_id_for_layer(c).alias("system_id"))


@query("p20_point_segment_distance", """
SELECT doc_id, seg_seq, CAST(round(CASE WHEN x1=x2 AND y1=y2 THEN 400*400 ELSE 0 END) AS BIGINT) * 0 AS zero,
       CAST(floor(1000 * sqrt(power(250 - (x1 + t*(x2-x1)), 2) + power(500 - (y1 + t*(y2-y1)), 2)) + 0.0005) AS BIGINT) AS d_milli
FROM (SELECT *, greatest(0, least(1, coalesce(((250-x1)*(x2-x1)+(500-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0), 0))) AS t FROM v_seg)""")
def point_segment(spark: SparkSession, d: str) -> DataFrame:
    dist = G.point_segment_distance(F.lit(250.0), F.lit(500.0), *[F.col(c) for c in pipes.ENDS])
    return V.segments(spark, d).select("doc_id", "seg_seq", F.lit(0).cast("long").alias("zero"), F.floor(1000 * dist + 0.0005).cast("long").alias("d_milli"))


@query("p21_axis_angle", """
SELECT doc_id, seg_seq, degrees(atan2(least(abs(x2-x1), 3), greatest(abs(x2-x1), 3))) <= 2 AS axis_aligned,
       degrees(atan2(least(abs(x2-x1), 3), greatest(abs(x2-x1), 3))) >= 4 AS diagonal FROM v_seg""")
def axis_angle(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.lit(3.0)
    return V.segments(spark, d).select("doc_id", "seg_seq", G.is_axis_aligned(dx, dy).alias("axis_aligned"), G.is_diagonal(dx, dy, 4.0).alias("diagonal"))


@query("p22_line_keys", """
SELECT doc_id, seg_seq, CAST(CASE WHEN x2 > x1 THEN 1000 ELSE 0 END AS BIGINT) AS kx, CAST(CASE WHEN y2 > y1 THEN 1000 ELSE 0 END AS BIGINT) AS ky,
       CAST(CASE WHEN x2 > x1 THEN y1 WHEN y2 > y1 THEN -x1 ELSE 0 END AS BIGINT) AS off FROM v_seg""")
def line_keys(spark: SparkSession, d: str) -> DataFrame:
    return islands.with_line(V.segments(spark, d)).select("doc_id", "seg_seq", F.col("_kx").alias("kx"), F.col("_ky").alias("ky"), F.rint("_off").cast("long").alias("off"))


@query("p24_bezier", """
SELECT doc_id, seg_seq, i AS part, CAST(floor(64*(x1*power(1-i/4.0,3) + 3*x2*power(1-i/4.0,2)*(i/4.0) + 3*x2*(1-i/4.0)*power(i/4.0,2) + x1*power(i/4.0,3)) + 0.01) AS BIGINT) AS x64
FROM v_seg, (SELECT unnest([0,1,2,3]) AS i) WHERE x2 > x1""")
def bezier(spark: SparkSession, d: str) -> DataFrame:
    c = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    s = V.segments(spark, d).filter("x2 > x1").select("doc_id", "seg_seq", F.posexplode(G.bezier(c, 4)).alias("part", "s"))
    return s.select("doc_id", "seg_seq", "part", F.floor(F.col("s.x1") * 64 + 0.01).cast("long").alias("x64"))


@query("p25_color_close", """SELECT doc_id, seg_seq, abs(r - 0.25) <= 0.15 AND abs(g) <= 0.15 AND abs(b - 0.5) <= 0.15 AS close FROM v_seg""")
def color_close(spark: SparkSession, d: str) -> DataFrame:
    return V.segments(spark, d).select("doc_id", "seg_seq", G.color_close(tuple(F.col(c) for c in "rgb"), (F.lit(0.25), F.lit(0.0), F.lit(0.5)), 0.15).alias("close"))


@query("s3_expand_rectangles", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS drawn FROM (
  SELECT doc_id, unnest([x2-x1, 7, x2-x1, 7]) AS w FROM v_seg WHERE x2 > x1) WHERE w > 0 GROUP BY doc_id""")
def expand(spark: SparkSession, d: str) -> DataFrame:
    items = V.segments(spark, d).filter("x2 > x1").select("doc_id", "page_no", F.col("seg_seq").alias("path_id"), F.lit(0).alias("item_seq"), F.lit("re").alias("kind"), F.array(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y1") + 7).alias("coords"), "width", "r", "g", "b", "layer")
    return pipes.expand_items(items, CFG).groupBy("doc_id").agg(F.count("*").alias("n"), F.rint(F.sum(pipes.length())).cast("long").alias("drawn"))


@query("s4_small_symbols", """
SELECT doc_id, seg_seq AS path_id, CAST(2*x1 + (x2-x1) AS BIGINT) AS cx2, CAST(greatest(x2-x1, 4) AS BIGINT) AS diameter
FROM v_seg WHERE x2 > x1 AND greatest(x2-x1, 4) <= 10""")
def small_symbols(spark: SparkSession, d: str) -> DataFrame:
    items = V.segments(spark, d).filter("x2 > x1").select("doc_id", "page_no", F.col("seg_seq").alias("path_id"), F.lit(0).alias("item_seq"), F.lit("c").alias("kind"), F.array(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y1"), F.col("x2"), F.col("y1") + 4, F.col("x1"), F.col("y1") + 4).alias("coords"))
    return pipes.symbols(items, CFG).select("doc_id", "path_id", F.rint(F.col("cx") * 2).cast("long").alias("cx2"), F.rint("diameter").cast("long").alias("diameter"))


@query("a1_width_histogram", """
, c AS (SELECT doc_id, width, r, g, b, count(*) AS k, min(seg_seq) AS f FROM v_seg GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, width ORDER BY k DESC, f) AS rn, sum(k) OVER (PARTITION BY doc_id, width) AS n FROM c)
SELECT doc_id, width, CAST(n AS BIGINT) AS n, r, g, b FROM t WHERE rn = 1""")
def width_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pipes.width_histogram(V.segments(spark, d)).drop("page_no")


@query("a2_dominant_color", """
, c AS (SELECT doc_id, width, r, g, b, count(*) AS k, min(seg_seq) AS f FROM v_seg GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) AS rn FROM c WHERE abs(width - 2.0) <= 2.0 * 0.3)
SELECT doc_id, 2.0::DOUBLE AS pen, r, g, b FROM t WHERE rn = 1""")
def dominant_color(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    return pipes.dominant_color(s, s.select(*PAGE).distinct().withColumn("pen", F.lit(2.0)), 0.3).drop("page_no")


_LINES = """, ln AS (SELECT *, CASE WHEN x2 > x1 THEN 1 ELSE 0 END AS kx, CASE WHEN x2 > x1 THEN y1 ELSE -x1 END AS off,
  CASE WHEN x2 > x1 THEN x1 ELSE y1 END AS t0, CASE WHEN x2 > x1 THEN x2 ELSE y2 END AS t1 FROM v_seg WHERE x2 > x1 OR y2 > y1)"""


@query("a3_coverage", _LINES + """
, l AS (SELECT doc_id, kx, off, sum(t1-t0) AS ink, max(t1)-min(t0) AS span FROM ln GROUP BY ALL)
SELECT doc_id, CAST(floor(1000 * sum(ink) / sum(span) + 0.000001) AS BIGINT) AS milli FROM l GROUP BY doc_id""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return islands.coverage(V.segments(spark, d)).select("doc_id", F.floor(F.col("coverage") * 1000 + 0.000001).cast("long").alias("milli"))


@query("a4_pipe_clusters", _LINES + """
, l AS (SELECT doc_id, width, kx, off, sum(t1-t0) AS ink, max(t1)-min(t0) AS span FROM ln GROUP BY ALL),
cov AS (SELECT doc_id, width, sum(ink) / sum(span) AS c FROM l GROUP BY ALL),
h AS (SELECT doc_id, width, count(*) AS n FROM v_seg GROUP BY ALL),
s AS (SELECT h.*, coalesce(c, 0) AS c, n >= greatest(40, 0.002 * sum(n) OVER (PARTITION BY doc_id)) AS often FROM h LEFT JOIN cov USING (doc_id, width)),
w AS (SELECT *, max(CASE WHEN often AND c >= 0.5 THEN width END) OVER (PARTITION BY doc_id) AS ww, max(CASE WHEN often THEN width END) OVER (PARTITION BY doc_id) AS oo, max(width) OVER (PARTITION BY doc_id) AS zz FROM s)
SELECT doc_id, width AS pen FROM w WHERE CASE WHEN ww IS NOT NULL THEN often AND c >= 0.5 AND width >= ww * 0.45 ELSE width = coalesce(oo, zz) END""")
def pipe_clusters(spark: SparkSession, d: str) -> DataFrame:
    return pipes.pipe_clusters(V.segments(spark, d), CFG).select("doc_id", "pen")


@query("a5_dash_gap", _LINES + """
, g AS (SELECT doc_id, t0 - max(t1) OVER (PARTITION BY doc_id, kx, off ORDER BY t0, t1, seg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM ln),
k AS (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM g WHERE gap > 0 AND gap <= 40),
p AS (SELECT DISTINCT doc_id FROM v_seg)
SELECT p.doc_id, CAST(coalesce(round(gap * 10), 0) AS BIGINT) AS typical10 FROM p LEFT JOIN (SELECT * FROM k WHERE n >= 20 AND i = floor(n * 0.75) + 1) USING (doc_id)""")
def dash_gap(spark: SparkSession, d: str) -> DataFrame:
    return islands.dash_gap(V.segments(spark, d)).select("doc_id", F.rint(F.col("max_gap") / 1.3 * 10).cast("long").alias("typical10"))


@query("w3_dash_gaps", _LINES + """
, g AS (SELECT doc_id, t0 - max(t1) OVER (PARTITION BY doc_id, kx, off ORDER BY t0, t1, seg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM ln)
SELECT doc_id, CAST(gap AS BIGINT) AS gap, count(*) AS n FROM g WHERE gap > 0 AND gap <= 40 GROUP BY ALL""")
def all_dash_gaps(spark: SparkSession, d: str) -> DataFrame:
    return islands.dash_gaps(V.segments(spark, d)).groupBy("doc_id", F.rint("gap").cast("long").alias("gap")).agg(F.count("*").alias("n"))


@query("w1_offset_runs", _LINES + """
, f AS (SELECT *, CASE WHEN off - lag(off) OVER w > 5 THEN 1 ELSE 0 END + CASE WHEN lag(off) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ln WINDOW w AS (PARTITION BY doc_id, kx ORDER BY off, seg_seq))
SELECT doc_id, seg_seq, CAST(sum(new) OVER (PARTITION BY doc_id, kx ORDER BY off, seg_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM f""")
def offset_runs(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).filter(pipes.length() > 0)
    return islands.offset_runs(islands.with_line(s), 5.0).select("doc_id", "seg_seq", F.col("_line").alias("line"))


_MERGED = _LINES + """
, o AS (SELECT *, max(t1) OVER (PARTITION BY doc_id, kx, off ORDER BY t0, t1, seg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ln),
n AS (SELECT *, CASE WHEN reach IS NULL OR t0 - reach > 4 THEN 1 ELSE 0 END AS new FROM o),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kx, off ORDER BY t0, t1, seg_seq ROWS UNBOUNDED PRECEDING) AS run FROM n),
r AS (SELECT doc_id, kx, off, run, min(t0) AS t0, max(t1) AS t1, count(*) AS k FROM m GROUP BY ALL)"""


@query("c3_merge_collinear", _MERGED + """
SELECT doc_id, CAST(CASE WHEN kx = 1 THEN t0 ELSE -off END AS BIGINT) AS x1, CAST(CASE WHEN kx = 1 THEN off ELSE t0 END AS BIGINT) AS y1,
       CAST(CASE WHEN kx = 1 THEN t1 ELSE -off END AS BIGINT) AS x2, CAST(CASE WHEN kx = 1 THEN off ELSE t1 END AS BIGINT) AS y2 FROM r""")
def merge_collinear(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).filter(pipes.length() > 0)
    gaps = s.select(*PAGE).distinct().withColumn("max_gap", F.lit(4.0))
    return islands.merge_collinear(s, gaps, tol=0.5).select("doc_id", *[_LONG(c) for c in pipes.ENDS])


@query("j9_crossings", """
, h AS (SELECT * FROM v_seg WHERE x2 > x1), u AS (SELECT * FROM v_seg WHERE y2 > y1)
SELECT h.doc_id, h.seg_seq, count(*) AS n FROM h JOIN u ON h.doc_id = u.doc_id AND u.x1 > h.x1 AND u.x1 <= h.x2 AND u.y1 <= h.y1 AND u.y2 > h.y1
GROUP BY ALL""")
def crossings(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    gaps = s.filter("x2 > x1").select(*PAGE, "seg_seq", *[F.col(c).alias(g) for c, g in zip(pipes.ENDS, ("_ax", "_ay", "_bx", "_by"), strict=True)])
    up = s.filter("y2 > y1").select(*PAGE, F.col("seg_seq").alias("other"), *pipes.ENDS)
    cut = islands.crossings(gaps, up).select("doc_id", "seg_seq", "other").distinct()
    return cut.groupBy("doc_id", "seg_seq").agg(F.count("*").alias("n"))


_EDGES = """
, e AS (SELECT doc_id, layer, seg_seq, x1 AS px, y1 AS py FROM v_seg UNION ALL SELECT doc_id, layer, seg_seq, x2, y2 FROM v_seg),
ed AS (SELECT DISTINCT a.doc_id, a.seg_seq AS a, b.seg_seq AS b FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.layer = b.layer AND a.seg_seq < b.seg_seq
  AND abs(a.px-b.px) <= 1.5 AND abs(a.py-b.py) <= 1.5 AND sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)) <= 1.5)"""


@query("j6_endpoint_pairs", _EDGES + "SELECT doc_id, a, b FROM ed")
def endpoint_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pipes.endpoint_pairs(V.segments(spark, d), 1.5).drop("page_no")


@query("c2_chain_groups", _EDGES + """
, s AS (SELECT doc_id, a, b FROM ed UNION SELECT doc_id, b, a FROM ed),
reach(doc_id, n, m) AS (SELECT doc_id, seg_seq, seg_seq FROM v_seg UNION SELECT r.doc_id, s.b, r.m FROM reach r JOIN s ON r.doc_id = s.doc_id AND r.n = s.a WHERE r.m < s.b)
SELECT doc_id, n AS seg_seq, min(m) AS chain FROM reach GROUP BY ALL""")
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    return pipes.chain_groups(V.segments(spark, d), 1.5).select("doc_id", "seg_seq", "chain")


@query("c7_free_ends", """
, e AS (SELECT doc_id, layer, x1 AS px, y1 AS py FROM v_seg UNION ALL SELECT doc_id, layer, x2, y2 FROM v_seg)
SELECT doc_id, layer, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py FROM e GROUP BY ALL HAVING count(*) = 1""")
def free_ends(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).withColumn("group", F.col("layer"))
    return pipes.free_ends(s, 0.5).select("doc_id", F.col("group").alias("layer"), _LONG("px"), _LONG("py"))


def _stub_round(before: str, after: str, n: int) -> str:
    return f""", {before}e AS (SELECT doc_id, layer, seg_seq, x1 AS px, y1 AS py FROM {before} UNION SELECT doc_id, layer, seg_seq, x2, y2 FROM {before}),
{before}k AS (SELECT doc_id, layer, px, py, count(DISTINCT seg_seq) AS k FROM {before}e GROUP BY ALL),
{after} AS (SELECT * FROM {before} s WHERE NOT ({_LEN} < 12 AND EXISTS (SELECT 1 FROM {before}k k WHERE k.doc_id = s.doc_id AND k.layer = s.layer AND k = 1 AND ((k.px = s.x1 AND k.py = s.y1) OR (k.px = s.x2 AND k.py = s.y2)))))"""


@query("c5_prune_stubs", ", q0 AS (SELECT * FROM v_seg)" + "".join(_stub_round(f"q{i}", f"q{i + 1}", i) for i in range(4)) + " SELECT doc_id, seg_seq FROM q4")
def prune_stubs(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).withColumns({"group": F.col("layer"), "piece": F.col("seg_seq")})
    return pipes.prune_stubs(s, 0.5, 12.0).select("doc_id", "seg_seq")


@query("c4_cut_at_contacts", """
, p AS (SELECT doc_id, x1 AS px, y1 AS py FROM v_seg UNION SELECT doc_id, x2, y2 FROM v_seg),
l AS (SELECT doc_id, seg_seq, x1, y1, x2, y2, (x2-x1)+(y2-y1) AS len FROM v_seg),
c AS (SELECT DISTINCT l.doc_id, l.seg_seq, CASE WHEN x2 > x1 THEN px - x1 ELSE py - y1 END AS t FROM l JOIN p ON l.doc_id = p.doc_id
  AND CASE WHEN x2 > x1 THEN py = y1 AND px - x1 > 0.5 AND px - x1 < len - 0.5 ELSE px = x1 AND py - y1 > 0.5 AND py - y1 < len - 0.5 END WHERE len > 1)
SELECT l.doc_id, l.seg_seq, 1 + count(c.t) AS pieces, CAST(any_value(len) AS BIGINT) AS len FROM l LEFT JOIN c USING (doc_id, seg_seq) GROUP BY ALL""")
def cut_at_contacts(spark: SparkSession, d: str) -> DataFrame:
    cut = pipes.cut_at_contacts(V.segments(spark, d), 0.5)
    return cut.groupBy("doc_id", "seg_seq").agg(F.count("*").alias("pieces"), F.rint(F.sum(pipes.length())).cast("long").alias("len"))


@query("c6_branches")
def branches(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).withColumn("piece_no", F.lit(0))
    b = pipes.branch_pieces(s, CFG, s.select(*PAGE).distinct().withColumn("min_len", F.lit(3.0)))
    return b.groupBy("doc_id", "layer", "branch_no").agg(F.count("*").alias("n"), F.rint(F.sum(pipes.length())).cast("long").alias("length"))


@query("c8_build_chains")
def build_chains(spark: SparkSession, d: str) -> DataFrame:
    chains, _ = pipes.build_chains(stored(pipes.pipe_segments(V.segments(spark, d), CFG), "pipe-segments"), CFG)
    return chains.select("doc_id", "chain_id", "layer", "system", "n_segments", F.rint("length_pt").cast("long").alias("length"))


@query("f4_cluster_filter", """
SELECT doc_id, seg_seq FROM v_seg WHERE abs(width - 2.0) <= 2.0 * 0.15 AND abs(r - 0.25) <= 0.15
 AND NOT ((x1+x2)/2 BETWEEN 100 AND 200 AND (y1+y2)/2 BETWEEN 100 AND 400)""")
def cluster_filter(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    pens = s.select(*PAGE).distinct().withColumns({"pen": F.lit(2.0), "r": F.lit(0.25), "g": F.lit(0.0), "b": F.lit(0.5)})
    return pipes.filter_by_clusters(s, pens, Config(exclude_zones=((100.0, 100.0, 200.0, 400.0),))).select("doc_id", "seg_seq")


@query("f5_layer_filter", f"SELECT doc_id, seg_seq, {_SYSTEM} AS system FROM v_seg WHERE layer LIKE '%|V-%-FE-%'")
def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    return pipes.pipe_segments(V.segments(spark, d), CFG).select("doc_id", "seg_seq", "system")


@query("a6_layer_lengths", f"SELECT doc_id, layer, CAST(sum({_LEN}) AS BIGINT) AS length, count(*) AS n FROM v_seg GROUP BY ALL")
def layer_lengths(spark: SparkSession, d: str) -> DataFrame:
    return pipes.layer_lengths(V.segments(spark, d)).select("doc_id", "layer", _LONG("length"), "n")


@query("a12_top_layers", f"""
SELECT * FROM (SELECT doc_id, layer, length, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, layer) AS rank FROM (SELECT doc_id, layer, CAST(sum({_LEN}) AS BIGINT) AS length FROM v_seg GROUP BY ALL)) WHERE rank <= 60""")
def top_layers(spark: SparkSession, d: str) -> DataFrame:
    return quantify.top_layers(pipes.layer_lengths(V.segments(spark, d))).select("doc_id", "layer", _LONG("length"), F.col("rank").cast("long").alias("rank"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each pipe segment as a run of its own."""
    s = V.segments(spark, d).filter("width = 2.0")
    return s.select(*PAGE, F.col("seg_seq").alias("chain_id"), F.lit(0).alias("piece_no"), "seg_seq", *pipes.ENDS, "width")


@query("f6_leader_candidates", """
SELECT doc_id, seg_seq, row_number() OVER (PARTITION BY doc_id ORDER BY seg_seq) - 1 AS leader_id FROM (
 SELECT doc_id, seg_seq, x1, y1, x2 + 3 AS x2, y2 + 3 AS y2 FROM v_seg WHERE width < 1.6) s
WHERE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) BETWEEN 4 AND 250 AND degrees(atan2(least(x2-x1, y2-y1), greatest(x2-x1, y2-y1))) >= 4""")
def leader_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d).withColumns({"x2": F.col("x2") + 3, "y2": F.col("y2") + 3})
    pen = s.select(*PAGE).distinct().withColumn("pipe_width", F.lit(2.0))
    return linking.leader_candidates(s, _runs(spark, d), pen, CFG).select("doc_id", "seg_seq", F.col("leader_id").cast("long").alias("leader_id"))


@query("f7_frames", """
SELECT doc_id, seg_seq AS chain_id, x2 - x1 + 10 > 45 OR (x2-x1)+(y2-y1) >= 40 AS excluded,
 CASE WHEN x2 - x1 + 10 > 45 THEN 'sidram' WHEN (x2-x1)+(y2-y1) >= 40 THEN 'ram/rutnät (lång rak ensam linje)' END AS reason FROM v_seg WHERE width = 2.0""")
def frames(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 40 and more as lone lines; on pages of 50 x 10, boxes 10 larger than their runs as page frames."""
    r = _runs(spark, d)
    c = r.select(*PAGE, "chain_id", F.lit(1).alias("n_segments"), F.lit(True).alias("axis_aligned"), pipes.length().alias("length_pt"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), (F.col("x2") + 10).alias("x1"), (F.col("y2") + 10).alias("y1"))
    pages = V.pages(r).withColumns({"width": F.lit(50.0), "height": F.lit(10.0)})
    return pipes.flag_frames(c, pages, Config(frame_len_pt=40.0)).select("doc_id", "chain_id", "excluded", F.col("excluded_reason").alias("reason"))


@query("f8_short_runs", "SELECT doc_id, count(*) AS kept, CAST(sum((x2-x1)+(y2-y1)) AS BIGINT) AS length FROM v_seg WHERE (x2-x1)+(y2-y1) >= 3 GROUP BY doc_id")
def short_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = V.segments(spark, d).withColumns({"length_pt": pipes.length(), "min_len": F.lit(CFG.min_branch_pt)})
    return pipes.long_enough(runs).groupBy("doc_id").agg(F.count("*").alias("kept"), F.rint(F.sum(pipes.length())).cast("long").alias("length"))


@query("j10_symbols_to_ends", """
, c AS (SELECT doc_id, seg_seq, x1 AS px, y1 AS py FROM v_seg WHERE width = 2.0 UNION ALL SELECT doc_id, seg_seq, x2, y2 FROM v_seg WHERE width = 2.0),
f AS (SELECT doc_id, seg_seq, px, py FROM c),
y AS (SELECT doc_id, seg_seq AS path_id, x1 + 1 AS cx, y1 + 2 AS cy FROM v_seg WHERE width = 0.5),
m AS (SELECT y.doc_id, y.path_id, arg_min(f.seg_seq, ((cx-px)*(cx-px)+(cy-py)*(cy-py)) * 1000000000 + f.seg_seq) AS chain_id FROM y JOIN f ON y.doc_id = f.doc_id AND (cx-px)*(cx-px)+(cy-py)*(cy-py) <= 36 GROUP BY ALL)
SELECT doc_id, chain_id, count(*) AS vertical_symbols FROM m GROUP BY ALL""")
def symbols_to_ends(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    marks = V.segments(spark, d).filter("width = 0.5").select(*PAGE, F.col("seg_seq").alias("path_id"), (F.col("x1") + 1).alias("cx"), (F.col("y1") + 2).alias("cy"))
    chains = r.select(*PAGE, "chain_id").withColumn("excluded", F.lit(False))
    return pipes.count_symbols(chains, r, marks, CFG).filter("vertical_symbols > 0").select("doc_id", "chain_id", "vertical_symbols")


@query("j12_nearest_chain", """
, p AS (SELECT doc_id, seg_seq AS point, x1 + 2 AS px, y1 + 3 AS py FROM v_seg WHERE width = 0.5),
m AS (SELECT p.doc_id, p.point, s.seg_seq, power(px - greatest(x1, least(x2, px)), 2) + power(py - greatest(y1, least(y2, py)), 2) AS d2
      FROM p JOIN v_seg s ON p.doc_id = s.doc_id AND s.width = 2.0 AND px BETWEEN x1 - 8 AND x2 + 8 AND py BETWEEN y1 - 8 AND y2 + 8)
SELECT doc_id, point, seg_seq AS chain_id, CAST(d2 AS BIGINT) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, point ORDER BY d2, seg_seq DESC) AS rn FROM m WHERE d2 <= 64) WHERE rn = 1""")
def nearest_chain(spark: SparkSession, d: str) -> DataFrame:
    points = V.segments(spark, d).filter("width = 0.5").select(*PAGE, F.col("seg_seq").alias("point"), (F.col("x1") + 2).alias("px"), (F.col("y1") + 3).alias("py"))
    near = linking.nearest_chain(points, _runs(spark, d), 8.0, "point")
    return near.select("doc_id", "point", "chain_id", F.rint(F.col("distance") * F.col("distance")).cast("long").alias("d2"))


@query("j7_bridge_dashes")
def bridged_dashes(spark: SparkSession, d: str) -> DataFrame:
    """Dashes of a page bridged shortest gap first: greedy, so a page is one task's work."""
    import pandas as pd

    ends = list(pipes.ENDS)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seg_seq", kind="stable")
        rows = bridge_dashes(list(p[ends].itertuples(index=False, name=None)), 1.5, 4.0)
        return pd.DataFrame([(p["doc_id"].iloc[0], i, len(g), int(round(extra))) for i, (g, extra) in enumerate(rows)], columns=["doc_id", "group", "n", "bridged"])

    return V.segments(spark, d).groupBy("doc_id").applyInPandas(run, "doc_id long, group long, n long, bridged long")


@query("p17_meters", f"SELECT doc_id, CAST(floor(sum({_LEN}) * 100 / ((1000.0/50) / (25.4/72)) + 0.0000001) AS BIGINT) AS cm FROM v_seg GROUP BY doc_id")
def meters(spark: SparkSession, d: str) -> DataFrame:
    return V.segments(spark, d).groupBy("doc_id").agg(F.floor(F.sum(pipes.length()) * 100 / F.lit(points_per_meter(50)) + 0.0000001).cast("long").alias("cm"))


@query("a8_chain_rollup", f"""
SELECT doc_id, layer AS chain, count(*) AS n, CAST(sum({_LEN}) AS BIGINT) AS length, CAST(min(x1) AS BIGINT) AS x0, CAST(max(x2) AS BIGINT) AS x1, arg_min(width, seg_seq) AS first_width FROM v_seg GROUP BY ALL""")
def chain_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    rolled = pipes.roll_up(s, "doc_id", F.col("layer").alias("chain"), also=[F.min_by("width", "seg_seq").alias("first_width")])
    return rolled.select("doc_id", "chain", F.col("n_segments").alias("n"), F.rint("length_pt").cast("long").alias("length"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), "first_width")


@query("grid_join_points_in_boxes", """
SELECT p.doc_id, count(*) AS n FROM v_seg p JOIN v_seg b ON p.doc_id = b.doc_id AND b.width = 2.0 AND p.x1 BETWEEN b.x1 - 3 AND b.x2 + 3 AND p.y1 BETWEEN b.y1 - 3 AND b.y2 + 3 GROUP BY ALL""")
def points_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = V.segments(spark, d)
    b = s.filter("width = 2.0").select(*PAGE, *[F.col(c).alias(f"b{c}") for c in pipes.ENDS])
    b = over_box(b, F.col("bx1") - 3, F.col("by1") - 3, F.col("bx2") + 3, F.col("by2") + 3, 40.0)
    inside = F.col("x1").between(F.col("bx1") - 3, F.col("bx2") + 3) & F.col("y1").between(F.col("by1") - 3, F.col("by2") + 3)
    return grid_join(at_point(s, F.col("x1"), F.col("y1"), 40.0), b, inside).groupBy("doc_id").agg(F.count("*").alias("n"))
