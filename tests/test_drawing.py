"""Operators on small drawings made by hand, and the whole plan on a synthetic page."""

import pytest
from pyspark.sql import functions as F

from quantspark.config import Config
from quantspark.operators import codes as K
from quantspark.operators import islands, legend, linking, pipes, quantify, validate
from quantspark.operators import scale as S
from quantspark.operators.nets import Net, bridge_dashes
from quantspark.plans import engine
from quantspark.sinks import bills
from quantspark.sources import cadpdf, facit, schema

CFG = Config()


def segments(spark, ends, width=2.0, layer=""):
    rows = [("d", 0, i, *map(float, e), float(width), 0.0, 0.0, 0.0, layer) for i, e in enumerate(ends)]
    return spark.createDataFrame(rows, "doc_id string, page_no int, seg_seq long, x1 double, y1 double, x2 double, y2 double, width double, r double, g double, b double, layer string")


def hits(spark, rows):
    """rows: (text, x, y[, width[, conf[, source]]]); boxes are 8 points high."""
    out = []
    for i, r in enumerate(rows):
        text, x, y, w, conf, source = (*r, *(40.0, 90.0, "ocr")[len(r) - 3 :]) if len(r) < 6 else r
        out.append(("d", 0, i, text, float(x), float(y), float(x + w), float(y + 8), float(conf), source, 11))
    return spark.createDataFrame(out, schema.HITS)


def lengths(spark, df):
    return sorted(round(r[0], 3) for r in df.select(pipes.length()).collect())


def chains(spark, ends, cfg=CFG):
    s = segments(spark, ends).withColumn("system", F.lit(None).cast("string"))
    return sorted(round(r.length_pt, 3) for r in pipes.build_chains(s, cfg)[0].collect())


def gaps(spark, gap):
    return spark.createDataFrame([("d", 0, float(gap))], "doc_id string, page_no int, max_gap double")


def test_bridged_dashes():
    dashes = [(10.0 * i, 0.0, 10.0 * i + 6, 0.0) for i in range(5)]
    assert [(len(g), extra) for g, extra in bridge_dashes(dashes, 1.5, 5.0)] == [(5, 16.0)]
    assert len(bridge_dashes([(0, 0, 10, 0), (10.5, 0, 20, 0), (20, 0.8, 20, 30)], 1.5, 0)) == 1


def test_no_cells_are_broadcast(spark, tmp_path):
    """Small files of long segments, written to many cells: as a broadcast they would all pass through the driver."""
    path = str(tmp_path / "s")
    segments(spark, [(0, 10 * i, 2000, 10 * i) for i in range(200)]).write.parquet(path)
    s = spark.read.parquet(path)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    for made in (pipes.cut_at_contacts(s, 0.5), pipes.endpoint_pairs(s, 0.5)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not any("_cx" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert islands.crossings(s.selectExpr("doc_id", "page_no", "x1 as _ax", "y1 as _ay", "x2 as _bx", "y2 as _by"), s)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0


def test_merge_collinear(spark):
    dashes = [(10 * i, 0, 10 * i + 6, 0) for i in range(5)]
    assert lengths(spark, islands.merge_collinear(segments(spark, dashes), gaps(spark, 5))) == [46.0]
    two = dashes + [(10 * i, 3, 10 * i + 6, 3) for i in range(5)]
    assert lengths(spark, islands.merge_collinear(segments(spark, two), gaps(spark, 5))) == [46.0, 46.0]
    assert lengths(spark, islands.merge_collinear(segments(spark, dashes), gaps(spark, 0))) == [6.0] * 5
    jitter = [(0, 180.4, 6, 180.4), (10, 180.6, 16, 180.6), (20, 180.5, 26, 180.5)]
    assert lengths(spark, islands.merge_collinear(segments(spark, jitter), gaps(spark, 5))) == [26.0]


def test_crossing_bridges(spark):
    ends = [(0, 0, 40, 0), (70, 0, 110, 0), (55, -20, 55, 20)]
    s = segments(spark, ends)
    assert 110.0 in lengths(spark, islands.merge_collinear(s, gaps(spark, 6), crossing_gap=40))
    assert 110.0 not in lengths(spark, islands.merge_collinear(s.filter("seg_seq < 2"), gaps(spark, 6), crossing_gap=40))


def test_dash_gap(spark):
    dashes = [(10 * i, 20 * r, 10 * i + 6, 20 * r) for r in range(6) for i in range(12)]
    assert 4.0 <= islands.dash_gap(segments(spark, dashes)).first().max_gap <= 6.5
    assert islands.dash_gap(segments(spark, [(0, 0, 300, 0)])).first().max_gap == 0


def test_junctions(spark):
    solid = Config(dash_gap_pt=0.0)
    assert chains(spark, [(0, 0, 100, 0), (100, 0, 200, 0), (100, 0, 100, 80)], solid) == [80.0, 200.0]
    assert chains(spark, [(0, 0, 200, 0), (100, 0, 100, 80)], solid) == [80.0, 200.0]
    assert len(chains(spark, [(0, 0, 100, 0), (100, 0, 100, 60), (100, 0, 100, -60)], solid)) == 3
    assert chains(spark, [(0, 0, 150, 0), (150, 0, 150, 100)], solid) == [250.0]


def test_chain_groups_and_free_ends(spark):
    s = segments(spark, [(0, 0, 10, 0), (10.5, 0, 20, 0), (20, 0.8, 20, 30), (100, 100, 120, 100)])
    assert sorted(r.chain for r in pipes.chain_groups(s, 1.5).collect()) == [0, 0, 0, 3]
    ends = segments(spark, [(0, 0, 10, 0), (10, 0, 10, 20)]).withColumn("group", F.lit(1))
    assert sorted((r.px, r.py) for r in pipes.free_ends(ends, 1.5).collect()) == [(0.0, 0.0), (10.0, 20.0)]
    assert [len(b) for b in Net([(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)], 0.1).branches(30)] == [3]


def test_pens(spark):
    pipe = segments(spark, [(0, 10 * i, 300, 10 * i) for i in range(50)], 2.04)
    thin = segments(spark, [(0, 5 + 10 * i, 200, 5 + 10 * i) for i in range(50)], 1.44)
    hatch = segments(spark, [(40 * (i % 10), 700 + 3 * (i // 10), 40 * (i % 10) + 2, 700 + 3 * (i // 10)) for i in range(300)], 0.72)
    every = pipe.unionByName(thin).unionByName(hatch)
    assert sorted(r.pen for r in pipes.pipe_clusters(every, CFG).collect()) == [1.44, 2.04]
    assert [r.pen for r in pipes.pipe_clusters(every, Config(pipe_width=0.72)).collect()] == [0.72]


def test_layers_choose_pipes(spark):
    s = segments(spark, [(0, 0, 100, 0)], layer="V-53BB-FE--S3-").unionByName(segments(spark, [(0, 9, 100, 9)], layer="K-27B---EI_"))
    got = pipes.pipe_segments(s, CFG).collect()
    assert [(r.layer, r.system) for r in got] == [("V-53BB-FE--S3-", "Spill- dagvatten")]
    assert [r.layer for r in pipes.pipe_segments(s, Config(pipe_layers=("K-27B---EI_",))).collect()] == ["K-27B---EI_"]


def test_dedup_keeps_places_apart(spark):
    rows = [("S3-R8-110", x, y) for x, y in ((100, 100), (103, 101), (400, 100), (404, 102), (100, 500), (101, 501), (102, 502))]
    got = K.best_of_cluster(K.clusters(hits(spark, rows), 12.0)).collect()
    assert sorted(r.raw_cluster_size for r in got) == [2, 2, 3]


def test_codes(spark):
    h = hits(spark, [("S3-P2", 100, 100), ("160(L)", 102, 112), ("2xKV1-X31", 300, 190, 60), ("V1-X31", 325, 190, 35), ("B7-GOLVBRUNN", 700, 700)])
    got = {r.raw_text: r for r in K.extract_codes(h, Config(exclude_zones=((690.0, 690.0, 800.0, 800.0),))).collect()}
    assert got["S3-P2"].full_code == "S3-P2-160(L)" and "V1-X31" not in got
    assert got["2xKV1-X31"]["count"] == 2 and got["B7-GOLVBRUNN"].excluded_reason == "exkluderingszon"


def test_scale(spark):
    pages = spark.createDataFrame([("d", 0, 1190.0, 842.0)], schema.PAGES)
    title = hits(spark, [("SKALA", 950, 820), ("1:5", 990, 820), ("1:50", 990, 830), ("1:100", 1010, 830)])
    assert S.determine_scale(pages, title, CFG).first().scale_text == "1:50"
    bar = hits(spark, [(str(i), 100 + 56.7 * i, 50, 6) for i in range(6)] + [("m", 100 + 56.7 * 5 + 15, 50, 6)])
    got = S.determine_scale(pages, bar, CFG).first()
    assert got.method == "skalstock" and round(got.pts_per_meter, 1) == 56.7
    both = S.determine_scale(pages, title.unionByName(bar.withColumn("text", F.col("text"))), CFG).first()
    assert both.method == "titelblock" and both.warnings == []
    assert S.determine_scale(pages, hits(spark, [("X", 0, 0)]), CFG).first().method == "okänd"
    assert S.determine_scale(pages, title, Config(scale="1:100")).first().method == "cli"


def test_legend(spark):
    words = [("SYSTEM", 10, 10), ("TAPPVATTEN", 55, 10), ("KV1-X31", 10, 30), ("VV1-X31", 10, 50), ("SYSTEM", 10, 100), ("SPILLVATTEN", 55, 100), ("S3-R8-75", 10, 120), ("B1-GOLVBRUNN", 300, 300), ("(8st)", 345, 300), ("FÖRKLARINGAR", 10, 0)]
    lines = legend.text_lines(hits(spark, words))
    got = {r.prefix: r.system for r in legend.prefix_map(lines, CFG).collect()}
    assert got["KV1"] == got["VV1"] == "Rör tappvatten" and got["S3"] == "Spill- dagvatten"
    assert [(r.code, r.expected) for r in legend.expected_counts(lines, CFG).collect()] == [("B1-GOLVBRUNN", 8)]
    assert legend.legend_box(lines).count() == 1


def test_leader_and_proximity(spark):
    runs = segments(spark, [(0, 200, 300, 200)]).select("doc_id", "page_no", F.lit(0).cast("long").alias("chain_id"), F.lit(0).alias("piece_no"), *pipes.ENDS)
    lead = spark.createDataFrame([("d", 0, 0, 100.0, 110.0, 140.0, 199.0)], "doc_id string, page_no int, leader_id long, x1 double, y1 double, x2 double, y2 double")
    codes = spark.createDataFrame([("d", 0, 0, 60.0, 95.0, 100.0, 103.0, False), ("d", 0, 1, 100.0, 185.0, 140.0, 193.0, False), ("d", 0, 2, 500.0, 500.0, 540.0, 508.0, False)], "doc_id string, page_no int, code_id long, x0 double, y0 double, x1 double, y1 double, excluded boolean")
    got = {r.code_id: r.link_method for r in linking.link_codes(codes, lead, runs, CFG).collect()}
    assert got == {0: "leader", 1: "proximity", 2: None}


def test_facit_and_reconciliation(spark, tmp_path):
    path = tmp_path / "facit.csv"
    path.write_text("﻿Subject;Längd;Lager;Antal_VS\nS3-R8-75;10,4;Spill;\nS3-R8-75;10,4;Spill;\nS3-R8-75;;Spill;2\nVV1;12,5;Tapp;\nMarkera;;;\nMarkera;;;\n", encoding="utf-8")
    f = validate.read_facit(facit.read_csv(spark, str(path)))
    by = {r.subject: r for r in f.collect()}
    assert (by["S3-R8-75"].n_rows, by["S3-R8-75"].total_length, by["S3-R8-75"].antal_vs) == (3, 20.8, 2) and by["Markera"].n_points == 2
    ours = spark.createDataFrame([("S3-R8-75", 2, 20.8, 0, 2), ("VV1", 1, 10.0, 0, 0), ("X", 0, 0.0, 1, 0)], "subject string, n_strackor long, total_langd_m double, n_punkter long, antal_vs long")
    r = validate.reconcile(ours, f)
    assert {x.subject: x.status for x in r.collect()} == {"S3-R8-75": "ok", "VV1": "deviates", "Markera": "missing", "X": "extra"}
    text = "\n".join(validate.report_lines(r))
    assert "-20 %" in text and "1/3" in text and "SAKNAS" in text
    sheet = bills.workbook({"A": [["Subject", "Längd"], ["S3", "1,5"], ["", None]]})
    got = validate.read_facit(facit.read_xlsx(spark, sheet)).collect()
    assert [(x.subject, x.total_length) for x in got] == [("S3", 1.5)]
    with pytest.raises(ValueError):
        validate.read_facit(spark.createDataFrame([("x",)], "a string"))


def pdf():
    """A page of 1190 x 842 points: two runs, a leader, thin strokes, a frame line, five texts."""
    up = lambda y: 842 - y
    line = lambda a, b, c, d: f"{a} {up(b)} m {c} {up(d)} l S"
    out = ["2 w"] + [line(100 + 50 * i, 400, 150 + 50 * i, 400) for i in range(4)] + [line(300, 400, 300, 450), line(300, 450, 300, 500)]
    out += [line(600 + 50 * i, 300, 650 + 50 * i, 300) for i in range(3)] + ["0.4 w", line(168, 352, 220, 398)]
    out += [line(50 + i, 50, 50 + i, 55) for i in range(30)] + ["2 w", line(20, 20, 1170, 20)]
    for text, x, y in (("S3-R8-75", 130, 348), ("2xKV1-X31", 600, 290), ("B7-GOLVBRUNN", 900, 700), ("SKALA", 950, 820), ("1:50", 990, 820)):
        out.append(f"BT /F1 8 Tf {x} {up(y)} Td ({text}) Tj ET")
    import zlib

    data = zlib.compress("\n".join(out).encode())
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 1190 842] /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"%%EOF"


def test_whole_page(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf())
    tables = {t: cadpdf.read(spark, [str(tmp_path / "a.pdf")], t) for t in ("pages", "hits", "items")}
    # forty pieces make a pen frequent; this page has ten
    got = engine.run(tables["pages"], tables["hits"], tables["items"], Config(min_cluster_count=5, dash_gap_pt=0.0))
    active = sorted(round(r.length_pt, 3) for r in got.chains.filter("not excluded").collect())
    assert active == [150.0, 300.0] and got.chains.filter("excluded").count() == 1
    rows = {r.subject: r for r in got.rows.collect()}
    assert rows["S3-R8-75"].langd_m == round(300 / 56.69291, 2) and rows["KV1-X31"].langd_m == round(150 / 56.69291, 2)
    assert rows["B7-GOLVBRUNN"].antal == 1 and got.scale.first().method == "titelblock"
    csv = bills.bill_csv(got.rows, "a.pdf").decode("utf-8-sig").splitlines()
    assert csv[0].startswith("Version;Document;Subject") and len(csv) == 4
    assert bills.bill_workbook(got, "a.pdf")[:2] == b"PK" and bills.code_csv(got.codes, "a.pdf").startswith(b"\xef\xbb\xbf")
    assert "Rörsträckor: 2 (1 exkluderade" in bills.run_report(got, "a.pdf") and '"method": "titelblock"' in bills.summary_json(got, "a.pdf")
    kinds = {r.kind for r in bills.annotations(got).select("kind").distinct().collect()}
    assert kinds == {"pipe", "label", "code", "link"}


def test_pdf_refuses_what_it_cannot_read():
    with pytest.raises(ValueError):
        cadpdf.read_pdf(b"%PDF-1.4 1 0 obj << /Encrypt 2 0 R >> endobj")


def test_vertical_rows(spark):
    codes = spark.createDataFrame([("d", 0, 0, "S3-R8-75", "S3-R8-75", "S3-R8-75", 1, 0.0, 0.0, 1.0, 1.0, 50.0, False, 0)], "doc_id string, page_no int, code_id long, raw_text string, base_code string, full_code string, count int, x0 double, y0 double, x1 double, y1 double, conf double, excluded boolean, linked_chain long")
    chain = spark.createDataFrame([("d", 0, 0, None, 100.0, 2, False, None, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_no int, chain_id long, system string, length_pt double, vertical_symbols long, excluded boolean, excluded_reason string, x0 double, y0 double, x1 double, y1 double")
    scale = spark.createDataFrame([("d", 0, None)], "doc_id string, page_no int, pts_per_meter double")
    systems = legend.systems_of_codes(codes, codes.select("doc_id", "page_no", F.lit("a").alias("prefix"), F.lit("b").alias("system")).limit(0), CFG)
    rows = {r.subject: r for r in quantify.quantity_rows(codes, chain, scale, systems, CFG).collect()}
    up = rows["S3-R8-75 Vertikal"]
    assert (up.antal_vs, up.total_vertikalhojd_m, up.lager) == (2, 5.6, "Spill- dagvatten")
    assert rows["S3-R8-75"].kommentar == "skala okänd (längd i pt); låg OCR-confidence (50)"


def test_jobs(spark, tmp_path):
    from quantspark.streaming import jobs

    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "good.pdf").write_bytes(pdf())
    (inbox / "note.pdf").write_bytes(b"not a drawing")
    (inbox / "locked.pdf").write_bytes(b"%PDF-1.4 1 0 obj << /Encrypt 2 0 R >> endobj")
    (inbox / "large.pdf").write_bytes(pdf() + b" " * 20000)
    run = lambda: jobs.watch(spark, str(inbox), out, str(tmp_path / "ck"), cfg=Config(pipe_width=2.0), fractions="0.9,0.9,1,1", most_bytes=len(pdf()) + 100).awaitTermination(300)
    run()
    got = {r.input_name: r for r in jobs.poll(spark, out).collect()}
    assert {n: r.status for n, r in got.items()} == {"good.pdf": "done", "note.pdf": "error", "locked.pdf": "error", "large.pdf": "error"}
    assert got["note.pdf"].error.startswith("400") and got["large.pdf"].error.startswith("413") and "encrypted" in got["locked.pdf"].error
    bill = jobs.rows_of(spark, out, got["good.pdf"].job_id)
    assert bill.count() == got["good.pdf"].n_rows > 0 and jobs.rows_of(spark, out, "unknown").count() == 0
    (inbox / "more.pdf").write_bytes(pdf())
    run()
    assert jobs.poll(spark, out).count() == 5  # files are jobs once


def test_streams(spark, tmp_path, sf_dir):
    from quantspark.streaming import jobs

    spark.createDataFrame([("d", 0, 10.0, 10.0)], schema.PAGES).write.parquet(str(tmp_path / "in"))
    seen = []
    q = jobs.run_folder(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.append(df.count()), "pages")
    q.awaitTermination(60)
    assert sum(seen) == 1
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events*.parquet")
    q = jobs.job_states(events).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("select sum(n) from states").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("name", ["j11_leader_links", "j13_proximity"])
def test_links_on_every_drawing(spark, sf_dir, monkeypatch, name):
    from quantspark.plans import queries_text as T

    near = lambda: sorted(map(tuple, T.QUERIES[name](spark, sf_dir).collect()))
    want = near()
    for view in ("hits", "segments"):
        of = getattr(T.V, view)
        monkeypatch.setattr(T.V, view, lambda *a, of=of: of(*a).withColumn("doc_id", F.col("doc_id") + 100))
    columns = T.QUERIES[name](spark, sf_dir).columns
    at = columns.index("doc_id")
    assert want and [(*r[:at], r[at] - 100, *r[at + 1 :]) for r in near()] == want
