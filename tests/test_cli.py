import os

from quantspark import cli

from .test_drawing import pdf


def test_flags_override_the_file(tmp_path):
    (tmp_path / "c.json").write_text('{"dpi": 300, "scale": "1:100"}', encoding="utf-8")
    args = cli.parser().parse_args(["x.pdf", "--config", str(tmp_path / "c.json"), "--scale", "1:50", "--exclude-zone", "0,0,1,1", "--pipe-width", "2,04;1,44", "--vertikalhojd", "Rör tappvatten=3"])
    cfg = cli.make_config(args)
    assert (cfg.dpi, cfg.scale, cfg.exclude_zones, cfg.pipe_widths) == (300, "1:50", ((0, 0, 1, 1),), (2.04, 1.44))
    assert cfg.vertical_heights["Rör tappvatten"] == 3 and cfg.vertical_heights["Okänt system"] == 2.8


def test_run(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(pdf())
    (tmp_path / "facit.csv").write_text("Subject;Längd;Lager;Antal_VS\nS3-R8-75;5,3;Spill;\n", encoding="utf-8")
    at = str(tmp_path / "a.pdf")
    assert cli.main([at, "--calibrate"], spark) == 0 and "Linjebredd-histogram" in capsys.readouterr().out
    assert cli.main([at, "--output-dir", str(tmp_path / "out"), "--pipe-width", "2", "--yes", "--facit", str(tmp_path / "facit.csv")], spark) == 0
    assert sorted(os.listdir(tmp_path / "out")) == [f"a_{n}" for n in ("annotations.pdf", "codes.csv", "preview.png", "quantities.csv", "quantities.xlsx", "report.txt", "summary.json", "validation.txt")]
    assert "S3-R8-75: facit 1 sträckor / 5,3 m totalt, vårt resultat 1 sträckor / 5,3 m totalt" in (tmp_path / "out" / "a_validation.txt").read_text(encoding="utf-8")
    assert cli.main([at, "--page", "7"], spark) == 1 and cli.main(["nope.pdf"], spark) == 1 and cli.main([at, "--scale", "nonsense"], spark) == 1


def test_annotations_are_drawn(spark, tmp_path):
    import zlib

    from quantspark.sources import cadpdf

    (tmp_path / "a.pdf").write_bytes(pdf())
    for layers, names in (("codes,pipes", {"codes", "links", "pipes"}), ("pipes", {"pipes"})):
        assert cli.main([str(tmp_path / "a.pdf"), "--output-dir", str(tmp_path / layers), "--pipe-width", "2", "--yes", "--layers", layers], spark) == 0
        raw = (tmp_path / layers / "a_annotations.pdf").read_bytes()
        assert {n for n in ("codes", "links", "pipes") if b"/Name (" + n.encode() + b")" in raw} == names
        (page,) = cadpdf.read_pdf(raw)  # our own reader finds the strokes, in their layers
        assert {x[-1] for x in page[2].items} == names
    png = (tmp_path / "pipes" / "a_preview.png").read_bytes()
    at = png.index(b"IDAT")
    width, height = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    pixels = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    assert len(pixels) == height * (3 * width + 1) and len(set(pixels)) > 2


class _Page:
    """A page of drawn text for an injected OCR engine: one tile holds a code, the others are blank."""

    @staticmethod
    def render(doc_id, page_no, box, dpi, hidden):
        import numpy as np

        grey = np.full((box[3], box[2]), 255, np.uint8)
        if (box[0], box[1]) == (0, 0):
            grey[:40] = 0
        return grey

    @staticmethod
    def recognise(grey, psm, lang):
        assert grey.min() == 0 and lang == "swe"  # blank tiles are not read
        return [("KV9-X31", 100.0, 200.0, 300.0, 250.0, 80.0), ("??", 0.0, 0.0, 1.0, 1.0, 5.0), (" ", 0.0, 0.0, 1.0, 1.0, 90.0)]


def test_ocr_flags(spark, tmp_path, capsys):
    import json

    from quantspark.sources import ocr

    (tmp_path / "a.pdf").write_bytes(pdf())
    run = lambda *flags, engine=None: cli.main([str(tmp_path / "a.pdf"), "--output-dir", str(tmp_path / "out"), "--pipe-width", "2", "--yes", *flags], spark, engine)
    engine = ocr.Engine(_Page.render, _Page.recognise)
    said = lambda: (tmp_path / "out" / "a_report.txt").read_text(encoding="utf-8")
    codes = lambda: (tmp_path / "out" / "a_codes.csv").read_text(encoding="utf-8-sig")
    assert run("--force-ocr") == 1 and "OCR" in capsys.readouterr().err
    assert run("--force-ocr", "--dpi", "72", "--tile-size", "400", "--psm", "11,6", engine=engine) == 0
    assert "KV9-X31" in codes() and "OCR: ja" in said()
    row = next(x for x in codes().splitlines() if "KV9-X31" in x).split(";")
    assert row[5:7] == ["200.0", "225.0"]  # pixels of the tile in points of the page
    assert run("--no-ocr", engine=engine) == 0 and "KV9-X31" not in codes() and "OCR: nej" in said()
    assert json.loads((tmp_path / "out" / "a_summary.json").read_text(encoding="utf-8"))["counts"]["n_codes"] >= 1
