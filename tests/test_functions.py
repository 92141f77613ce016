import pytest
from pyspark.sql import functions as F

from quantspark.config import Config, parse_scale, parse_vertical_heights, parse_zone, points_per_meter, safe_name, zones_from_fractions
from quantspark.functions import codes as C
from quantspark.functions import colors
from quantspark.functions import layers as L
from quantspark.functions import numbers as N


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_code_pattern(spark):
    good = ["S3-R8-75", "VG+1.46(L)", "KV2-X31", "2xVV1-X31", "B7-GOLVBRUNN", "S3-P2-160", "VVC1-X22", "D1-110"]
    bad = ["SKALA", "FÖRKLARINGAR", "hej", "12345", "A", "PLAN", "160(L)", "75", None]
    got = values(column(spark, good + bad), C.is_code(F.col("v")))
    assert got == [True] * len(good) + [False] * (len(bad) - 1) + [None]


def test_nx(spark):
    df = column(spark, ["2xKV1-X31", "5xVV1-X31", "KV1-X31", "2x160"])
    assert values(df, C.nx_count(F.col("v"))) == [2, 5, 1, 1]
    assert values(df, C.nx_base(F.col("v"))) == ["KV1-X31", "VV1-X31", "KV1-X31", "2x160"]


def test_inline_dimension_and_prefixes(spark):
    df = column(spark, ["S3-R8-110", "S3-P2", "110", "KV1-X31", "160(L)-40"])
    assert values(df, C.has_inline_dimension(F.col("v"))) == [True, False, False, False, True]
    assert values(df, C.letter_prefix(F.col("v"))) == ["S", "S", "110", "KV", "160(L)"]


def test_layers(spark):
    names = ["p|V-53BB-FE--S3-", "V-53BB--T--S3--", "K-27B---EI_", "V-52BB-FE--V1-", "V-XX-FE-D2", None, ""]
    df = column(spark, names)
    assert values(df, L.is_pipe_layer(F.col("v"))) == [True, False, False, True, True, False, False]
    assert values(df, L.system_for_layer(F.col("v"))) == ["Spill- dagvatten", "Spill- dagvatten", None, "Rör tappvatten", "Spill- dagvatten", None, None]
    assert values(df, L.system_id_for_layer(F.col("v")))[:2] == ["S3", "S3"]


def test_numbers(spark):
    df = column(spark, [" 1 234,5", "12 000", "", None, "x", "-2,9"])
    assert values(df, N.to_number(F.col("v"))) == [1234.5, 12000.0, None, None, None, -2.9]
    assert values(df, N.to_whole(F.col("v")))[-1] == -2
    d = column(spark, [2.675, 0.125, 1.005, None], "double")
    assert values(d, N.round_exact(F.col("v"), 2)) == [2.67, 0.12, 1.0, None]
    assert values(column(spark, [0.25, 0.35, None], "double"), N.decimal_comma(F.col("v"))) == ["0,2", "0,3", ""]


def test_colors(spark):
    import hashlib

    codes = ["S3-R8-75", "KV1-X31", "å"]
    want = [colors.PALETTE[int.from_bytes(hashlib.sha256(c.encode()).digest()[:8], "big") % 20] for c in codes]
    assert values(column(spark, codes), colors.color_for_code(F.col("v"))) == want
    got = colors.distinct_colors([f"c{i}" for i in range(25)])
    assert len(set(list(got.values())[:20])) >= 1 and len(set(got.values()) & set(colors.PALETTE)) == 20


def test_config(tmp_path):
    assert round(points_per_meter(50), 4) == 56.6929
    assert parse_scale("56,7 pt/m") == 56.7 and parse_scale("1 : 50") == points_per_meter(50)
    with pytest.raises(ValueError):
        parse_scale("50")
    assert parse_vertical_heights("Rör tappvatten=3, Okänt system=2.5") == {"Rör tappvatten": 3.0, "Okänt system": 2.5}
    assert parse_zone("3,4,1,2") == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        parse_zone("1,2,3")
    assert zones_from_fractions("0,0,.5,.5;.5,.5,1,1", 100, 200) == ((0, 0, 50, 100), (50, 100, 100, 200))
    path = tmp_path / "c.json"
    path.write_text('{"pipe_color": [0, 0, 1], "exclude_zones": [[1, 2, 3, 4]]}', encoding="utf-8")
    assert Config.from_file(str(path)).exclude_zones == ((1, 2, 3, 4),)
    with pytest.raises(KeyError):
        Config.from_json('{"nope": 1}')
    assert Config.from_json(Config(dpi=300).to_json()).dpi == 300
    assert safe_name("a/b:c.pdf") == "abc.pdf"
