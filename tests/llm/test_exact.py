"""Fingerprints, exact dedup, line dedup: SQL on the small tables, brute force on the edge cases."""

import hashlib
import re
import unicodedata

import duckdb
import pytest

from quantspark.llm import exact_dedup, fingerprints, line_dedup, registry
from quantspark.llm.perfect_hash import PerfectHash

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(str, df.select(rel.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, rel.df().itertuples(index=False, name=None)))


@pytest.mark.parametrize("bits,digits", [(64, 64), (3, 64), (2, 1)])
def test_exact_groups(edge, edge_rows, bits, digits):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in edge_rows:
        groups.setdefault(body(r[1]), []).append(r)
    got = exact_dedup.exact_groups(edge, capacity=4, hash_bits=bits, digest_width=digits).collect()
    assert len(got) == len(edge_rows)
    for g in got:
        own = groups[next(body(r[1]) for r in edge_rows if r[0] == g.doc_id)]
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        assert (g.keep_id, g.group_size, g.kept, g.text_sha256) == (keep[0], len(own), g.doc_id == keep[0], sha(body(own[0][1])))


def test_directory_doubles(spark):
    hashes = spark.range(2000).selectExpr("xxhash64(id) as h", "if(id = 7, 900, 1) as n")
    slots = exact_dedup.directory(hashes, capacity=1)
    depth = (len(slots) - 1).bit_length()
    assert len(slots) == 1 << depth and depth > 3 and max(c for _, _, c in slots) >= 900 // 8
    for i, (b, local, _) in enumerate(slots):  # a bucket's slots share its leading bits
        assert {x >> (depth - local) for x, (y, _, _) in enumerate(slots) if y == b} == {i >> (depth - local)}
    assert [b for b, _, _ in slots] == sorted(b for b, _, _ in slots)
    assert exact_dedup.directory(spark.range(0).selectExpr("id as h", "id as n")) == [(0, 0, 1)]


def test_rows_are_found_through_the_directory(edge, edge_rows):
    """With two of the directory's pointers exchanged, the rows of their buckets are not found."""
    keys, texts, index, slots = exact_dedup.build(edge, capacity=4)
    assert exact_dedup.look_up(keys, texts, index, slots).count() == len(edge_rows)
    a, z = slots[0], slots[-1]
    wrong = [(z[0], *a[1:]) if s[0] == a[0] else (a[0], *z[1:]) if s[0] == z[0] else s for s in slots]
    moved = {a[0], z[0]}
    lost = index.filter(index["bucket"].isin(*moved)).agg({"group_size": "sum"}).first()[0]
    assert lost and exact_dedup.look_up(keys, texts, index, wrong).count() == len(edge_rows) - lost


@pytest.mark.parametrize("width,rows_in_range", [(32, 512), (1, 512), (32, 4)])
def test_edited_likeness(edge, edge_rows, width, rows_in_range):
    order = sorted((r for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    form = lambda t: re.sub(r"[\s\x1c-\x1f]+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")
    got = fingerprints.edited_likeness(edge, width=width, rows_in_range=rows_in_range).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for g in got:
        by.setdefault(g.doc_id, g)
    names = {}
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = by[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), sha(edited)) or r[0] == 3
        assert g.near_edited == float(form(edited) == form(text)) and g.near_next == float(form(after) == form(text)) or r[0] == 3
        names.setdefault(form(text), set()).add(g.fingerprint)
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(edge, width=width).collect()}
    assert len(set(alone.values())) == len(names)


@pytest.mark.parametrize("rows_in_range,most", [(8, 65_536), (4, 3), (1, 65_536)])
def test_next_by_id(spark, rows_in_range, most):
    """Null ids, the ends of long, one far id, dense ids and a repeated row: each row's next one, by brute force."""
    ids = [-(2**63), 2**63 - 1, 10**15, *range(1000, 1600)]
    rows = [(i, f"text {i}") for i in ids] + [(None, "without an id"), (1200, "text 1200")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["text"], rows_in_range=rows_in_range, most_ranges=most).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    want = sorted(zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r.text, r.next_text) for r in got) == want


@pytest.mark.parametrize("kw", [{}, {"key_bits": 2, "unit_bytes": 400}])
def test_lines(edge, edge_rows, kw):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for r in edge_rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(2**63 - 1 if r[0] is None else r[0])
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(edge, carry=True, **kw).collect()}
    for r in edge_rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != r[0])]
        g = got[r[0], len(lines)]
        assert (g.n_dropped, g.text) == (len(lines) - len(left), "\n".join(left)) and g["row"]["row"] == "r"


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64))
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(h.number(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).number(keys).max() == -1


def test_counts_decide():
    """The index holds all lines; a line's count, not its presence, makes it a repeat."""
    import numpy as np

    k, prints = np.array([7, 7, 9, 7, 9], np.uint64), np.array([1, 1, 1, 2, 1], np.uint64)
    index = line_dedup.LineIndex(k, prints, np.array([5, 3, 8, 4, 8]), np.array([1, 1, 1, 2, 1], np.uint32))
    assert index.hash.n == 2 and len(index.listed) == 1
    count, first = index.probe(np.array([7, 7, 9, 9, 1], np.uint64), np.array([1, 2, 1, 5, 1], np.uint64))
    assert count.tolist() == [2, 2, 1, 0, 0] and first[:3].tolist() == [3, 4, 8]
    assert line_dedup._told(k, [prints, np.array([5, 3, 8, 4, 8]), np.array([1, 1, 1, 2, 1], np.uint32)]).tolist() == [2, 1, 0, 1, 0]


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert fingerprints.edited_likeness(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
