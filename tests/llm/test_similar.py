"""The n-gram join, substring dedup and suffix-array dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantspark.llm import ngram_join, substring_dedup, suffix_dedup, units
from quantspark.llm.kernels import Words, grams, mix, window_minima

LAST = 2**63 - 1
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_groups(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words_of(lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[root(a)] = min(least.get(root(a), LAST), rows[a][0])
    return sorted((str(rows[a][0]), len(sets[a]), str(rows[a][0] if not sets[a] else least.get(root(a)))) for a in range(len(rows)))


def found_groups(df, **kw):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_groups(df, **kw).collect())


@pytest.mark.parametrize("k,percent,block", [(3, 90, 1024), (2, 60, 4)])
def test_groups(edge, edge_rows, k, percent, block):
    assert found_groups(edge, words=k, percent=percent, block=block, unit_bytes=1000 * block) == brute_groups([(r[0], r[1]) for r in edge_rows], k, percent)


@pytest.mark.parametrize("percent", [20, 50, 80, 100])
def test_small_sets(spark, percent):
    """Sets of one to four tokens, some tokens in most documents: any percent is exact."""
    rng = np.random.default_rng(percent)
    rows = [(i, " ".join(f"w{min(9, rng.geometric(0.3))}" if i % 3 else f"v{rng.integers(40)}" for _ in range(rng.integers(1, 5)))) for i in range(160)]
    rows += [(500, "a"), (501, "a b"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_groups(df, words=1, percent=percent) == brute_groups(rows, 1, percent)


def test_percent_is_checked(edge):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            ngram_join.similar_groups(edge, percent=percent)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_equal_sums(spark, n):
    """Two different words whose polynomial sums modulo 2**64 agree are different words, sets and windows."""
    x = thue_morse(n)
    y = x.translate({97: "b", 98: "a"})
    head = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*head, x])), (2, " ".join([*head, y])), (3, x), (4, y), (5, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found_groups(df, words=3, percent=90) == brute_groups(rows, 3, 90)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_windows(df).collect())
    assert got == brute_windows(rows, 13)
    assert found_bytes(df) == brute_bytes(rows, 100)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(150, rng.integers(0, 5), replace=False):
            w[j] = f"x{rng.integers(10)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_groups(df, words=3, percent=90, block=16) == brute_groups(rows, 3, 90)


def test_chained_sets(spark):
    """A component of 20,000 sets, each of which shares a signature with the next alone, needs no quadratic tasks."""
    n = 20_000
    groups = spark.range(n).selectExpr("id as node", "0L as component", "100L as n", "20 as level")
    shared = spark.range(n).selectExpr("id as node", "explode(array(id, id + 1)) as sig").filter(f"sig between 1 and {n - 1}")
    tasks = ngram_join._all_tasks(groups, shared, 64).cache()
    assert tasks.count() <= 2 * n
    pairs = tasks.alias("a").join(tasks.alias("b"), "task").filter("b.node = a.node + 1").select("a.node").distinct().count()
    assert pairs == n - 1
    assert ngram_join._tasks(groups, 64).count() > 50 * n  # as pairs of blocks


@pytest.mark.parametrize("words,percent", [(1, 50), (1, 80)])
def test_chains_by_signature(spark, words, percent):
    rows = [(i, f"a{i} a{i + 1} a{i + 2} {'b' + str(i) if i % 3 else ''}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found_groups(df, words=words, percent=percent, block=4) == brute_groups(rows, words, percent)


def test_one_of_each(edge):
    kept = ngram_join.one_of_each(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id = 13").count() == 1 and kept.filter("doc_id in (14, 16)").count() == 0


def test_one_of_each_by_rows(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{rng.integers(9999)}" for _ in range(n))
    near = lambda t: t + " more"
    a, b, c, d, e, f = (text(60) for _ in range(6))
    rows = [(None, a), (None, None), (None, ""), (None, b), (None, near(b)), (1, c), (1, near(c)), (2, d), (3, near(d)), (3, e), (None, near(e)), (4, f), (4, f), (4, f.upper()), (None, a), (None, " ")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = [r.text for r in got]
    assert texts.count(a) == 1 and (b in texts) + (near(b) in texts) == 1 and (c in texts) + (near(c) in texts) == 1
    assert d in texts and near(d) not in texts and e in texts and near(e) not in texts and (f in texts) + (f.upper() in texts) == 1
    assert sorted(t or "" for t in texts if not (t or "").strip()) == ["", "", " "] and len(texts) == 9


def brute_windows(rows, n):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = words_of(t)
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), LAST if i is None else i)
    out = []
    for i, t in rows:
        w, own = words_of(t), LAST if i is None else i
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < own:
                gone |= set(range(j, j + n))
        out.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("n,kw", [(13, {}), (5, {"first": 1}), (13, {"first": 2, "hash_bits": 3, "unit_bytes": 3000}), (1, {}), (8, {"first": 20})])
def test_windows(edge, edge_rows, n, kw):
    """Any first length; units of a few texts; forced collisions of the first hash."""
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_windows(edge, words=n, **kw).collect())
    assert got == brute_windows([(r[0], r[1]) for r in edge_rows], n)


def test_doubling_ends(spark, docs):
    assert substring_dedup.lengths(13, 4) == [4, 8, 13] and substring_dedup.lengths(5, 7) == [5]
    found = [r["length"] for r in substring_dedup.longest_repeats(docs.limit(60)).collect()]
    assert found == [13 * 2**i for i in range(len(found))] and found
    rows = [(i, " ".join(f"{i}-{j}" for j in range(50))) for i in range(20)] + [(99, "0-0 0-1 0-2 0-3 other")]
    corpus = units.write(spark.createDataFrame(rows, "doc_id long, text string"))
    stopped = substring_dedup.Repeats(corpus, 13, 2)
    assert stopped.sizes == [2, 4, 8, 13] and stopped.found[-1] == 0 and len(stopped.found) == 3 and not stopped.complete


def test_units(edge, edge_rows):
    """Units hold every row once, in their order; answers reach the unit that asked, whatever the number of units and parts."""
    for size in (1, 500, 1 << 22):
        corpus = units.write(edge, carry=F.struct(*[edge[c] for c in edge.columns]), unit_bytes=size)
        corpus.bits = 5
        assert sorted(map(str, units.carried(corpus).select("row.*").collect())) == sorted(map(str, edge.collect()))
        keys = lambda u: mix(u.ids.astype(np.uint64))
        path, *_ = units.ask(corpus, lambda u: (keys(u), [u.ids]), lambda k, v: v[0] % 7, [np.int64], "test")
        tell = lambda u: [pa.RecordBatch.from_arrays([pa.array(u.ids), pa.array(units.told(u, "q", keys(u), 5).astype(np.int64))], ["id", "n"])]  # noqa: B023, E731
        got = units.each(corpus, tell, "id long, n long", {"q": path}).collect()
        assert len(got) == len(edge_rows) and all(r.n == r.id % 7 for r in got)


def brute_bytes(rows, n):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b, own = (t or "").encode(), LAST if i is None else i
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen.setdefault(b[j : j + n], (own, j)) != (own, j):
                gone[j : j + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def found_bytes(df, **kw):
    d = suffix_dedup.dedup_bytes(df, **kw)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n, r.h) for r in d.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h")).collect())


@pytest.mark.parametrize("kw", [{}, {"hot": 1, "shard_bits": 2, "unit_bytes": 4000}, {"hot": 3, "in_memory": 50}, {"window": 64, "unit_bytes": 2000}])
def test_bytes(edge, edge_rows, kw):
    """Groups split down to single places, shards of many times the entries held in memory, units of a few texts."""
    assert found_bytes(edge, **kw) == brute_bytes([(r[0], r[1]) for r in edge_rows], kw.get("window", 100))


def test_hot_passage(spark):
    """A passage that many documents hold, each going on differently: groups are split, none stays hot."""
    r = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{i}" for i in r.integers(0, 500, n))
    passage = prose(30)
    rows = [(i, f"{prose(12)} {passage if i % 3 else passage[: 66 + i % 40]} {prose(12)}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_bytes(df, hot=8, unit_bytes=3000) == brute_bytes(rows, 100)


def test_short_texts_alone(spark):
    for texts in ([None], ["", ""], ["short", None, "", "short", "x" * 99]):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert found_bytes(df) == brute_bytes(rows, 100)


def test_suffix_array(monkeypatch):
    """Order and common prefixes against brute force, in memory and on disk, with small parts and blocks."""
    from quantspark.llm import induced

    r = np.random.default_rng(0)
    cases = [np.append(r.integers(1, s + 1, n), 0) for n, s in ((1, 3), (9, 2), (60, 2), (500, 3), (900, 400), (900, 2))] + [np.append(np.ones(300, int), 0), np.append(np.tile([1, 2, 3], 100), 0)]
    cases += [np.append(np.repeat(r.integers(1, 4, 60), r.integers(1, 9, 60)), 0), np.append(np.tile(r.integers(1, 5, 70), 8), 0)]
    cases += [np.append(r.integers(1, s + 1, n), 0) for n, s in zip(r.integers(1, 80, 60), r.integers(1, 5, 60), strict=True)]
    for held, part, block in ((1 << 22, 1 << 20, 1 << 16), (4, 7, 8)):
        monkeypatch.setattr(induced, "_PART", part)
        monkeypatch.setattr(induced, "BLOCK", block)
        for t in cases:
            want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
            agree = [0] + [next(k for k in range(len(t)) if t[a + k] != t[b + k]) for a, b in zip(want, want[1:], strict=False)]
            order, shared = induced.suffix_array(t, int(t.max()) + 1, held)
            assert order.tolist() == want and shared.tolist() == agree


def test_shard_larger_than_memory(monkeypatch):
    """A shard of some hundred times the entries that arrays may hold in memory is sorted in files."""
    from quantspark.llm import induced

    made = []
    array = induced._Files.array

    def counted(self, n, dtype, fill=None):
        made.append(n > self.in_memory)
        return array(self, n, dtype, fill)

    monkeypatch.setattr(induced._Files, "array", counted)
    r = np.random.default_rng(7)
    t = np.append(np.tile(r.integers(1, 30, 2500), 8), 0)
    order, shared = induced.suffix_array(t, 30, 200)
    plain, same = induced.suffix_array(t, 30)
    assert (order == plain).all() and (shared == same).all() and shared.max() == 2500 * 7 and sum(made) > 10


def test_kernels():
    texts = ["a b  c", "", "\nx", "c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    w = Words(raw, off)
    assert np.diff(w.off).tolist() == [3, 0, 1, 1] and w.hash[2] == w.hash[4] != w.hash[0]
    assert len(grams(w.hash, 9)) == 0
    h = np.array([5, 3, 9, 3, 1], np.uint64) << np.uint64(32)
    assert window_minima(h, 3).tolist() == [1, 1, 4] and window_minima(h, 5).tolist() == [4]


def test_empty(empty):
    assert ngram_join.similar_groups(empty).count() == 0
    assert substring_dedup.dedup_windows(empty).count() == 0
    assert suffix_dedup.dedup_bytes(empty).count() == 0
