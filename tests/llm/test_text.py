"""BPE, token counts, toxicity, mixing, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantspark.llm import bpe, mixing, registry, token_counts, toxicity

from .test_similar import brute_groups


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_round_trip(edge, edge_rows, library):
    got = {}
    for r in bpe.round_trip(edge).collect():
        got.setdefault(r.doc_id, r)
    for r in edge_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        g = got[r[0]]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    again = bpe.decode(bpe.encode(edge)).collect()
    assert sorted((str(r.id), r.text) for r in again) == sorted((str(r[0]), r[1] or "") for r in edge_rows)


def test_random_texts(library):
    r, own = random.Random(3), bpe.loaded()
    for _ in range(400):
        text = "".join(r.choice([" ", "  ", "\n", "'s", "a", "Ab", "é", "1", "²", "!", "<|endoftext|>", "日", "\x1c", " ", chr(r.randrange(32, 0x2FFF))]) for _ in range(r.randrange(40)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text
    assert own.decode([255, 100, 240]) == library.decode([255, 100, 240], skip_special_tokens=False)


def test_token_counts(spark, edge, edge_rows, library):
    n = np.array(sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows))
    sums = token_counts.running_sums(token_counts.histogram(bpe.lengths(edge)), block=16).cache()
    for r in sums.collect():
        assert (r.docs_fitting, r.docs_longer) == ((n <= r.n_tokens).sum(), (n > r.n_tokens).sum())
        assert (r.tokens_kept, r.tokens_fitting) == (np.minimum(n, r.n_tokens).sum(), n[n <= r.n_tokens].sum()) and r.tokens_kept + r.tokens_cut == n.sum()
    for limit in (0, 5, 100, 10**6):
        got = token_counts.at_limit(sums, limit).first()
        assert (got.docs_fitting, got.tokens_kept) == ((n <= limit).sum(), np.minimum(n, limit).sum())
    for q in (0.1, 0.5, 1.0):
        assert token_counts.quantile(sums, q).first().n_tokens == n[int(np.ceil(q * len(n))) - 1]


def test_toxicity_learns(spark):
    r = random.Random(2)
    plain, rude = [f"p{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], ["grumble", "snarl", "hiss"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(rude))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scored(docs, model).select("row.doc_id", "score", (toxicity.fold("row.doc_id") == 0).alias("held")).collect()
    held = [g for g in got if g.held]
    assert np.mean([(g.score >= 0.5) == (g.doc_id % 5 == 0) for g in held]) > 0.97
    again = toxicity.scored(docs.withColumn("lang", F.lit(None).cast("string")), model).select("row.doc_id", "score").collect()
    assert {g.doc_id: g.score for g in again} == {g.doc_id: g.score for g in got}


def test_scores_by_brute_force(spark, edge, edge_rows):
    """Each score again, word by word and filter by filter, from the model's arrays."""
    import re

    from quantspark.llm.kernels import words_hash

    labels = spark.createDataFrame([(i, i % 2) for i in range(45)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    got = {r["row"].doc_id: r.score for r in toxicity.scored(edge, model).collect()}
    for doc_id, text, *_ in edge_rows:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = [m.group() for m in re.finditer(rb"[a-z\x80-\xff]+", raw)]
        one = lambda w: int(words_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(64 - toxicity.BITS))
        rows = [model.table[model.place[one(w)]] for w in words] + [np.zeros(toxicity.DIMS)] * toxicity.PAD
        total = model.base
        for f, shift, out in zip(model.filters, model.shift, model.out, strict=True):
            padded = rows + [np.zeros(toxicity.DIMS)] * len(f)
            best = np.max([sum(padded[i + j] @ f[j] for j in range(len(f))) for i in range(len(rows))], axis=0)
            total += np.maximum(best + shift, 0) @ out
        assert abs(got[doc_id] - 1 / (1 + np.exp(-total))) < 1e-4


def test_sample_is_bounded_by_bytes(spark):
    rows = [(i, ("good words here " if i % 2 else "bad snarl hiss ") * (40_000 if i == 7 else 5), "en") for i in range(1, 200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1, 200)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda hashes, *a: seen.append(sum(map(len, hashes))) or train(hashes, *a)
        toxicity.fit(docs, labels, sample_bytes=3000)
    finally:
        toxicity.train = train
    assert 0 < seen[0] <= 3000


def test_every_label_takes_part(spark):
    """More labels than a shard, and more than the 16,000 that fitting once took: a word that few documents hold is learnt from them."""
    n = 24_000
    rows = [(i, f"calm words {'xa' if i % 3 else 'xb'} " + ("snarl" if i % 7 == 0 else "fine") + (" rarely" if i % 4001 == 3 else ""), "en") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(n)], "doc_id long, toxic int")
    kept = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 > 1]
    model = toxicity.fit(docs, labels)
    one = toxicity.word_rows(np.frombuffer(b"rarely", np.uint8), np.array([0, 6]))[0][0]
    assert (model.place[one] > 0) == (sum(i % 4001 == 3 for i in kept) >= toxicity.LEAST_DOCS)
    some = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).filter(toxicity.fold("_id") != 0)
    shards = toxicity._shards(toxicity._hashed(docs, some, "doc_id", "text", "lang"), 4).cache()
    _, _, sizes = toxicity._vocabulary(shards)
    assert sizes[0].tolist() == [sum(i % 7 > 0 for i in kept), sum(i % 7 == 0 for i in kept)] and sizes.sum() > 16_000
    got = toxicity.scored(docs, model).select("row.doc_id", "score").collect()
    assert np.mean([(g.score >= 0.5) == (g.doc_id % 7 == 0) for g in got]) > 0.99
    again = toxicity.fit(docs.repartition(3), labels.repartition(2))  # how rows lie changes nothing
    assert np.array_equal(again.table, model.table) and again.thresholds == model.thresholds
    # thresholds, by brute force
    score = dict(got)
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 1]
    least = toxicity.calibrated(np.array([score[i] for i in held]), np.array([i % 7 == 0 for i in held], float), ["en"] * len(held))
    assert all(abs(least[k] - model.thresholds[k]) <= 1 / toxicity.GRID + 1e-6 for k in ("", "en"))


def test_toxicity_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(6, 1), (9, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    got = toxicity.scored(edge, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= g.score <= 1 for g in got)
    none = toxicity.fit(edge, labels.limit(0))
    assert {round(g.score, 5) for g in toxicity.scored(edge, none).collect()} == {0.0}
    assert toxicity.scored(empty, model).count() == 0


def test_rake():
    totals = {("a", "x"): 100.0, ("a", "y"): 300.0, ("b", "x"): 50.0, ("b", "y"): 550.0, ("c", "x"): 0.0}
    w = mixing.rake(totals, [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6, "z": 0.3}])
    assert abs(sum(w.values()) - 1) < 1e-9 and abs(w["a", "x"] + w["a", "y"] - 0.5) < 1e-6 and abs(w["a", "x"] + w["b", "x"] - 0.4) < 1e-6
    p = mixing.probabilities(totals, w, 0.3)
    assert abs(sum(p[c] * totals[c] for c in w) - 300) < 1e-6 and max(p.values()) <= 1
    assert mixing.rake({}, [{}]) == {} and mixing.probabilities({}, {}, 0.5) == {}


def test_mixing(docs, edge, edge_rows, empty):
    mix = mixing.fit(docs, {"lang": {"en": 0.4, "de": 0.3, "fr": 0.3}}, budget=0.4)
    out = mixing.decided(docs, mix).collect()
    for r in out:
        draw = int(hashlib.md5(f"{mixing.SEED}:{r['row'].doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.kept == (draw < r.probability) and r.probability == mix.cells[r.source, r.lang, r.topic]
        assert r.n_tokens == len(r["row"].text.split())
    assert {c[1] for c in mix.cells} <= {"en", "de", "fr", "*"}
    assert mixing.decided(edge, mixing.fit(edge)).count() == len(edge_rows)
    assert mixing.decided(empty, mixing.fit(empty)).count() == 0


def test_mixing_of_many_sources(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(r.randrange(1, 30))) + (" 123456" if i % 5 == 0 else ""), r.choice(["en", "de", None]), f"site{int(r.random() ** 3 * 1300)}") for i in range(6000)]
    rows += [(6000 + i, "a word", "en", f"tail{i}") for i in range(600)] + [(7000, "", "en", "site1"), (7001, None, "fr", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    assert docs.select("source").distinct().count() > 1001
    for targets in (None, {"source": {"site0": 2.0, "site1": 1.0, "gone": 1.0}}, {"lang": {"en": 0.5, "de": 0.5}}):
        near, far = (sorted(mixing.decided(docs, mixing.fit(docs, targets, budget=0.6, most_cells=n)).collect(), key=lambda x: x["row"].doc_id) for n in (10**6, 0))
        assert len(near) == len(far) == len(rows)
        for a, b in zip(near, far, strict=True):
            assert (a.source, a.lang, a.topic, a.n_tokens) == (b.source, b.lang, b.topic, b.n_tokens)
            assert abs(a.weight - b.weight) < 1e-8 and abs(a.probability - b.probability) < 1e-5
        if not targets:
            assert {x.source for x in far} == {x[3] for x in rows}
            have, whole = {}, sum(x.n_tokens for x in far)
            cells = {(x.source, x.lang, x.topic): x.weight for x in far}
            for x in far:
                have[x.source] = have.get(x.source, 0) + x.n_tokens
            n = sum(v > 0 for v in have.values())
            got = {}
            for (source, _, _), w in cells.items():
                got[source] = got.get(source, 0) + w
            assert max(abs(got[v] - (0.5 * k / whole + 0.5 / n if k else 0)) for v, k in have.items()) < 1e-4


def brute_lines(texts):
    """What line dedup leaves of each text."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(held[key(x)]) == i) for i, t in texts.items()}


def test_pipeline(spark, sf_dir, docs, texts, library):
    """Every stage against brute force on all that the stage before kept."""
    rows, kept = docs, set(texts)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
        out = corpus_pipeline.stored(stage(spark, rows, sf_dir), "test")
        if name == "BPE":
            got = {r.doc_id: r for r in out.collect()}
            assert sorted(got) == sorted(before) and all(r.is_exact for r in got.values())
            for i, t in before.items():
                ids = library.encode(t or "", add_special_tokens=False).ids
                assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) > 0.4 * len(before)
        if name == "line dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
            assert {i: r.text for i, r in after.items()} == brute_lines(before)
        else:
            assert all(r.text == before[i] for i, r in after.items())
        if name == "toxicity":
            model = toxicity.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            said = toxicity.scored(rows, model, carry=["doc_id", "lang"]).collect()
            assert set(after) == {r["row"].doc_id for r in said if r.score < model.thresholds.get(r["row"].lang, model.thresholds[""])}
        if name == "n-gram Jaccard join":
            assert set(after) == {int(i) for i, _, least in brute_groups(list(before.items()), 5, 80) if i == least}
        if name == "mixing":
            mix = mixing.fit(rows)
            cells = {r["row"].doc_id: (r.source, r.lang, r.topic, r.n_tokens) for r in mixing.decided(rows, mix).collect()}
            totals = {}
            for *c, n in cells.values():
                totals[tuple(c)] = totals.get(tuple(c), 0.0) + n
            weights = mixing.rake(totals, [mixing.flattened(totals, d, mixing.FLATTEN) for d in range(3)])
            chance = mixing.probabilities(totals, weights, mixing.BUDGET)
            draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
            assert set(after) == {i for i, (*c, n) in cells.items() if draw(i) < chance.get(tuple(c), 1.0)}
            assert all(n == len((before[i] or "").split()) for i, (*_, n) in cells.items())
        kept, rows = set(after), out
    assert len(kept) < len(texts)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))
