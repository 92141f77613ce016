"""Toxicity: a convolutional text classifier, trained in numpy.

A text's words (runs of letters, A-Z lower cased) are hashed; hashes that
LEAST_DOCS training documents hold have a row of an embedding table, others
share the empty row, which is zero. Filters of one, two and three words slide over the whole
text, each gives the greatest of its responses, and a logistic layer turns
those into a score. The first embedding dimension starts from a word's smoothed log odds of standing in a toxic document, and
half of the filters from passing it on; these are initial values, which training moves like all others. Training descends the
gradient of all parameters (Adam) on all labelled documents; one part of them,
not trained on, chooses the epoch and the thresholds.

The labelled documents' word hashes are written to the shared folder in shards
of SHARD documents. In each epoch every shard is a task's: it takes its steps
from the common parameters, and the changes of all are averaged. Counts, losses
and the thresholds' shares are sums over all shards. The driver holds the
parameters alone: DIMS doubles for each row of the table, of which there are
at most 2**BITS, however many documents are labelled.

Thresholds are calibrated by language: for each, the least score whose
rejections are right often enough (PRECISION) on the part that was not trained
on; languages with few labelled documents take the threshold of all together.
A threshold decides what a filter rejects; it never changes a score.

Null and empty texts have a score too, that of a text without words. A very
long text is scored whole; some 60 bytes for each of its bytes must fit a task. Rows that
repeat a doc_id get the same score for the same text. Labels that are null or
have no document are passed over; without labels of both kinds every score is
the share of toxic labels (0 if there are none). An empty table gives an empty
result. Other columns can be carried along, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .kernels import U64, Words, chunks, lowered

BITS, DIMS, FILTERS, WIDTHS, PAD, LEAST_DOCS = 20, 12, 12, (1, 2, 3), 2, 3
EPOCHS, BATCH, RATE, DECAY, DOUBT, WEIGHT, SEED = 6, 64, 0.01, 1e-4, 8.0, 3.0, 7
#: DOUBT: documents that the smoothing of log odds counts for; WEIGHT: of a toxic document, as they are few.
#: Share of rejections that must be right, and labelled documents of a language that its own threshold needs.
PRECISION, LEAST_LABELS = 0.95, 200
#: Thresholds of a model of shards are multiples of 1 / GRID.
GRID = 1 << 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_GAP = ~_LETTER


def word_rows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the BITS-bit word hashes of a chunk's texts, PAD times -1 after each."""
    w = Words(lowered(raw), off, _GAP)
    rows = (w.hash >> U64(64 - BITS)).astype(np.int32)
    n = np.diff(w.off)
    starts = np.concatenate([[0], np.cumsum(n + PAD)])
    out = np.full(int(starts[-1]), -1, np.int32)
    out[np.arange(len(rows)) + PAD * np.repeat(np.arange(len(n)), n)] = rows
    return out, starts


def _ahead(rows: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For j = 0.. the row that lies j places after each; the empty row where that is another text's."""
    out = [rows]
    for j in range(1, max(WIDTHS)):
        shifted = np.concatenate([rows[j:], np.zeros(min(j, len(rows)), rows.dtype)])
        for d in range(1, j + 1):
            shifted[ends - d] = 0
        out.append(shifted)
    return out


@dataclass
class Model:
    place: np.ndarray  # of each hash its row of the table; the last entry is that of -1
    table: np.ndarray  # (rows, DIMS); row 0 is the empty one, zero
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    shift: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float]

    def tables(self) -> list[list[np.ndarray]]:
        """The response of each embedding row at each place of each filter: scoring is look-ups and sums."""
        return [[(self.table @ w).astype(np.float32) for w in f] for f in self.filters]

    def score(self, hashes: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        n, rows = len(starts) - 1, self.place[hashes]
        total = np.full(n, self.base)
        if not n:
            return total
        ahead = _ahead(rows, starts[1:])
        for k, (at, shift) in enumerate(zip(tables, self.shift, strict=True)):
            seen = at[0][rows]
            for j in range(1, len(at)):
                seen += at[j][ahead[j]]
            best = np.maximum.reduceat(seen, starts[:-1], axis=0) + shift
            total += np.maximum(best, 0) @ self.out[k]
        return 1 / (1 + np.exp(-total))


def _odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of standing in a toxic document. seen: (2, words), how many documents of each label hold a word; n:
    how many there are. The empty row's come first."""
    share = (seen + DOUBT * (n / n.sum())[:, None]) / (n + DOUBT)[:, None]
    return np.concatenate([[0], np.clip(np.log(share[1]) - np.log(share[0]), -3, 3)])


def _rows_of(hashes: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each hash, log odds of each row): rows for hashes that LEAST_DOCS documents hold, and the smoothed log odds
    of their presence in toxic documents, where the first dimension of the table starts."""
    seen = np.zeros((2, (1 << BITS) + 1), np.int32)
    for h, t in zip(hashes, toxic, strict=True):
        seen[int(t), np.unique(h[:-PAD])] += 1
    active = np.flatnonzero(seen[:, :-1].sum(0) >= LEAST_DOCS)
    return _places(active), _odds(seen[:, active], np.array([(toxic == 0).sum(), (toxic == 1).sum()], float))


def _places(active: np.ndarray) -> np.ndarray:
    place = np.zeros((1 << BITS) + 1, np.int32)
    place[active] = np.arange(1, len(active) + 1)
    return place


def _first(odds: np.ndarray, base: float, r: np.random.Generator) -> dict[str, np.ndarray]:
    """The parameters that training starts from: t the table, b the base, o the output layer, f and s of each width."""
    table = r.normal(0, 0.1, (len(odds), DIMS))
    filters = [r.normal(0, 0.1, (w, DIMS, FILTERS)) for w in WIDTHS]
    out = np.zeros((len(WIDTHS), FILTERS))
    table[:, 0] = odds
    table[0] = 0
    for w, f in zip(WIDTHS, filters, strict=True):
        f[:, 0, : FILTERS // 2] += 1 / w
        out[w - 1, : FILTERS // 2] = 0.3
    return {"t": table, "b": np.array([base]), "o": out} | {f"f{k}": f for k, f in enumerate(filters)} | {f"s{k}": np.zeros(FILTERS) for k in range(len(WIDTHS))}


def _base(share: float) -> float:
    return float(np.log((share + 1e-6) / (1 - share + 1e-6)))


def _model(place: np.ndarray, p: dict[str, np.ndarray]) -> Model:
    """The parameters as they are now; later steps don't change them."""
    return Model(place, p["t"].copy(), [p[f"f{k}"].copy() for k in range(len(WIDTHS))], [p[f"s{k}"].copy() for k in range(len(WIDTHS))], p["o"].copy(), float(p["b"][0]), {})


def _moments(p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    return {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}


def _epoch(p: dict[str, np.ndarray], moments: tuple, step: int, rows: list[np.ndarray], toxic: np.ndarray, order: np.ndarray) -> tuple[int, np.ndarray]:
    """One pass over the documents `order` in small steps that change p and moments: (steps so far, rows of the table that
    were moved)."""
    moment, square = moments
    moved = np.zeros(len(p["t"]), bool)
    for part in np.array_split(order, max(1, len(order) // BATCH)):
        step += 1
        flat = np.concatenate([rows[i] for i in part])
        ends = np.cumsum([len(rows[i]) for i in part])
        starts = np.concatenate([[0], ends[:-1]])
        ahead = _ahead(flat, ends)
        total, pooled = np.full(len(part), p["b"][0]), []
        for k, w in enumerate(WIDTHS):
            f = p[f"f{k}"]
            seen = sum(p["t"][ahead[j]] @ f[j] for j in range(w))
            where = np.stack([seen[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)])
            top = seen[where, np.arange(FILTERS)] + p[f"s{k}"]
            pooled.append((where, top))
            total += np.maximum(top, 0) @ p["o"][k]
        slope = (1 / (1 + np.exp(-total)) - toxic[part]) * np.where(toxic[part] == 1, WEIGHT, 1) / len(part)
        grad = {k: DECAY * v for k, v in p.items() if k != "t"} | {"b": np.array([slope.sum()])}
        touched, pulls = [], []
        for k, w in enumerate(WIDTHS):
            where, top = pooled[k]
            on = top > 0
            grad["o"][k] += (np.where(on, top, 0) * slope[:, None]).sum(0)
            back = slope[:, None] * p["o"][k] * on
            grad[f"s{k}"] = grad[f"s{k}"] + back.sum(0)
            for j in range(w):
                at = ahead[j][where]
                grad[f"f{k}"][j] += np.einsum("dfe,df->ef", p["t"][at], back)
                touched.append(at.ravel())
                pulls.append((back[:, :, None] * p[f"f{k}"][j].T[None]).reshape(-1, DIMS))
        hit, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        moved[hit] = True
        pull = np.zeros((len(hit), DIMS))
        np.add.at(pull, inverse, np.concatenate(pulls))
        pull[hit == 0] = 0
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        for k in p:
            rows_of = hit if k == "t" else slice(None)
            g = pull if k == "t" else grad[k]
            moment[k][rows_of] = 0.9 * moment[k][rows_of] + 0.1 * g
            square[k][rows_of] = 0.999 * square[k][rows_of] + 0.001 * g * g
            p[k][rows_of] -= RATE * (moment[k][rows_of] / fix1) / (np.sqrt(square[k][rows_of] / fix2) + 1e-8)
    moved[0] = False
    return step, np.flatnonzero(moved)


def _losses(scores: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return -np.where(toxic == 1, np.log(scores + 1e-9), np.log(1 - scores + 1e-9))


def train(hashes: list[np.ndarray], toxic: np.ndarray, held: np.ndarray, langs: list[str]) -> Model:
    """A model of documents in hand. hashes: each document's word hashes (with PAD); held: the documents that choose epoch and
    thresholds."""
    r = np.random.default_rng(SEED)
    fit = np.flatnonzero(~held)
    place, odds = _rows_of([hashes[i] for i in fit], toxic[fit]) if len(fit) else (_places(np.zeros(0, int)), np.zeros(1))
    p = _first(odds, _base(float(toxic.mean()) if len(toxic) else 0.0), r)
    if len(np.unique(toxic[fit])) < 2:
        return _untaught(place, p)
    rows, moments, best, kept, step = [place[h] for h in hashes], _moments(p), np.inf, None, 0
    check = np.flatnonzero(held) if held.any() else fit
    for _ in range(EPOCHS):
        step, _ = _epoch(p, moments, step, rows, toxic, r.permutation(fit))
        now = _model(place, p)
        loss = _losses(_scored(now, [hashes[i] for i in check]), toxic[check]).mean()
        if loss < best:
            best, kept = loss, now
    kept.thresholds = calibrated(_scored(kept, [hashes[i] for i in check]), toxic[check], [langs[i] for i in check])
    return kept


def _untaught(place: np.ndarray, p: dict[str, np.ndarray]) -> Model:
    out = _model(place, p)
    out.table *= 0
    out.out *= 0
    return out


def _scored(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    tables, out = model.tables(), []
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        out.append(model.score(np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])]), tables))
    return np.concatenate(out) if out else np.zeros(0)


def calibrated(scores: np.ndarray, toxic: np.ndarray, langs: list[str]) -> dict[str, float]:
    """The least score by language, and under "" of all, from which on rejections are right at PRECISION; 0.5 at least."""

    def least(s: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        last = np.append(s[order][1:] != s[order][:-1], True)
        good = np.flatnonzero(last & (right >= PRECISION))
        return max(0.5, float(s[order][good[-1]])) if len(good) else 0.5

    names = np.array([x or "" for x in langs], object)
    out = {"": least(scores, toxic)}
    for name in sorted(set(names) - {""}):
        own = names == name
        if own.sum() >= LEAST_LABELS and toxic[own].any():
            out[name] = least(scores[own], toxic[own])
    return out


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


#: Documents and words (PAD included) of a shard of the labelled documents; of the fixed point in which shards' numbers are summed.
SHARD, SHARD_WORDS, POINT = 4096, 4 << 20, 2.0**30
_SHARD = "toxic binary, held binary, langs array<string>, starts binary, rows binary"


def _hashed(docs: DataFrame, some: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(id, toxic, held, lang, rows): the word hashes of the documents of `some` (_id, _toxic), deflated."""
    lang = F.coalesce(docs[lang_col], F.lit("")) if lang_col else F.lit("")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    rows = rows.join(some.hint("merge"), "_id")  # labels grow with the corpus: no broadcast, at no size
    rows = rows.select(F.col("_id").cast("long"), "_toxic", (fold("_id") == 1).alias("held"), "lang", "text")

    def batch(b: pa.RecordBatch):
        data: list[bytes] = []
        for _, _, raw, off in chunks(b.column(4)):
            ids, starts = word_rows(raw, off)
            data += [zlib.compress(ids[a:z].tobytes(), 1) for a, z in zip(starts[:-1], starts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(data, pa.binary())], ["id", "toxic", "held", "lang", "rows"])

    return common.by_batch(rows, batch, "id long, toxic int, held boolean, lang string, rows binary")


def _shards(rows: DataFrame, n: int) -> DataFrame:
    """Rows of `_hashed` packed into n shards by a hash of the id, one row each, or several where the texts are long. What a
    shard holds, and in which order, depends on the rows alone, not on how they lie."""
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(n)), "_h": F.xxhash64("id", F.lit(SEED))})
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard", "_h", "id", "toxic", "lang", F.xxhash64("rows"))

    def pack(batches):
        have, words, last = [], 0, None

        def packed():
            toxic, held, langs, data = zip(*have, strict=True)
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
            cells = [np.array(toxic, np.int8).tobytes(), np.array(held, np.int8).tobytes(), list(langs), starts.tobytes(), zlib.compress(b"".join(data), 1)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()], strict=True)], ["toxic", "held", "langs", "starts", "rows"])

        for b in batches:
            for shard, *row in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                row[3] = zlib.decompress(row[3])
                if have and (shard != last or words + len(row[3]) // 4 > SHARD_WORDS):
                    yield packed()
                    have, words = [], 0
                last, words = shard, words + len(row[3]) // 4
                have.append(row)
        if have:
            yield packed()
        common.tidy()

    return rows.select("shard", "toxic", "held", "lang", "rows").mapInArrow(pack, _SHARD)


def _opened(b: pa.RecordBatch):
    """Of each shard of a batch its labels, whether held, languages and word hashes."""
    for toxic, held, langs, starts, rows in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
        at, h = np.frombuffer(starts, np.int64), np.frombuffer(zlib.decompress(rows), np.int32)
        yield np.frombuffer(toxic, np.int8).astype(float), np.frombuffer(held, np.int8) == 1, langs, [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def _vocabulary(shards: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all labelled documents: (hashes that LEAST_DOCS documents to train on hold, how many of each label hold them,
    how many documents there are, as (2, 2): to train on or held, by label)."""

    def batch(b: pa.RecordBatch):
        for toxic, held, _, hashes in _opened(b):
            own = np.zeros((2, 1 << BITS), np.int32)
            for i in np.flatnonzero(~held):
                own[int(toxic[i]), np.unique(hashes[i][:-PAD])] += 1
            at = np.flatnonzero(own.any(0))
            sizes = [((held == x) & (toxic == y)).sum() for x in (0, 1) for y in (0, 1)]  # at -1, -2 by label: to train on, held
            word = np.concatenate([at, [-1, -2]])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (word, np.concatenate([own[0, at], sizes[0::2]]), np.concatenate([own[1, at], sizes[1::2]]))], ["word", "plain", "bad"])

    all_ = common.by_batch(shards, batch, "word long, plain long, bad long").groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("bad").alias("bad"))
    got = all_.filter((F.col("plain") + F.col("bad") >= LEAST_DOCS) | (F.col("word") < 0)).toArrow().to_pandas().sort_values("word")
    word, seen = got["word"].to_numpy(np.int64), got[["plain", "bad"]].to_numpy(np.int64).T
    sizes = np.array([seen[:, word == k].sum(1) for k in (-1, -2)])
    return word[word >= 0], seen[:, word >= 0], sizes


def _round(shards: DataFrame, place: np.ndarray, p: dict[str, np.ndarray], held_out: bool, number: int, learn: bool) -> tuple[dict[str, np.ndarray], float]:
    """(parameters after one more epoch, loss of p): every shard takes an epoch's steps from p; the changes are averaged by
    documents, those of a table's row over the shards that moved it. Numbers are summed as integers, so in any order alike."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast((place, p))
    names = [k for k in p if k != "t"]
    flat = lambda q: np.concatenate([q[k].ravel() for k in names])
    wide = -(-sum(p[k].size for k in names) // DIMS)  # the others' numbers go as rows of DIMS, before the table's

    def batch(b: pa.RecordBatch):
        place, p = sent.value
        for toxic, held, _, hashes in _opened(b):
            fit, check = np.flatnonzero(~held), np.flatnonzero(held == held_out)
            scores = _scored(_model(place, p), [hashes[i] for i in check])
            keys, n, values = np.array([-1]), len(check), np.zeros((1, DIMS))
            values[0, 0] = np.rint(_losses(scores, toxic[check]) * POINT).sum()
            weight = np.array([n])
            if learn and len(fit):
                q = {k: v.copy() for k, v in p.items()}
                order = np.random.default_rng([SEED, number]).permutation(fit)
                _, moved = _epoch(q, _moments(q), 0, [place[h] for h in hashes], toxic, order)
                rest = np.zeros(wide * DIMS)
                change = flat(q) - flat(p)
                rest[: len(change)] = change
                keys = np.concatenate([keys, np.arange(wide), wide + moved])
                more = np.concatenate([rest.reshape(wide, DIMS), q["t"][moved] - p["t"][moved]])
                values = np.concatenate([values, np.rint(more * (len(fit) * POINT))])
                weight = np.concatenate([weight, np.full(len(more), len(fit))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weight), *[pa.array(values[:, d].astype(np.int64)) for d in range(DIMS)]], ["key", "n", *[f"v{d}" for d in range(DIMS)]])

    schema = "key long, n long, " + ", ".join(f"v{d} long" for d in range(DIMS))
    sums = common.by_batch(shards, batch, schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", *(f"v{d}" for d in range(DIMS)))])
    got = sums.toArrow()
    sent.destroy()  # else the driver keeps a copy of every round
    common.tidy()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    value = np.stack([got[f"v{d}"].to_numpy() for d in range(DIMS)], 1)
    loss = float(value[key == -1, 0].sum()) / POINT / max(1, int(n[key == -1].sum()))
    out = {k: v.copy() for k, v in p.items()}
    step = value / (n * POINT).clip(1)[:, None]
    rest = np.zeros((wide, DIMS))
    on = (key >= 0) & (key < wide)
    rest[key[on]] = step[on]
    change, at = rest.ravel(), 0
    for k in names:
        out[k] += change[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    on = key >= wide
    out["t"][key[on] - wide] += step[on]
    return out, loss


def _thresholds(shards: DataFrame, model: Model, held_out: bool) -> dict[str, float]:
    """`calibrated` over all shards, for thresholds that are multiples of 1 / GRID."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch):
        for toxic, held, langs, hashes in _opened(b):
            check = np.flatnonzero(held == held_out)
            place = np.floor(_scored(sent.value, [hashes[i] for i in check]) * GRID).astype(np.int64).clip(GRID // 2 - 1)
            own = [langs[i] for i in check]
            for names, keep in (([""] * len(own), np.ones(len(own), bool)), (own, np.array([x != "" for x in own], bool))):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(names, keep, strict=True) if k], pa.string()), pa.array(place[keep]), pa.array(toxic[check][keep].astype(np.int64))], ["lang", "place", "toxic"])

    found = common.by_batch(shards, batch, "lang string, place long, toxic long").groupBy("lang", "place").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    w = Window.partitionBy("lang")
    found = found.withColumns({"_n": F.sum("n").over(w), "_bad": F.sum("bad").over(w)})
    found = found.filter((F.col("lang") == "") | (F.col("_n") >= LEAST_LABELS) & (F.col("_bad") > 0))
    # a language has GRID / 2 + 1 rows at most
    right = F.sum("bad").over(w.orderBy(F.desc("place"))) / F.sum("n").over(w.orderBy(F.desc("place")))
    good = F.min(F.when((F.col("_right") >= PRECISION) & (F.col("place") >= GRID // 2), F.col("place")))
    got = found.withColumn("_right", right).groupBy("lang").agg(good.alias("place")).collect()
    sent.destroy()  # else the driver keeps a copy of every round
    common.tidy()
    return {"": 0.5} | {r.lang: 0.5 if r.place is None else max(0.5, r.place / GRID) for r in sorted(got)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", sample: int | None = None, sample_bytes: int | None = None) -> Model:
    """A model of labels(doc_id, toxic) whose fold is not 0; fold 1 is held for epoch and thresholds.

    Every labelled document takes part. Only a caller who gives `sample` or `sample_bytes` gets a model of no more labels
    or bytes of texts than that, those of least hash of the id, trained on the driver.
    """
    some = labels.select(labels["doc_id"].alias("_id"), labels["toxic"].cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null")
    some = some.filter(fold("_id") != 0)
    if sample is not None or sample_bytes is not None:
        got = _hashed(docs, _sampled(docs, some, id_col, text_col, sample, sample_bytes), id_col, text_col, lang_col).toArrow()
        got = got.to_pandas().sort_values(["id", "toxic"], kind="stable")
        ids = [np.frombuffer(zlib.decompress(x), np.int32) for x in got["rows"]]
        return train(ids, got["toxic"].to_numpy(np.float64), got["held"].to_numpy(bool), list(got["lang"]))
    with common.Scratch():
        n = max(1, -(-some.count() // SHARD))
        shards = common.stored(_shards(_hashed(docs, some, id_col, text_col, lang_col), n), "labelled")
        active, seen, sizes = _vocabulary(shards)
        place, whole = _places(active), int(sizes.sum())
        odds = _odds(seen, sizes[0].astype(float)) if sizes[0].sum() else np.zeros(1)
        p = _first(odds, _base(float(sizes[:, 1].sum() / whole) if whole else 0.0), np.random.default_rng(SEED))
        if not sizes[0].all():
            return _untaught(place, p)
        best, kept, held_out = np.inf, None, bool(sizes[1].sum())
        for number in range(EPOCHS + 1):
            then, loss = _round(shards, place, p, held_out, number, number < EPOCHS)
            if number and loss < best:
                best, kept = loss, p
            p = then
        model = _model(place, kept)
        model.thresholds = _thresholds(shards, model, held_out)
        return model


def _sampled(docs: DataFrame, some: DataFrame, id_col: str, text_col: str, sample: int | None, sample_bytes: int | None) -> DataFrame:
    """Of labels (_id, _toxic) those of least hash, before the first that goes over a limit."""
    if sample is not None:
        some = some.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample)
    if sample_bytes is not None:
        sizes = docs.select(docs[id_col].alias("_id"), F.octet_length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("long").alias("_size"))
        sizes = sizes.join(some.select("_id").distinct(), "_id").groupBy("_id").agg(F.sum("_size").alias("_size"))
        so_far = F.sum("_size").over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
        some = some.join(sizes.withColumn("_sum", so_far).filter(F.col("_sum") <= sample_bytes).select("_id"), "_id", "left_semi")
    return some


def scored(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", carry: list[str] | None = None) -> DataFrame:
    """(row, score, threshold): the carried columns (all by default) as one struct, the score of the whole text, and the
    threshold of its language.

    The model goes to the executors as a broadcast: 4 MB of places, and a row of DIMS doubles for a word that LEAST_DOCS
    labelled documents hold, at most 2**BITS of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[str, object] = {}

    def batch(b: pa.RecordBatch):
        if "tables" not in kept:
            kept["tables"] = sent.value.tables()
        out = []
        texts = b.column(1) if b.num_columns > 1 else pc.struct_field(b.column(0), text_col).cast(pa.string())
        for _, _, raw, off in chunks(texts):
            out.append(sent.value.score(*word_rows(raw, off), kept["tables"]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], ["row", "score"])

    kept_columns = docs.columns if carry is None else carry
    rows = docs.select(common.row_of(docs.select(kept_columns)).alias("row"), *([] if text_col in kept_columns else [docs[text_col].cast("string").alias("text")]))
    out = common.by_batch(rows, batch, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    base = F.lit(model.thresholds.get("", 0.5))
    for name, value in sorted(model.thresholds.items()):
        if name and lang_col in kept_columns:
            base = F.when(F.col("row")[lang_col] == name, F.lit(value)).otherwise(base)
    return out.withColumn("threshold", base)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, common.table(spark, sf_dir, "labels")), carry=["doc_id", "lang"]).withColumn("doc_id", F.col("row.doc_id"))
    rejected = F.col("score") >= F.col("threshold")
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", rejected.alias("rejected"))
