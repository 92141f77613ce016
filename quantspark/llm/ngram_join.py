"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its different shingles of `words` words, A-Z lower
cased, as 64-bit hashes. Two documents link when 100 * |x & y| >= percent *
|x | y|, so they share at least o = ceil(percent * n / 100) of the n tokens of
either, and under one order of all tokens the j-th shared token is among the
first n - o + j of both.

Order: tokens by a count over all documents, rare ones first: each unit of
texts (see `units`) sends its different sets' tokens to ranges of hashes, where
they are counted, and is answered the counts. 32 bits of a token and its range
travel; tokens that agree in them share a count, sets that a unit holds several
times count once, and counts end at 255. Any order gives the same links, so a
count only has to be the same number wherever it is read.

Signatures: a rare token stands for itself; frequent tokens are dealt to m
classes by hash, the prefix is extended by m tokens, and pairs of tokens of
one class are indexed: of m + 1 shared frequent tokens two are in one class.
Sets so small that they may share fewer index their frequent tokens alone too.
m depends on the size class of a set; a set is indexed in its own size class
and the next, so two sets that can link have one in common. Tokens of one
document alone are never indexed.

Sets that are equal are one node, with any number of documents. Nodes with a
signature in common form candidate groups by a star around the signature's
least node, never by all pairs. A group's sets then meet in tasks of at most
BLOCK sets a side: small groups share a task, and a larger group is cut into
blocks by size class and hash, each pair of blocks that can hold a link being
a task. Where a group is a long chain, of sets that are alike in no more than a
signature, its sets meet by signature instead, if that sends fewer copies. A task indexes its sets by their prefixes again, skips pairs that are
joined already, verifies the rest exactly, and returns the links that join.
Components of the links are the result.

Null and empty texts have no tokens and link with nothing. A text with fewer
words than a shingle has its whole sequence as one token. Rows that repeat a
doc_id are nodes by their texts. A null doc_id takes part and never names a
component unless all ids in it are null. An empty table gives an empty result.
A very long text is one set: its tokens, 8 bytes each, must fit a task.
percent 100 links equal sets alone. Words and shingles are 64-bit hashes; two
different sets of one key are told apart by a second key.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators.components import connected_components

from . import common, units
from .kernels import U64, Words, chunks, grams, lowered, mix

#: Documents that hold a token before it counts as frequent; sets and tokens in a block; tokens of a prefix to one class of pairs.
RARE, BLOCK, BLOCK_TOKENS, PER_CLASS = 16, 1024, 1 << 20, 40


def token_sets(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): each document's different tokens in ascending order."""
    w = Words(lowered(raw), off)
    n = np.diff(w.off)
    out: list[np.ndarray] = []
    g = grams(w.hash, words)
    for i, (a, m) in enumerate(zip(w.off[:-1].tolist(), n.tolist(), strict=True)):
        if m >= words:
            out.append(np.unique(g[a : a + m - words + 1]))
        elif m:
            out.append(grams(w.hash[a : a + m], m, seed=m))
        else:
            out.append(np.zeros(0, U64))
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(tokens: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, sums over its tokens."""
    out = []
    for salt in (0x51ED270B0F1C3A57 + seed, 0xA24BAED4963EE407 + seed):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens ^ U64(salt)))])
        out.append(mix(sums[off[1:]] - sums[off[:-1]]))
    return out[0], out[1]


def _checked(words: int, percent: int) -> None:
    if words < 1 or not 1 <= percent <= 100:
        raise ValueError("words must be 1 or more, percent 1 to 100")


def _overlap(n, percent: int):
    return (n * percent + 99) // 100


def _level(n: np.ndarray, percent: int) -> np.ndarray:
    """Size classes: sets that can link are in one class or two that are next to each other."""
    if percent == 100:
        return n.astype(np.int64)
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _classes(level: np.ndarray, percent: int) -> np.ndarray:
    return np.maximum(1, ((level if percent == 100 else (100 / percent) ** level) / PER_CLASS).astype(np.int64))


class _Sets:
    """A unit's sets: tokens, offsets, two keys each, and the first row of each different set."""

    def __init__(self, texts: pa.Array, words: int, seed: int):
        tokens, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, _, raw, off in chunks(texts):
            t, at = token_sets(raw, off, words)
            tokens.append(t)
            sizes.append(np.diff(at))
        self.tokens, self.n = np.concatenate(tokens), np.concatenate(sizes)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.key, self.check = set_keys(self.tokens, self.off, seed)
        self.once = np.sort(np.unique(self.key, return_index=True)[1])

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of the different sets."""
        some = np.zeros(len(self.n), bool)
        some[self.once] = True
        return self.tokens[np.repeat(some, self.n)], np.concatenate([[0], np.cumsum(self.n[self.once])])


def _counts(corpus: units.Corpus, words: int) -> str:
    """Answers of each unit's tokens: how many sets hold them, those that differ in each unit."""

    def question(unit: units.Unit) -> tuple[np.ndarray, list[np.ndarray]]:
        s = _Sets(unit.texts, words, 0)
        keys = np.unique(s.tokens)
        n = np.bincount(np.searchsorted(keys, s.different()[0]), minlength=len(keys))
        return keys, [np.clip(n, 1, 255)]

    def reply(keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        _, back = np.unique(keys, return_inverse=True)
        return np.minimum(np.bincount(back, values[0]), 255)[back]

    return units.ask(corpus, question, reply, [np.uint8], "ngram-counts", short=True)[0]


def prefix_signatures(tokens: np.ndarray, counts: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set's position) of sets; counts: documents that hold each token."""
    sizes = np.diff(off)
    sig, owner = [], []
    for i in np.flatnonzero(sizes > (1 if percent > 50 else 0)).tolist():
        a, b, n = off[i], off[i + 1], int(sizes[i])
        c = counts[a:b]
        spare = n - _overlap(n, percent)
        ones = int((c < 2).sum())
        level = _level(np.array([n]), percent)
        levels = np.concatenate([level, level + 1])
        m = _classes(levels, percent)
        if ones >= spare + 1 + m.max():
            continue  # the whole prefix is of tokens that no other document has
        order = np.lexsort((tokens[a:b], c))
        t, c = tokens[a:b][order], c[order]
        head = t[: spare + 1][(c[: spare + 1] > 1) & (c[: spare + 1] <= RARE)]
        sig.append(mix(head ^ U64(0x1F83D9ABFB41BD6B)))
        owner.append(np.full(len(head), i))
        for lv, classes in zip(levels.tolist(), m.tolist(), strict=True):
            length = spare + 1 + classes
            often = t[:length][c[:length] > RARE]
            if n - spare <= classes:  # a set that may share too few tokens for a pair
                sig.append(mix(mix(often ^ U64(0x6A09E667F3BCC909)) + U64(lv + 1)))
                owner.append(np.full(len(often), i))
            if len(often) < 2:
                continue
            kind = (mix(often) % U64(classes)).astype(np.int64)
            by = np.argsort(kind, kind="stable")
            often, kind = often[by], kind[by]
            ends = np.searchsorted(kind, kind, "right")
            left = np.repeat(np.arange(len(often)), ends - np.arange(len(often)) - 1)
            right = np.arange(len(left)) - np.repeat(np.cumsum(ends - np.arange(len(often)) - 1) - (ends - np.arange(len(often)) - 1), ends - np.arange(len(often)) - 1) + left + 1
            x, y = np.minimum(often[left], often[right]), np.maximum(often[left], often[right])
            sig.append(mix(mix(x + U64(lv + 1)) + y))
            owner.append(np.full(len(left), i))
    if not sig:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(owner)


def _signed(corpus: units.Corpus, words: int, percent: int, seed: int, answers: str) -> DataFrame:
    """(unit, no, rid, doc_id, n, node, check, sigs): each document's set, and the signatures of a unit's different sets."""
    bits = corpus.bits

    def rows(unit: units.Unit):
        s = _Sets(unit.texts, words, seed)
        tokens, off = s.different()
        keys = np.unique(s.tokens)  # as asked
        counts = units.told(unit, "counts", keys, bits)[np.searchsorted(keys, tokens)]
        sig, owner = prefix_signatures(tokens, counts, off, percent)
        by = np.argsort(s.once[owner], kind="stable")
        ends = np.searchsorted(s.once[owner][by], np.arange(len(s.n) + 1))
        sigs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig[by].view(np.int64)))
        at = [pa.array(np.full(len(s.n), unit.number)), pa.array(np.arange(len(s.n), dtype=np.int32)), pa.array(unit.rids), pa.array(unit.ids, mask=unit.null)]
        yield pa.RecordBatch.from_arrays([*at, pa.array(s.n), pa.array(s.key.view(np.int64)), pa.array(s.check.view(np.int64)), sigs], ["unit", "no", "rid", "doc_id", "n", "node", "check", "sigs"])

    return units.each(corpus, rows, "unit long, no int, rid long, doc_id long, n long, node long, check long, sigs array<bigint>", {"counts": answers})


def links_within(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of keys that link, enough of them to join all that links join. side: sets of one task's two blocks; pairs
    within a block are left to the block's own task unless all have the same side."""
    n = np.array([len(x) for x in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    tokens, local, often = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, often))] = np.arange(len(tokens))
    local = rank[local]
    often = np.sort(often)
    off = np.concatenate([[0], np.cumsum(n)])
    local = local[np.lexsort((local, owner))]
    prefix = [local[off[i] : off[i] + n[i] - _overlap(n[i], percent) + 1] for i in range(len(sets))]
    prefix = [p[often[p] > 1] for p in prefix]
    mixed = len(np.unique(side)) > 1
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[int, list[int]] = {}
    mark = np.zeros(len(tokens) + 1, np.int64)
    links = []
    for i in np.argsort(n, kind="stable").tolist():
        least = -(-n[i] * percent // 100)
        seen = {j for t in prefix[i].tolist() for j in index.get(t, ())}
        own = root(i)
        seen = [j for j in seen if n[j] >= least and (not mixed or side[i] != side[j]) and root(j) != own]
        if seen:
            mark[local[off[i] : off[i + 1]]] = 1
            at = np.concatenate([local[off[j] : off[j + 1]] for j in seen])
            both = np.add.reduceat(mark[at], np.concatenate([[0], np.cumsum(n[seen])[:-1]]))
            mark[local[off[i] : off[i + 1]]] = 0
            for j, k in zip(seen, both.tolist(), strict=True):
                if 100 * k >= percent * (n[i] + n[j] - k) and root(j) != root(i):
                    parent[root(j)] = root(i)
                    links.append((int(keys[i]), int(keys[j])))
        for t in prefix[i].tolist():
            index.setdefault(t, []).append(i)
    return links


def _need(sets: Column, tokens: Column, block: int) -> Column:
    """Blocks for so many sets with so many tokens."""
    return F.greatest(F.ceil(sets / block), F.ceil(tokens / BLOCK_TOKENS), F.lit(1)).cast("long")


def _blocks(large: DataFrame, block: int) -> DataFrame:
    """(component, level, blocks): how many blocks a component's sets of a size class are cut into."""
    per_level = large.groupBy("component", "level").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    return per_level.select("component", "level", "k", _need(F.col("k"), F.col("t"), block).cast("int").alias("blocks"))


def _met(cut: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (component, level) with the blocks (_l, _b) that may hold sets they link with."""
    other = blocks.select(F.col("component").alias("_c"), F.col("level").alias("_l"), F.col("blocks").alias("_b"))
    return cut.join(other, (F.col("component") == F.col("_c")) & (F.abs(F.col("level") - F.col("_l")) <= 1))


def _tasks(groups: DataFrame, block: int) -> DataFrame:
    """(node, task, side) of sets (node, component, n, level): small components share a task, pairs of a large one's blocks
    that can hold a link are a task each."""
    total = groups.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    sized = groups.join(total, "component")
    few = _need(F.col("m"), F.col("tokens"), block) == 1
    every = groups.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    bins = _need(F.lit(float(every["m"])), F.lit(float(every["tokens"])), block)
    alone = sized.filter(few).select("node", F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("component"), bins)).alias("task"), F.lit(0).alias("side"))
    large = sized.filter(~few)
    blocks = _blocks(large, block)
    cut = large.join(blocks.drop("k"), ["component", "level"]).withColumn("no", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = _met(cut, blocks).withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    mine, theirs = F.struct("level", "no"), F.struct(F.col("_l").alias("level"), F.col("_no").alias("no"))
    name = lambda x: F.concat_ws(".", x["level"], x["no"])
    pair = F.concat_ws("/", F.col("component"), name(F.least(mine, theirs)), name(F.greatest(mine, theirs)))
    split = met.select("node", pair.alias("task"), F.when(mine > theirs, 1).otherwise(0).alias("side"))
    return alone.unionByName(split).distinct()


def _chained(groups: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """(component) of large components whose sets would be sent more often to pairs of blocks than to their signatures: long
    chains of sets that are alike in no more than a signature. shared: (node, sig), signatures of several sets."""
    total = groups.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    large = groups.join(total.filter(_need(F.col("m"), F.col("tokens"), block) > 1).select("component"), "component", "left_semi")
    blocks = _blocks(large, block)
    by_block = _met(blocks, blocks).groupBy("component").agg(F.sum(F.col("k") * F.col("_b")).alias("to_blocks"))
    by_sig = large.join(shared, "node").groupBy("component").agg(F.count("*").alias("to_signatures"))
    return by_block.join(by_sig, "component").filter("to_signatures < to_blocks").select("component")


def _all_tasks(groups: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """The tasks of all candidates: by component, or by signature for the sets of chained components. Either way sets that share
    a signature meet."""
    chained = common.stored(_chained(groups, shared, block), "ngram-chained")
    if chained.isEmpty():
        return _tasks(groups, block)
    plain = _tasks(common.stored(groups.join(chained, "component", "left_anti"), "ngram-groups"), block)
    sets = groups.join(chained, "component", "left_semi").join(shared, "node").select("node", F.col("sig").alias("component"), "n", "level")
    by_sig = _tasks(common.stored(sets, "ngram-groups"), block)
    return plain.unionByName(by_sig.withColumn("task", F.concat(F.lit("g/"), "task")))


def _grouped(corpus: units.Corpus, words: int, percent: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, nodes, named): each document's place and set key, the different sets, the component of those that link."""
    with common.Scratch() as held:
        counts = _counts(corpus, words)
        for seed in range(8):
            signed = common.stored(_signed(corpus, words, percent, seed, counts), "ngram-sets")
            keys = signed.drop("sigs")
            nodes = keys.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.min(F.struct("unit", "no")).alias("at"))
            if nodes.filter("low <> high").isEmpty():
                break  # no two different sets have one key
        held.keep(signed)
        named = held.keep(common.stored(_linked(corpus, signed, nodes, words, percent, block, seed), "ngram-components"))
    return keys, nodes, named


def _linked(corpus: units.Corpus, signed: DataFrame, nodes: DataFrame, words: int, percent: int, block: int, seed: int) -> DataFrame:
    """(node, component, rep) of the sets that link with another."""
    sigs = signed.select("node", F.explode("sigs").alias("sig"))
    star = sigs.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    shared = sigs.join(star, "sig")
    edges = shared.filter("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct()
    level = F.col("n").cast("int") if percent == 100 else F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")
    groups = connected_components(edges).withColumnRenamed("id", "node").join(nodes.select("node", "n", "at"), "node")
    groups = common.stored(groups.select("node", "component", "n", level.alias("level"), "at"), "ngram-groups")
    tasks = common.stored(_all_tasks(groups, shared.select("node", "sig"), block), "ngram-tasks")
    links = common.stored(_verified(corpus, groups, tasks, words, percent, seed), "ngram-links")
    return connected_components(links).withColumnRenamed("id", "node").join(nodes, "node").select("node", "component", "rep")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK, unit_bytes: int = units.UNIT_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; a component is named by its least doc_id."""
    _checked(words, percent)
    keys, nodes, named = _grouped(units.write(docs, id_col, text_col, unit_bytes=unit_bytes), words, percent, block)
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("node", "least")
    out = keys.join(nodes.select("node", "rep"), "node", "left").join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _verified(corpus: units.Corpus, groups: DataFrame, tasks: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """(src, dst) of links found in the tasks. One document sends each set, from the place that `groups` names."""
    wanted = units.give(corpus, groups.select("at.*"), "ngram-wanted")

    def send(unit: units.Unit):
        at = units.given(unit, "wanted")
        if len(at):
            s = _Sets(unit.texts.take(pa.array(at)), words, seed)
            yield pa.RecordBatch.from_arrays([pa.array(s.key.view(np.int64)), pa.array([s.tokens[a:z].tobytes() for a, z in zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True)], pa.binary())], ["node", "tokens"])

    def verify(t: pa.Table) -> pa.Table:
        node, first = np.unique(t["node"].to_numpy(), return_index=True)
        data, side = t["tokens"], t["side"].to_numpy()[first]
        found = links_within(node, [np.frombuffer(data[i].as_py(), U64) for i in first.tolist()], side, percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        del data
        common.tidy()
        return pa.table({"src": pa.array(pairs[:, 0].copy()), "dst": pa.array(pairs[:, 1].copy())})

    sets = units.each(corpus, send, "node long, tokens binary", {"wanted": wanted})
    return sets.join(tasks, "node").groupBy("task").applyInArrow(verify, "src long, dst long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates stays: the least by id (null ids last), then by set key, then by its number in the corpus.

    Rows without words stay. Rows are named by their number in the corpus, so null and repeated ids are rows like others.
    """
    _checked(words, percent)
    corpus = units.write(docs, id_col, text_col, common.row_of(docs, text_col))
    keys, _, named = _grouped(corpus, words, percent, BLOCK)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "node", "rid")
    first = keys.filter("n > 0").groupBy("node").agg(F.min(order).alias("first"))  # before rows move, one for each set
    best = first.join(named.select("node", "component"), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
    kept = best.select("first.rid").unionByName(keys.filter("n = 0").select("rid"))
    told = units.for_rows(corpus, kept.withColumn("data", F.lit(None).cast("binary")), "ngram-kept")

    def rows(b: pa.RecordBatch, found: np.ndarray, _: pa.Array) -> pa.RecordBatch:
        return b.filter(pa.array(found))

    out = units.each_row(corpus, told, rows, f"rid long, text string, row {corpus.kind}")
    text = F.col("text").cast(docs.schema[text_col].dataType)
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.size + y.size - k)
), sym AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(node, least) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, reach.least FROM reach JOIN sym ON reach.node = sym.a WHERE reach.least < sym.b
)
SELECT w.doc_id, coalesce(size, 0) AS n_shingles, (SELECT min(least) FROM reach WHERE node = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
