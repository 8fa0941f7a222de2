"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: the majority of each bit over the hashes of all word shingles. The query (``classes``) takes 64
bits of three-word shingles, repeats included, and links at 3 differing bits; the near-copy operator
(``representatives``) takes 128 bits of the distinct five-word shingles.

Index: fingerprints meet in cells, one for each table and value of the table's bits. For the query the tables
are exact: of so many blocks that all but three must agree, each choice of the agreeing ones is a table, and
there are more and longer ones the more fingerprints there are. For near copies a table is a fixed choice of
bits, as many that a cell holds some hundreds of fingerprints, and there are so many tables that a pair of a
Jaccard coefficient of 0.8 misses all of them with probability ``MISS`` (less above 0.8). In a cell the
fingerprints are sorted by Gray rank, in which those that share leading bits stand together. The shared
leading patterns form the upper nodes; a pair of nodes is followed only while the differences counted so far
stay within the limit, and not at all once all below both is known to be in one component; so whole groups
are pruned. A cell of more than ``CELL`` fingerprints (for near copies ``NEAR_TIMES`` as many) is cut into shares, and each two shares meet in a task
of their own, but for shares of one component; so no task holds an unbounded group and no pair is left out.

Groups of copies: equal fingerprints (for near copies: equal sets of shingles) are one vertex from the start.
Before pairs are searched, the rows of a cell meet its hubs only (the row with the most copies, and one by
chance; for near copies in the first tables), which joins a large group by a number of pairs in proportion to it.

Near copies are decided by the sets themselves: a candidate pair (up to ``REACH`` of 128 bits apart) is a link
if the sets' Jaccard coefficient is 0.8 or more. A parity of the sets rules out most others without them.

Components: alternating large-star and small-star steps, each cut by a checkpoint.

Values: no words (null, empty, white space only) give fingerprint zero, which is linked like any other; for
near copies such texts are one class. Rows without doc_id are kept, and never name a component unless none of
its rows has one (then null). Several rows of one doc_id count each with its own text; of rows alike in
doc_id and text ``representatives`` keeps one. An empty table gives an empty result. ``classes`` does not
read other columns; ``representatives`` hands on all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, drop_written, frugal, small_batches, text_of, written
from evidentia.operators.iterate import components

BITS = 3
#: Differing bits of 128 up to which near copies are candidates: 20 are expected at a Jaccard coefficient of 0.8, 4 the deviation.
REACH = 32
#: Probability that a pair of a Jaccard coefficient of 0.8 agrees in a bit: the angle of two sets of a cosine of 8/9.
AGREE = 1 - math.acos(8 / 9) / math.pi
MISS = 0.01
#: Tables whose cells have a hub by chance, too.
HUB_TABLES = 4
#: Tables in which near copies meet hubs; a pair that meets in another one only is left to the search of all pairs.
NEAR_HUB_TABLES = 8
#: Bits of a set's parity.
PARITY = 1024
#: Fingerprints of a cell that meet in one task.
CELL = 512
#: So many times as many for near copies, of which fewer and larger cells are made: each table is one more copy of all rows in an exchange.
NEAR_TIMES = 8
#: Rows of a task's index, before the copies that large cells add.
SHARD = 1 << 15
#: Rows of two longs up to which a table is broadcast.
SMALL = 200_000
_PAIRS = 1 << 19
_CHUNK = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """The XXH64 of the shingles, in pieces; A-Z count as a-z, words are runs of other bytes than ASCII white space; a shorter text is one shingle."""
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        yield np.array([digest(line, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    first, last = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(first), _CHUNK):
        yield np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], np.uint64)


def _majority(pieces: Iterator[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for h in pieces:
        total += len(h)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprint(text: str, shingle: int = 3) -> int:
    """Of the whole text, repeated shingles counted as often as they stand there."""
    return _majority(_shingle_hashes(text, shingle))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted."""
    found = [np.unique(h) for h in _shingle_hashes(text, 5)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *found]))


def wide_fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles: the majority of their hashes, and of the hashes mixed once more."""

    def mixed() -> Iterator[np.ndarray]:
        for at in range(0, len(found), _CHUNK):
            h = found[at : at + _CHUNK] * _MIX[0]
            h ^= h >> np.uint64(32)
            h *= _MIX[1]
            yield h ^ (h >> np.uint64(29))

    return _majority(found[at : at + _CHUNK] for at in range(0, len(found), _CHUNK)), _majority(mixed())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(count_a: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All combinations of each pair's children: the pair, and the place within either side."""
    size = count_a * count_b
    pair = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    return pair, within // count_b[pair], within % count_b[pair]


def _stars(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Each vertex' least label after joining the pairs' components."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _apart(code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(code[a] ^ code[b]).sum(1, dtype=np.int64)


def _ordered(cell: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The rows' order: by cell, then by the Gray rank of each of the code's words."""
    return np.lexsort((*[gray_rank(code[:, w]) for w in range(code.shape[1] - 1, -1, -1)], cell))


def _parts(cell: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of whole cells of two rows or more, so many that their pairs are about ``_PAIRS``."""
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(edge, len(cell)))
    edge, size = edge[size > 1], size[size > 1]
    budget = np.cumsum(size.astype(np.int64) ** 2) // _PAIRS
    for part in np.split(np.arange(len(edge)), np.flatnonzero(budget[1:] != budget[:-1]) + 1):
        if len(part):
            yield np.repeat(edge[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])


def linked(cell: np.ndarray, code: np.ndarray, label: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) of a forest of the links within each cell, but for what one label joins already; codes of a cell are distinct."""
    order = _ordered(cell, code)
    cell, code = cell[order], code[order]
    _, first, known = np.unique(label[order], return_index=True, return_inverse=True)
    known = first[known]
    # neighbours in Gray order come first: they join most of a dense group
    near = np.flatnonzero(cell[1:] == cell[:-1])
    near = near[_apart(code, near, near + 1) <= bits]
    joined = _stars(near, near + 1, known.copy())
    for rows in _parts(cell):
        a, b = _search(cell[rows], code[rows], joined[rows], bits)
        joined = _stars(rows[a], rows[b], joined)
    other = np.flatnonzero(joined != known)
    return order[other], order[joined[other]]


def crossing(cell: np.ndarray, code: np.ndarray, label: np.ndarray, bits: int, maybe: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within ``bits`` in a cell whose labels differ and that ``maybe`` does not rule out."""
    order = _ordered(cell, code)
    cell, code, label = cell[order], code[order], label[order]
    label = np.unique(label, return_inverse=True)[1]
    for rows in _parts(cell):
        a, b = _search(cell[rows], code[rows], label[rows], bits)
        # rows of one code are one leaf: each of a leaf's rows meets each of the other's
        same = np.append(True, (cell[rows][1:] != cell[rows][:-1]) | (code[rows][1:] != code[rows][:-1]).any(1))
        begin = np.flatnonzero(same)
        count = np.zeros(len(rows), np.int64)
        count[begin] = np.diff(np.append(begin, len(rows)))
        budget = np.cumsum(count[a] * count[b]) // _PAIRS
        for part in np.split(np.arange(len(a)), np.flatnonzero(budget[1:] != budget[:-1]) + 1):
            pair, i, j = _spread(count[a[part]], count[b[part]])
            x, y = a[part][pair] + i, b[part][pair] + j
            keep = (label[rows[x]] != label[rows[y]]) & ((a[part][pair] != b[part][pair]) | (i < j))
            x, y = order[rows[x[keep]]], order[rows[y[keep]]]
            keep = slice(None) if maybe is None else maybe(x, y)
            yield x[keep], y[keep]


def _search(cell: np.ndarray, code: np.ndarray, label: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (first rows of one code) within ``bits``, a leaf with itself too, but for pairs known to be in one component."""
    other = cell[1:] != cell[:-1]
    first = np.flatnonzero(np.append(True, other))
    left = right = np.arange(len(first))
    # the differences of the words before, pair by pair, are counted anew from the nodes' first rows
    levels = [(0, 56), (0, 48), (0, 32), (0, 0)] if code.shape[1] == 1 else [(w, s) for w in range(code.shape[1]) for s in (32, 0)]
    for word, shift in levels:
        lead = code[:, word] >> np.uint64(shift)
        begins = np.append(True, other | (lead[1:] != lead[:-1]))
        node = np.flatnonzero(begins)
        low, high = np.minimum.reduceat(label, node), np.maximum.reduceat(label, node)
        child = np.searchsorted(node, first)
        count = np.diff(np.append(child, len(node)))
        found = []
        budget = np.cumsum(count[left] * count[right]) // _PAIRS
        for part in np.split(np.arange(len(left)), np.flatnonzero(budget[1:] != budget[:-1]) + 1):
            pair, i, j = _spread(count[left[part]], count[right[part]])
            a, b = child[left[part]][pair] + i, child[right[part]][pair] + j
            keep = (a <= b) & ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[keep], b[keep]
            differ = np.bitwise_count(lead[node[a]] ^ lead[node[b]]).astype(np.int64)
            if word:
                differ += _apart(code[:, :word], node[a], node[b])
            found.append((a[differ <= bits], b[differ <= bits]))
        left, right, first = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), node
        if shift == 0:
            other = begins[1:]
    return first[left], first[right]


def exact_tables(bits: int, n: int) -> np.ndarray:
    """Masks (table, word) of 64 bits: codes within ``bits`` agree on one table's bits at least; longer ones for more codes."""
    for blocks in range(bits + 1, bits + 4):
        # the narrowest choice of agreeing blocks
        if (64 // blocks) * (blocks - bits) >= math.log2(max(n, 2)) - 6:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array([[sum(c)] for c in combinations(block, blocks - bits)], np.uint64)


def likely_tables(n: int) -> np.ndarray:
    """Masks (table, word) of 128 bits for near copies among n fingerprints, the same for the same n."""
    width = max(10, math.ceil(math.log2(max(n, 2))) - 9)
    number = math.ceil(math.log(MISS) / math.log(1 - AGREE**width))
    chance = np.random.default_rng(128)
    out = np.zeros((number, 128), np.uint8)
    for row in out:
        row[chance.choice(128, width, replace=False)] = 1
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def _words(prints: DataFrame) -> list[str]:
    return [c for c in prints.columns if c.startswith("w")]


def _possible(n: np.ndarray, parity: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and parities can have a Jaccard coefficient of 4/5: they differ in a ninth of their sizes' sum at most."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    return (5 * small >= 4 * large) & (9 * _apart(parity, a, b) <= small + large)


def _celled(prints: DataFrame, tables: np.ndarray) -> DataFrame:
    """(cell, at, node, label, copies, w0, ...) and, if there are, n and p0, ...: a row for each table."""
    words = _words(prints)
    names = ["cell", "at", *prints.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                n, code = part.num_rows, np.column_stack([part.column(c).to_numpy().view(np.uint64) for c in words])
                for at, mask in enumerate(tables):
                    cell = np.full(n, at, np.uint64)
                    for w in range(len(words)):
                        cell = (cell ^ (code[:, w] & mask[w])) * _MIX[0]
                        cell ^= cell >> np.uint64(32)
                        cell *= _MIX[2]
                        cell ^= cell >> np.uint64(29)
                    yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(np.full(n, at, np.int32)), *[part.column(c) for c in names[2:]]], names)

    return prints.mapInArrow(frugal(run), "cell long, at int, " + ", ".join(f"{c} long" for c in names[2:]))


def _differ(words: list[str], a: str, b: str) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return total


def _to_hubs(rows: DataFrame, words: list[str], bits: int) -> DataFrame:
    """(u, v): rows within ``bits`` of a hub of their cell: its row with the most copies, if two or more, and in some tables one by chance."""
    row = F.struct("node", *words)
    most = F.max_by(row, F.when(F.col("copies") > 1, F.struct("copies", F.xxhash64("node"))))
    some = F.min_by(row, F.when(F.col("at") < HUB_TABLES, F.xxhash64("node", "at")))
    hubs = rows.groupBy("cell").agg(F.array_compact(F.array_distinct(F.array(most, some))).alias("h")).select("cell", F.explode("h").alias("h")).select("cell", "h.*")
    found = rows.alias("r").join(hubs.alias("h"), (F.col("r.cell") == F.col("h.cell")) & (F.col("r.node") != F.col("h.node")) & (_differ(words, "r", "h") <= bits))
    return found.select(F.least("r.node", "h.node").alias("u"), F.greatest("r.node", "h.node").alias("v")).distinct()


def _meeting(rows: DataFrame, heavy: DataFrame, most: int) -> DataFrame:
    """The rows with i and j: a cell's rows that meet in one task; the shares of a heavy cell in pairs, but for shares of one label."""
    light = rows.join(heavy, "cell", "left_anti").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    # read several times, made once
    inside = cut(rows.join(heavy.select("cell"), "cell", "left_semi"))
    sizes = inside.groupBy("cell", "label").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > most).select("cell", "label", F.ceil(F.col("n") / most).cast("int").alias("own"))
    rest = sizes.filter(F.col("n") <= most).groupBy("cell").agg(F.ceil(F.sum("n") / most).cast("int").alias("pool"))
    name = lambda of, share: F.xxhash64(of, share)
    shares = large.select("cell", F.col("label").alias("of"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("k")).unionByName(rest.select("cell", F.lit(None).cast("long").alias("of"), F.explode(F.sequence(F.lit(0), F.col("pool") - 1)).alias("k")))
    shares = shares.select("cell", "of", name(F.col("of"), F.col("k")).alias("share"))
    pairs = shares.alias("a").join(shares.alias("b"), "cell").filter("a.share <= b.share and (a.of is null or b.of is null or a.of <> b.of)")
    pairs = pairs.select("cell", F.col("a.share").alias("i"), F.col("b.share").alias("j"))
    places = pairs.select("cell", F.explode(F.array_distinct(F.array("i", "j"))).alias("share"), "i", "j")
    placed = inside.join(large, ["cell", "label"], "left").join(rest, "cell", "left")
    many = F.coalesce("own", "pool", F.lit(1)).cast("long")
    own = F.when(F.col("own").isNotNull(), F.col("label"))
    share = name(own, F.pmod(F.when(F.col("own").isNotNull(), F.xxhash64("node")).otherwise(F.xxhash64("label")), many).cast("int"))
    return light.unionByName(placed.withColumn("share", share).drop("own", "pool").join(places, ["cell", "share"]).drop("share"))


def _pairs(rows: DataFrame, words: list[str], bits: int, total: int, forest: bool) -> DataFrame:
    """(u, v): the pairs that the cells' indexes find; a forest of them where a pair within ``bits`` is a link."""
    shards = max(1, -(-total // SHARD))
    parity = [c for c in rows.columns if c.startswith("p")]

    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in ("node", "cell", "label", "i", "j")}
        code = np.column_stack([t.column(c).to_numpy().view(np.uint64) for c in words])
        order = np.lexsort((col["j"], col["i"], col["cell"]))
        new = np.append(False, np.any([np.diff(col[c][order]) != 0 for c in ("cell", "i", "j")], axis=0))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new)
        maybe = None
        if parity:
            n, p = t.column("n").to_numpy(), np.column_stack([t.column(c).to_numpy().view(np.uint64) for c in parity])
            maybe = lambda a, b: _possible(n, p, a, b)
        found = [linked(group, code, col["label"], bits)] if forest else list(crossing(group, code, col["label"], bits, maybe))
        a, b = (np.concatenate([np.empty(0, np.int64), *[col["node"][f[s]] for f in found]]) for s in (0, 1))
        return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    rows = rows.withColumn("shard", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(shards)))
    return rows.drop("at", "copies").groupBy("shard").applyInArrow(run, "u long, v long").distinct()


def link_components(prints: DataFrame, bits: int, tables: np.ndarray, decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the rows (node, copies, w0, ...) that have a link: a pair within ``bits`` that meets in a table and that ``decide`` (all, where there is none) keeps.

    With n and p0, ... (a set's size and parity) pairs that these rule out are not asked for.
    """
    words, total, most = _words(prints), prints.count(), CELL if decide is None else NEAR_TIMES * CELL
    plain = prints.withColumn("label", F.col("node"))
    heavy = cut(_celled(prints.select(*words), tables).groupBy("cell").count().filter(F.col("count") > most).select("cell"))
    edges, labelled = None, plain
    if decide is not None or not heavy.isEmpty():
        # where pairs are links by themselves, only the rows of heavy cells need hubs
        narrow = _celled(prints.select("node", "copies", *words), tables if decide is None else tables[:NEAR_HUB_TABLES])
        hubs = _to_hubs(narrow if decide is not None else narrow.join(heavy, "cell", "left_semi"), words, bits)
        edges = decide(hubs) if decide is not None else cut(hubs)
        roots = components(edges)
        labelled = plain.join(roots, "node", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    rows = _celled(labelled, tables)
    met = rows.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}) if heavy.isEmpty() else _meeting(rows, heavy, most)
    found = _pairs(met, words, bits, len(tables) * total, decide is None)
    found = decide(found) if decide is not None else found
    return components(found if edges is None else edges.unionByName(found))


def classes(docs: DataFrame, shingle: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links of up to ``bits`` reach."""
    small_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = link_components(distinct.select(F.col("fp").alias("node"), "copies", F.col("fp").alias("w0")), bits, exact_tables(bits, distinct.count()))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _parity(found: np.ndarray) -> bytes:
    """A bit for each residue: whether an odd number of the shingles has it. Two texts differ in no more bits than shingles."""
    return np.packbits(np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()


_FOLDED = ("p0", "p1", "p2", "p3")
_SET = "doc_id long, digest long, k1 long, k2 long, n long, parity binary, w0 long, w1 long, p0 long, p1 long, p2 long, p3 long"


def _set_prints(rows: DataFrame) -> DataFrame:
    """The digest (k1, k2) of each text's set of shingles, their number and parity, and the fingerprint (w0, w1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, parity, wide = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                keys.append(xxhash.xxh128_digest(found.tobytes()))
                sizes.append(len(found))
                parity.append(_parity(found))
                wide.append(wide_fingerprint(found))
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            code = np.array(wide, np.uint64).reshape(-1, 2).view(np.int64)
            # the parity of the residues of a quarter as many: what the index carries
            folded = np.bitwise_xor.reduce(np.frombuffer(b"".join(parity), np.int64).reshape(-1, PARITY // 256, 4), axis=1)
            columns = [*key.T, sizes, pa.array(parity, pa.binary()), *code.T, *folded.T]
            yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), *[c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]], ["doc_id", "digest", "k1", "k2", "n", "parity", "w0", "w1", *_FOLDED])

    return rows.mapInArrow(frugal(run), _SET)


def _near(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): those of the pairs whose sets of shingles have a Jaccard coefficient of 4/5 or more, by the sets themselves."""

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = {c: batch.column(c).to_numpy() for c in ("u", "v", "un", "vn")}
                sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("up", "vp")]
                sizes = np.stack([col["un"], col["vn"]]).astype(np.int64)
                keep = (9 * np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64) <= sizes.sum(0)) & (5 * sizes.min(0) >= 4 * sizes.max(0))
                yield pa.record_batch([pa.array(col["u"][keep]), pa.array(col["v"][keep])], ["u", "v"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["node", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("u"), batch.column("v"))], ["u", "v"])

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("parity").alias(f"{c}p"))
    maybe = cut(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(frugal(fits), "u long, v long"))
    needed = maybe.select(F.col("u").alias("node")).unionByName(maybe.select(F.col("v").alias("node"))).distinct()
    needed = cut(needed.join(classes.select("node", "first.doc_id", "first.digest"), "node"))
    # a few longs a row: with so few of them the texts stay where they are, else both sides are exchanged
    few = F.broadcast(needed) if needed.count() <= SMALL else needed
    found = cut(rows.join(few, ["doc_id", "digest"]).select("node", "text").mapInArrow(frugal(sets), "node long, s binary").dropDuplicates(["node"]))
    both = maybe.join(found.select(F.col("node").alias("u"), "s"), "u").join(found.select(F.col("node").alias("v"), F.col("s").alias("t")), "v")
    return cut(both.select("u", "v", "s", "t").mapInArrow(frugal(decide), "u long, v long"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, but for those near to one of a smaller doc_id (rows without doc_id stay)."""
    small_batches(docs.sparkSession)
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    prints = written(_set_prints(rows), "shingles")
    firsts = [F.first(c).alias(c) for c in ("n", "parity", "w0", "w1", *_FOLDED)]
    found = written(prints.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("copies"), *firsts).withColumnRenamed("k1", "node"), "classes")
    roots = link_components(found.select("node", "copies", "w0", "w1", "n", *_FOLDED), REACH, likely_tables(found.count()), lambda pairs: _near(pairs, found, rows))
    named = found.select("node", "k2", "first.doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = named.select(F.col("node").alias("k1"), "k2", "root").join(least, "root")
    # by the text, too: rows of one doc_id may differ in it
    gone = written(prints.join(named, ["k1", "k2"]).filter("doc_id <> least").select("doc_id", "digest").distinct(), "gone")
    twice = written(prints.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest"), "twice")
    drop_written(prints, found)
    # the documents as one value: no name of theirs can clash with one of these
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("digest")]
    # two longs a row: with so few of them the documents stay where they are
    few = F.broadcast(gone) if gone.count() <= SMALL else gone
    kept = docs.select(F.struct("*").alias("row"), *key).join(few, ["doc_id", "digest"], "left_anti")
    if not twice.isEmpty():
        alike = kept.join(twice, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(twice, ["doc_id", "digest"], "left_anti").select("row").unionByName(alike.select("row"))
    return kept.select("row.*")
