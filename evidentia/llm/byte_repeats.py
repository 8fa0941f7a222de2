"""Suffix-array deduplication of byte passages that documents share.

Method: the Burrows-Wheeler transform of a collection is built column by column. Each round inserts
one symbol for every string, right to left; the new suffixes' ranks follow from the transform of the
round before (LF mapping), and the common-prefix array is updated at the inserted places and at their
successors. After the last round, suffixes that agree on their first ``k`` bytes are neighbours with
common prefixes of at least ``k``.

Distribution: every ``k``-byte window belongs to its minimiser, the smallest hash among its 24-byte
substrings, so equal windows always meet in one group. Runs of windows with one minimiser form
strings of at most ``k + 26`` bytes, which bounds the number of rounds by a constant, whatever the
documents' length. A first exchange of 4-byte minimiser keys finds the ones that occur in two or more
documents (a false agreement of keys only costs work); only strings of these are sent to be indexed,
each once for each block of documents. The text itself crosses the network once: all three uses of it
read the same exchange. A string with many occurrences arrives once for each block, with the
smallest doc_id there. A minimiser with ``HOT`` different strings or more is not indexed as one: each of its
windows is dealt by a hash of its whole content instead, so that no task holds a frequent phrase's contexts.

Values: a null text is empty, a null doc_id comes before all others (and stays null), rows with equal doc_id never
remove from each other, documents shorter than ``k`` bytes are kept whole, an empty table gives an
empty result. Other columns are handed on by ``cleaned``, whatever their names (but for n_chars, which is counted
again), and not read by ``remove_repeats``. Passages of 24 to 200 bytes can be asked for.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import NO_ID, release, small_batches, text_of

MER = 24
#: Text of a block, and what one index holds before it, in bytes.
BLOCK_BYTES = 6 << 20

#: Strings that are indexed together, unless one key has more.
COLLECTION = 1200
#: More than the windows of a string.
_STARTS = 32
#: Different strings of a key in all blocks from which on its windows are dealt by their whole content.
HOT = 20_000
#: Strings of a key in a block from which on they are counted.
_COUNTED = 16
#: Windows hashed at a time, so that the arrays stay in the processor's cache.
_CHUNK = 1 << 15

_B = 0x9E3779B97F4A7C15
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mers(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 24-byte substring, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(1)
    parts = {1: h}
    for width in (1, 2, 4, 8):
        h = h[:-width] * np.uint64(pow(_B, width, 1 << 64)) + h[width:]
        parts[2 * width] = h
    power8 = np.uint64(pow(_B, 8, 1 << 64))
    n = len(raw) - MER + 1
    out = parts[16][:n] * power8 + parts[8][16 : 16 + n]
    out ^= out >> np.uint64(30)
    out *= _M1
    out ^= out >> np.uint64(27)
    out *= _M2
    out ^= out >> np.uint64(31)
    return out


def _window_least(h: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if rest := span - width:
        h = np.minimum(h[:-rest], h[rest:])
    return h


def _runs(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's bytes, cut at the documents' ends: each run's minimiser, first window and number of windows."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    found, values, before = [], [], np.uint64(0)
    for at in range(0, n, _CHUNK):
        least = _window_least(_mers(raw[at : at + _CHUNK + k - 1]), k - MER + 1)
        change = np.append(not at or least[0] != before, least[1:] != least[:-1])
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(least))]
        change[own - at] = True
        before = least[-1]
        new = np.flatnonzero(change)
        found.append(new + at)
        values.append(least[new])
    first, value = np.concatenate(found), np.concatenate(values)
    # windows that leave their document are the last ones of its last run
    length = np.minimum(np.append(first[1:], n), ends[np.searchsorted(ends, first, side="right")] - k + 1) - first
    value, first, length = value[length > 0], first[length > 0], length[length > 0]
    span = min(k - MER + 1, _STARTS - 1)
    if len(length) and length.max() > span:
        pieces = -(-length // span)
        at = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        value, first, length = value[at], first[at] + step * span, np.minimum(span, length[at] - step * span)
    return value, first, length


class _Block:
    """One block's documents, in an order that follows from their rows alone."""

    def __init__(self, table: pa.Table, k: int, parts: int) -> None:
        ids, texts = table.column("_id").to_pylist(), [x.encode() for x in table.column("text").to_pylist()]
        self.order = order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.buffer = b"".join(self.texts)
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.value, self.first, self.length = _runs(np.frombuffer(self.buffer, np.uint8), self.ends, k)
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        self.k, self.parts = k, parts
        self._place()

    def _split(self, rows: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """These runs become windows of their own, each with a hash of its whole content for a minimiser, so equal ones still meet; the runs' flags after that."""
        import xxhash

        if not len(rows):
            return flag
        hot = np.zeros(len(self.value), bool)
        hot[rows] = True
        size = np.where(hot, self.length, 1)
        at = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        hot = hot[at]
        self.first, self.length = self.first[at] + step, np.where(hot, 1, self.length[at])
        self.doc, self.value = self.doc[at], self.value[at]
        self.value[hot] = np.array([xxhash.xxh64_intdigest(self.buffer[f : f + self.k]) for f in self.first[hot].tolist()], np.uint64)
        self._place()
        return flag[at]

    def _place(self) -> None:
        self._found = None
        self.part = (self.value % np.uint64(self.parts)).astype(np.int64)
        self.key = (self.value >> np.uint64(32)).astype(np.uint32)

    def _keyed(self, bits: dict[int, bytes]) -> np.ndarray:
        """The runs of the keys that the parts' bits (in the order of ``keys``) name."""
        wanted = np.zeros(len(self.value), bool)
        found = self.keys()
        for p, own in bits.items():
            if p not in found or not any(own):
                continue
            keys, _, rows = found[p]
            hit = np.unpackbits(np.frombuffer(own, np.uint8), count=len(keys)).astype(bool)
            # the part's runs are ordered by key, as its keys are
            wanted[rows] = hit[np.searchsorted(keys, self.key[rows])]
        return np.flatnonzero(wanted)

    def many(self) -> dict[int, dict[int, int]]:
        """Each part's keys (by their place among its keys) that several runs have, with the number of their different strings."""
        out: dict[int, dict[int, int]] = {}
        for p, (keys, _, rows) in self.keys().items():
            place = np.searchsorted(keys, self.key[rows])
            size = np.bincount(place, minlength=len(keys))
            for i in np.flatnonzero(size >= _COUNTED).tolist():
                own = rows[np.searchsorted(place, i) : np.searchsorted(place, i, "right")]
                strings = {self.buffer[f : f + m + self.k - 1] for f, m in zip(self.first[own].tolist(), self.length[own].tolist(), strict=True)}
                out.setdefault(p, {})[i] = len(strings)
        return out

    def keys(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each part's distinct keys, ascending, whether two documents of this block have them, and the part's runs ordered by key."""
        if self._found is not None:
            return self._found
        out = self._found = {}
        order = np.argsort(self.part.astype(np.uint64) << np.uint64(32) | self.key, kind="stable")
        part, key, ids = self.part[order], self.key[order], self.ids[self.doc[order]]
        if not len(part):
            return out
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        twice = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        begins = np.append(at, len(order))
        part, key = part[at], key[at]
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(part)), strict=True):
            out[int(part[a])] = key[a:b], twice[a:b], order[begins[a] : begins[b]]
        return out

    def strings(self, repeated: dict[int, bytes]) -> dict[int, tuple[dict[bytes, int], list, list, list]]:
        """Of the repeated keys, each part's distinct strings in order of appearance; the runs' places; the strings' least doc_id and key.

        Runs of hot keys are split for good, so that places are those of the runs after it.
        """
        flag = np.zeros(len(self.value), bool)
        flag[self._keyed({p: x[: len(x) // 2] for p, x in repeated.items()})] = True
        rows = np.flatnonzero(self._split(self._keyed({p: x[len(x) // 2 :] for p, x in repeated.items()}), flag))
        out: dict[int, tuple[dict[bytes, int], list, list, list]] = {}
        k, buffer = self.k, self.buffer
        for p, first, n, i, d in zip(self.part[rows].tolist(), self.first[rows].tolist(), self.length[rows].tolist(), rows.tolist(), self.ids[self.doc[rows]].tolist(), strict=True):
            if (x := out.get(p)) is None:
                x = out[p] = ({}, [], [], [])
            s = buffer[first : first + n + k - 1]
            j = x[0].setdefault(s, len(x[0]))
            x[1].append((i, j))
            if j == len(x[2]):
                x[2].append(d)
                x[3].append(i)
            elif d < x[2][j]:
                x[2][j] = d
        return out


def collection_bwt(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, common) of the collection's suffixes of at least ``k`` bytes and all others, in lexical order.

    owner: string * _STARTS + start of the suffix, or -1 for a suffix of less than ``k`` bytes; common: the
    common prefix with the suffix before, counted up to ``k`` (the ends of strings are all distinct).
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(lengths) - lengths
    # symbols: 0 ends a string, bytes follow by their rank among the bytes that occur
    rank = np.zeros(256, np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    if len(used) > 255:
        raise ValueError("UTF-8 text has at most 243 different bytes")
    rank[used] = np.arange(1, len(used) + 1)
    data = rank[data]
    # round 0: the ends, in the strings' order; each is preceded by its string's last symbol
    bwt = data[base + lengths - 1].copy()
    common = np.zeros(n, np.uint8)
    owner = None
    active, place = np.arange(n), np.arange(n)
    for j in range(1, int(lengths.max()) + 1):
        alive = lengths[active] >= j
        active, place = active[alive], place[alive]
        order = np.argsort(bwt, kind="stable")
        symbols = bwt[order]
        ends = int(np.searchsorted(symbols, 1))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        lf = inverse[place]
        sort = np.argsort(lf)
        active, place, lf = active[sort], place[sort], lf[sort]
        target = n + lf - ends
        # common prefixes at the new places: one more than the least between the occurrences of the symbol
        before = lf - 1
        has = (lf > ends) & (symbols[before] == symbols[lf])
        mine = np.zeros(len(lf), np.int64)
        if has.any():
            mine[has] = _least(common, order[before[has]] + 1, place[has] + 1) + 1
        after = np.minimum(lf + 1, len(order) - 1)
        then = (lf + 1 < len(order)) & (symbols[after] == symbols[lf])
        size = len(bwt) + len(active)
        fresh = np.zeros(size, bool)
        fresh[target] = True
        old = ~fresh
        symbol = np.where(lengths[active] > j, data[base[active] + np.maximum(lengths[active] - j - 1, 0)], 0).astype(np.uint8)
        grown, bwt_old = np.empty(size, np.uint8), bwt
        grown[old], grown[target] = bwt_old, symbol
        lcp = np.empty(size, np.uint8)
        lcp[old], lcp[target] = common, np.minimum(mine, k)
        if then.any():
            lcp[target[then] + 1] = np.minimum(_least(common, place[then] + 1, order[after[then]] + 1) + 1, k)
        if j >= k:
            who = np.empty(size, np.int32)
            who[old] = -1 if owner is None else owner
            who[target] = active * _STARTS + (lengths[active] - j)
            owner = who
        bwt, common, place = grown, lcp, target
    return owner, common


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for each pair; no range is empty."""
    cut = np.empty(2 * len(start), np.int64)
    cut[0::2], cut[1::2] = start, stop
    return np.minimum.reduceat(np.append(values, np.uint8(255)), cut)[0::2].astype(np.int64)


def smaller_elsewhere(strings: list[bytes], docs: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """For each string the least doc_id that has each of its windows, as rows of ``docs``' type (unused places: the string's own).

    Equal windows have equal keys, so a string that is its key's only one has nothing to be compared with.
    """
    width = max(len(s) for s in strings) - k + 1
    least = np.repeat(docs[:, None], width, 1)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    edge = np.append(np.flatnonzero(new), len(order))
    size = np.diff(edge)
    order = order[np.repeat(size > 1, size)]
    size = size[size > 1]
    # whole keys together, so many that a collection's arrays stay in the processor's cache
    share = (np.cumsum(size) - size) // COLLECTION
    for at, n in zip(*(lambda first: (first, np.diff(np.append(first, len(size)))))(np.flatnonzero(np.append(True, share[1:] != share[:-1]))) if len(size) else ((), ()), strict=True):
        some = order[size[:at].sum() : size[: at + n].sum()]
        owner, common = collection_bwt([strings[i] for i in some.tolist()], k)
        group = np.cumsum(common < k)
        real = owner >= 0
        owner, group = owner[real], group[real]
        if len(owner):
            edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            which = some[owner // _STARTS]
            least[which, owner % _STARTS] = np.repeat(np.minimum.reduceat(docs[which], edge), np.diff(np.append(edge, len(owner))))
    return least


_BLOB = "block long, part long, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "part", "blob"])


def _find_keys(k: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        release()
        block = t.column("_block")[0].as_py()
        b = _Block(t, k, parts)
        many, rows = b.many(), []
        for p, (keys, twice, _) in b.keys().items():
            several = many.get(p, {})
            head = np.array([len(keys), len(several)], np.int64).tobytes()
            counts = np.array(list(several), np.uint32).tobytes() + np.array(list(several.values()), np.uint32).tobytes()
            rows.append((block, p, head + counts + keys.tobytes() + np.packbits(twice).tobytes()))
        del b
        release()
        return pa.Table.from_batches([_blobs(rows)])

    return run


def _repeated_keys(t: pa.Table) -> pa.Table:
    """A part's rows of all blocks: two bits for each key, one set if two documents anywhere have it, one if it is hot."""
    found, sizes, total = [], [], Counter()
    for blob in t.column("blob"):
        raw = blob.as_py()
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16 + 8 * m
        own = np.frombuffer(raw, np.uint32, n, at)
        for place, count in zip(np.frombuffer(raw, np.uint32, m, 16).tolist(), np.frombuffer(raw, np.uint32, m, 16 + 4 * m).tolist(), strict=True):
            total[int(own[place])] += count
        found.append((own, np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 4 * n), count=n).astype(bool)))
        sizes.append(n)
    hot = np.isin(np.concatenate([x[0] for x in found]), np.array([key for key, n in total.items() if n >= HOT], np.uint32))
    keys, twice = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    eq = keys[order][1:] == keys[order][:-1]
    same[1:] |= eq
    same[:-1] |= eq
    # a key that one block alone has counts if two documents there do
    twice[order] |= same
    rows, at = [], 0
    for block, n in zip(t.column("block").to_pylist(), sizes, strict=True):
        rows.append((block, t.column("part")[0].as_py(), np.packbits(twice[at : at + n]).tobytes() + np.packbits((hot & twice)[at : at + n]).tobytes()))
        at += n
    return pa.Table.from_batches([_blobs(rows)])


def _send_strings(k: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        rows = []
        if len(docs) and len(bits):
            block = docs.column("_block")[0].as_py()
            b = _Block(docs, k, parts)
            for p, (strings, _, least, at) in b.strings(dict(zip(bits.column("part").to_pylist(), bits.column("blob").to_pylist(), strict=True))).items():
                head = np.array([len(strings)], np.int64).tobytes() + np.array(least, np.int64).tobytes() + b.key[at].tobytes() + np.array([len(s) for s in strings], np.uint8).tobytes()
                rows.append((block, p, head + b"".join(strings)))
            del b
        release()
        return pa.Table.from_batches([_blobs(rows)])

    return run


def _index_strings(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        whole: dict[bytes, int] = {}
        docs: list[int] = []
        keys: list[int] = []
        refs = []
        for blob in t.column("blob"):
            raw = blob.as_py()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            least = np.frombuffer(raw, np.int64, n, 8)
            own = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
            sizes = np.frombuffer(raw, np.uint8, n, 8 + 12 * n).tolist()
            at, ref = 8 + 13 * n, []
            for size, d, key in zip(sizes, least.tolist(), own.tolist(), strict=True):
                j = whole.setdefault(raw[at : at + size], len(whole))
                at += size
                if j == len(docs):
                    docs.append(d)
                    keys.append(key)
                elif d < docs[j]:
                    docs[j] = d
                ref.append(j)
            refs.append((np.array(ref, np.int64), least))
        least = smaller_elsewhere(list(whole), np.array(docs, np.int64), np.array(keys, np.uint32), k)
        weight = np.int64(1) << np.arange(least.shape[1], dtype=np.int64)
        part = t.column("part")[0].as_py()
        rows = [(block, part, ((least[ref] < own[:, None]) @ weight).astype(np.int32).tobytes()) for block, (ref, own) in zip(t.column("block").to_pylist(), refs, strict=True)]
        del whole, docs, keys, refs, least
        release()
        return pa.Table.from_batches([_blobs(rows)])

    return run


def _spans(b: _Block, bits: dict[int, bytes], masks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes of the block as sorted, disjoint spans that no document's end cuts."""
    found = []
    for p, (_, places, least, _) in b.strings(bits).items():
        mask = np.frombuffer(masks[p], np.int32)
        runs, which = np.array(places, np.int64).T
        repeat = b.ids[b.doc[runs]] > np.array(least, np.int64)[which]
        full = (np.int64(1) << b.length[runs]) - 1
        flags = np.where(repeat, full, mask[which].astype(np.int64) & full)
        hit = flags != 0
        runs, flags = runs[hit], flags[hit]
        if len(runs):
            on = (flags[:, None] >> np.arange(b.length[runs].max())) & 1
            row, off = np.nonzero(on)
            found.append(b.first[runs][row] + off)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.sort(np.concatenate(found))
    doc = np.searchsorted(b.ends, windows, side="right")
    # runs of the covered bytes: a window that begins behind the end of the last begins a new one; touching ones join
    gap = np.append(True, (windows[1:] > windows[:-1] + b.k) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(windows)) - 1
    return windows[first], windows[last] + b.k


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(k: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for i, raw, spans in _cuts(docs, sent, k, parts):
            kept, to = [], 0
            for x, y in spans:
                kept.append(raw[to:x])
                to = y
            kept.append(raw[to:])
            rows.append((docs.column("doc_id")[i].as_py(), len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        return pa.table({c: pa.array([r[i] for r in rows], pa.string() if c == "kept_sha256" else pa.int64()) for i, c in enumerate(names)})

    return run


def _clean(k: int, parts: int, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        order, texts = [], []
        for i, raw, spans in _cuts(docs, sent, k, parts):
            order.append(i)
            texts.append(cut_text(raw, spans))
        rest = docs.column("row").combine_chunks().take(pa.array(order, pa.int64()))
        others = [c for c in columns if c != "text"]
        out = {c: pa.array(texts, pa.string()) if c == "text" else rest.field(others.index(c)) for c in columns}
        if "n_chars" in columns:
            out["n_chars"] = pa.array([len(t) for t in texts], out["n_chars"].type)
        return pa.table(out)

    return run


def _cuts(docs: pa.Table, sent: pa.Table, k: int, parts: int) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """(row, bytes, removed spans) of each of a block's documents."""
    if not len(docs):
        return
    b = _Block(docs, k, parts)
    by: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for kind, p, blob in zip(sent.column("kind").to_pylist(), sent.column("part").to_pylist(), sent.column("blob").to_pylist(), strict=True):
        by[kind][p] = blob
    start, stop = _spans(b, by[0], by[1])
    at = np.searchsorted(start, np.concatenate([[0], b.ends]))
    begin = 0
    for i, raw in enumerate(b.texts):
        yield b.order[i], raw, [(int(x) - begin, int(y) - begin) for x, y in zip(start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]], strict=True)]
        begin = int(b.ends[i])


def cut_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left as text: a span that begins or ends inside a code point leaves that code point whole."""
    kept, to = [], 0
    for x, y in spans:
        while x < y and x < len(raw) and raw[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        kept.append(raw[to:x])
        to = y
    kept.append(raw[to:])
    return b"".join(kept).decode()


def _plan(docs: DataFrame, k: int, block_bytes: int, clean: bool) -> DataFrame:
    if not MER <= k <= 200:
        raise ValueError(f"passages of {MER} to 200 bytes are found")
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_of())).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # the other columns as one value: no name of theirs can clash with one of these
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]) if clean else F.col("doc_id")
    blocked = docs.select(rest.alias("row" if clean else "doc_id"), own.alias("_id"), text_of().alias("text"))
    # by the text, too: many rows may have no doc_id
    blocked = blocked.withColumn("_block", F.pmod(F.xxhash64("_id", "text"), F.lit(blocks)))
    by_block = blocked.groupBy("_block")
    keys = by_block.applyInArrow(_find_keys(k, blocks), _BLOB)
    bits = keys.groupBy("part").applyInArrow(_repeated_keys, _BLOB)
    strings = by_block.cogroup(bits.groupBy("block")).applyInArrow(_send_strings(k, blocks), _BLOB)
    masks = strings.groupBy("part").applyInArrow(_index_strings(k), _BLOB)
    both = bits.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))
    together = by_block.cogroup(both.groupBy("block"))
    if clean:
        return together.applyInArrow(_clean(k, blocks, docs.columns), docs.withColumn("text", text_of()).schema)
    return together.applyInArrow(_apply(k, blocks), _RESULT)


def remove_repeats(docs: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256 after each byte goes that a ``k``-byte string covers which also starts in a document with a smaller doc_id."""
    return _plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, block_bytes, False)


def cleaned(docs: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' columns, with what is left of each text (code points are left whole) and, if there is n_chars, its code points."""
    return _plan(docs, k, block_bytes, True)


#: DuckDB SQL of ``remove_repeats`` for passages of 50 bytes: two hexadecimal digits a byte, cut in blocks of 1,000 bytes first.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, pos, substr(part, 2 * (pos % 1000) + 1, 100) AS w FROM 
  (SELECT doc_id, h, block, substr(h, 2000 * block + 1, 2100) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS block FROM d)), LATERAL (SELECT unnest(range(block * 1000, least(block * 1000 + 1000, len(h) // 2 - 49))) AS pos) AS starts),
least_doc AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hits AS (SELECT doc_id, pos FROM windows JOIN least_doc USING (w) WHERE first < doc_id),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -100) + 50 THEN 1 ELSE 0 END AS fresh FROM hits)),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
cut AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM d JOIN gaps USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
