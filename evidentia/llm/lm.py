"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background (the documents), have one vocabulary: the
words (lower-cased runs between white space) that occur at least twice in both corpora together; all
others are one unknown word. For corpus x, with a word's or pair's count c, N words and V vocabulary
entries and the unknown word,

    p(w)     = (c(w) + ALPHA) / (N + ALPHA * V)
    p(w | v) = MIX * c(v w) / c(v) + (1 - MIX) * p(w)        p(w) alone where c(v) is 0

and a text's score is the mean over its words of ln p_background - ln p_target: the lower, the more it is
like the target. The counts are those of all words and pairs of both corpora; neither is capped, so what is
gathered grows with the input.

Distribution: texts are dealt into blocks. A block sends each part of the code space its distinct words
and pairs with their counts there (summed before the exchange, so a frequent word is one entry for each
block); a part adds up and answers each block with the totals of what it sent, in the same order. Words are
64-bit hashes; within a part 40 bits tell them apart, which confuses some in ten million. Counts are 64-bit numbers.

Values: a null or blank text has no words, score and losses 0. Rows with one doc_id, or none, are scored apart. An
empty target gives every word the probability 1/V there; an empty table gives an empty result. Other columns are
not read (those of the target only deal its rows into blocks).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, release, small_batches, text_of

ALPHA = 0.1
MIX = 0.6
BLOCK_BYTES = 8 << 20
#: Words whose hashes a worker remembers, and words scored at a time.
MAX_WORDS = 300_000
CHUNK = 1 << 17
#: Bits that tell words, or pairs, of a part apart.
_KEY = 40
_START = np.uint64(0x5851F42D4C957F2D)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode(), 7)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h
        return h


_HASHES = _Hashes()


class _Block:
    """The words of a block's texts, as indexes into its distinct words and pairs; without places, the distinct ones alone."""

    def __init__(self, texts: list[str], parts: int, places: bool = True) -> None:
        chunks, sizes = [], []
        for t in texts:
            words = t.lower().split()
            chunks.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        word = np.concatenate(chunks) if chunks else np.zeros(0, np.uint64)
        del chunks
        starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(word), bool)
        self.first[starts[self.sizes > 0]] = True
        pair = np.empty_like(word)
        pair[1:] = word[:-1]
        pair[self.first] = _START
        pair *= _C1
        pair ^= (word + _C2) * _C3
        pair ^= pair >> np.uint64(29)
        pair *= _C2
        pair ^= pair >> np.uint64(32)
        self.at = []
        #: for words and for pairs: the part, key and count of each distinct one, ordered by part and key
        self.distinct = []
        codes = [word, pair]
        del word, pair
        while codes:
            code = codes.pop(0)
            # the part from the upper half's remainder, the key from the lower half and the eight bits on top
            joint = ((code >> np.uint64(32)) % np.uint64(parts)) << np.uint64(_KEY)
            joint |= (code >> np.uint64(56)) << np.uint64(32) | code & np.uint64(0xFFFFFFFF)
            del code
            if places:
                unique, at, count = np.unique(joint, return_inverse=True, return_counts=True)
                self.at.append(at.astype(np.int32))
                del at
            else:
                joint.sort()
                edge = np.flatnonzero(np.append(True, joint[1:] != joint[:-1])) if len(joint) else np.zeros(0, np.int64)
                unique, count = joint[edge], np.diff(np.append(edge, len(joint)))
            del joint
            self.distinct.append(((unique >> np.uint64(_KEY)).astype(np.int64), unique & np.uint64((1 << _KEY) - 1), count))

    def slices(self, parts_of: np.ndarray) -> dict[int, slice]:
        edge = np.flatnonzero(np.append(True, parts_of[1:] != parts_of[:-1])) if len(parts_of) else np.zeros(0, np.int64)
        return {int(parts_of[a]): slice(int(a), int(b)) for a, b in zip(edge, np.append(edge[1:], len(parts_of)), strict=True)}


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers of 0 and more, each array in the narrowest kind that holds all of its own."""
    import zstandard

    narrow = [a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for a in arrays]
    head = np.array([(len(a), a.itemsize) for a in narrow], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in narrow))


def _unpack(blob: bytes, number: int = 4) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 16 * number, []
    for n, width in np.frombuffer(raw, np.int64, 2 * number).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"u{width}", n, at).astype(np.int64))
        at += n * width
    return out


_SENT = "block long, target boolean, part long, blob binary"
_ANSWER = "block long, part long, blob binary, vocabulary long, words_t long, words_b long, rare_t long, rare_b long"


def _count(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        release("lm")
        b = _Block(t.column("text").to_pylist(), parts, False)
        by = [b.slices(d[0]) for d in b.distinct]
        rows = []
        for p in sorted(by[0].keys() | by[1].keys()):
            arrays = []
            for (_, key, count), where in zip(b.distinct, by, strict=True):
                s = where.get(p, slice(0, 0))
                # keys ascend within a part: differences are small numbers
                arrays += [np.diff(key[s], prepend=np.uint64(0)), count[s]]
            rows.append((p, _pack(*arrays)))
        del b, by
        release("lm")
        block, target = t.column("block")[0].as_py(), t.column("target")[0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "target": pa.array([target] * len(rows), pa.bool_()), "part": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _add_up(t: pa.Table) -> pa.Table:
    blocks, targets = t.column("block").to_pylist(), t.column("target").to_pylist()
    sent = [_unpack(x.as_py()) for x in t.column("blob")]
    totals, stats = [], None
    for kind in (0, 1):
        keys = np.concatenate([np.cumsum(s[2 * kind]) for s in sent])
        counts = np.concatenate([s[2 * kind + 1] for s in sent])
        of_target = np.repeat(targets, [len(s[2 * kind]) for s in sent])
        unique, at = np.unique(keys, return_inverse=True)
        both = [np.bincount(at[of_target == x], counts[of_target == x], len(unique)).astype(np.int64) for x in (True, False)]
        totals.append((at, both))
        if not kind:
            rare = both[0] + both[1] < 2
            stats = (int((~rare).sum()), int(both[0].sum()), int(both[1].sum()), int(both[0][rare].sum()), int(both[1][rare].sum()))
    rows, place = [], [0, 0]
    for block, target, s in zip(blocks, targets, sent, strict=True):
        arrays = []
        for kind in (0, 1):
            n = len(s[2 * kind])
            at, both = totals[kind]
            where = at[place[kind] : place[kind] + n]
            place[kind] += n
            arrays += [both[0][where], both[1][where]]
        if not target:
            rows.append((block, _pack(*arrays)))
    part = t.column("part")[0].as_py()
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    table = [[r[0], part, r[1], None, None, None, None, None] for r in rows] + [[-1, part, None, *stats]]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    return pa.table({c: pa.array([r[i] for r in table], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


def losses(word: tuple[np.ndarray, np.ndarray], before: tuple[np.ndarray, np.ndarray], pair: tuple[np.ndarray, np.ndarray], stats: dict[str, int], alpha: float, mix: float) -> list[np.ndarray]:
    """For the target and the background: -ln p of each word after the one before (count 0: none), from their counts in both."""
    rare = word[0] + word[1] < 2
    out = []
    for x, name in ((0, "t"), (1, "b")):
        c = np.where(rare, stats[f"rare_{name}"], word[x]).astype(float)
        p = (c + alpha) / (stats[f"words_{name}"] + alpha * (stats["vocabulary"] + 1))
        follows = before[x] > 0
        p = np.where(follows, mix * pair[x] / np.maximum(before[x], 1) + (1 - mix) * p, p)
        out.append(-np.log(p))
    return out


_RESULT = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _score(parts: int, stats: dict[str, int], alpha: float, mix: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = len(docs)
        if n:
            b = _Block(docs.column("text").to_pylist(), parts)
            by = [b.slices(d[0]) for d in b.distinct]
            counts = [[np.zeros(len(d[0]), np.int64) for _ in (0, 1)] for d in b.distinct]
            for p, blob in zip(answers.column("part").to_pylist(), answers.column("blob").to_pylist(), strict=True):
                got = _unpack(blob)
                for kind in (0, 1):
                    if s := by[kind].get(p):
                        counts[kind][0][s], counts[kind][1][s] = got[2 * kind], got[2 * kind + 1]
            sums, sizes = [np.zeros(n), np.zeros(n)], b.sizes
            ends = np.cumsum(sizes)
            for lo in range(0, len(b.first), CHUNK):
                hi = min(lo + CHUNK, len(b.first))
                word, pair = ([c[b.at[kind][lo:hi]] for c in counts[kind]] for kind in (0, 1))
                # the word before; the first of all is a text's first
                before = [np.where(b.first[lo:hi], 0, c[b.at[0][np.arange(lo, hi) - 1]]) for c in counts[0]]
                doc = np.searchsorted(ends, np.arange(lo, hi), side="right")
                for total, each in zip(sums, losses(tuple(word), tuple(before), tuple(pair), stats, alpha, mix), strict=True):
                    total += np.bincount(doc, each, n)
            means = [s / np.maximum(sizes, 1) for s in sums]
            del b, by, counts
            release("lm")
        else:
            means, sizes = [np.zeros(0), np.zeros(0)], np.zeros(0, np.int64)
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(sizes, pa.int64()), "target_loss": means[0], "background_loss": means[1], "score": means[0] - means[1]})

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, alpha: float = ALPHA, mix: float = MIX, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, mean losses under the target's and the background's model, and their difference; ``target`` has a column text."""
    small_batches(docs.sparkSession)
    sizes = [df.agg(F.sum(F.octet_length(text_of())).alias("n")).first()["n"] or 0 for df in (docs, target)]
    blocks, target_blocks = (max(1, -(-n // block_bytes)) for n in sizes)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), F.lit(False).alias("target"))
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), text_of().alias("text"), (blocks + F.pmod(F.xxhash64(*target.columns), F.lit(target_blocks))).alias("block"), F.lit(True).alias("target"))
    sent = scored.unionByName(aimed).groupBy("block").applyInArrow(_count(blocks), _SENT)
    answers = cut(sent.groupBy("part").applyInArrow(_add_up, _ANSWER))
    names = ["vocabulary", "words_t", "words_b", "rare_t", "rare_b"]
    total = answers.filter("block = -1").agg(*[F.sum(c).alias(c) for c in names]).first()
    stats = {c: total[c] or 0 for c in names}
    answers = answers.filter("block >= 0").select("block", "part", "blob")
    return scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(blocks, stats, alpha, mix), _RESULT)


def _corpus_sql(table: str) -> str:
    return f"SELECT *, row_number() OVER () AS d, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM {table}"


def _loss_sql(x: str) -> str:
    """-ln p of a word w after v under one corpus' model, from the joined counts."""
    alone = f"((CASE WHEN w.t + w.b < 2 THEN rare_{x} ELSE w.{x} END) + {ALPHA}) / (words_{x} + {ALPHA} * (vocabulary + 1))"
    return f"-ln(CASE WHEN coalesce(v.{x}, 0) > 0 THEN {MIX} * coalesce(p.{x}, 0) / v.{x} + {1 - MIX} * ({alone}) ELSE {alone} END)"


#: DuckDB SQL of ``cross_entropy_difference`` of documents against conversations, with its defaults, rounded to six digits.
SQL = f"""
WITH docs AS (SELECT doc_id, d, ws FROM ({_corpus_sql('documents')})),
tokens AS (
  SELECT 'b' AS c, d, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs
  UNION ALL SELECT 't', d, unnest(ws), generate_subscripts(ws, 1) FROM ({_corpus_sql('conversations')})),
after AS (SELECT *, lag(word) OVER (PARTITION BY c, d ORDER BY i) AS before FROM tokens),
w AS (SELECT word, count(*) FILTER (c = 't') AS t, count(*) FILTER (c = 'b') AS b FROM tokens GROUP BY word),
p AS (SELECT before, word, count(*) FILTER (c = 't') AS t, count(*) FILTER (c = 'b') AS b FROM after WHERE before IS NOT NULL GROUP BY before, word),
stats AS (SELECT count(*) FILTER (t + b >= 2) AS vocabulary, sum(t) AS words_t, sum(b) AS words_b, coalesce(sum(t) FILTER (t + b < 2), 0) AS rare_t, coalesce(sum(b) FILTER (t + b < 2), 0) AS rare_b FROM w),
each AS (SELECT a.d, {_loss_sql('t')} AS lt, {_loss_sql('b')} AS lb FROM after a JOIN w ON w.word = a.word LEFT JOIN w v ON v.word = a.before LEFT JOIN p ON p.before = a.before AND p.word = a.word, stats WHERE a.c = 'b'),
means AS (SELECT d, avg(lt) AS lt, avg(lb) AS lb FROM each GROUP BY d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(lt, 0.0), 6) AS target_loss, round(coalesce(lb, 0.0), 6) AS background_loss, round(coalesce(lt - lb, 0.0), 6) AS score FROM docs LEFT JOIN means USING (d)
"""
