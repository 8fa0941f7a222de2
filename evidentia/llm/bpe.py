"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding: a token sequence is the BPE encoding of its bytes exactly if each adjacent pair of tokens is
the encoding of its own bytes. So a non-deterministic transducer reads bytes, guesses where tokens end,
and only lets a token follow one it may stand beside. Its threads are (last token, place in the token
trie). The subset construction runs on demand: a state is the set of live threads, and a transition,
computed when a text first needs it and kept while the table has room, tells for each thread which one it continues and the token it ends.
Tokens leave as soon as one thread is left, after a lookahead that the longest token bounds. Each prefix has one encoding, so
exactly one thread stands at a token's end after each byte; at the end of the input it gives the rest.

Decoding: ids become bytes as they come, and an incremental UTF-8 state machine keeps the bytes of an
unfinished code point until the next chunk; the digest of what is decoded is taken from its text.

Memory: each Python worker has tables of its own. The trie is one dictionary of edges and two flat arrays; ids
are remembered packed, four bytes each; states, pairs and words are kept up to fixed numbers and computed
again beyond, so a worker's tables stay at about 400 MB whatever the texts; a parameter asks for less.

Values: a null text is empty (no ids, the digests of nothing). Any length of text or piece is encoded in
time proportional to it. Null and repeated doc_ids are handed on, a row for each document; other columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import frugal, small_batches, text_of

MAX_STATES = 200_000
MAX_PAIRS = 500_000
MAX_EDGES = 60_000
#: Bytes read outside the full table until it is begun anew, for texts of another kind.
REFRESH = 4_000_000
MAX_WORDS = 400_000
MAX_PIECES = 60_000
#: Longer pieces are not kept.
KEPT_PIECE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one piece at a time; ``ranks`` must hold every single byte that occurs."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0) -> None:
        self.ranks = ranks
        #: the tables' bounds, as shares of the constants
        self.max_states, self.max_pairs, self.max_edges = (int(share * n) for n in (MAX_STATES, MAX_PAIRS, MAX_EDGES))
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: node << 8 | byte to the node below; each node's token or -1; whether it has nodes below
        self.below: dict[int, int] = {}
        self.token = array("i", [-1])
        self.inner = bytearray(1)
        for t, r in ranks.items():
            node = 0
            for b in t:
                nxt = self.below.get(node << 8 | b)
                if nxt is None:
                    nxt = self.below[node << 8 | b] = len(self.token)
                    self.inner[node] = 1
                    self.inner.append(0)
                    self.token.append(-1)
                node = nxt
            self.token[node] = r
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[bytes, bytes] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        # a thread is (last token + 1) << 32 | place in the trie; place 0 is a token's end
        start = (0,)
        self.states: list[tuple[int, ...]] = [start]
        self.done = bytearray([0])
        self.number = {start: 0}
        #: state << 8 | byte to the next state and, for each of its threads, the one it continues << 24 | (ended token + 1)
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.backs: dict[tuple[int, ...], tuple[int, ...]] = {}
        #: bytes read outside the table
        self.missed = 0

    def _state(self, threads: tuple[int, ...]) -> int | None:
        """The threads' state; None if it is a new one and the table is full."""
        number = self.number.get(threads)
        if number is None and len(self.states) < self.max_states:
            number = self.number[threads] = len(self.states)
            self.states.append(threads)
            self.done.append(_done(threads))
        return number

    def _parts(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts that the token's own merge joins; None for one byte."""
        data, best = self.bytes_of[token], None
        if len(data) == 1:
            return None
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            low, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if low == 1 << 60:
                raise ValueError(f"no merges make token {token}")
            best = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return best

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the token's edge while it is being merged, each with the rank that ends it."""
        edges = self.edges[side]
        if (known := edges.get(token)) is None:
            if len(edges) >= self.max_edges:
                edges.clear()
                self.splits.clear()
            known = [(self.bytes_of[token], 1 << 60)]
            at = token
            while True:
                if at not in self.splits:
                    self.splits[at] = self._parts(at)
                if (split := self.splits[at]) is None:
                    break
                known.append((split[side], at))
                at = self.ranks[split[side]]
            edges[token] = known
        return known

    def adjacent(self, left: int, right: int) -> bool:
        """Whether no merge joins a part at the left token's end with one at the right token's start.

        Such a merge comes before the one that ends the left part, and not after the one that ends the
        right part (of equal ranks the leftmost goes first).
        """
        if left < 0:
            return True
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            rank, known = self.ranks.get, True
            for a, end in self._edge(left, 1):
                for b, stop in self._edge(right, 0):
                    r = rank(a + b)
                    if r is not None and r < end and r <= stop:
                        known = False
                        break
                if not known:
                    break
            self.pairs[key] = known
        return known

    def _step(self, threads: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The next threads, and for each of them the one it comes from and the token it ended, if any."""
        # a next thread << 32 | the one it comes from << 24 | the token it ended + 1: in the threads' order
        found = []
        below, inner, token_at, pairs = self.below, self.inner, self.token, self.pairs
        come = 0
        for thread in threads:
            nxt = below.get((thread & 0xFFFFFFFF) << 8 | byte)
            if nxt is not None:
                last = thread >> 32
                if inner[nxt]:
                    found.append((last << 32 | nxt) << 32 | come)
                token = token_at[nxt]
                if token >= 0:
                    fits = pairs.get((last - 1) << 32 | token)
                    if fits is None:
                        fits = self.adjacent(last - 1, token)
                    if fits:
                        found.append((token + 1) << 64 | come | token + 1)
            come += 1 << 24
        if len(found) > 1:
            found.sort()
        return tuple([t >> 32 for t in found]), tuple([t & 0xFFFFFFFF for t in found])

    def _output(self, i: int, trail: list) -> list[int]:
        """The tokens that the trail of the i-th thread ended."""
        out = []
        for back in reversed(trail):
            step = back[i]
            i = step >> 24
            token = step & 0xFFFFFF
            if token:
                out.append(token - 1)
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if self.missed > REFRESH:
            self._reset()
        state, moves, trail, out = 0, self.moves, [], []
        #: the live threads while they are no state of the full table
        loose: tuple[int, ...] | None = None
        for byte in piece:
            if loose is None:
                key = state << 8 | byte
                move = moves.get(key)
                if move is None:
                    threads, back = self._step(self.states[state], byte)
                    number = self._state(threads)
                    if number is None:
                        loose = threads
                    else:
                        back = self.backs.setdefault(back, back)
                        moves[key] = number, back
                        state = number
                else:
                    state, back = move
            else:
                loose, back = self._step(loose, byte)
                self.missed += 1
                state = self.number.get(loose, -1)
                if state >= 0:
                    loose = None
            if len(back) > 1:
                trail.append(back)
            elif trail:
                # one thread is left, at a token's end: all before is decided
                trail.append(back)
                out += self._output(0, trail)
                trail.clear()
            elif token := back[0] & 0xFFFFFF:
                out.append(token - 1)
        if not trail:
            return out
        return out + self._output(self.done[state] if loose is None else _done(loose), trail)


def _done(threads: tuple[int, ...]) -> int:
    """The thread that stands at a token's end."""
    return next(i for i, t in enumerate(threads) if not t & 0xFFFFFFFF)


class _Unsafe(Exception):
    """A match of the pattern may reach over this space."""


class _Kept(dict):
    """Remembers the packed ids of up to twice ``most`` entries: a full generation becomes the old one."""

    old: dict = {}
    most = MAX_PIECES

    def keep(self, key: str, ids: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = ids


#: Signs that are a match of their own behind a word.
_SIGNS = frozenset(".,;:!?")


class _Words(_Kept):
    """A word between single spaces to the ids of the space and the word.

    A space between two characters that aren't white space begins a match of the pattern, whatever
    stands around it, so the matches of such a word don't depend on the rest of the text.
    """

    most = MAX_WORDS

    def __init__(self, pieces: _Pieces, split) -> None:
        self.pieces, self.split = pieces, split

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is not None:
            self.keep(word, ids)
            return ids
        if word.isalpha():
            # letters alone are one match with their space
            ids = array("i", self.pieces.machine.encode(b" " + word.encode())).tobytes()
        elif word[-1:] in _SIGNS and word[:-1].isalpha():
            ids = self._match(" " + word[:-1]) + self.pieces[word[-1]]
        elif not word or word[0].isspace() or word[-1].isspace():
            raise _Unsafe
        else:
            pieces = self.split(" " + word)
            # a match that begins with the space is a word of its own, and remembered as one
            ids = b"".join([self._match(p) if p[0] == " " else self.pieces[p] for p in pieces])
        if len(word) <= KEPT_PIECE:
            self.keep(word, ids)
        return ids


    def _match(self, piece: str) -> bytes:
        """The ids of a match that begins with a space: those of a word, by its own."""
        word = piece[1:]
        ids = self.get(word) or self.old.get(word)
        if ids is None:
            ids = array("i", self.pieces.machine.encode(piece.encode())).tobytes()
            if len(word) <= KEPT_PIECE:
                self.keep(word, ids)
        return ids


class _Pieces(_Kept):
    """A match of the pattern to its ids."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = array("i", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= KEPT_PIECE:
            self.keep(piece, ids)
        return ids


class Encoder:
    """Texts to ids: the pattern's matches, each through the transducer; frequent ones are remembered."""

    def __init__(self, path: str, pattern: str, share: float = 1.0) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.machine = Transducer(load_ranks(path), share)
        self.pieces = _Pieces(self.machine)
        self.pieces.most = int(share * MAX_PIECES)
        #: Only this pattern is known to begin a match at single spaces.
        self.words = _Words(self.pieces, self.split) if pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+") else None
        if self.words is not None:
            self.words.most = int(share * MAX_WORDS)

    def packed(self, text: str) -> bytes:
        """The text's ids, four bytes each."""
        if self.words is not None:
            first, *rest = text.split(" ")
            if first and not first[-1].isspace():
                try:
                    return b"".join([*map(self.pieces.__getitem__, self.split(first)), *map(self.words.__getitem__, rest)])
                except _Unsafe:
                    pass
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()


class Utf8:
    """Bytes to text as they come: those of an unfinished code point wait for the next ones."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, raw: bytes) -> str:
        data = self.waiting + raw
        whole = len(data)
        for back in range(1, min(3, whole) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            # 2, 3 or 4 bytes by the lead byte's ones
            if (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0) >= back:
                whole -= back
            break
        self.waiting = data[whole:]
        return data[:whole].decode()

    def end(self) -> None:
        if self.waiting:
            raise UnicodeDecodeError("utf-8", self.waiting, 0, len(self.waiting), "unexpected end of data")


class Decoder:
    """Ids to bytes and, as far as code points are whole, to text."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of

    def stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
        """Chunk by chunk the ids' bytes and the text that they complete; ids are read as they are needed."""
        machine, ids = Utf8(), iter(ids)
        while some := list(islice(ids, chunk)):
            raw = b"".join(map(self.bytes_of.__getitem__, some))
            yield raw, machine.feed(raw)
        machine.end()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, share: float = 1.0) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern, share)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, share: float = 1.0) -> DataFrame:
    """Per document: the number of its ids, the digest of the ids, and the digest of the bytes they decode to.

    share: of the memory that the tables may take; less of it takes more time.
    """
    small_batches(docs.sparkSession)
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        enc = encoder(path, pattern, share)
        # the tables hold no cycles: looking through them again and again would cost more than encoding
        gc.freeze()
        gc.set_threshold(500_000, 50, 1000)
        dec = Decoder(enc.machine.bytes_of)
        digits = {i: str(i) for i in enc.machine.bytes_of}
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for text in batch.column("text"):
                ids = memoryview(enc.packed(text.as_py())).cast("i")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                sha = hashlib.sha256()
                for _, whole in dec.stream(ids):
                    sha.update(whole.encode())
                raw_sha.append(sha.hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(frugal(run, "bpe"), SCHEMA)


def token_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    small_batches(docs.sparkSession)
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = pa.array([enc.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(frugal(run, "bpe"), "doc_id long, ids array<int>")
