"""Media columns: signatures, structure, corrected types, carved parts.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. Each hit goes to
its format's validator, which walks the structure (chunks, segments, boxes, pages, checksums where the
format has them) and tells the length that it confirms, or nothing. The type of the hit at the value's
start corrects the declared one; confirmed hits elsewhere are carved as embedded media, also those in
the payload of a container.

Payloads are stored losslessly as 8-bit PCM in a RIFF/WAVE container: one byte, one sample.

Values: a null or empty value has no type, no length and no embedded media; a value whose start no
validator confirms keeps its declared type, unconfirmed. Tie of formats at one place: the first of
``FORMATS``. A value of any length is read whole, once by the automaton; validators share what they learn of a
value, so that text full of magic bytes is no dearer (but for data made of valid chunks inside each other).
``round_trip`` hands on null and repeated doc_ids, a row for each document, and reads no other columns; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import frugal, small_batches, text_of

RATE = 8000
UNIT = 64


class Value:
    """A value's bytes, and what validators have learnt of them: each place is looked at once, however many hits lead to it."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self._memos: dict[str, dict] = {}
        self._jpeg: np.ndarray | None = None

    def marks(self, mark: bytes) -> list[int]:
        """All places of a mark, ascending."""
        if mark not in self._marks:
            found, at = [], self.data.find(mark)
            while at >= 0:
                found.append(at)
                at = self.data.find(mark, at + 1)
            self._marks[mark] = found
        return self._marks[mark]

    def jpeg_markers(self) -> np.ndarray:
        """Places of 0xff that are neither stuffed nor restarts."""
        if self._jpeg is None:
            x = np.frombuffer(self.data, np.uint8)
            nxt = x[1:]
            self._jpeg = np.flatnonzero((x[:-1] == 0xFF) & (nxt != 0) & ((nxt < 0xD0) | (nxt > 0xD7)))
        return self._jpeg

    def memo(self, name: str) -> dict:
        return self._memos.setdefault(name, {})

    def follow(self, name: str, p: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
        """Where a chain that begins at p ends; step: the next place (always further on), or None and the end (None: broken)."""
        memo, path = self.memo(name), []
        while p not in memo:
            path.append(p)
            nxt, end = step(p)
            if nxt is None:
                break
            p = nxt
        else:
            end = memo[p]
        memo.update(dict.fromkeys(path, end))
        return end


def _riff(v: Value, at: int, form: bytes, first: bytes | None) -> int | None:
    data = v.data
    if len(data) < at + 12 or data[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data) or end < at + 12:
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        size = struct.unpack_from("<I", data, p + 4)[0]
        if p + 8 + size > end:
            return None
        seen.add(data[p : p + 4])
        p += 8 + size + size % 2
    return end - at if seen and (first is None or first in seen) else None


def _wav(v: Value, at: int) -> int | None:
    return _riff(v, at, b"WAVE", b"data")


def _webp(v: Value, at: int) -> int | None:
    return _riff(v, at, b"WEBP", None)


def _avi(v: Value, at: int) -> int | None:
    return _riff(v, at, b"AVI ", None)


def _png(v: Value, at: int) -> int | None:
    data = v.data

    def chunk(p: int) -> tuple[int | None, int | None]:
        if p + 12 > len(data):
            return None, None
        size, kind = struct.unpack_from(">I4s", data, p)
        end = p + 12 + size
        if end > len(data) or not kind.isalpha() or zlib.crc32(data[p + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None, None
        return (None, end) if kind == b"IEND" else (end, None)

    if data[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None
    end = v.follow("png", at + 8, chunk)
    return end - at if end else None


def _gif(v: Value, at: int) -> int | None:
    data = v.data
    if len(data) < at + 13:
        return None

    def sub(p: int) -> tuple[int | None, int | None]:
        return (p + 1 + data[p], None) if p < len(data) and data[p] else (None, p + 1)

    def block(p: int) -> tuple[int | None, int | None]:
        if p < len(data) and data[p] == 0x3B:
            return None, p + 1
        if p < len(data) and data[p] == 0x21:
            return v.follow("gif-sub", p + 2, sub), None
        if p + 10 <= len(data) and data[p] == 0x2C:
            own = data[p + 9]
            return v.follow("gif-sub", p + 11 + (3 << ((own & 7) + 1) if own & 0x80 else 0), sub), None
        return None, None

    flags = data[at + 10]
    end = v.follow("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), block)
    return end - at if end else None


def _jpeg(v: Value, at: int) -> int | None:
    data = v.data

    def segment(p: int) -> tuple[int | None, int | None]:
        if data[p : p + 2] == b"\xff\xd9":
            return None, p + 2
        if p + 4 > len(data) or data[p] != 0xFF:
            return None, None
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2 or p + 2 + size > len(data):
            return None, None
        nxt = p + 2 + size
        if data[p + 1] == 0xDA:
            # the scan's own bytes end at the next marker
            markers = v.jpeg_markers()
            i = int(np.searchsorted(markers, nxt))
            return (int(markers[i]), None) if i < len(markers) else (None, None)
        return nxt, None

    end = v.follow("jpeg", at + 2, segment)
    return end - at if end else None


def _bmp(v: Value, at: int) -> int | None:
    data = v.data
    if len(data) < at + 30:
        return None
    size, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    good = header in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and not reserved and width > 0 and height
    return size if good and 26 <= offset <= size <= len(data) - at else None


def _au(v: Value, at: int) -> int | None:
    data = v.data
    if len(data) < at + 24:
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    good = 24 <= offset <= 4096 and 1 <= encoding <= 27 and 1000 <= rate <= 768_000 and 1 <= channels <= 64
    return offset + size if good and offset + size <= len(data) - at else None


def _aiff(v: Value, at: int) -> int | None:
    data = v.data
    if data[at + 8 : at + 12] not in (b"AIFF", b"AIFC"):
        return None
    end = at + 8 + struct.unpack_from(">I", data, at + 4)[0]
    if end > len(data):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        size = struct.unpack_from(">I", data, p + 4)[0]
        seen.add(data[p : p + 4])
        p += 8 + size + size % 2
    return end - at if b"COMM" in seen and p >= end else None


def _ogg(v: Value, at: int) -> int | None:
    data = v.data

    def page(p: int) -> tuple[int | None, int | None]:
        if data[p : p + 4] != b"OggS" or p + 27 > len(data) or data[p + 4]:
            return None, None
        n = data[p + 26]
        end = p + 27 + n + sum(data[p + 27 : p + 27 + n])
        if end > len(data):
            return None, None
        return (None, end) if data[p + 5] & 4 else (end, None)

    # a stream begins with a page that says so; its other pages are no media of their own
    end = v.follow("ogg", at, page) if len(data) > at + 5 and data[at + 5] & 2 else None
    return end - at if end else None


def _pdf(v: Value, at: int) -> int | None:
    ends, starts = v.marks(b"%%EOF"), v.marks(b"startxref")
    i, j = bisect_left(ends, at), bisect_left(starts, at)
    if i == len(ends) or j == len(starts) or starts[j] + 9 > ends[i] or not v.data[at + 5 : at + 6].isdigit():
        return None
    return ends[i] + 5 - at


def _gzip(v: Value, at: int) -> int | None:
    data, z = v.data, zlib.decompressobj(31)
    try:
        p = at
        while p < len(data) and not z.eof:
            z.decompress(data[p : p + 65_536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            p += 65_536
    except zlib.error:
        return None
    return min(p, len(data)) - len(z.unused_data) - at if z.eof else None


def _zip(v: Value, at: int) -> int | None:
    """The first end record whose sizes lead back to this place."""
    data, memo = v.data, v.memo("zip")
    if None not in memo:
        memo[None] = 0
        for end in v.marks(b"PK\x05\x06"):
            if end + 22 <= len(data):
                size, offset, note = struct.unpack_from("<IIH", data, end + 12)
                begin = end - offset - size
                if begin >= 0 and data[begin + offset : begin + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(data):
                    memo.setdefault(begin, end + 22 + note)
    return memo[at] - at if at in memo else None


def _mp4(v: Value, at: int) -> int | None:
    data, kinds, path, p = v.data, v.memo("mp4"), [], at
    # of each box on the way: where the boxes that follow it end, and whether a movie is among them
    while p + 8 <= len(data) and (p == at or data[p + 4 : p + 8] != b"ftyp"):
        if p in kinds and p != at:
            break
        size, kind = struct.unpack_from(">I4s", data, p)
        if size < 8 or p + size > len(data) or not kind.isalnum():
            break
        path.append((p, kind))
        p += size
    # another file's first box ends this one
    end, movie = kinds.get(p, (p, False)) if p != at and data[p + 4 : p + 8] != b"ftyp" else (p, False)
    for q, kind in reversed(path):
        movie = movie or kind == b"moov"
        kinds[q] = end, movie
    return end - at if movie and data[at + 4 : at + 8] == b"ftyp" and end > at else None


#: Type, magic bytes, their place from the value's start, validator.
FORMATS: tuple[tuple[str, bytes, int, Callable[[Value, int], int | None]], ...] = (
    ("audio/wav", b"RIFF", 0, _wav),
    ("image/webp", b"RIFF", 0, _webp),
    ("video/x-msvideo", b"RIFF", 0, _avi),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("audio/basic", b".snd", 0, _au),
    ("audio/aiff", b"FORM", 0, _aiff),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("video/mp4", b"ftyp", 4, _mp4),
)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found: dict[bytes, list[int]] = {}
    for i, (_, magic, _, _) in enumerate(FORMATS):
        found.setdefault(magic, []).append(i)
    a = ahocorasick.Automaton()
    for magic, which in found.items():
        a.add_word(magic.decode("latin-1"), (len(magic), which))
    a.make_automaton()
    return a


def hits(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of everything that a validator confirms, by offset; what stands inside confirmed media behind the start is left out."""
    out, taken = [], set()
    value, inner = Value(data), (0, 0)
    for last, (size, which) in automaton().iter(data.decode("latin-1")):
        for i in which:
            kind, _, offset, validate = FORMATS[i]
            at = last + 1 - size - offset
            if at < 0 or at in taken or inner[0] < at < inner[1]:
                continue
            length = validate(value, at)
            if length:
                taken.add(at)
                out.append((at, length, kind))
                if at:
                    inner = at, at + length
    return sorted(out)


def inspect(data: bytes | None, declared: str | None = None) -> tuple[str | None, int | None, list[tuple[int, int, str]]]:
    """The corrected type, the confirmed length (None: unconfirmed), and the embedded media: the outermost ones behind the start."""
    if not data:
        return None, None, []
    found = hits(data)
    whole = found[0] if found and found[0][0] == 0 else None
    embedded, end = [], 0
    for at, length, kind in found:
        if at and at >= end:
            embedded.append((at, length, kind))
            end = at + length
    return (whole[2], whole[1], embedded) if whole else (declared, None, embedded)


def store(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples; its length must be even."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a confirmed wave file."""
    p = 12
    while media[p : p + 4] != b"data":
        size = struct.unpack_from("<I", media, p + 4)[0]
        p += 8 + size + size % 2
    return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]


Batches = Iterator[pa.RecordBatch]
_PART = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])


def _inspect(batches: Batches, media: str, declared: str, names: list[str]) -> Batches:
    for batch in batches:
        found = [inspect(d.as_py(), t.as_py()) for d, t in zip(batch.column(media), batch.column(declared), strict=True)]
        embedded = [[{"offset": a, "length": n, "type": k} for a, n, k in f[2]] for f in found]
        cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array(embedded, pa.list_(_PART))]
        yield pa.record_batch([*batch.columns, *cols], [*batch.schema.names, *names])


def inspected(df: DataFrame, media: str, declared: str, prefix: str = "media_") -> DataFrame:
    """All columns, and ``<prefix>type, <prefix>length, <prefix>embedded``; columns of these names are replaced."""
    names = [f"{prefix}type", f"{prefix}length", f"{prefix}embedded"]
    df = df.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(frugal(lambda batches: _inspect(batches, media, declared, names)), f"{schema}, `{names[0]}` string, `{names[1]}` long, `{names[2]}` array<struct<offset:long,length:long,type:string>>")


def _store(batches: Batches) -> Batches:
    for batch in batches:
        media, sizes = [], []
        for t in batch.column("text"):
            raw = t.as_py().encode()
            sizes.append(len(raw))
            media.append(store(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
        declared = pa.array(["application/octet-stream"] * len(sizes), pa.string())
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), declared], ["doc_id", "n_bytes", "media", "declared"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's bytes, padded with bytes 0, in a container that is declared as plain bytes."""
    return _texts(docs).mapInArrow(frugal(_store), "doc_id long, n_bytes long, media binary, declared string")


def features(payload: bytes, kind: str, embedded: list) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    level = x - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    seen = np.bincount(x, minlength=256)
    share = seen[seen > 0] / len(x)
    entropy = float(-(share * np.log2(share)).sum())
    return f"{kind};samples={len(x)};mean={x.mean():.4f};rms={np.sqrt((level**2).mean()):.4f};crossings={crossings};entropy={entropy:.4f};embedded={len(embedded)}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(batches: Batches) -> Batches:
    for batch in batches:
        rows = []
        for d, kind, embedded in zip(batch.column("media"), batch.column("media_type"), batch.column("media_embedded"), strict=True):
            raw = d.as_py() or b""
            sha = hashlib.sha256(raw).hexdigest()
            if kind.as_py() != "audio/wav":
                rows.append((None, None, None, len(raw), sha, None))
                continue
            payload = samples(raw)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), sha, features(payload, kind.as_py(), embedded.as_py())))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", *names])


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of what ``inspected`` confirmed as a wave file; anything else has none (null)."""
    return media.mapInArrow(frugal(_read_back), RESULT)


def round_trip(docs: DataFrame) -> DataFrame:
    """``read_back(inspected(stored(docs)))`` in one Python worker a task, a few rows at a time."""
    small_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        small = (batch.slice(a, 256) for batch in batches for a in range(0, batch.num_rows, 256))
        return _read_back(_inspect(_store(small), "media", "declared", ["media_type", "media_length", "media_embedded"]))

    return _texts(docs).mapInArrow(frugal(run), RESULT)
