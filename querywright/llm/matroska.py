"""Matroska columns: a writer and a parser of EBML documents, and the packet table of a file.

The parser reads variable-length element ids and sizes (unknown sizes too), descends into master elements, and turns
SimpleBlocks and BlockGroups with any lacing (none, Xiph, fixed, EBML) into packets: track, timestamp, key frame flag
and byte range in the file. Cues give the indexed clusters. The writer stores a payload as an uncompressed 8-bit track.

Defined results: a null text counts as empty; an empty text is stored as 64 zero bytes. Equal texts give equal bytes:
no clock, random id or row id goes into a file. Bytes after a broken element are ignored, as players do.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.llm.common import map_chunks

# Fixed values of the format: element ids.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, DOC_TYPE = 0x4286, 0x4282
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
#: The two elements that may have an unknown size, and what ends them: elements of their own level or of one above.
UNKNOWN_ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)
PAD, RATE = 64, 8000


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def double(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing head and the frames."""
    if kind == NO_LACING:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = 256, per_block: int = 8, cluster_ms: int = 1000) -> bytes:
    """A Matroska file that holds the payload as 8-bit samples. Blocks take fixed lacing when their frames are of one
    size, EBML lacing when the last is shorter, none when there is one frame."""
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + double(DURATION, len(payload) * 1000 / RATE))
    audio = element(AUDIO, double(SAMPLING_FREQUENCY, float(RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + audio
    parts, cues, at, start, blocks = [info, element(TRACKS, element(TRACK_ENTRY, entry))], [], 0, 0, []
    at = sum(map(len, parts))

    def close() -> None:
        nonlocal at, blocks
        if blocks:
            body = element(CLUSTER, uint(CLUSTER_TIMESTAMP, start) + b"".join(blocks))
            cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
            parts.append(body)
            at, blocks = at + len(body), []

    for p in range(0, len(payload), frame * per_block):
        now = p * 1000 // RATE
        if not blocks or now - start >= cluster_ms:
            close()
            start = now
        frames = [payload[i : min(i + frame, p + frame * per_block)] for i in range(p, min(p + frame * per_block, len(payload)), frame)]
        kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == frame else EBML_LACING
        blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", now - start, 0x80 | kind << 1) + lace(frames, kind)))
    close()
    head = element(EBML, uint(EBML_VERSION, 1) + element(DOC_TYPE, b"matroska"))
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are ones)."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("broken variable-length integer")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def _unknown_end(data: bytes, at: int, end: int, ends: set[int]) -> int:
    """Where the first element of `ends` begins; children of unknown size are entered, as one of them may end both."""
    while ends and at < end:
        try:
            ident, body, _ = read_vint(data, at, True)
            if ident in ends:
                return at
            size, body, unknown = read_vint(data, body)
        except (ValueError, IndexError):
            return end
        at = body if unknown else body + size
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin and end of the body) of each element in a range; a segment or cluster of unknown size ends before the first element
    that cannot be inside it, any other at the range's end."""
    while at < end:
        try:
            ident, at, _ = read_vint(data, at, True)
            size, at, unknown = read_vint(data, at)
        except (ValueError, IndexError):
            return
        stop = _unknown_end(data, at, end, UNKNOWN_ENDS.get(ident, set())) if unknown else at + size
        if stop > end:
            return
        yield ident, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body."""
    if kind == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        size = (end - at) // n
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            begin = at
            value, at, _ = read_vint(data, at)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, key frame, begin, end)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    laced: int = 0
    scale: int = 1_000_000
    duration: float = 0.0


def parse(data: bytes) -> Media:
    m = Media()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, at, _ = read_vint(data, a)
        rel, flags = struct.unpack_from(">hB", data, at)
        kind = flags >> 1 & 3
        m.laced += kind != NO_LACING
        step = m.tracks.get(track, {}).get("step", 0)
        for i, (x, y) in enumerate(unlace(data, at + 3, b, kind)):
            m.packets.append((track, (base + rel) * m.scale + i * step, bool(flags & 0x80) if key is None else key, x, y))

    def cluster(a: int, b: int) -> None:
        base = 0
        for ident, x, y in elements(data, a, b):
            if ident == CLUSTER_TIMESTAMP:
                base = number(x, y)
            elif ident == SIMPLE_BLOCK:
                block(x, y, base, None)
            elif ident == BLOCK_GROUP:
                inner = list(elements(data, x, y))
                key = all(i != REFERENCE_BLOCK for i, _, _ in inner)
                for i, p, q in inner:
                    if i == BLOCK:
                        block(p, q, base, key)

    def walk(a: int, b: int, into: dict) -> None:
        for ident, x, y in elements(data, a, b):
            if ident == CLUSTER:
                m.clusters.append(x)
                cluster(x, y)
            elif ident == TRACK_ENTRY:
                walk(x, y, track := {})
                m.tracks[track.get("number", len(m.tracks) + 1)] = track
            elif ident == CUE_POINT:
                walk(x, y, cue := {})
                m.cues.append((cue.get("time", 0) * m.scale, cue.get("track", 0), cue.get("position", 0)))
            elif ident in MASTERS:
                walk(x, y, into)
            elif ident in NAMES:
                name, kind = NAMES[ident]
                into[name] = data[x:y].decode("latin-1") if kind == "s" else real(x, y) if kind == "f" else number(x, y)
                if ident == TIMESTAMP_SCALE:
                    m.scale = into[name]

    top: dict = {}
    walk(0, len(data), top)
    m.duration = top.get("duration", 0.0)
    return m


NAMES = {
    TRACK_NUMBER: ("number", "u"), TRACK_TYPE: ("type", "u"), CODEC_ID: ("codec", "s"), DEFAULT_DURATION: ("step", "u"), BIT_DEPTH: ("bits", "u"), CHANNELS: ("channels", "u"), SAMPLING_FREQUENCY: ("rate", "f"),
    TIMESTAMP_SCALE: ("scale", "u"), DURATION: ("duration", "f"), CUE_TIME: ("time", "u"), CUE_TRACK: ("track", "u"), CUE_CLUSTER_POSITION: ("position", "u"), DOC_TYPE: ("doctype", "s"),
}


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, and the same with zeros up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (of the text), media (a Matroska file of the padded text)."""

    def work(ids: list, texts: list) -> dict:
        made = [padded(t) for t in texts]
        return {"id": ids, "n_bytes": [n for n, _ in made], "media": [mux(p) for _, p in made]}

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, _schema(f"id {kind}, n_bytes long, media binary"))


def packet_table(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file: id, n, track, ts_ns, keyframe, begin, length."""

    def work(ids: list, files: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "n", "track", "ts_ns", "keyframe", "begin", "length")}
        for i, data in zip(ids, files, strict=True):
            for n, (track, ts, key, a, b) in enumerate(parse(data or b"").packets):
                for k, v in zip(out, (i, n, track, ts, key, a, b - a), strict=True):
                    out[k].append(v)
        return out

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")), work, _schema(f"id {kind}, n int, track int, ts_ns long, keyframe boolean, begin long, length long"))


def features(data: bytes) -> tuple[bytes, str]:
    """The payload read back from a file, and a line about its structure and samples."""
    m = parse(data)
    payload = b"".join(data[a:b] for _, _, _, a, b in m.packets)
    track = m.tracks.get(1, {})
    indexed = sum(1 for _, _, p in m.cues if p)
    mean = float(np.frombuffer(payload, dtype=np.uint8).mean()) if payload else 0.0
    return payload, f"codec={track.get('codec', '')};tracks={len(m.tracks)};clusters={len(m.clusters)};cues={indexed};packets={len(m.packets)};laced={m.laced};last_ns={m.packets[-1][1] if m.packets else 0};duration_ms={m.duration:.3f};mean={mean:.4f}"


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back, and returns digests of both and the features."""

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for t in texts:
            n, stored = (made := padded(t))[0], mux(made[1])
            payload, line = features(stored)
            for k, v in zip(out, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), line), strict=True):
                out[k].append(v)
        return {"doc_id": ids, **out}

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, _schema(f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
