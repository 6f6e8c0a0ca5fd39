"""Media columns in Matroska: a writer for 8-bit PCM payloads and a parser that turns a file into a packet table.

The parser reads variable-length EBML elements, clusters, blocks with every kind of lacing, and cues; each packet
has its track, timestamp and byte range within the file. Both run inside Spark tasks, one document at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed element ids of the Matroska format
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACED, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT))

FRAME, FRAME_MS, LACE, PER_CLUSTER = 576, 72, 8, 64  # 576 samples at 8 kHz last 72 ms
NONE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size: the shortest form that is not all ones, or ``width`` bytes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced_block(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    """One SimpleBlock body: track, relative timestamp, flags, lace sizes, frames."""
    lacing = lacing if len(frames) > 1 else NONE
    head = vint(track) + at.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    sizes = [len(f) for f in frames]
    if lacing != NONE:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """``payload`` (a multiple of FRAME bytes) as one PCM track: laced blocks in clusters, then cues."""
    audio = element(AUDIO, element(RATE, np.array([8000.0], ">f8").tobytes()) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LACED, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio)
    frames = len(payload) // FRAME
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, np.array([frames * FRAME_MS], ">f8").tobytes()) + element(MUXER, b"kelora") + element(WRITER, b"kelora"))
    parts, cues, at = [info, element(TRACKS, track)], [], 0
    at = sum(map(len, parts))
    step = LACE * FRAME
    for c in range(0, frames, PER_CLUSTER):
        body = [uint(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(c + PER_CLUSTER, frames), LACE):
            n = min(LACE, frames - b, c + PER_CLUSTER - b)
            chunk = payload[b * FRAME : b * FRAME + min(step, n * FRAME)]
            body.append(element(SIMPLE, laced_block(1, (b - c) * FRAME_MS, [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)], 1 + b // LACE % 3)))
        cues.append(element(CUE, uint(CUE_TIME, c * FRAME_MS) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, place after it); -1 for the reserved all-ones size, which means unknown."""
    first = data[at]
    if not first:
        raise ValueError("variable-length number longer than 8 bytes")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw ^ 1 << 7 * width
    return -1 if value == (1 << 7 * width) - 1 else value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of the elements in ``data[at:end]``."""
    while at < end:
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = end if size < 0 else min(end, at + size)
        yield ident, at, stop
        at = stop


def lace_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, length) of each frame of a block whose lace head begins at ``at``."""
    if lacing == NONE:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACE:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw, at = read_vint(data, at)
            sizes.append(sizes[-1] + (raw if raw >= 0 else (1 << 7 * width) - 1) - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def demux(data: bytes) -> dict:
    """Tracks, cues and packets (track, timestamp ms, start, length, lacing, keyframe, cluster) of a Matroska file."""
    out = {"tracks": {}, "cues": [], "packets": [], "clusters": 0, "scale": 1_000_000}
    num = lambda a, b: int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, base: int, simple: bool) -> None:
        track, a = read_vint(data, a)
        rel, flags = int.from_bytes(data[a : a + 2], "big", signed=True), data[a + 2]
        lacing = flags >> 1 & 3
        ranges = lace_ranges(data, a + 3, b, lacing)
        each = FRAME_MS if track in out["tracks"] else 0
        for i, (s, n) in enumerate(ranges):
            out["packets"].append((track, base + rel + i * each, s, n, lacing, bool(flags & 0x80) and simple, out["clusters"]))

    for ident, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        for kind, c, d in elements(data, a, b):
            if kind == INFO:
                out["scale"] = next((num(x, y) for i, x, y in elements(data, c, d) if i == SCALE), out["scale"])
            elif kind == TRACKS:
                for i, x, y in elements(data, c, d):
                    if i == TRACK:
                        own = {j: (u, v) for j, u, v in elements(data, x, y)}
                        out["tracks"][num(*own[NUMBER])] = data[slice(*own[CODEC])].decode()
            elif kind == CLUSTER:
                base = 0
                out["clusters"] += 1
                for i, x, y in elements(data, c, d):
                    if i == TIMESTAMP:
                        base = num(x, y)
                    elif i == SIMPLE:
                        block(x, y, base, True)
                    elif i == GROUP:
                        for j, u, v in elements(data, x, y):
                            if j == BLOCK:
                                block(u, v, base, False)
            elif kind == CUES:
                for i, x, y in elements(data, c, d):
                    own = {j: (u, v) for j, u, v in elements(data, x, y)}
                    place = {j: num(u, v) for j, u, v in elements(data, *own[CUE_AT])}
                    out["cues"].append((num(*own[CUE_TIME]), place[CUE_TRACK], place[CUE_CLUSTER] + a))
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each whole text (null: empty) stored losslessly as a Matroska file. Narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):  # bounds what one output batch holds
                part = b.iloc[i : i + 512]
                rows = [padded(t) for t in part[text]]
                yield pd.DataFrame({key: part[key], "n_bytes": [n for n, _ in rows], "media": [mux(p) for _, p in rows]})

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per packet of each file: key, track, timestamp_ms, start, length, lacing, keyframe, cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, m in zip(b[key], b["media"]):
                got = pd.DataFrame(demux(m)["packets"], columns=["track", "timestamp_ms", "start", "length", "lacing", "keyframe", "cluster"])
                yield got.assign(**{key: k})[[key, *got.columns]]

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "media").mapInPandas(run, f"{key} {kind}, track long, timestamp_ms long, start long, length long, lacing int, keyframe boolean, cluster long")


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the stored bytes back through the packet table of each file and digest payload, file and samples."""

    def one(data: bytes) -> tuple:
        got = demux(data)
        payload = b"".join([data[s : s + n] for _, _, s, n, _, _, _ in got["packets"]])
        x = np.frombuffer(payload, np.uint8)
        above = x > 127
        level = int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))
        power = int((x.astype(np.int32) ** 2).sum(dtype=np.int64)) // max(1, len(x))
        crossings = int(np.count_nonzero(above[1:] != above[:-1]))
        last = got["packets"][-1] if got["packets"] else (0, 0, 0, 0, 0, 0, 0)
        feature = f"tracks={len(got['tracks'])};clusters={got['clusters']};cues={len(got['cues'])};packets={len(got['packets'])};ms={last[1] + FRAME_MS};level={level};power={power};crossings={crossings}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([one(m) for m in b["media"]], columns=names, index=b.index)
            yield pd.concat([b[[key, "n_bytes"]], got], axis=1)

    kind = media.schema[key].dataType.simpleString()
    return media.mapInPandas(run, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: sizes and digests of the payload that was read back from the stored container.

    A null text is the empty text, whose payload is one padded block; equal texts and repeated rows give equal values;
    extra columns are not read; no rows give no rows.
    """
    return digests(with_media(docs))
