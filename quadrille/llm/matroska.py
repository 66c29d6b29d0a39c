"""Media columns as Matroska: write and parse EBML, clusters, lacing and cues.

`mux` packs raw 8-bit samples into an audio track (``A_PCM/INT/LIT``): EBML header, segment, info, tracks,
cues and clusters whose blocks carry up to eight EBML-laced frames.  `packets` parses any Matroska
bytes (variable-length ids and sizes, unknown-size clusters, SimpleBlock and BlockGroup, no, Xiph,
fixed and EBML lacing) into a packet table: track, timestamp, byte range.  `cues` reads the index.

Cases: a null or empty payload is an empty one, stored as one unit of padding; equal payloads give equal bytes, and
repeated rows a row each; a very long text is more clusters; truncated or foreign bytes, a sampling rate that isn't
above zero and times beyond 64 bits raise ValueError or IndexError in `packets` and are a row without packets
in `packet_table` (with `ok` false); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import _spark

# Element ids of the Matroska specification.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, INFO, TRACKS, ENTRY, AUDIO, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}

SAMPLE_RATE = 8000
FRAME = 1920  # samples of a frame: 240 ms
LACED = 8
CLUSTER_BLOCKS = 16
LARGEST = 1 << 63


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ms: int
    offset: int
    size: int
    keyframe: bool
    cluster: int


def put_size(n: int, width: int = 0) -> bytes:
    """A data size as a variable-length integer (shortest, or of `width` bytes)."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def put_signed(n: int) -> bytes:
    """A lace size difference: a variable-length integer with half its range as bias."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return put_size(n + (1 << 7 * width - 1) - 1, width)


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + put_size(len(body)) + body


def number(kind: int, n: int, width: int = 0) -> bytes:
    return element(kind, n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], track: int, relative: int) -> bytes:
    """The body of a SimpleBlock: one frame without lacing, several with EBML lacing."""
    head = put_size(track) + relative.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    return b"".join([head, b"\x86", bytes([len(frames) - 1]), put_size(sizes[0]), *(put_signed(b - a) for a, b in zip(sizes[:-2], sizes[1:-1])), *frames])


_HEAD = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
_TRACKS = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """Raw 8-bit samples as one Matroska file, cues before clusters."""
    ms = lambda samples: samples * 1000 // SAMPLE_RATE
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, np.array(ms(len(payload)), ">f8").tobytes()) + element(MUXER, b"quadrille") + element(WRITER, b"quadrille"))
    block, clusters, times = FRAME * LACED, [], []
    for c in range(0, len(payload), block * CLUSTER_BLOCKS):
        at, body = ms(c), []
        for b in range(c, min(len(payload), c + block * CLUSTER_BLOCKS), block):
            piece = payload[b : b + block]
            body.append(element(SIMPLE_BLOCK, lace([piece[i : i + FRAME] for i in range(0, len(piece), FRAME)], 1, ms(b) - at)))
        clusters.append(element(CLUSTER, number(TIMESTAMP, at, 8) + b"".join(body)))
        times.append(at)
    point = lambda t, at: element(CUE_POINT, number(CUE_TIME, t, 8) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at, 8)))
    first = len(info) + len(_TRACKS) + len(element(CUES, b"".join(point(t, 0) for t in times)))
    places = np.cumsum([first, *map(len, clusters)]).tolist()
    index = element(CUES, b"".join(map(point, times, places)))
    return _HEAD + element(SEGMENT, b"".join([info, _TRACKS, index, *clusters]))


def read_vint(buf: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The variable-length integer at `at` (None-like -1 for an unknown size) and the place after it."""
    if at >= len(buf) or not buf[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - buf[at].bit_length()
    if at + width > len(buf):
        raise ValueError(f"truncated integer at byte {at}")
    n = int.from_bytes(buf[at : at + width], "big")
    if not keep_marker:
        n -= 1 << 7 * width
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def elements(buf: bytes, at: int, end: int, stop: frozenset = frozenset()):
    """(id, body start, body end) of the elements in buf[at:end]; an unknown size runs to `end` or to an element in `stop`."""
    while at < end:
        kind, body = read_vint(buf, at, True)
        size, body = read_vint(buf, body)
        if kind in stop:
            return
        if size < 0:
            last = end
            if kind == CLUSTER:
                last = body
                for _, _, last in elements(buf, body, end, frozenset(TOP_LEVEL)):
                    pass
        else:
            last = body + size
            if last > end:
                raise ValueError(f"element {kind:x} ends beyond its parent")
        yield kind, body, last
        at = last


def _block(buf: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    track, at = read_vint(buf, at)
    relative, flags = int.from_bytes(buf[at : at + 2], "big", signed=True), buf[at + 2]
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, relative, bool(flags & 0x80), [(at, end - at)]
    count, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // count] * (count - 1)
    elif kind == 1:
        for _ in range(count - 1):
            n = 0
            while buf[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + buf[at])
            at += 1
    else:
        n, at = read_vint(buf, at)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - buf[at].bit_length()
            raw, at = read_vint(buf, at)
            raw = (1 << 7 * width) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - (1 << 7 * width - 1) + 1)
        sizes = sizes[: count - 1]
    frames = []
    for n in [*sizes, end - at - sum(sizes)]:
        if n < 0 or at + n > end:
            raise ValueError("lace sizes beyond the block")
        frames.append((at, n))
        at += n
    return track, relative, bool(flags & 0x80), frames


def _real(raw: bytes) -> float:
    if len(raw) not in (0, 4, 8):
        raise ValueError("a real number has 0, 4 or 8 bytes")
    return float(np.frombuffer(raw, f">f{len(raw)}")[0]) if raw else 0.0


def packets(buf: bytes, frame_ms: float | None = None) -> tuple[list[Packet], dict]:
    """All frames in file order and what the header says (scale, duration, rate, cues).

    Laced frames after the first have the time that their sizes give at the track's rate."""
    meta = {"scale": 1_000_000, "duration": 0.0, "rate": 8000.0, "cues": [], "clusters": 0}
    out: list[Packet] = []
    top = list(elements(buf, 0, len(buf)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for kind, a, b in top:
        if kind != SEGMENT:
            continue
        origin = a
        for kind, a, b in elements(buf, a, b):
            if kind == INFO:
                for k, x, y in elements(buf, a, b):
                    if k == SCALE:
                        meta["scale"] = int.from_bytes(buf[x:y], "big")
                    elif k == DURATION:
                        meta["duration"] = _real(buf[x:y])
            elif kind == TRACKS:
                for k, x, y in elements(buf, a, b):
                    for k2, x2, y2 in elements(buf, x, y) if k == ENTRY else ():
                        for k3, x3, y3 in elements(buf, x2, y2) if k2 == AUDIO else ():
                            if k3 == RATE:
                                meta["rate"] = _real(buf[x3:y3])
                                if not 0 < meta["rate"] < 1e12:
                                    raise ValueError("no usable sampling rate")
            elif kind == CUES:
                for k, x, y in elements(buf, a, b):
                    point = {}
                    for k2, x2, y2 in elements(buf, x, y):
                        if k2 == CUE_TIME:
                            point["time"] = int.from_bytes(buf[x2:y2], "big")
                        for k3, x3, y3 in elements(buf, x2, y2) if k2 == CUE_POSITIONS else ():
                            if k3 == CUE_CLUSTER:
                                point["at"] = origin + int.from_bytes(buf[x3:y3], "big")
                    meta["cues"].append((point.get("time", 0), point.get("at", -1)))
            elif kind == CLUSTER:
                base, index = 0, meta["clusters"]
                meta["clusters"] += 1
                for k, x, y in elements(buf, a, b):
                    if k == TIMESTAMP:
                        base = int.from_bytes(buf[x:y], "big")
                        continue
                    blocks = [(x, y)] if k == SIMPLE_BLOCK else [(p, q) for k2, p, q in elements(buf, x, y) if k2 == BLOCK] if k == BLOCK_GROUP else []
                    for p, q in blocks:
                        track, relative, key, frames = _block(buf, p, q)
                        done = 0
                        for at, n in frames:
                            time = (base + relative) * meta["scale"] // 1_000_000 + int(done * 1000 // meta["rate"])
                            if not (-LARGEST <= time < LARGEST and 0 <= track < LARGEST):
                                raise ValueError("a time or track beyond 64 bits")
                            out.append(Packet(track, time, at, n, key, index))
                            done += n
    return out, meta


def demux(buf: bytes, track: int = 1) -> bytes:
    """The samples of one track, in file order."""
    return b"".join(buf[p.offset : p.offset + p.size] for p in packets(buf)[0] if p.track == track)


def seek(buf: bytes, ms: int) -> int:
    """The byte place of the cluster that the cues give for a time."""
    cues = [c for c in packets(buf)[1]["cues"] if c[0] <= ms]
    return max(cues)[1] if cues else -1


def packet_table(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per packet of each row of (doc_id, media): track, timestamp_ms, offset, size, keyframe, cluster.

    Bytes that aren't Matroska give one row with `ok` false and null packet columns; null media none."""
    def run(batches):
        for batch in batches:
            rows = []
            for key, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if buf is None:
                    continue
                try:
                    rows += [(key, True, p.track, p.timestamp_ms, p.offset, p.size, p.keyframe, p.cluster) for p in packets(buf)[0]]
                except (ValueError, IndexError):  # what the parser raises on bytes that break the format
                    rows.append((key, False, *[None] * 6))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "ok", "track", "timestamp_ms", "offset", "size", "keyframe", "cluster"])

    return media.select(F.col("doc_id").cast("long"), F.col(column).cast("binary")).mapInArrow(
        run, "doc_id long, ok boolean, track long, timestamp_ms long, offset long, size long, keyframe boolean, cluster long")


def pad(raw: bytes, unit: int = 192) -> bytes:
    return raw + b" " * (-len(raw) % unit if raw else unit)


def features(table: list[Packet], meta: dict, samples: bytes) -> str:
    """A short description from the packet table and the samples read back."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    total, square = int(x.sum()), int((x * x).sum())
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"packets={len(table)};clusters={meta['clusters']};cues={len(meta['cues'])};ms={int(meta['duration'])};last_ms={table[-1].timestamp_ms if table else 0};sum={total};energy={square};crossings={turns}"


def media_digests(docs: DataFrame, unit: int = 192) -> DataFrame:
    """Store each text as Matroska audio, read the stored bytes back, and describe both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        from quadrille.llm import _text

        for part, data, offsets in _text.slices(batches):
            raw, rows = data.tobytes(), []
            for key, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                media = mux(pad(raw[a:b], unit))
                table, meta = packets(media)
                back = b"".join(media[p.offset : p.offset + p.size] for p in table if p.track == 1)
                rows.append((key, b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(table, meta, back)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _spark.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, unit: int = 192) -> DataFrame:
    """doc_id and the stored Matroska bytes of each text."""
    def run(batches):
        from quadrille.llm import _text

        for part, data, offsets in _text.slices(batches):
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(pad(raw[a:b], unit)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], names=["doc_id", "media"])

    return _spark.texts(docs).mapInArrow(run, "doc_id long, media binary")
