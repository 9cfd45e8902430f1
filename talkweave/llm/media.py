"""Documents as Matroska audio, and Matroska files as packet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import keyed_text, restore_key

# Element ids of the Matroska specification (RFC 9559) and of EBML (RFC 8794).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3

FRAME, RATE, LACED, BLOCKS = 576, 8000, 8, 32
_MS = FRAME * 1000 // RATE


def vint(n: int) -> bytes:
    """A size of the fewest bytes; a value of all ones is kept for "unknown"."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(tag: int, body: bytes) -> bytes:
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(tag: int, n: int) -> bytes:
    return element(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(tag: int, x: float) -> bytes:
    return element(tag, np.array(x, ">f8").tobytes())


_HEAD = element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1)
        + _uint(DEFAULT_DURATION, _MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def write_matroska(payload: bytes) -> bytes:
    """8-bit samples at 8 kHz: blocks of up to 8 equal-sized laced frames, 32 blocks a cluster, a cue for each cluster."""
    frames = len(payload) // FRAME
    info = element(
        INFO,
        _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, frames * _MS) + element(MUXING_APP, b"talkweave") + element(WRITING_APP, b"talkweave"),
    )
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for c in range(0, frames, LACED * BLOCKS):
        body = [_uint(TIMESTAMP, c * _MS)]
        for b in range(c, min(frames, c + LACED * BLOCKS), LACED):
            n = min(LACED, frames - b)
            lace = bytes([0x80 | FIXED_LACE << 1, n - 1]) if n > 1 else b"\x80"
            body.append(element(SIMPLE_BLOCK, vint(1) + ((b - c) * _MS).to_bytes(2, "big", signed=True) + lace + payload[b * FRAME : (b + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c * _MS) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds; packets: (track, timestamp ns, offset, size, key frame, cluster, block, place in the lace)."""

    scale: int
    duration: float
    tracks: list[tuple[int, int, str]]
    packets: list[tuple[int, int, int, int, bool, int, int, int]]
    cues: list[tuple[int, int, int]]


_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}


def _read_vint(data: bytes, at: int, keep_mark: bool) -> tuple[int, int, bool]:
    """(value, next place, whether all value bits are set)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no variable-length integer at byte {at}")
    end = at + width
    if end > len(data):
        raise ValueError("the file ends inside a variable-length integer")
    n = int.from_bytes(data[at:end], "big")
    bits = n & ((1 << 7 * width) - 1)
    return (n if keep_mark else bits), end, bits == (1 << 7 * width) - 1


def elements(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(id, start of the body, its end) in file order, masters before their children.

    A segment or cluster of unknown size ends with its parent, or where an element
    begins that only its parent can hold. A body that runs beyond its parent is an error.
    """
    stack, at = [(0, len(data), False)], 0
    while True:
        while len(stack) > 1 and at >= stack[-1][1]:
            stack.pop()
        if at >= len(data):
            return
        tag, at, _ = _read_vint(data, at, True)
        size, at, unknown = _read_vint(data, at, False)
        while stack[-1][2] and stack[-1][0] == CLUSTER and tag in (CLUSTER, CUES, TRACKS, INFO):
            stack.pop()
        end = stack[-1][1] if unknown else at + size
        if end > stack[-1][1]:
            raise ValueError(f"element {tag:#x} runs beyond its parent")
        yield tag, at, end
        if tag in _MASTERS:
            stack.append((tag, end, unknown))
        else:
            at = end


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose lace header begins at ``at``, and where the first frame begins."""
    if kind == NO_LACE:
        return [end - at], at
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED_LACE:
        if (end - at) % n:
            raise ValueError("a fixed-size lace isn't a multiple of its frames")
        return [(end - at) // n] * n, at
    if kind == XIPH_LACE:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            start = at
            x, at, _ = _read_vint(data, at, False)
            # later sizes are signed differences, biased by half the range of their width
            sizes.append(x if not k else sizes[-1] + x - ((1 << (7 * (at - start) - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


def read_matroska(data: bytes) -> Media:
    m, durations = Media(1_000_000, 0.0, [], [], []), {}
    cluster, clusters, block, track, kind, codec, cue, cue_track = 0, 0, 0, 0, 0, "", 0, 0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: float(np.frombuffer(data[a:b], f">f{b - a}")[0]) if b > a else 0.0
    for tag, a, b in elements(data):
        if tag in (SIMPLE_BLOCK, BLOCK):
            at_track, at, _ = _read_vint(data, a, False)
            when = (cluster + int.from_bytes(data[at : at + 2], "big", signed=True)) * m.scale
            flags = data[at + 2]
            sizes, at = lace_sizes(data, at + 3, b, flags >> 1 & 3)
            step = durations.get(at_track, 0)
            for k, size in enumerate(sizes):
                m.packets.append((at_track, when + k * step, at, size, bool(flags & 0x80), clusters - 1, block, k))
                at += size
            block += 1
        elif tag == CLUSTER:
            clusters += 1
        elif tag == TIMESTAMP:
            cluster = number(a, b)
        elif tag == TIMESTAMP_SCALE:
            m.scale = number(a, b)
        elif tag == DURATION:
            m.duration = real(a, b)
        elif tag == TRACK_ENTRY:
            m.tracks.append((0, 0, ""))
        elif tag == TRACK_NUMBER:
            track = number(a, b)
            m.tracks[-1] = (track, *m.tracks[-1][1:])
        elif tag == TRACK_TYPE:
            kind = number(a, b)
            m.tracks[-1] = (m.tracks[-1][0], kind, m.tracks[-1][2])
        elif tag == CODEC_ID:
            codec = data[a:b].decode()
            m.tracks[-1] = (*m.tracks[-1][:2], codec)
        elif tag == DEFAULT_DURATION:
            durations[m.tracks[-1][0]] = number(a, b)
        elif tag == CUE_TIME:
            cue = number(a, b)
        elif tag == CUE_TRACK:
            cue_track = number(a, b)
        elif tag == CUE_CLUSTER_POSITION:
            m.cues.append((cue * m.scale, cue_track, number(a, b)))
    return m


def to_matroska(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as an audio file; null and empty texts are one padded frame."""

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.iloc[a : a + 256]
                raw = [t.encode() for t in part["t"]]
                yield pd.DataFrame({"k": part["k"].array, "n_bytes": [len(x) for x in raw], "media": [write_matroska(pad(x)) for x in raw]})

    return restore_key(keyed_text(docs, id_col, text_col).mapInPandas(run, "k string, n_bytes long, media binary"), docs, id_col)


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: track, codec, timestamp_ns, byte_offset, byte_length, keyframe, cluster, block, lace.

    A null file has no packets; a file that isn't Matroska gives one row with ``error`` set.
    """

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b["k"], b["m"]):
                if data is None:
                    continue
                try:
                    m = read_matroska(data)
                except (ValueError, IndexError) as e:
                    rows.append((k, *[None] * 9, str(e)))
                    continue
                codecs = {n: c for n, _, c in m.tracks}
                rows += [(k, p[0], codecs.get(p[0]), *p[1:], None) for p in m.packets]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            for c in ("track", "timestamp_ns", "byte_offset", "byte_length", "cluster", "block", "lace"):
                out[c] = out[c].astype("Int64")
            yield out

    schema = "k string, track long, codec string, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, cluster long, block long, lace long, error string"
    return restore_key(files.select(F.col(id_col).cast("string").alias("k"), F.col(media_col).alias("m")).mapInPandas(run, schema), files, id_col)


def audio_features(media: Media, samples: np.ndarray) -> str:
    x = samples.astype("f8") - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"packets={len(media.packets)};clusters={len(media.cues)};ms={media.duration:.0f};rms={np.sqrt(np.mean(x * x)):.4f};peak={np.abs(x).max():.0f};crossings={crossings}"


def media_digest(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored files back through their packets: payload and media digests and features."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for data in b["media"]:
                m = read_matroska(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in m.packets])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), audio_features(m, np.frombuffer(payload, "u1"))))
            yield pd.concat([b[["k", "n_bytes"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    out = files.select(F.col(id_col).cast("string").alias("k"), "n_bytes", "media").mapInPandas(
        run, "k string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return restore_key(out, files, id_col)
