"""Content-chosen anchors: which places of a text can begin a string that occurs elsewhere."""

from __future__ import annotations

import numpy as np

GRAM = 128
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
_MIX = [np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)]
_BLOCK = 1 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 128 bytes from each place, by doubling."""
    h = data.astype("u8") * _ODD[0] + np.uint64(1)
    for k, odd in zip((1, 2, 4, 8, 16, 32, 64), _ODD):
        h = h[:-k] * odd + (h[k:] ^ (h[k:] >> np.uint64(29)))
    h ^= h >> np.uint64(33)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima that run forward and backward inside blocks of that width."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    fore = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): runs of windows of ``length`` bytes that share their anchor, in the text's order.

    A window's anchor is its leftmost 128 bytes of smallest hash. Equal windows have equal
    anchors at equal offsets, whatever stands around them. Blocks bound the memory; a run
    that a block's end cuts in two is two runs.
    """
    width, n = length - GRAM + 1, len(data) - length + 1
    firsts, lasts, anchors = [], [], []
    for a in range(0, max(n, 0), _BLOCK):
        h = gram_hashes(data[a : min(len(data), a + _BLOCK + length - 1)])
        # the upper bits order, the lower ones say where: the minimum of both is the leftmost smallest
        packed = (h & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(h), dtype="u8")
        at = (sliding_min(packed, width) & np.uint64(0x3FFFFF)).astype("i8")
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        firsts.append(new + a)
        lasts.append(np.append(new[1:], len(at)) - 1 + a)
        anchors.append(h[at[new]])
    if not firsts:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


def anchor_place(raw: bytes, length: int) -> int:
    """Where the anchor of the first window of ``raw`` begins."""
    h = gram_hashes(np.frombuffer(raw, "u1", length)) & np.uint64(0xFFFFFFFFFFC00000)
    return int(h.argmin())
