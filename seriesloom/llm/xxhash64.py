"""The published XXH64 hash of many byte spans at once, as NumPy array operations."""

from __future__ import annotations

import numpy as np

# The five primes of the XXH64 specification.
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state, lane):
    return _turn(state + lane * P2, 31) * P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[starts[i]:ends[i]]`` for each i."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    fours = np.ndarray(len(data) + 1, "<u4", held, strides=(1,))
    at = starts.astype(np.int64)
    size = ends - starts
    with np.errstate(over="ignore"):
        begin = np.uint64(seed)
        out = np.full(len(at), begin + P5)
        long = np.flatnonzero(size >= 32)
        if len(long):
            out[long] = _stripes(eights, at[long], size[long] // 32, begin)
            at[long] += size[long] // 32 * 32
        out += size.astype(np.uint64)
        left = ends - at
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            out[some] = _turn(out[some] ^ _round(np.uint64(0), eights[at[some]]), 27) * P1 + P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        out[some] = _turn(out[some] ^ (fours[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left >= 1)
            out[some] = _turn(out[some] ^ (held[at[some]].astype(np.uint64) * P5), 11) * P1
            at[some] += 1
            left[some] -= 1
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        return out ^ (out >> np.uint64(32))


def _stripes(eights: np.ndarray, at: np.ndarray, stripes: np.ndarray, seed: np.uint64) -> np.ndarray:
    lanes = [np.full(len(at), v) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
    some = np.arange(len(at))
    done = 0
    while len(some):
        for k in range(4):
            lanes[k][some] = _round(lanes[k][some], eights[at[some] + done * 32 + k * 8])
        done += 1
        some = some[stripes[some] > done]
    out = sum((_turn(v, bits) for v, bits in zip(lanes[1:], (7, 12, 18), strict=True)), _turn(lanes[0], 1))
    for v in lanes:
        out = (out ^ _round(np.uint64(0), v)) * P1 + P4
    return out
