"""Hashed byte n-grams of whole texts, block by block."""

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20  # bytes hashed at a time, so that a very long text needs little memory


def hashed_blocks(data: bytes, orders: range, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers (0 to 2**bits - 1) of all byte n-grams, each n-gram once."""
    buffer = np.frombuffer(data, np.uint8).astype(np.uint32)
    for start in range(0, len(buffer), BLOCK):
        block = buffer[start : start + BLOCK + orders[-1] - 1]
        grams = np.full(len(block), 2166136261, np.uint32)
        for n in range(1, orders[-1] + 1):
            if len(block) < n:
                break
            grams = (grams[: len(block) - n + 1] ^ block[n - 1 :]) * np.uint32(16777619)
            if n in orders:
                own = grams[:BLOCK] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                yield ((own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def distinct(data: bytes, orders: range, bits: int) -> np.ndarray:
    """Sorted bucket numbers that occur."""
    seen = np.zeros(1 << bits, bool)
    for block in hashed_blocks(data, orders, bits):
        seen[block] = True
    return np.flatnonzero(seen).astype(np.int32)


def counted(data: bytes, orders: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket numbers that occur, and how often."""
    total = np.zeros(1 << bits, np.int64)
    for block in hashed_blocks(data, orders, bits):
        total += np.bincount(block, minlength=1 << bits)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]
