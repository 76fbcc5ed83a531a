"""CRC-32C (Castagnoli) of many byte strings at once.

Leading zeros don't change a CRC that starts at zero, so each string is padded
in front to whole blocks. All blocks advance together, four bytes a step; then
the blocks of each string are joined with the linear map that appends a
block's worth of zeros. The usual start value is the same as inverting the
first four bytes.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
BLOCK = 1024


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return table


_BYTE = _byte_table()


def _after_zeros(crc: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        crc = (crc >> 8) ^ _BYTE[crc & 0xFF]
    return crc


_half = np.arange(1 << 16, dtype=np.uint32)
_LOW, _HIGH = _after_zeros(_half, 4), _after_zeros(_half << 16, 4)


def _block_map() -> tuple[np.ndarray, np.ndarray]:
    """Images of all low and high halves under ``BLOCK`` zero bytes, from the images of single bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = _after_zeros(bits, BLOCK)
    out = []
    for part in (image[:16], image[16:]):
        table = np.zeros(1 << 16, np.uint32)
        for i, x in enumerate(part):
            table ^= np.where(_half >> i & 1, x, np.uint32(0)).astype(np.uint32)
        out.append(table)
    return out[0], out[1]


_SKIP_LOW, _SKIP_HIGH = _block_map()


def _words(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Advance each row's CRC over its row of little-endian 32-bit words."""
    for j in range(words.shape[1]):
        crc = crc ^ words[:, j]
        crc = _LOW[crc & 0xFFFF] ^ _HIGH[crc >> 16]
    return crc


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each string; all must have at least four bytes."""
    if not parts:
        return np.zeros(0, np.uint32)
    size = np.array([len(p) for p in parts])
    blocks = -(-size // BLOCK)
    end = np.cumsum(blocks)
    flat = np.zeros(int(end[-1]) * BLOCK, np.uint8)
    for p, n, stop in zip(parts, size.tolist(), (end * BLOCK).tolist()):
        flat[stop - n:stop] = np.frombuffer(p, np.uint8)
        flat[stop - n:stop - n + 4] ^= 0xFF
    one = _words(np.zeros(int(end[-1]), np.uint32), np.ascontiguousarray(flat.view("<u4").reshape(-1, BLOCK // 4).T).T)
    crc = np.zeros(len(parts), np.uint32)
    begin = end - blocks
    alive = np.arange(len(parts))
    for k in range(int(blocks.max())):
        alive = alive[blocks[alive] > k]
        c = crc[alive]
        crc[alive] = _SKIP_LOW[c & 0xFFFF] ^ _SKIP_HIGH[c >> 16] ^ one[begin[alive] + k]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted form that record files store."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
