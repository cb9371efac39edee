"""Scalar text functions: keys, hashes, boundaries, visibility. Plain Python, used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np

#: Code points that show nothing, besides white space (first and last of each range).
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x2800, 0x2800), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
_VISIBLE = re.compile("[^\\s" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in INVISIBLE) + "]")


def canonical_key(text: str) -> str:
    """Comparison key of a term: trimmed, full case fold, then NFC."""
    return unicodedata.normalize("NFC", text.strip().casefold())


def has_visible_text(text: str) -> bool:
    return _VISIBLE.search(text) is not None


def char_bounds(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The range moved inwards to UTF-8 boundaries and into the text."""
    inside = lambda i: 0 < i < len(raw) and raw[i] & 0xC0 == 0x80
    start = min(max(start, 0), len(raw))
    while inside(start):
        start += 1
    end = min(max(end, start), len(raw))
    while end > start and inside(end):
        end -= 1
    return start, end


def cut_bytes(text: str, limit: int) -> tuple[str, bool]:
    """The longest beginning of at most `limit` bytes that ends between characters, and whether it was cut."""
    raw = text.encode()
    return (text, False) if len(raw) <= limit else (raw[: char_bounds(raw, 0, limit)[1]].decode(), True)


def line_starts(raw: bytes) -> list[int]:
    """Byte places of the beginnings of lines; LF, CRLF and a lone CR end lines."""
    return [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", raw))]


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def siphash13(texts: Sequence[bytes]) -> np.ndarray:
    """SipHash-1-3 under zero keys of many byte strings at once: one vector step a word of the longest."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    words = sizes[order] // 8
    starts = np.zeros(n, np.int64)
    padded = [texts[i] + b"\0" * (7 - len(texts[i]) % 8) + bytes([len(texts[i]) & 255]) for i in order]  # the last word ends in the length
    flat = np.frombuffer(b"".join(padded), "<u8") if n else np.zeros(0, np.uint64)
    starts[1:] = np.cumsum(words + 1)[:-1] if n else starts[1:]
    # Fixed values of the algorithm: the initial state is "somepseudorandomlygeneratedbytes".
    v = [np.full(n, np.uint64(int.from_bytes(b"somepseudorandomlygeneratedbytes"[8 * i : 8 * i + 8], "big"))) for i in range(4)]

    def rounds(a, b, c, d, times):
        for _ in range(times):
            a, c = a + b, c + d
            b, d = _rotate(b, 13) ^ a, _rotate(d, 16) ^ c
            a = _rotate(a, 32) + d
            c = c + b
            b, d = _rotate(b, 17) ^ c, _rotate(d, 21) ^ a
            c = _rotate(c, 32)
        return a, b, c, d

    with np.errstate(over="ignore"):
        for k in range(int(words[0]) + 1 if n else 0):
            live = int(np.searchsorted(-words, -k, "right"))
            m = flat[starts[:live] + k]
            a, b, c, d = rounds(v[0][:live], v[1][:live], v[2][:live], v[3][:live] ^ m, 1)
            v[0][:live], v[1][:live], v[2][:live], v[3][:live] = a ^ m, b, c, d
        a, b, c, d = rounds(v[0], v[1], v[2] ^ np.uint64(0xFF), v[3], 3)
    out = np.zeros(n, np.uint64)
    out[order] = a ^ b ^ c ^ d
    return out
