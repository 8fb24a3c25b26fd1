"""Dense text features, computed in Arrow batches: byte classes with numpy, word classes through a bounded memo."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Byte classes; a word is what the contract calls one: a run of bytes outside space and 0x09-0x0D.
UPPER, LOWER, DIGIT, SPACE, BREAK, SYMBOL, SHOUT, STOP, PUNCT, LEAD, TAIL, OTHER = range(12)
_STEP = 1 << 22


def _lut() -> np.ndarray:
    lut = np.full(256, OTHER, np.uint8)
    for cls, chars in ((UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (DIGIT, b"0123456789"), (SPACE, b" \t\v\f\r"), (BREAK, b"\n"), (PUNCT, b"\"'()+-/=@[]\\^_`{}~"), (SYMBOL, b"#*$%&|<>"), (SHOUT, b"!?"), (STOP, b".,;:")):
        lut[list(chars)] = cls
    lut[0x80:0xC0], lut[0xC0:] = TAIL, LEAD
    return lut


LUT = _lut()


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)


def byte_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each byte class per row, and of words per row. Works in steps, so a huge text costs no more memory."""
    off, data = text_buffers(texts)
    n = len(off) - 1
    classes, words = np.zeros((n, 12), np.int64), np.zeros(n, np.int64)
    for a in range(int(off[0]), int(off[-1]), _STEP) if n else ():
        b = min(a + _STEP, int(off[-1]))
        lo, hi = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        rows = np.repeat(np.arange(hi - lo), np.diff(np.clip(off[lo : hi + 1], a, b)))
        cls = LUT[data[a:b]]
        classes[lo:hi] += np.bincount(rows * 12 + cls, minlength=(hi - lo) * 12).reshape(-1, 12)
        blank = (cls == SPACE) | (cls == BREAK)
        start = ~blank
        start[1:] &= blank[:-1]
        if a > off[0]:
            start[0] &= LUT[data[a - 1]] in (SPACE, BREAK)
        # The first byte of a text starts a word whatever stands before it.
        firsts = off[lo:hi][(off[lo:hi] >= a) & (off[lo:hi] < b)] - a
        start[firsts] = ~blank[firsts]
        words[lo:hi] += np.bincount(rows[start], minlength=hi - lo)
    return classes, words


#: Lower-cases A-Z in bytes of UTF-8; bytes.split() then splits at exactly space and 0x09-0x0D.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw_texts(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; nulls are empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """word -> value, computed once; emptied when it holds `most` entries, so memory is bounded whatever the vocabulary."""

    def __init__(self, value, most: int = 400_000):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = v = self.value(word)
        return v
