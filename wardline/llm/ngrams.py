"""Words and word shingles inside tasks, by numpy on the bytes of an Arrow text column: no Python object per word.

A word is a maximal run of anything but the six ASCII blanks, A-Z lower-cased; its hash is a polynomial of its bytes modulo
2**64, mixed. Columns are worked in slices of whole texts of about SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
SLICE = 1 << 21
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
# Value of a byte: 0 for a blank, else its lower-cased value and 1 more.
VALUES = np.array([0 if b in b" \t\n\v\f\r" else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint64)
POWERS = np.cumprod(np.where(np.arange(4096) > 0, np.uint64(0xD1342543DE82EF95), np.uint64(1)), dtype=np.uint64)
END = np.uint64(0x632BE59BD9B4E019)  # the end of a text


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, so that order by value is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_bytes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data` and where they start; `begins` are places at which a word cannot go on."""
    v = VALUES[data]
    word = v > 0
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    begins = begins[begins < len(data)]
    fresh[begins] = word[begins]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    # Words beyond the table go round it; the bytes' sum of powers still depends on every byte.
    v = v[first:] * POWERS[place & (len(POWERS) - 1)]
    if len(place) and place.max() >= len(POWERS):
        round_ = (place // len(POWERS)).astype(np.uint64)
        v *= np.where(round_ > 0, MIX[0] * (2 * round_ + np.uint64(1)), np.uint64(1))
    return spread(np.add.reduceat(v, starts - first)), starts


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words of all texts of the slice, words per text) for each slice of a string column."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        until = max(int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1, row + 1)
        at = offsets[row : until + 1]
        hashes, starts = _long(data[at[0] : at[-1]]) if until == row + 1 else _hash_bytes(data[at[0] : at[-1]], at[:-1] - at[0])
        yield row, hashes, np.diff(np.searchsorted(starts, at - at[0]))
        row = until


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A single text, worked in pieces that end at a blank so that memory stays bounded."""
    if len(data) <= 2 * SLICE:
        return _hash_bytes(data, np.zeros(1, np.int64))
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and VALUES[data[end]]:
            more = np.flatnonzero(VALUES[data[end : end + SLICE]] == 0)
            end = end + int(more[0]) if len(more) else min(end + SLICE, len(data))
        h, s = _hash_bytes(data[at:end], np.zeros(1, np.int64))
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its five-word shingles) for every text; of the whole sequence if it has fewer words;
    none without words."""
    for first, h, counts in word_hashes(texts):
        ends = np.cumsum(counts)
        full = _grams(h, SHINGLE)
        for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if n >= SHINGLE:
                yield first + k, np.unique(full[end - n : end - SHINGLE + 1])
            else:
                yield first + k, _grams(h[end - n : end], n) if n else np.empty(0, np.uint64)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += spread(h[i : n + i] + MIX[i]) * (MIX[i] | np.uint64(1))
    return spread(total)


def with_ends(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a slice with END after every text."""
    out = np.full(len(h) + len(counts), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)] = h
    return out


def set_key(sorted_set: np.ndarray) -> int:
    """A key of the whole set as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(sorted_set.tobytes()))))
