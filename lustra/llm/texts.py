"""Words and their hashes, and the blockwise exchange that the text operators share.

An operator that compares windows of all documents works on *blocks*: groups of documents of
a few megabytes, by a hash of id and text. A block sends the hashes it holds to the buckets they
belong to, a bucket sums or compares what all blocks sent, and answers each block. Spark deals
out blocks, requests and replies by shuffles; numpy works inside one block or bucket. A hot
document, line or passage costs one entry per block and bucket, whatever its number of copies
in the block, and the texts themselves are shuffled once: Spark reuses the exchange by block
for every round of one query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words where a word is ``[^\x20\x09-\x0D]+``: what bytes.split() drops.
WHITE = b"\t\n\x0b\x0c\r "
WHITE_CHARS = WHITE.decode()
#: Bytes of text in one block, and expected entries of one bucket.
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20
#: Texts are hashed in runs of about this many bytes, which bounds the temporary arrays.
RUN_BYTES = 1 << 20

#: Odd step between the positions of a word.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WINDOW_BASE = np.uint64(0xD1342543DE82EF95)
_CHECK_BASE = np.uint64(0xAF251AF3B0F025B5)


def _byte_codes(lower: bool) -> np.ndarray:
    """A random odd number for each byte, 0 for white space."""
    codes = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
    codes = codes * np.uint64(2) + np.uint64(1)
    codes[list(WHITE)] = 0
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {lower: _byte_codes(lower) for lower in (False, True)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(texts: list[bytes], size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``size`` bytes."""
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text after the other, and the words of each text.

    A word's hash is the sum of one mixed value for each of its bytes, told by byte and position. It has no algebra by which
    words of equal hashes could be made up, as a polynomial modulo a power of two has.
    """
    parts, counts = [], []
    codes = _CODES[lower]
    for first, last in runs(texts):
        data = np.frombuffer(b" ".join([*texts[first:last], b""]), np.uint8)
        terms = codes[data]
        edges = np.flatnonzero(np.diff(terms != 0, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            lengths = ends - starts
            inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = mixed(terms[terms != 0] + inside.astype(np.uint64) * _STEP)
            parts.append(mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths)))
        limits = np.cumsum([len(t) + 1 for t in texts[first:last]])
        counts.append(np.diff(np.searchsorted(starts, limits), prepend=0))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def window_hashes(words: np.ndarray, width: int, check: bool = False) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` words; ``check`` takes a second base."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _CHECK_BASE if check else _WINDOW_BASE
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * base + words[j : j + n]
    return mixed(h)


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie inside one text, and the number of that text."""
    room = np.maximum(counts - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    owner = np.repeat(np.arange(len(counts)), room)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
    return first[owner] + inside if len(owner) else owner, owner


def as_bytes(column) -> list[bytes]:
    """Values of an Arrow column of binary texts, null as empty."""
    return [t or b"" for t in column.to_pylist()]


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, by one aggregate."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def blocked(
    docs: DataFrame, id_col: str, text_col: str, total: int, *more: Column, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``block, doc, body`` and ``more``: texts as bytes, dealt to blocks by a hash of id and text.

    The text spreads rows that share an id or have none; the id spreads copies of a text. Ids are whole numbers.
    """
    n = max(1, -(-total // block_bytes))
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc"),
        F.col(text_col).cast("string").cast("binary").alias("body"),
        *more,
    )


def bucket_bits(total: int, bytes_per_entry: int = 6) -> int:
    """Bits of a hash that number the buckets, so that a bucket gets about BUCKET_ENTRIES."""
    return max(0, (total // bytes_per_entry // BUCKET_ENTRIES).bit_length())


def bucket_slices(keys: np.ndarray, bits: int) -> Iterable[tuple[int, slice]]:
    """Ranges of sorted 64-bit keys with the same top bits. The work follows the keys, not the number of buckets."""
    if not len(keys):
        return []
    tops = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(tops[1:] != tops[:-1]) + 1])
    ends = [*starts[1:].tolist(), len(keys)]
    return [(b, slice(i, j)) for b, i, j in zip(tops[starts].tolist(), starts.tolist(), ends, strict=True)]


def fragments(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of each key below those that number its bucket."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted
