"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

An entry of the list is a host and the start of a path, as in ``example.org/es/``, with a verdict. It
fits its host and all subdomains if the path of the url starts with its path; the longest entry
wins. The digests of all entries lie sorted in an array next to the full strings. For each url the
entries that could fit are spelt out (its host suffixes with starts of its path, of the shapes the
list has), hashed, looked up for a whole batch at once, and compared with the stored strings, so
that a collision of digests decides nothing.

The list is read in parts of bounded size. A part is broadcast as bytes, and each Python worker
maps it from an unlinked file of its own; more parts are more passes without a shuffle, so a hot
host costs nothing extra and the list may have any size.

A null url or one without ``://`` has an empty host and path, and no entry fits. Entries that
occur with both verdicts block. Repeated rows are judged one by one.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import materialize

#: Bytes of entries in one part of the list.
PART_BYTES = 16 << 20
#: Passes in one job; beyond it the verdicts found so far are written.
PASSES_PER_JOB = 8

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host after the first ``://``, A-Z lower-cased, and path without query and fragment."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_LOWER), slash + path


class DigestArray:
    """Entries in the order of their digests: two arrays and the strings, in one byte string."""

    def __init__(self, entries: dict[bytes, bool]):
        ordered = sorted((xxhash.xxh64_intdigest(e), e) for e in entries)
        self.n = len(ordered)
        digests = np.array([d for d, _ in ordered], np.uint64)
        ends = np.cumsum([len(e) for _, e in ordered], dtype=np.int64)
        blocks = np.array([entries[e] for _, e in ordered], np.uint8)
        self.data = b"".join([digests.tobytes(), ends.astype(np.int64).tobytes(), blocks.tobytes(), *(e for _, e in ordered)])
        #: Labels of the host and bytes of the path that entries have.
        self.shapes = sorted({_shape(e) for e in entries})


def _shape(entry: bytes) -> tuple[int, int]:
    host, slash, path = entry.partition(b"/")
    return host.count(b".") + 1, len(slash + path)


class MappedArray:
    """A digest array in a file that this process alone sees."""

    def __init__(self, n: int, data: bytes, shapes: list[tuple[int, int]]):
        self.shapes, self._n = shapes, n
        with tempfile.TemporaryFile() as file:
            file.write(data or b"\0")
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self._digests = np.frombuffer(self._map, np.uint64, n)
        self._ends = np.frombuffer(self._map, np.int64, n, 8 * n)
        self._blocks = np.frombuffer(self._map, np.uint8, n, 16 * n)
        self._strings = 17 * n

    def _string(self, i: int) -> bytes:
        start = int(self._ends[i - 1]) if i else 0
        return self._map[self._strings + start : self._strings + int(self._ends[i])]

    def candidates(self, host: bytes, path: bytes) -> Iterator[bytes]:
        """Strings of the list's shapes that would fit."""
        if not host:
            return
        dots = [i for i, c in enumerate(host) if c == 46]
        for labels, length in self.shapes:
            if labels <= len(dots) + 1 and length <= len(path):
                start = dots[-labels] + 1 if labels <= len(dots) else 0
                yield host[start:] + path[:length]

    def longest(self, parts: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bool] | None]:
        """The longest entry that fits each host and path, and whether it blocks."""
        best: list[tuple[bytes, bool] | None] = [None] * len(parts)
        wanted = [(i, c) for i, p in enumerate(parts) for c in self.candidates(*p)]
        if not wanted or not self._n:
            return best
        keys = np.array([xxhash.xxh64_intdigest(c) for _, c in wanted], np.uint64)
        at = np.searchsorted(self._digests, keys)
        near = np.minimum(at, self._n - 1)
        for j in np.flatnonzero(self._digests[near] == keys).tolist():
            i, candidate = wanted[j]
            place = int(at[j])
            while place < self._n and self._digests[place] == keys[j]:
                if self._string(place) == candidate:
                    best[i] = longer(best[i], (candidate, bool(self._blocks[place])))
                place += 1
        return best


def longer(a: tuple[bytes, bool] | None, b: tuple[bytes, bool]) -> tuple[bytes, bool]:
    """The longer entry; of two of one length the first by byte order."""
    return b if a is None or (-len(b[0]), b[0]) < (-len(a[0]), a[0]) else a


def _list_parts(entries: DataFrame, part_bytes: int) -> Iterator[dict[bytes, bool]]:
    listed = entries.select(F.col("entry").cast("binary").alias("entry"), (F.col("verdict") == "block").alias("blocks"))
    listed = listed.filter(F.col("entry").isNotNull()).groupBy("entry").agg(F.max("blocks").alias("blocks"))
    total = listed.agg(F.sum(F.octet_length("entry") + 17).alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_bytes))
    for part in range(n):
        rows = listed.filter(F.pmod(F.xxhash64("entry"), F.lit(n)) == part)
        yield {bytes(r["entry"]): bool(r["blocks"]) for r in rows.toLocalIterator()}


def _judge(array):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = MappedArray(*array.value)
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("body").to_pylist()]
            rules = [r and r.encode() for r in batch.column("rule").to_pylist()]
            before = [(r, b) if r is not None else None for r, b in zip(rules, batch.column("blocks").to_pylist(), strict=True)]
            best = [b if a is None else a if b is None else longer(a, b) for a, b in zip(before, mapped.longest(parts), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("body"),
                    pa.array([h.decode("utf-8", "replace") for h, _ in parts], pa.string()),
                    pa.array([p.decode("utf-8", "replace") for _, p in parts], pa.string()),
                    pa.array([b and b[0].decode("utf-8", "replace") for b in best], pa.string()),
                    pa.array([b[1] if b else None for b in best], pa.bool_()),
                ],
                schema=batch.schema,
            )

    return judge


def judge_urls(
    pages: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow", part_bytes: int = PART_BYTES
) -> DataFrame:
    """``row`` (a struct of all given columns), ``host``, ``path``, ``rule`` and ``verdict``.

    ``entries`` has ``entry`` and ``verdict`` (allow or block); urls that none fits get ``default``.
    """
    context = pages.sparkSession.sparkContext
    text = lambda: F.lit(None).cast("string")
    found = pages.select(
        F.struct("*").alias("row"),
        F.col(url_col).cast("string").cast("binary").alias("body"),
        text().alias("host"),
        text().alias("path"),
        text().alias("rule"),
        F.lit(None).cast("boolean").alias("blocks"),
    )
    schema = found.schema
    for k, part in enumerate(_list_parts(entries, part_bytes)):
        if k and k % PASSES_PER_JOB == 0:
            found = materialize(found, "urls")
        array = DigestArray(part)
        shared = context.broadcast((array.n, array.data, array.shapes))
        found = found.mapInArrow(_judge(shared), schema)
    verdict = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(default)
    return found.select("row", "host", "path", "rule", verdict.alias("verdict"))
