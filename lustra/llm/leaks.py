"""Benchmark decontamination by Wu-Manber search over words.

Windows of consecutive item words are the patterns. Patterns of one length form a group. Two
words are a block: a shift table tells how far the search may jump from the block at hand
without missing a pattern, blocks that end a pattern lead to a bucket of patterns, and a
direct comparison of all words confirms an occurrence. The benchmark's patterns are read in
parts of bounded size; each part is one narrow pass over the documents, so a benchmark of any
size needs neither a shuffle of texts nor a large broadcast.

Null and empty texts have no words and no hits; items without words are no patterns. Items
with a null id mark words as hit but are not listed. Repeated rows are searched one by one,
repeated items count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.session import materialize

#: Words of a window.
WIDTH = 10
#: Bytes of benchmark text searched for in one pass, which bounds what a task holds.
PART_BYTES = 8 << 20
#: Passes in one job; beyond it the hits found so far are written.
PASSES_PER_JOB = 8

#: Lower case for A-Z; all but digits, letters and bytes beyond ASCII separate words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def search_words(text: bytes | None) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return (text or b"").translate(_WORD_BYTES).split()


class WuManber:
    """Shift tables and suffix buckets for the windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            words = search_words(text)
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners[tuple(words[i : i + size])].add(item)
        self.groups = []
        for length in sorted({len(p) for p in owners}):
            block = min(2, length)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
            for pattern, found in owners.items():
                if len(pattern) == length:
                    for end in range(block, length + 1):
                        at = pattern[end - block : end]
                        shift[at] = min(shift.get(at, length), length - end)
                    buckets[pattern[-block:]].append((list(pattern), found))
            self.groups.append((length, block, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of hit words, and the items with an occurring window."""
        starts, items = [], set()
        for length, block, shift, buckets in self.groups:
            far = length - block + 1
            end, last = length, len(words)
            while end <= last:
                at = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                jump = shift.get(at, far)
                if not jump:
                    window = words[end - length : end]
                    for pattern, found in buckets[at]:
                        if pattern == window:
                            starts.append((end - length, end))
                            items |= found
                    jump = 1
                end += jump
        return merge_spans(starts), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _item_parts(items: DataFrame, id_col: str, text_col: str, part_bytes: int) -> Iterator[list]:
    """The items in parts of about ``part_bytes``, read one after the other."""
    texts = items.select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("body")
    ).filter(F.col("body").isNotNull())
    total = texts.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_bytes))
    for part in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == part).distinct()
        yield [(r["item"], bytes(r["body"])) for r in rows.toLocalIterator()]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``row`` (a struct of all given columns), ``n_words``, ``spans`` of hit words and ``items``.

    One row for each row. ``spans`` are maximal half-open ranges of word numbers; ``items`` are
    the sorted ids of the items with a window in the document, as strings.
    """
    spark = docs.sparkSession
    found = docs.select(
        F.struct("*").alias("row"),
        F.col(text_col).cast("string").cast("binary").alias("body"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = found.schema
    for k, part in enumerate(_item_parts(items, item_col, item_text_col, part_bytes)):
        if k and k % PASSES_PER_JOB == 0:
            found = materialize(found, "leaks")
        tables = spark.sparkContext.broadcast(WuManber(part, width))
        found = found.mapInArrow(_searcher(tables), schema)
    return found.drop("body")


def _searcher(tables):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = tables.value
        for batch in batches:
            n_words, spans, items = [], [], []
            before = zip(
                batch.column("body").to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True
            )
            for body, old_spans, old_items in before:
                words = search_words(body)
                new_spans, new_items = matcher.search(words)
                both = merge_spans([*new_spans, *((s["start"], s["end"]) for s in old_spans)])
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in both])
                items.append(sorted({*old_items, *new_items} - {None}))
            kinds = batch.schema
            columns = [
                batch.column("row"),
                batch.column("body"),
                pa.array(n_words, kinds.field("n_words").type),
                pa.array(spans, kinds.field("spans").type),
                pa.array(items, kinds.field("items").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return search
