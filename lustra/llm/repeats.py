"""Substring dedup: passages that an earlier document holds are removed.

All windows of a fixed number of words are hashed by Rabin-Karp. A first exchange finds the
windows that several blocks share by 32 bits of their hash below the bucket's, a few bytes for
each window; a second one takes these candidates only, with 96 bits, and the smallest id that
holds each is found. A window goes if a document with a smaller id holds it too, and the windows that go
merge into maximal intervals of words. Windows are judged on the input, not on what is left.

Null and empty texts have no words. A null id counts as larger than all others. Rows with one
id do not remove each other's passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.llm.texts import (
    as_bytes,
    blocked,
    bucket_bits,
    bucket_slices,
    find,
    fragments,
    runs,
    text_bytes,
    window_hashes,
    window_starts,
    word_hashes,
)

#: Words of a window.
WIDTH = 13
NO_ID = (1 << 63) - 1

_PARTS = "bucket int, block int, parts binary, checks binary, docs binary"


def _windows(bodies: list[bytes], width: int, check: bool = False):
    """Hashes of all windows inside a text, their text and the word they start at, in runs."""
    for first, last in runs(bodies):
        words, counts = word_hashes(bodies[first:last], lower=False)
        starts, owner = window_starts(counts, width)
        h = window_hashes(words, width)[starts]
        second = window_hashes(words, width, check=True)[starts] if check else h
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        yield first, last, counts, h, second, owner, starts - begin[owner]


def _first_ids(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest id of each, and one place of it."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    return h[new], ids[new], order[new]


def _message(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "parts", "checks", "docs"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _ask(bits: int, width: int):
    """32 bits of each window of a block, by bucket."""

    def run(texts: pa.Table) -> pa.Table:
        found = [np.unique(w[3]) for w in _windows(as_bytes(texts["body"]), width)]
        keys = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        block = texts["block"][0].as_py()
        return _message([(b, block, fragments(keys[s], bits).tobytes(), None, None) for b, s in bucket_slices(keys, bits)])

    return run


def _shared(asked: pa.Table) -> pa.Table:
    """For each block that asked: its fragments that another block has too."""
    parts = [np.unique(np.frombuffer(x, np.uint32)) for x in asked["parts"].to_pylist()]
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    several = keys[counts > 1]
    bucket, rows = asked["bucket"][0].as_py(), []
    for block, part in zip(asked["block"].to_pylist(), parts, strict=True):
        part = part[find(several, part)[1]]
        if len(part):
            rows.append((bucket, block, part.tobytes(), None, None))
    return _message(rows)


def _known(answers: pa.Table) -> np.ndarray:
    """Bucket and fragment of all candidates of a block, in order."""
    parts = [
        np.frombuffer(part, np.uint32).astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
        for bucket, part in zip(answers["bucket"].to_pylist(), answers["parts"].to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def _offer(bits: int, width: int):
    """The candidates of a block with 64 and 32 bits of hash and their smallest id."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = _known(answers)
        if not texts.num_rows or not len(known):
            return _message([])
        ids = texts["doc"].to_numpy()
        hashes, checks, docs = [], [], []
        for first, _, _, h, second, owner, _ in _windows(as_bytes(texts["body"]), width, check=True):
            top = (h >> np.uint64(64 - bits)) << np.uint64(32) if bits else np.uint64(0)
            there = find(known, top | fragments(h, bits))[1]
            hashes.append(h[there])
            checks.append((second[there] >> np.uint64(32)).astype(np.uint32))
            docs.append(ids[first + owner[there]])
        checks = np.concatenate(checks)
        h, docs, place = _first_ids(np.concatenate(hashes), np.concatenate(docs))
        checks = checks[place]
        narrow = np.uint32 if len(docs) and docs.max() < 1 << 32 and docs.min() >= 0 else np.int64
        block = texts["block"][0].as_py()
        return _message(
            [(b, block, h[s].tobytes(), checks[s].tobytes(), docs[s].astype(narrow).tobytes()) for b, s in bucket_slices(h, bits)]
        )

    return run


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _smallest(offered: pa.Table) -> pa.Table:
    """For each block: its windows that a smaller id of another block holds, with that id."""
    h = [np.frombuffer(x, np.uint64) for x in offered["parts"].to_pylist()]
    checks = [np.frombuffer(x, np.uint32) for x in offered["checks"].to_pylist()]
    docs = [_ids(x, len(p)) for x, p in zip(offered["docs"].to_pylist(), h, strict=True)]
    every_h, every_check, every_doc = map(np.concatenate, (h, checks, docs))
    order = np.lexsort((every_doc, every_check, every_h))
    a, b = every_h[order], every_check[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    smallest = np.empty_like(every_doc)
    smallest[order] = every_doc[order][new][np.cumsum(new) - 1]
    bucket, rows, at = offered["bucket"][0].as_py(), [], 0
    for block, part, check, doc in zip(offered["block"].to_pylist(), h, checks, docs, strict=True):
        low = smallest[at : at + len(part)]
        at += len(part)
        less = low < doc
        if less.any():
            rows.append((bucket, block, part[less].tobytes(), check[less].tobytes(), low[less].tobytes()))
    return _message(rows)


def _remove(width: int):
    """Removal intervals and kept text of each document of a block."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        bodies, ids = as_bytes(texts["body"]), texts["doc"].to_numpy()
        told = [np.frombuffer(x, np.uint64) for x in answers["parts"].to_pylist()]
        low = [_ids(x, len(p)) for x, p in zip(answers["docs"].to_pylist(), told, strict=True)]
        # Smallest id of each window that occurs in several documents of this block or in others.
        own_h, own_ids = [np.concatenate([*told, np.zeros(0, np.uint64)])], [np.concatenate([*low, np.zeros(0, np.int64)])]
        for first, _, _, h, _, owner, _ in _windows(bodies, width):
            own_h.append(h)
            own_ids.append(ids[first + owner])
        smallest_h, smallest_id, _ = _first_ids(np.concatenate(own_h), np.concatenate(own_ids))
        n_words, removed, kept, spans = [], [], [], []
        for first, last, counts, h, _, owner, start in _windows(bodies, width):
            goes = smallest_id[find(smallest_h, h)[0]] < ids[first + owner] if len(h) else np.zeros(0, bool)
            owner, start = owner[goes], start[goes]
            ends = np.searchsorted(owner, np.arange(last - first), "right")
            begin = 0
            for i, end in enumerate(ends.tolist()):
                places, words = start[begin:end], bodies[first + i].split()
                begin = end
                # A gap of more than a window's width starts a new interval.
                cuts = np.flatnonzero(np.diff(places) > width)
                lows = places[np.concatenate([[0], cuts + 1]).astype(int)] if len(places) else places
                highs = places[np.concatenate([cuts, [-1]]).astype(int)] + width if len(places) else places
                intervals = list(zip(lows.tolist(), highs.tolist(), strict=True))
                out, at = [], 0
                for a, b in intervals:
                    out += words[at:a]
                    at = b
                out += words[at:]
                n_words.append(int(counts[i]))
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
                spans.append([{"start": a, "end": b} for a, b in intervals])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table(
            {"doc": texts["doc"].combine_chunks(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """``doc, n_words, n_removed, removed, kept``, one row for each row of ``docs``.

    ``removed`` are half-open ranges of word numbers, ``kept`` the other words joined by one
    space.
    """
    total = text_bytes(docs, text_col)
    bits = bucket_bits(total)
    texts = blocked(docs, id_col, text_col, total).withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))
    in_block = texts.groupBy("block")
    asked = in_block.applyInArrow(_ask(bits, width), _PARTS)
    candidates = asked.groupBy("bucket").applyInArrow(_shared, _PARTS)
    offered = in_block.cogroup(candidates.groupBy("block")).applyInArrow(_offer(bits, width), _PARTS)
    firsts = offered.groupBy("bucket").applyInArrow(_smallest, _PARTS)
    cleaned = in_block.cogroup(firsts.groupBy("block")).applyInArrow(
        _remove(width),
        "doc bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept string",
    )
    return cleaned.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc")))
