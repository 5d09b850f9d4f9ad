"""Language-model scores from a probabilistic suffix tree over the bytes of normalised texts.

A text is its lower-case words joined by one space, with a line feed before and after; no
word holds white space, so words and byte string stand for each other. The line feed in front
is context only, the one at the end is predicted like any byte.

Training counts all contexts of up to ``DEPTH`` bytes in Spark. A context that makes up at least
the share ``RARE`` of all positions may become a state, so there are at most ``DEPTH / RARE`` states
whatever the size of the corpus: that bounds what is collected and broadcast. It is kept if
its next-byte distribution diverges from that of its longest proper suffix by ``DIVERGENCE`` nats, or if
a longer context that ends in it is kept. The distribution of a state is smoothed with its
suffix's, down to add-one counts of single bytes. A byte is scored in the longest suffix of
what precedes it that is a state.

Next to it stands a base score: add-one frequencies of whole words, with one end per text.

Null and empty texts consist of the end alone. Rows are scored one by one; rows with a null id
have a null remainder, count as held out and are not learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.llm.texts import (
    as_bytes,
    blocked,
    bucket_bits,
    bucket_slices,
    find,
    runs,
    text_bytes,
    word_hashes,
)
from lustra.session import materialize

DEPTH = 6
RARE = 5e-6
DIVERGENCE = 0.01
#: Weight of the suffix's distribution, in observations.
PRIOR = 32.0
#: Tasks that add up the contexts, by their last two bytes.
CONTEXT_BUCKETS = 64
#: Positions whose contexts are sorted at once.
POSITIONS = 1 << 21


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether a document is kept back from training."""
    rest = F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == remainder, F.lit(True))


def _streams(bodies: list[bytes]) -> list[bytes]:
    return [b"\n" + b" ".join(t.lower().split()) + b"\n" for t in bodies]


def _positions(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each predicted byte, and how many each stream has.

    A key has the bytes before the predicted one, the last of them first, and then that byte;
    0 stands before a text.
    """
    pad = b"\0" * depth
    data = np.frombuffer(b"".join([pad + s for s in streams]), np.uint8)
    lengths = np.array([len(s) for s in streams])
    keys = np.zeros(len(data), np.uint64)
    for k in range(depth):
        keys[depth:] |= data[depth - 1 - k : len(data) - 1 - k].astype(np.uint64) << np.uint64(8 * (depth - k))
    keys |= data
    ends = np.cumsum(lengths + depth)
    # Neither the padding nor the line feed in front is predicted.
    wanted = np.ones(len(data), bool)
    for k in range(depth + 1):
        wanted[ends - lengths - depth + k] = False
    return keys[wanted], lengths - 1


def _counted(depth: int):
    """Contexts and next bytes of a task's texts with their counts, by bucket."""

    def run(batches):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            streams = _streams(as_bytes(batch.column("body")))
            for first, last in runs(streams, POSITIONS):
                found.append(np.unique(_positions(streams[first:last], depth)[0], return_counts=True))
                if len(found) > 6:
                    found = [_added(found)]
        if not found:
            return
        keys, counts = _added(found)
        bucket = _context_bucket(keys, depth)
        order = np.argsort(bucket, kind="stable")
        limits = np.searchsorted(bucket[order], np.arange(CONTEXT_BUCKETS + 1))
        for b in range(CONTEXT_BUCKETS):
            own = order[limits[b] : limits[b + 1]]
            if len(own):
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([b], pa.int32()), "keys": pa.array([keys[own].tobytes()], pa.binary()), "counts": pa.array([counts[own].astype(np.uint32).tobytes()], pa.binary())}
                )

    return run


def _context_bucket(keys: np.ndarray, depth: int) -> np.ndarray:
    last_two = keys >> np.uint64(8 * (depth - 1))
    return ((last_two * np.uint64(40503)) >> np.uint64(5)) % np.uint64(CONTEXT_BUCKETS)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in found])
    counts = np.concatenate([c for _, c in found]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _frequent(depth: int, least: int):
    """Per context length: next bytes, with counts, of the contexts that are frequent enough.

    Contexts of one byte are spread over buckets and come with all their counts.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = [
            (np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32))
            for k, c in zip(group["keys"].to_pylist(), group["counts"].to_pylist(), strict=True)
        ]
        keys, counts = _added(parts)
        rows = []
        for k in range(1, depth + 1):
            context = keys >> np.uint64(8 * (depth - k + 1))
            entries, total = _added([((context << np.uint64(8)) | (keys & np.uint64(255)), counts)])
            if k > 1:
                owner = entries >> np.uint64(8)
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums = np.repeat(np.add.reduceat(total, starts), np.diff([*starts, len(owner)]))
                entries, total = entries[sums >= least], total[sums >= least]
            rows.append((k, entries.tobytes(), total.astype(np.int64).tobytes()))
        return pa.table(
            {"length": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())}
        )

    return run


@dataclass
class SuffixTree:
    """States by length: sorted contexts, log10 weight of the suffix, sorted entries and log10 p."""

    root: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.levels)

    @property
    def states(self) -> int:
        return 1 + sum(len(level[0]) for level in self.levels)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after the bytes before it."""
        symbol = keys & np.uint64(255)
        p = self.root[symbol.astype(np.int64)]
        # Suffixes of states are states, so only keys that met one so far go on.
        active = np.arange(len(keys))
        for k, (contexts, rest, entries, logs) in enumerate(self.levels, 1):
            context = keys[active] >> np.uint64(8 * (self.depth - k + 1))
            at, is_state = find(contexts, context)
            active, context, at = active[is_state], context[is_state], at[is_state]
            if not len(active):
                break
            place, seen = find(entries, (context << np.uint64(8)) | symbol[active])
            p[active] = np.where(seen, logs[place], rest[at] + p[active])
        return p


def build_tree(
    levels: list[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE, prior: float = PRIOR
) -> SuffixTree:
    """Keep the contexts that diverge from their suffix, and smooth.

    ``levels`` has, for each context length from 1, sorted entries (context, then next byte)
    and their counts.
    """
    symbols = np.bincount((levels[0][0] & np.uint64(255)).astype(np.int64), levels[0][1], 256)
    root = np.log10((symbols + 1) / (symbols.sum() + 257))
    tree, keep = SuffixTree(root, []), []
    everything = []
    for k, (entries, counts) in enumerate(levels, 1):
        owner = entries >> np.uint64(8)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        contexts = owner[starts]
        sizes = np.diff([*starts, len(owner)])
        totals = np.add.reduceat(counts, starts) if len(starts) else counts
        n = np.repeat(totals, sizes)
        # What the suffix, smoothed with its own, says of the same bytes.
        symbol = entries & np.uint64(255)
        suffix = ((owner >> np.uint64(8)) << np.uint64(8)) | symbol
        if k == 1:
            below = root[symbol.astype(np.int64)]
        else:
            up_contexts, up_rest, up_entries, up_logs = everything[-1]
            place, seen = find(up_entries, suffix)
            at, _ = find(up_contexts, owner >> np.uint64(8))
            below = np.where(seen, up_logs[place], up_rest[at]) if len(up_logs) else np.zeros(len(owner))
        logs = np.log10((counts + prior * 10.0**below) / (n + prior))
        gain = counts / n * (np.log(counts / n) - below * np.log(10))
        diverges = np.add.reduceat(gain, starts) >= divergence if len(starts) else np.zeros(0, bool)
        everything.append((contexts, np.log10(prior / (totals + prior)), entries, logs))
        keep.append(diverges)
    for k in range(len(levels) - 1, 0, -1):
        needed = np.unique(everything[k][0][keep[k]] >> np.uint64(8))
        keep[k - 1] = keep[k - 1] | np.isin(everything[k - 1][0], needed)
    for (contexts, rest, entries, logs), kept in zip(everything, keep, strict=True):
        of_kept = np.isin(entries >> np.uint64(8), contexts[kept])
        tree.levels.append((contexts[kept], rest[kept], entries[of_kept], logs[of_kept]))
    return tree


def fit_tree(
    texts: DataFrame, total: int, depth: int = DEPTH, rare: float = RARE, divergence: float = DIVERGENCE, prior: float = PRIOR
) -> SuffixTree:
    """Learn from all rows of ``texts`` (a column ``body``), which hold about ``total`` bytes."""
    least = max(2, int(rare * total))
    counted = texts.mapInArrow(_counted(depth), "bucket int, keys binary, counts binary")
    frequent = counted.groupBy("bucket").applyInArrow(
        _frequent(depth, least), "length int, keys binary, counts binary"
    )
    parts: dict[int, list] = {k: [] for k in range(1, depth + 1)}
    for row in frequent.toLocalIterator():
        parts[row["length"]].append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    levels = [_added(p) if sum(len(x[0]) for x in p) else none for p in parts.values()]
    return build_tree(levels, divergence, prior)


_WORDS = "bucket int, block int, keys binary, counts binary"


def _ask_words(bits: int):
    """Distinct words of a block with their count in its training texts, by bucket."""

    def run(texts: pa.Table) -> pa.Table:
        words, counts = word_hashes(as_bytes(texts["body"]), lower=True)
        learnt = np.repeat(~texts["held_out"].to_numpy().astype(bool), counts)
        keys, place = np.unique(words, return_inverse=True)
        own = np.bincount(place, learnt, len(keys)).astype(np.uint32)
        block = texts["block"][0].as_py()
        rows = [(b, block, keys[s].tobytes(), own[s].tobytes()) for b, s in bucket_slices(keys, bits)]
        return _word_table(rows)

    return run


def _word_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "keys", "counts"])


def _answer_words(asked: pa.Table) -> pa.Table:
    """Corpus counts in the order of each block's words; the first block also gets the totals."""
    keys = [np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in asked["counts"].to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    bucket, rows, at = asked["bucket"][0].as_py(), [], 0
    for i, (block, own) in enumerate(zip(asked["block"].to_pylist(), keys, strict=True)):
        sums = np.array([(total > 0).sum(), total.sum()], np.int64).tobytes() if not i else b""
        told = total[place[at : at + len(own)]]
        narrow = told.astype(np.uint32) if not len(told) or told.max() < 1 << 32 else told
        rows.append((bucket, block, sums, narrow.tobytes()))
        at += len(own)
    return _word_table(rows)


_SCORES = "kind int, doc bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double"


def _score(bits: int, tree):
    """Scores of a block's texts (kind 0), and the totals it was told (kind 1)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model = tree.value
        bodies = as_bytes(texts["body"])
        words, sizes = word_hashes(bodies, lower=True)
        keys, place = np.unique(words, return_inverse=True)
        told = dict(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        corpus = np.zeros(len(keys), np.int64)
        for b, s in bucket_slices(keys, bits):
            n = s.stop - s.start
            corpus[s] = np.frombuffer(told[b], np.uint32 if len(told[b]) == 4 * n else np.int64)
        owner = np.repeat(np.arange(len(bodies)), sizes)
        logs = np.bincount(owner, np.log10(corpus + 1.0)[place], len(bodies))
        known = np.bincount(owner, (corpus > 0)[place], len(bodies)).astype(np.int64)
        scores = []
        streams = _streams(bodies)
        for first, last in runs(streams, POSITIONS):
            positions, lengths = _positions(streams[first:last], model.depth)
            grams, at = np.unique(positions, return_inverse=True)
            p = model.log10(grams)[at]
            scores.append(np.add.reduceat(p, np.cumsum(lengths) - lengths))
        sums = [np.frombuffer(x, np.int64) for x in answers["keys"].to_pylist() if x]
        n, m = len(bodies), len(sums)
        none = np.zeros(m)
        return pa.table(
            {
                "kind": pa.array([0] * n + [1] * m, pa.int32()),
                "doc": pa.concat_arrays([texts["doc"].combine_chunks(), pa.nulls(m, pa.int64())]),
                "held_out": pa.array([*texts["held_out"].to_pylist(), *[True] * m], pa.bool_()),
                "n_tokens": np.concatenate([sizes + 1, [x[1] for x in sums]]).astype(np.int64),
                "n_known": np.concatenate([known, [x[0] for x in sums]]).astype(np.int64),
                "log_counts": np.concatenate([logs, none]),
                "score": np.concatenate([*scores, none]),
            }
        )

    return run


def score_texts(
    docs: DataFrame, held_back: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """``doc, held_out, n_tokens, n_known, train_tokens, base_score, score, states`` of each row.

    ``held_back`` tells the rows that are scored only; the others are learnt from and scored.
    """
    total = text_bytes(docs, text_col)
    bits = bucket_bits(total, 24)
    texts = blocked(docs, id_col, text_col, total, held_back.alias("held_out"))
    tree = fit_tree(texts.filter(~F.col("held_out")).select("body"), total, depth)
    model = docs.sparkSession.sparkContext.broadcast(tree)
    in_block = texts.groupBy("block")
    answers = in_block.applyInArrow(_ask_words(bits), _WORDS).groupBy("bucket").applyInArrow(_answer_words, _WORDS)
    rows = materialize(in_block.cogroup(answers.groupBy("block")).applyInArrow(_score(bits, model), _SCORES), "scores")

    is_text = F.col("kind") == 0
    totals = rows.agg(
        F.sum(F.when(~is_text, F.col("n_tokens"))).alias("words"),
        F.sum(F.when(~is_text, F.col("n_known"))).alias("distinct"),
        F.sum((is_text & ~F.col("held_out")).cast("long")).alias("ends"),
    ).first()
    ends = totals["ends"] or 0
    n, v = (totals["words"] or 0) + ends, (totals["distinct"] or 0) + (ends > 0)
    log10 = lambda x: float(np.log10(x))
    return rows.filter(is_text).select(
        "doc",
        "held_out",
        "n_tokens",
        (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + log10(ends + 1) - F.col("n_tokens") * log10(n + v + 1)).alias("base_score"),
        "score",
        F.lit(tree.states).alias("states"),
    )
