"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

A document is the set of its distinct shingles of five words. Documents with one set form a
class and are represented by the smallest id. Two sets of ``n`` and ``m`` shingles are similar
when they share at least ``t (n + m) / (100 + t)`` of them, for a similarity of ``t`` percent.

* Small sets enumerate their subsets of exactly that size, one group of subsets for each size
  that a partner may have. Sets that agree on a subset are similar, so no pair is compared.
* Large sets, and small ones that may match a large one, are put in order from the rarest
  shingle to the most frequent; similar sets share a shingle in their first parts. These
  inverted lists are scanned. Shingles that occur in a single set are in no list.
* The boundary between small and large is the size with the least total cost: subsets to
  enumerate below it, entries to scan above it, the mean length of a list being measured.

Only components are asked for, so a list of many similar sets is not expanded into pairs: every
set is first compared with one centre of its lists, and only pairs of sets that are still in
different components are enumerated and compared, all of them.

How often a shingle occurs is counted by fragments of its hash; two shingles that share a
fragment get one count, which changes the order the same way for all sets and no result.

Null and empty texts, and texts without words, have an empty set and link with nothing. Rows
with one id are one document with several texts. Rows with a null id take part, and have the
component null if no row with an id is linked to them.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lustra.llm.components import connected
from lustra.llm.texts import (
    WHITE_CHARS,
    as_bytes,
    blocked,
    bucket_bits,
    bucket_slices,
    find,
    fragments,
    mixed,
    runs,
    text_bytes,
    window_hashes,
    word_hashes,
)
from lustra.operators.lookup import GROUP_ROWS, build_lookup
from lustra.session import materialize

#: Words of a shingle, and the least similarity in percent.
WIDTH = 5
PERCENT = 75
#: No boundary beyond this size is looked at; the number of subsets explodes before.
LARGEST_SMALL = 20
#: Cost of scanning an entry of a list, against that of a subset.
SCAN_COST = 4
#: Stands for a null id inside this module.
NO_ID = (1 << 63) - 1
#: One of so many shingle hashes serves to measure the mean length of the lists.
SAMPLED = 1 << 10


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Shingles that similar sets of ``n`` and ``m`` share at least."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    """Sizes of the sets that may be similar to one of ``n``."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Similar sets share one of so many first shingles."""
    return n + percent * -n // 100 + 1


def subset_count(n: int, boundary: int, percent: int = PERCENT) -> int:
    sizes = (m for m in partner_sizes(n, percent) if m <= boundary)
    return sum(comb(n, least_overlap(n, m, percent)) for m in sizes)


def best_boundary(histogram: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """Largest size of a small set, by cost; ``histogram`` has the sets of each size."""

    def cost(x: int) -> float:
        small = sum(c * subset_count(n, x, percent) for n, c in histogram.items() if n <= x)
        scanned = (c * prefix_length(n, percent) for n, c in histogram.items() if 100 * n > percent * x)
        return small + SCAN_COST * list_length * sum(scanned)

    return min(range(LARGEST_SMALL + 1), key=cost)


def _shingle_sets(bodies: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(bodies, lower=True)
    ends = np.cumsum(counts)
    h = window_hashes(words, width)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(h[end - n : end - width + 1]))
        elif n:
            short = np.uint64(n)
            for w in words[end - n : end]:
                short = mixed(np.array([short]) ^ w)[0]
            sets.append(np.array([short]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _digests(width: int):
    """Rows ``block, doc, digest, n, sample`` of a batch of texts."""

    def run(batches):
        for batch in batches:
            bodies = as_bytes(batch.column("body"))
            digest, sizes, sample = [], [], []
            for first, last in runs(bodies):
                for s in _shingle_sets(bodies[first:last], width):
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sizes.append(len(s))
                    # Multiples of SAMPLED after mixing are as random as the hashes themselves.
                    sample.append(_as_long(s[s % np.uint64(SAMPLED) == 0]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block"),
                    batch.column("doc"),
                    pa.array(digest, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sample, pa.list_(pa.int64())),
                ],
                names=["block", "doc", "digest", "n", "sample"],
            )

    return run


def _own_sets(texts: pa.Table, classes: pa.Table, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids and sets of the documents of a block that represent their class, each set once."""
    wanted = set(zip(classes["doc"].to_pylist(), classes["digest"].to_pylist(), strict=True))
    ids = texts["doc"].to_pylist()
    own = {doc for doc, _ in wanted}
    rows = [i for i, doc in enumerate(ids) if doc in own]
    bodies = as_bytes(texts["body"].take(pa.array(rows, pa.int64())))
    docs, sets = [], []
    for i, s in zip(rows, _shingle_sets(bodies, width), strict=True):
        key = (ids[i], hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        if key in wanted:
            wanted.discard(key)
            docs.append(ids[i])
            sets.append(s)
    return docs, sets


def _block_of(*tables: pa.Table) -> int:
    return next(t["block"][0].as_py() for t in tables if t.num_rows)


def _ask(bits: int, width: int):
    """Fragments of a block's shingles and in how many of its sets each occurs, by bucket."""

    def run(texts: pa.Table, classes: pa.Table) -> pa.Table:
        block = _block_of(texts, classes)
        _, sets = _own_sets(texts, classes, width)
        keys, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        rows = [(b, block, fragments(keys[s], bits).tobytes(), counts[s].tobytes()) for b, s in bucket_slices(keys, bits)]
        return pa.table(
            {"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "parts": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())}
        )

    return run


def _count(asked: pa.Table) -> pa.Table:
    """For each block that asked: its fragments that occur in several sets, and in how many."""
    parts = [np.frombuffer(x, np.uint32) for x in asked["parts"].to_pylist()]
    counts = [np.frombuffer(x, np.uint8) for x in asked["counts"].to_pylist()]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts)).astype(np.uint32)
    frequent = total[place]
    out, at = [], 0
    for block, part in zip(asked["block"].to_pylist(), parts, strict=True):
        n = frequent[at : at + len(part)]
        at += len(part)
        shared = n > 1
        if shared.any():
            out.append((block, part[shared].tobytes(), n[shared].tobytes()))
    bucket = asked["bucket"][0].as_py()
    return pa.table(
        {"block": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "parts": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary())}
    )


_ENTRY = "kind int, key bigint, doc bigint, n int, tail int, side int, shared array<bigint>"
LIST, SUBSET, SET = 0, 1, 2


def _entries(bits: int, width: int, boundary: int, percent: int):
    """Entries of inverted lists, subsets of small sets, and the shared shingles of a set."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        is_class = pc.is_valid(replies["digest"])
        classes, answers = replies.filter(is_class), replies.filter(pc.invert(is_class))
        docs, sets = _own_sets(texts, classes, width)
        known, often = [], []
        for bucket, part, count in zip(answers["bucket"].to_pylist(), answers["parts"].to_pylist(), answers["counts"].to_pylist(), strict=True):
            known.append(np.frombuffer(part, np.uint32).astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)))
            often.append(np.frombuffer(count, np.uint32))
        known = np.concatenate([*known, np.zeros(0, np.uint64)])
        often = np.concatenate([*often, np.zeros(0, np.uint32)])
        order = np.argsort(known)
        known, often = known[order], often[order]
        parts = []
        for doc, s in zip(docs, sets, strict=True):
            n = len(s)
            if n <= boundary:
                keys, sides = _subset_keys(s, boundary, percent)
                parts.append((SUBSET, doc, n, keys, np.zeros(len(keys), np.int32), sides, None))
            if 100 * n > percent * boundary:
                top = (s >> np.uint64(64 - bits)) << np.uint64(32) if bits else np.uint64(0)
                at, there = find(known, top | fragments(s, bits))
                df = np.where(there, often[at], 1) if len(known) else np.ones(n, np.uint32)
                first = np.lexsort((s, df))[: prefix_length(n, percent)]
                tails = n - np.flatnonzero(df[first] > 1).astype(np.int32)
                if len(tails):
                    keys = _as_long(s[first[n - tails]])
                    parts.append((LIST, doc, n, keys, tails, np.zeros(len(keys), np.int32), None))
                    nothing = np.zeros(1, np.int32)
                    parts.append((SET, doc, n, nothing.astype(np.int64), nothing, nothing, _as_long(s[df > 1])))
        return _entry_table(parts)

    return run


def _entry_table(parts: list[tuple]) -> pa.Table:
    lengths = [len(p[3]) for p in parts]
    spread = lambda i, kind: np.repeat(np.array([p[i] for p in parts], kind), lengths)
    joined = lambda i, kind: np.concatenate([*(p[i] for p in parts), np.zeros(0, kind)]).astype(kind)
    # Entries without a set have an empty one.
    shared = [p[6] if p[6] is not None else np.zeros(0, np.int64) for p in parts]
    ends = np.cumsum(np.repeat([len(x) for x in shared], lengths)) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    values = np.concatenate([*shared, np.zeros(0, np.int64)])
    return pa.table(
        {
            "kind": spread(0, np.int32),
            "key": joined(3, np.int64),
            "doc": spread(1, np.int64),
            "n": spread(2, np.int32),
            "tail": joined(4, np.int32),
            "side": joined(5, np.int32),
            "shared": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64())),
        }
    )


def _subset_keys(s: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each subset that a partner of some size must share; the sides are
    1 for the smaller set, 2 for the larger and 4 for sets of one size."""
    n = len(s)
    values = mixed(s)
    keys, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for m in partner_sizes(n, percent):
        if m <= boundary:
            salt = np.uint64(min(n, m) * 1000 + max(n, m))
            chosen = np.array(list(combinations(range(n), least_overlap(n, m, percent))))
            keys.append(_as_long(mixed(values[chosen].sum(axis=1, dtype=np.uint64) + salt)))
            sides.append(np.full(len(chosen), 1 if n < m else 2 if n > m else 4, np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def _may_match(n: Column, m: Column, tail_n: Column, tail_m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar, if the first shingle they share has so many
    shingles, itself included, from it to the end of either set."""
    need = (100 + percent) * F.least(tail_n, tail_m) >= percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & need


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar."""
    us = sets.select(F.col("doc").alias("u"), F.col("n").alias("nu"), F.col("shared").alias("su"))
    vs = sets.select(F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("shared").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(vs, "v").join(us, "u").filter((100 + percent) * common >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")
    )


def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc, n_shingles, component``: one row for each row of ``docs``."""
    total = text_bytes(docs, text_col)
    bits = bucket_bits(total)
    texts = blocked(docs, id_col, text_col, total).withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))
    members = materialize(
        texts.mapInArrow(_digests(width), "block int, doc bigint, digest binary, n bigint, sample array<bigint>"),
        "sets",
    )
    classes = materialize(
        members.filter("n > 0").groupBy("digest").agg(F.min(F.struct("doc", "block")).alias("first"), F.first("n").alias("n"))
        .select("digest", "first.doc", "first.block", "n"),
        "classes",
    )
    boundary = _boundary(members, classes, percent)

    by_block = classes.select("block", "doc", "digest")
    asked = texts.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(
        _ask(bits, width), "bucket int, block int, parts binary, counts binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(_count, "block int, bucket int, parts binary, counts binary")
    told = answers.select(
        "block", F.lit(None).cast("bigint").alias("doc"), F.lit(None).cast("binary").alias("digest"), "bucket", "parts", "counts"
    ).unionByName(by_block, allowMissingColumns=True)
    entries = materialize(
        texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_entries(bits, width, boundary, percent), _ENTRY),
        "entries",
    )
    lists = entries.filter(F.col("kind") == LIST).select("key", "doc", "n", "tail")
    sets = entries.filter(F.col("kind") == SET).select("doc", "n", "shared")
    links = _subset_links(entries.filter(F.col("kind") == SUBSET))

    # Every set against one centre of its lists.
    centres = lists.groupBy("key").agg(F.min(F.struct("doc", "n", "tail")).alias("c"), F.count(F.lit(1)).alias("m"))
    near = (
        lists.join(centres.filter("m > 1"), "key")
        .filter((F.col("doc") != F.col("c.doc")) & _may_match(F.col("n"), F.col("c.n"), F.col("tail"), F.col("c.tail"), percent))
        .groupBy(F.col("doc").alias("u"))
        .agg(F.min("c.doc").alias("v"))
    )
    links = materialize(links.unionByName(_similar(near, sets, percent)), "links")
    found = connected(links)

    # All pairs that are still apart.
    pairs = _apart(lists, found, percent)
    more = materialize(_similar(pairs, sets, percent), "links")
    if not more.isEmpty():
        found = connected(links.unionByName(more))
    return _labelled(members, classes, found)


def _boundary(members: DataFrame, classes: DataFrame, percent: int) -> int:
    sizes = classes.groupBy(F.least("n", F.lit(4 * LARGEST_SMALL)).alias("n")).count().collect()
    seen = members.select(F.explode("sample").alias("x")).groupBy("x").count()
    lengths = seen.agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("different")).first()
    mean = lengths["all"] / lengths["different"] if lengths["different"] else 1.0
    return best_boundary({r["n"]: r["count"] for r in sizes}, mean, percent)


def _subset_links(subsets: DataFrame) -> DataFrame:
    """Sets that share a subset: all of one size, or those of two sizes if both are there."""
    agreed = subsets.groupBy("key").agg(
        F.min("doc").alias("first"), F.max("doc").alias("high"), F.bit_or("side").alias("sides")
    )
    agreed = agreed.filter((F.col("first") < F.col("high")) & F.col("sides").isin(3, 4)).select("key", "first")
    return subsets.join(agreed, "key").filter(F.col("doc") != F.col("first")).select(F.col("first").alias("u"), F.col("doc").alias("v")).distinct()


def _apart(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that may be similar and are in different components."""
    labels = found.select(F.col("node").alias("doc"), "component")
    placed = lists.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = materialize(placed, "lists")
    several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    # Documents of one component that the bounds cannot tell apart meet others as one.
    kind = ["key", "component", "n", "tail"]
    parts = materialize(placed.join(several.select("key"), "key", "left_semi").select(*kind).distinct(), "parts")
    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "key"))
    meet = side(parts, "u").join(side(parts, "v"), "key").filter(
        (F.col("component_u") < F.col("component_v"))
        & _may_match(F.col("n_u"), F.col("n_v"), F.col("tail_u"), F.col("tail_v"), percent)
    )
    for x in ("u", "v"):
        meet = meet.join(side(placed, x).withColumnRenamed(f"doc_{x}", x), ["key", *(f"{c}_{x}" for c in kind[1:])])
    return meet.select("u", "v").distinct()


def _labelled(members: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The component of each row, by its class."""
    firsts = (
        classes.select("digest", F.col("doc").alias("node"))
        .join(found, "node", "left")
        .select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    )
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    known = lambda c: F.when(c != NO_ID, c)
    return members.join(firsts, (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left").select(
        known(F.col("doc")).alias("doc"), F.col("n").alias("n_shingles"), known(own).alias("component")
    )


def _marked(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, text, mark``: a number for each id and text.

    It is the id itself where that is a whole number and has one text only, as small ids make good centres: the first version of a text is
    closer to its copies than they are to each other. Other rows take a 64-bit hash of id and text, beyond usual ids.
    """
    mark = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = texts.select(F.struct(*texts.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))
    if dict(rows.dtypes)["id"] not in ("tinyint", "smallint", "int", "bigint"):
        return rows
    counted = rows.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("mark").alias("a"), F.max("mark").alias("b"), F.count(F.lit(1)).alias(GROUP_ROWS)
    )
    several = materialize(counted.filter("a < b").select("id", F.lit(True).alias("several"), GROUP_ROWS), "repeated-ids")
    if several.isEmpty():
        return rows.withColumn("mark", F.coalesce(F.col("id").cast("long"), "mark"))
    told = build_lookup(several, "id", written=True).attach(rows)
    own = F.when(F.col("id").isNotNull() & F.col("several").isNull(), F.col("id").cast("long"))
    return told.withColumn("mark", F.coalesce(own, "mark")).drop("several")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: of each group of linked texts one row, that with the smallest id.

    Rows that share an id without being linked all stay, and a null id is the last of its group; such rows are told
    apart by a 64-bit hash of id and text. Of rows equal in id and text the one with the smallest hash of all columns stays. Texts without
    words are linked with nothing, so all their rows stay.
    """
    has_words = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(WHITE_CHARS)) != ""
    rows = _marked(docs.filter(has_words), id_col, text_col)
    groups = materialize(
        link_documents(rows.select("mark", "text"), "mark", "text").select(F.col("doc").alias("mark"), "component"), "groups"
    )
    ids = rows.select("mark", "id").distinct()
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    stay = groups.distinct().join(ids, "mark").groupBy("component").agg(F.min(order).alias("first")).select("first.mark")
    one = Window.partitionBy("mark").orderBy("all")
    hashable = [F.col(f"row.`{name}`") for name, kind in docs.dtypes if "map<" not in kind]
    # Copies collapse before the shuffle, in which the rows then meet those that stay.
    first = rows.select("row", "mark", F.xxhash64(*hashable).alias("all")).withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    return first.join(stay.hint("shuffle_hash"), "mark").select("row.*").unionByName(docs.filter(~has_words))
