"""Toxicity: words are restored from leetspeak, spacing and repetition, then scored.

Every disguised token is a lattice: a digit or sign may stand for some letters, a separator for nothing, a run
of one letter for one or two of them. Viterbi decoding finds the cheapest path under a trigram
model of characters, which is counted over all texts. Plain words stay as they are.

The score comes from the restored words and their starts. Features that labelled toxic texts have far
more often than others are evidence; their log odds add up on top of the odds of a text without any.
They are learnt from at most ``SAMPLE`` labelled documents, chosen by hash, with copies of a text
counted once; the bound is the only one, all documents are scored in full.

Null and empty texts have no evidence and get the odds of such texts. Rows are scored one by
one. A document labelled several times counts as toxic if any label says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lustra.llm.texts import as_bytes, runs

#: Labelled documents that the evidence is learnt from, at most.
SAMPLE = 20_000
#: Characters that may stand for letters.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
}
SEPARATORS = " .-_*"
#: Costs in nats: a sign read as a letter, a doubled letter kept, a separator dropped.
SIGN, DOUBLE, DROP = 1.0, 1.0, 0.3
#: Starts of words that are features, in letters.
STARTS = (4, 5)
#: Evidence: toxic texts that have it at least, also as a share, least log odds, and the
#: number of words that add up.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, ADDED = 5, 0.012, 4.0, 4
#: Smallest log odds of a text without evidence: one strong feature outweighs them.
LEAST_BASE = -7.0

_SIGNS = re.escape("".join(STANDS_FOR))
_UNIT = rf"[a-z{_SIGNS}]"
_SPACED = re.compile(rf"(?<![^\W_]){_UNIT}(?:[ .\-_*]{_UNIT}){{3,}}(?![^\W_])")
_DISGUISED = re.compile(rf"[a-z][{_SIGNS}*_]+[a-z]|(?<!\S)[{_SIGNS}]+[a-z]{{2}}|([a-z])\1\1")
_WORD = re.compile(r"[^\W\d_]+")
_EDGES = "\"'()[]{}<>,.;:?!#%&*$"

SYMBOLS = 28  # boundary, a-z, all else
_CLASS = np.full(256, 27, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _trigrams(batches):
    """Trigrams of character classes in a task's texts."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        bodies = as_bytes(batch.column("body"))
        for first, last in runs(bodies):
            c = _CLASS[np.frombuffer(b" ".join([b" ", *bodies[first:last], b" "]), np.uint8)]
            codes = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
            counts += np.bincount(codes, minlength=SYMBOLS**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"code": pa.array(seen, pa.int64()), "n": pa.array(counts[seen], pa.int64())})


class CharModel:
    """Costs of a character after two others: trigrams smoothed with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        self._cost = -np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5))
        self._known: dict[str, str] = {}

    def restored(self, token: str) -> str:
        """The cheapest reading of a lower-case token."""
        if token not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[token] = self._decoded(token)
        return self._known[token]

    def _decoded(self, token: str) -> str:
        # A state is the last two classes; it keeps the cheapest way there, as links back.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for readings in _lattice(token):
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, way) in states.items():
                for text, extra in readings:
                    x, y, total, path = a, b, cost + extra, way
                    for ch in text:
                        k = _symbol(ch)
                        total += self._cost[x, y, k]
                        x, y, path = y, k, (path, ch)
                    if (x, y) not in reached or total < reached[x, y][0]:
                        reached[x, y] = (total, path)
            states = reached
        _, way = min(((cost + self._cost[a, b, 0], way) for (a, b), (cost, way) in states.items()), key=lambda s: s[0])
        out = []
        while way:
            way, ch = way
            out.append(ch)
        return "".join(reversed(out))


def _symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


def _lattice(token: str):
    """For each run of one character its readings with their costs."""
    for match in re.finditer(r"(.)\1*", token, re.S):
        ch, n = match[1], len(match[0])
        if ch in SEPARATORS:
            yield [("", DROP)]
        elif ch in STANDS_FOR:
            yield [(c * k, SIGN * n + DOUBLE * (k - 1)) for c in STANDS_FOR[ch] for k in ((1, 2) if n > 1 else (1,))]
        elif n > 2:
            yield [(ch, DOUBLE), (ch * 2, DOUBLE)]
        else:
            yield [(ch * n, 0.0)]


def restore(text: str, model: CharModel) -> str:
    """The lower-case text with disguised tokens decoded."""
    text = text.lower()
    text = _SPACED.sub(lambda m: model.restored(m[0]), text)
    if not _DISGUISED.search(text):
        return text
    tokens = []
    for token in text.split():
        bare = token.rstrip(_EDGES).lstrip("\"'([{<")
        tokens.append(model.restored(bare) if bare and _DISGUISED.search(bare) else token)
    return " ".join(tokens)


def features(text: str, model: CharModel) -> set[str]:
    """Words of the restored text, and starts of longer ones."""
    words = set(_WORD.findall(restore(text, model)))
    return words | {f"{w[:n]}-" for n in STARTS for w in words if len(w) > n}


class Evidence:
    """Log odds of the features that point to toxic texts."""

    def __init__(self, toxic: Counter, clean: Counter, n_toxic: int, n_clean: int):
        self.odds = {}
        for f, t in toxic.items():
            odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1))
            if t >= max(LEAST_TEXTS, LEAST_SHARE * n_toxic) and odds >= LEAST_ODDS:
                self.odds[f] = odds
        self.none = LEAST_BASE

    def set_base(self, toxic_without: int, clean_without: int) -> None:
        """Odds of a text without evidence, from those seen."""
        odds = math.log((toxic_without + 0.5) / (clean_without + 0.5))
        self.none = max(LEAST_BASE, odds)

    def score(self, found: set[str]) -> float:
        # Words with one start count once, by their strongest feature.
        words: dict[str, float] = {}
        for f in found & self.odds.keys():
            start = f[: STARTS[0]]
            words[start] = max(words.get(start, 0.0), self.odds[f])
        best = sorted(words.values(), reverse=True)[:ADDED]
        return 1 / (1 + math.exp(-(self.none + sum(best))))


def count_characters(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character model of all texts; at most 28 x 28 x 28 counts reach the driver."""
    bodies = docs.select(F.col(text_col).cast("string").cast("binary").alias("body"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in bodies.mapInArrow(_trigrams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row["code"]] = row["n"]
    return CharModel(counts)


def learn_evidence(
    docs: DataFrame, labels: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Evidence:
    """Evidence from the labelled documents, at most ``sample`` of them.

    ``labels`` has ``id_col`` and ``toxic``. The ids of the sample are the only broadcast.
    """
    context = docs.sparkSession.sparkContext
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
        .select(F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.col("toxic").cast("int").alias("toxic"))
    )
    shared = context.broadcast(model)

    def count(batches):
        found: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for body, toxic in zip(as_bytes(batch.column("body")), batch.column("toxic").to_pylist(), strict=True):
                found[toxic].update(features(body.decode("utf-8", "replace"), shared.value))
                found[toxic][""] += 1
        rows = [(f, toxic, n) for toxic, counter in found.items() for f, n in counter.items()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = [pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["f", "toxic", "n"])

    is_toxic = F.col("toxic") > 0
    counts = (
        texts.mapInArrow(count, "f string, toxic int, n bigint")
        .groupBy("f")
        .agg(F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(~is_toxic, F.col("n")).otherwise(0)).alias("c"))
        .filter((F.col("t") >= LEAST_TEXTS) | (F.col("f") == ""))
        .collect()
    )
    sizes = next(((r["t"], r["c"]) for r in counts if r["f"] == ""), (0, 0))
    toxic = Counter({r["f"]: r["t"] for r in counts if r["f"]})
    clean = Counter({r["f"]: r["c"] for r in counts if r["f"]})
    evidence = Evidence(toxic, clean, *sizes)
    known = context.broadcast(evidence.odds)

    def without(batches):
        n = Counter()
        for batch in batches:
            for body, is_toxic in zip(as_bytes(batch.column("body")), batch.column("toxic").to_pylist(), strict=True):
                if not known.value.keys() & features(body.decode("utf-8", "replace"), shared.value):
                    n[min(is_toxic, 1)] += 1
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([0, 1], pa.int32()), "n": pa.array([n[0], n[1]], pa.int64())})

    bare = texts.mapInArrow(without, "toxic int, n bigint").groupBy("toxic").agg(F.sum("n").alias("n")).collect()
    left = {r["toxic"]: r["n"] for r in bare}
    evidence.set_base(left.get(1, 0), left.get(0, 0))
    return evidence


def score_toxicity(docs: DataFrame, model: CharModel, evidence: Evidence, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all given columns), ``score`` and ``evidence``, one row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, evidence))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(text_col).cast("string").cast("binary").alias("body"),
        F.lit(0.0).alias("score"),
        F.array().cast("array<string>").alias("evidence"),
    )

    def score(batches):
        chars, known = shared.value
        for batch in batches:
            scores, why = [], []
            for body in as_bytes(batch.column("body")):
                found = features(body.decode("utf-8", "replace"), chars)
                scores.append(known.score(found))
                why.append(sorted(found & known.odds.keys()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("body"), pa.array(scores, pa.float64()), pa.array(why, pa.list_(pa.string()))],
                schema=batch.schema,
            )

    return rows.mapInArrow(score, rows.schema).drop("body")


def held_out(id_col: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether the labels of a document are kept back."""
    rest = F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == remainder, F.lit(True))
