"""Quality rules: a hashed n-gram log-likelihood ratio, and counts that any document must pass.

The words and word pairs of the trusted documents and of the whole corpus are hashed into a
fixed number of bins, which gives two multinomials. A document's score is the mean over its
n-grams of the logarithm of trusted over raw probability. Everything is DataFrame expressions:
higher-order functions inside a row, one hash aggregate over the bins, and counts of fixed size.

``judge_against`` is what the query and the pipeline use. Its ratio compares the trusted count of a bin
with the count to be expected from the raw one, both with ``PRIOR`` observations added, so that
a bin without evidence says nothing, and it leaves out the document's own n-grams. A document is kept
if its counts are in order and its score is not far below the middle score of its group (its language).
How far is told by the spread of all scores, so the rule is the same at every size of the corpus.

``fit_ratio`` and ``judge_quality`` are the plain form: weights of fixed smoothing, one fixed threshold. Its
scores move with the size of the corpus.

Null and empty texts have no words and fail. Rows are judged one by one, so repeated ids and
rows stay. A trusted id that occurs several times counts once. Without trusted documents all
scores are 0 and the counts alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lustra.llm.texts import WHITE_CHARS
from lustra.session import materialize

#: Bins of the hashed n-grams: the size of the model, whatever the corpus.
BINS = 1 << 15
#: Pseudo-count of a bin, in shares of the mean count.
SMOOTHING = 0.01
#: Smallest mean log ratio of a kept document.
THRESHOLD = -0.055
#: Observations that say a bin is as frequent in trusted texts as in all.
PRIOR = 10.0
#: A kept document's score is at most so many spreads of all scores below the middle of its group.
SPREADS = 8.0
#: A group's middle is mixed with that of all documents, which counts as so many. Smaller groups have no own.
GROUP_PRIOR = 3
#: Middles and spread are told in steps of one in so many.
STEPS = 100_000
#: Terms of a score are summed as multiples of one in so many.
FRACTION = float(1 << 30)
#: Spread at least, for tables whose texts are nearly all alike.
LEAST_SPREAD = 0.005
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Counts of a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _followers(array: str, n: str, by: int) -> tuple[Column, Column]:
    """The array without its last ``by`` items, and without its first ``by``."""
    rest = F.greatest(F.col(n) - by, F.lit(0))
    return F.slice(array, F.lit(1), rest), F.slice(array, F.lit(1 + by), rest)


def with_hashes(df: DataFrame) -> DataFrame:
    """Add to ``words`` their number ``n``, their hashes ``h`` and those of neighbours, ``pairs``.

    Each is a column that later ones use several times, so that no lambda computes it again.
    """
    df = df.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("pairs", F.zip_with(*_followers("h", "n", 1), lambda a, b: F.xxhash64(a, b)))


def _listed(values: list[str]) -> Column:
    """An array of doubles that does not make the plan larger than its text."""
    return F.split(F.lit(",".join(values)), ",").cast("array<double>")


@dataclass(frozen=True)
class RatioModel:
    """Log ratio of each bin."""

    weights: tuple[float, ...]

    def score(self) -> Column:
        """Mean log ratio of the n-grams in columns ``h`` and ``pairs``; 0 without words."""
        table = _listed([f"{w:.5f}" for w in self.weights])
        bins = len(self.weights)
        add = lambda acc, x: acc + F.get(table, F.pmod(x, F.lit(bins)).cast("int"))
        total = F.aggregate(F.concat("h", "pairs"), F.lit(0.0), add)
        return F.when(F.col("n") > 0, total / (2 * F.col("n") - 1)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class CountedRatio:
    """Counts of each bin in all documents and in the trusted ones."""

    raw: tuple[int, ...]
    target: tuple[int, ...]

    def scores(self, texts: DataFrame, prior: float) -> DataFrame:
        """Mean log ratio of each text's n-grams to the other texts: ``bins`` in order and ``ends`` are replaced.

        ``trusted`` is the score of a text whose n-grams are part of the trusted counts, and ``other`` that
        of one whose n-grams are not. Both are part of the raw counts. All other columns are carried
        along with each run of a bin, so there should be no text among them. The terms are summed as whole multiples of
        1 / ``FRACTION``, so their order does not matter.
        """
        carried = [c for c in texts.columns if c not in ("bins", "ends")]
        if not sum(self.target):
            return texts.select(*carried, F.lit(0.0).alias("trusted"), F.lit(0.0).alias("other"))
        raw, target = (_listed([str(c) for c in counts]) for counts in (self.raw, self.target))
        none, size, total = F.lit(0.0), 2.0 * F.col("n") - 1.0, float(sum(self.target))
        all_others = F.greatest(float(sum(self.raw)) - size, F.lit(1.0))
        place = F.get("bins", F.col("end"))
        length = F.col("end") - F.coalesce(F.get("ends", F.col("nth") - 1), F.lit(-1))
        runs = (
            texts.withColumn("number", F.monotonically_increasing_id())
            .select("*", F.posexplode_outer("ends").alias("nth", "end"))
            .select("number", *carried, length.cast("double").alias("times"), F.get(raw, place).alias("raw"), F.get(target, place).alias("target"))
        )
        others = F.greatest(F.col("raw") - F.col("times"), none)

        def mean(seen: Column, trusted: Column) -> Column:
            term = F.col("times") * F.log((seen + prior) / (others * (trusted / all_others) + prior))
            return F.coalesce(F.sum(F.floor(term * FRACTION + 0.5)) / (FRACTION * size), none)

        own = mean(F.greatest(F.col("target") - F.col("times"), none), F.greatest(total - size, none))
        other = mean(F.col("target"), F.lit(total))
        return runs.groupBy("number", *carried).agg(own.alias("trusted"), other.alias("other")).drop("number")


def fit_ratio(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bins: int = BINS,
    smoothing: float = SMOOTHING,
) -> RatioModel:
    """Weights of the plain form, from the counts of the bins."""
    counted = count_bins(docs, trusted, id_col, text_col, bins)
    if not sum(counted.target):
        return RatioModel((0.0,) * bins)

    def logs(values: tuple[int, ...]) -> list[float]:
        total, extra = sum(values), smoothing * sum(values) / bins
        return [math.log((v + extra) / (total * (1 + smoothing))) for v in values]

    return RatioModel(tuple(t - r for t, r in zip(logs(counted.target), logs(counted.raw), strict=True)))


def count_bins(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS
) -> CountedRatio:
    """Count the bins over all of ``docs`` and over those whose id is in ``trusted``.

    Only the counts, two per bin, reach the driver. The trusted ids grow with the corpus, so they
    meet the texts by a shuffle at every size and are never broadcast.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = trusted.select(F.col(id_col).alias("id")).distinct()
    marked = texts.join(ids.withColumn("is_trusted", F.lit(1)).hint("merge"), "id", "left").select(
        words_of(F.col("text")).alias("words"), F.coalesce("is_trusted", F.lit(0)).alias("is_trusted")
    )
    counts = (
        with_hashes(marked)
        .select("is_trusted", F.explode(F.concat("h", "pairs")).alias("gram"))
        .groupBy(F.pmod("gram", F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("is_trusted").alias("target"))
        .collect()
    )
    raw, target = [0] * bins, [0] * bins
    for row in counts:
        raw[row["bin"]], target[row["bin"]] = row["raw"], row["target"]
    return CountedRatio(tuple(raw), tuple(target))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in 3-word windows that occur more than once in the text."""
    longs, placed = F.array().cast("array<bigint>"), "array<struct<g:bigint,i:int>>"
    # Two neighbouring pairs are three words.
    fewer = F.greatest(F.col("n") - 2, F.lit(0))
    grams = F.zip_with(F.slice("pairs", F.lit(1), fewer), F.slice("pairs", F.lit(2), fewer), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("grams", F.when(F.col("n") >= 3, grams).otherwise(longs))
    in_order = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("placed", F.when(repeats, in_order).otherwise(F.array().cast(placed)))
    df = df.withColumn("m", F.size("placed"))
    same = F.zip_with(
        *_followers("placed", "m", 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))
    )
    starts = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    covered = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long"))


def with_runs(df: DataFrame, bins: int) -> DataFrame:
    """Add ``bins``, those of the n-grams in order, and ``ends``, the last place of each bin.

    No item of the arrays can be null, so Spark sorts them as plain integers.
    """
    of_gram = lambda x: F.coalesce(F.pmod(x, F.lit(bins)).cast("int"), F.lit(0))
    df = df.withColumn("bins", F.sort_array(F.transform(F.concat("h", "pairs"), of_gram)))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.size("bins") - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("ends", F.filter(places, lambda i: ~F.get("bins", i).eqNullSafe(F.get("bins", i + 1))))


def _measured(
    docs: DataFrame, text_col: str, columns: Sequence[str] = ("*",), prepared: Callable[[DataFrame], DataFrame] | None = None, **scores: Column
) -> DataFrame:
    """``row`` (a struct of the named columns), the counts of its text, and the scores.

    ``prepared`` adds the columns that the scores use.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*columns).alias("row"), text.alias("text"), words_of(F.col(text_col)).alias("words"))
    df = _with_repeats(with_hashes(df))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines)
    if prepared:
        df = prepared(df)
    return df.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        *(score.alias(name) for name, score in scores.items()),
    )


def _base_failed(min_words: int, max_repeated_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))


def judge_quality(
    docs: DataFrame,
    model: RatioModel,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """``row`` (a struct of all given columns) and the verdict columns, one row for each row."""
    return (
        _measured(docs, text_col, log_ratio=model.score())
        .withColumn("base_failed", _base_failed(min_words, max_repeated_percent))
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
    )


def middles(scores: DataFrame, group: Column, value: Column) -> DataFrame:
    """``group, m, n``: the middle value of each group, the lower of two, and its rows.

    Values are counted in steps of 1 / ``STEPS`` with map-side combine; the window runs over the steps, of which a group has
    as many as the range of a log ratio allows, whatever its rows. The order of the rows does not matter.
    """
    steps = scores.groupBy(group.alias("group"), F.floor(value * STEPS + 0.5).alias("step")).agg(F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy("group")
    placed = steps.withColumns({"upto": F.sum("here").over(whole.orderBy("step")), "n": F.sum("here").over(whole)})
    return placed.filter(2 * F.col("upto") >= F.col("n")).groupBy("group", "n").agg((F.min("step") / STEPS).alias("m"))


def judge_against(
    docs: DataFrame,
    trusted: DataFrame,
    model: CountedRatio,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_col: str | None = None,
    columns: Sequence[str | Column] = ("*",),
    prior: float = PRIOR,
    spreads: float = SPREADS,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """``row`` (a struct of the named columns) and the verdict columns, one row for each row of ``docs``.

    ``model`` counts the bins of these documents and of those in ``trusted``. The ids of the latter meet the
    scored rows by a shuffle, and the named columns are carried along with each n-gram, so there should be no text
    among them. Middles and spread are those of all documents of ``min_words`` words, copies counted once; only they
    reach the driver, one middle for each group of ``GROUP_PRIOR`` documents.
    """
    ids = trusted.select(F.col(id_col).alias("id")).distinct().withColumn("is_trusted", F.lit(True)).hint("merge")
    asked = docs.select(
        F.struct(*columns).alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(group_col).cast("string") if group_col else F.lit(None), F.lit("")).alias("group"),
        F.col(text_col).alias("text"),
    )
    measured = _measured(asked, "text", ["row", "id", "group"], lambda df: with_runs(df, len(model.raw)), n=F.col("n"), bins=F.col("bins"), ends=F.col("ends"))
    own = F.when(F.col("is_trusted"), F.col("trusted")).otherwise(F.col("other"))
    scored = materialize(
        model.scores(measured, prior)
        .withColumn("id", F.col("row.id"))
        .join(ids, "id", "left")
        .select(
            F.col("row.row").alias("row"),
            F.col("row.group").alias("group"),
            *COUNTS,
            own.alias("log_ratio"),
            _base_failed(min_words, max_repeated_percent).alias("base_failed"),
        ),
        "quality",
    )

    texts = scored.filter(F.col("n_words") >= min_words).select("group", "log_ratio", *COUNTS).distinct()
    counted = materialize(texts.select("group", "log_ratio"), "quality-scores")
    everywhere = middles(counted, F.lit(""), F.col("log_ratio")).first()
    middle = everywhere["m"] if everywhere else 0.0
    own_middle = [
        F.lit(x)
        for r in middles(counted, F.col("group"), F.col("log_ratio")).filter(F.col("n") >= GROUP_PRIOR).collect()
        for x in (r["group"], (r["n"] * r["m"] + GROUP_PRIOR * middle) / (r["n"] + GROUP_PRIOR))
    ]
    centre = F.lit(middle)
    if own_middle:
        centre = F.coalesce(F.element_at(F.create_map(*own_middle), F.col("group")), centre)
    # 1.4826 makes the middle distance of a normal distribution its standard deviation.
    far = middles(counted, F.lit(""), F.abs(F.col("log_ratio") - centre)).first()
    distance = far["m"] if far else 0.0
    spread = max(LEAST_SPREAD, 1.4826 * distance)
    near = F.col("log_ratio") >= centre - spreads * spread
    return scored.withColumn("kept", ~F.col("base_failed") & near).drop("group")


def kept_rows(
    docs: DataFrame, trusted: DataFrame, model: CountedRatio, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``judge_against`` keeps, unchanged.

    A verdict depends on id, text and group alone. It comes back to the rows by 96 bits of hashes of these, so no text is
    carried through the scoring.
    """
    told_apart = [F.col(id_col), F.col(text_col), F.col(text_col).isNull(), *([F.col(group_col)] if group_col else [])]
    marks = [F.xxhash64(*told_apart).alias("mark"), F.hash(*told_apart).alias("check")]
    judged = judge_against(docs, trusted, model, id_col, text_col, group_col, marks)
    kept = judged.filter("kept").select("row.*").distinct()
    return docs.select(F.struct("*").alias("row"), *marks).join(kept, ["mark", "check"], "left_semi").select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good at least once and never as bad."""
    return (
        labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter(F.col("q") == 1).select("doc_id")
    )
