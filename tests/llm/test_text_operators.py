"""Operators on words and windows against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lustra.llm import jaccard, leaks, quality, repeats, suffix_tree, texts as helpers
from lustra.llm.components import connected


def words(text):
    return (text or "").encode().split()


def test_word_hashes_agree_with_words(texts):
    bodies = [(t or "").encode() for t in texts]
    hashes, counts = helpers.word_hashes(bodies, lower=True)
    expected = [w for b in bodies for w in b.lower().split()]
    assert counts.tolist() == [len(b.split()) for b in bodies]
    by_word = defaultdict(set)
    for w, h in zip(expected, hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(h) == 1 for h in by_word.values())
    assert len({next(iter(h)) for h in by_word.values()}) == len(by_word)


def test_buckets_hold_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    for bits in (0, 3, 6):
        parts = [(b, keys[s]) for b, s in helpers.bucket_slices(keys, bits)]
        assert np.array_equal(np.concatenate([p for _, p in parts]), keys)
        assert all((p >> np.uint64(64 - bits) == b).all() for b, p in parts if bits)


def groups(texts, percent=75):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_groups(docs, texts):
    found = {r["doc"]: (r["n_shingles"], r["component"]) for r in jaccard.link_documents(docs).collect()}
    assert found == groups(texts)
    kept = [r["doc_id"] for r in jaccard.first_of_groups(docs).collect()]
    blank = [i for i, t in enumerate(texts) if not (t or '').strip(' \t\n\v\f\r')]
    assert sorted(kept) == sorted({c for _, c in found.values()} | set(blank))


def test_first_of_groups_goes_by_row(spark):
    """Repeated ids of unlinked texts, copies without an id, texts without words, columns with the names of the operator."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [
        (1, a, "x", 1), (1, b, "x", 1), (None, c, "x", 1), (None, c, "y", 2), (None, c, "y", 2),
        (7, b + " end", "x", 1), (5, a, "x", 3), (5, a, "y", 3), (0, a + " end", "x", 1),
        (3, "", "x", 1), (3, "", "x", 1), (3, None, "x", 1), (None, " ", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, row int")
    kept = [tuple(r) for r in jaccard.first_of_groups(docs).collect()]
    blank = [r for r in rows if not (r[1] or "").strip()]
    found = [r for r in kept if (r[1] or "").strip()]
    assert sorted(map(str, kept)) == sorted(map(str, blank + found))
    # Of the copies of a the one with id 0, of those of b that with id 1, and one of those of c.
    assert sorted((str(r[0]), r[1]) for r in found) == [("0", a + " end"), ("1", b), ("None", c)]
    again = [tuple(r) for r in jaccard.first_of_groups(docs.repartition(5)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))
    texts = docs.selectExpr("concat('k', doc_id) as doc_id", "text")
    assert jaccard.first_of_groups(texts).count() == len(kept)
    assert jaccard.first_of_groups(docs.filter("false")).collect() == []


def test_small_sets_by_subsets_and_lists(spark):
    draw = random.Random(3)
    letters = [f"w{i}" for i in range(14)]
    rows = [" ".join(letters[s : s + draw.randint(5, 14)]) for s in (0, 0, 1, 1, 2, 0, 3, 0, 1)] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    expected = groups(rows)
    for boundary in (0, 4, 20):
        jaccard_boundary = jaccard._boundary
        jaccard._boundary = lambda *_, b=boundary: b
        try:
            found = {r["doc"]: (r["n_shingles"], r["component"]) for r in jaccard.link_documents(df).collect()}
        finally:
            jaccard._boundary = jaccard_boundary
        assert found == expected


def test_boundary_follows_cost():
    sizes = dict.fromkeys(range(1, 40), 100)
    assert jaccard.best_boundary(sizes, 1.0) <= jaccard.best_boundary(sizes, 1000.0)
    assert jaccard.least_overlap(4, 4) == 4 and jaccard.least_overlap(7, 7) == 6


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


def test_repeats(docs, texts):
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        expected[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    found = repeats.remove_repeats(docs).collect()
    assert {r["doc"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == expected
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in found)
    assert any(r["n_removed"] for r in found)


@pytest.mark.parametrize("part_bytes", [60, 1 << 20])
def test_leaks(spark, docs, texts, part_bytes):
    source = leaks.search_words(texts[3].encode())
    items = [(1, " ".join(w.decode() for w in source[2:16])), (2, "A, b! C"), (3, ""), (4, None), (5, "one"), (1, "zz yy"), (None, "a b c d")]
    found = leaks.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes)
    patterns = defaultdict(set)
    for item, text in items:
        w = leaks.search_words((text or "").encode())
        for j in range(max(len(w) - 9, 1) if w else 0):
            patterns[tuple(w[j : j + 10])].add(item)
    for r in found.collect():
        w = leaks.search_words((texts[r["row"]["doc_id"]] or "").encode())
        hit, seen = set(), set()
        for p, owners in patterns.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    seen |= owners
        assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == hit
        assert r["items"] == sorted(str(x) for x in seen - {None}) and r["n_words"] == len(w)


def test_quality_counts(docs, texts):
    model = quality.RatioModel((0.0,) * 16)
    symbols = set("#*$%&|<>")
    for r in quality.judge_quality(docs, model).collect():
        text = texts[r["row"]["doc_id"]] or ""
        w = [x.decode() for x in text.encode().split()]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in symbols for c in text) and r["n_repeat_words"] == len(covered)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])


def test_quality_ratio(spark):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))
    rows = [(1, "good text here and more good text"), (2, "junk junk !! junk"), (3, None), (4, "good junk")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_ratio(df, spark.createDataFrame([(1,), (1,), (3,)], "doc_id long"), bins=64)

    def bins(text):
        h = [word(w) for w in (text or "").split()]
        return [x % 64 for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:], strict=False))]]

    raw, target = Counter(b for _, t in rows for b in bins(t)), Counter(bins(rows[0][1]))
    log = lambda c, b: math.log((c[b] + 0.01 * sum(c.values()) / 64) / (sum(c.values()) * 1.01))
    for r in quality.judge_quality(df, model).collect():
        own = bins(r["row"]["text"])
        expected = sum(log(target, b) - log(raw, b) for b in own) / len(own) if own else 0.0
        assert r["log_ratio"] == pytest.approx(expected, abs=1e-4)
    assert set(quality.fit_ratio(df, spark.createDataFrame([], "doc_id long"), bins=8).weights) == {0.0}


def test_counted_ratio_leaves_own_grams_out(spark):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))
    rows = [(1, "good text here and more good text"), (2, "junk junk !! junk"), (3, None), (4, "good junk"), (None, "more text here"), (5, "good text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (3,), (5,)], "doc_id long")

    def bins(text):
        h = [word(w) for w in (text or "").split()]
        return Counter(x % 64 for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:], strict=False))])

    raw, target = sum((bins(t) for _, t in rows), Counter()), bins(rows[0][1]) + bins("good text")
    found = quality.judge_against(df, trusted, quality.count_bins(df, trusted, bins=64), prior=3.0).collect()
    assert sorted(str(r["row"]["doc_id"]) for r in found) == ["1", "2", "3", "4", "5", "None"]
    for r in found:
        own = bins(r["row"]["text"])
        t, a = target - own if r["row"]["doc_id"] in (1, 3, 5) else target, raw - own
        share = t.total() / a.total()
        expected = sum(n * math.log((t[b] + 3) / (a[b] * share + 3)) for b, n in own.items()) / own.total() if own else 0.0
        assert r["log_ratio"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_unlabelled_clean_texts_are_kept(spark, folder):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet") for name in ("documents", "labels"))
    # Half of the good documents lose their label, and four of five texts that are not English their place.
    good = quality.trusted_ids(labels).withColumn("good", F.lit(True))
    rare = docs.filter((F.col("lang") == "en") | (F.col("doc_id") % 10 < 2)).select("doc_id", "lang", "text")
    trusted = good.filter(F.col("doc_id") % 2 == 0).select("doc_id")
    judged = quality.judge_against(rare, trusted, quality.count_bins(rare, trusted), group_col="lang", columns=["doc_id", "lang"])
    rows = judged.filter(~F.col("base_failed")).select("row.*", "kept").join(good, "doc_id", "left").toPandas()
    unlabelled = rows[(rows.good == True) & (rows.doc_id % 2 == 1)]  # noqa: E712
    assert len(unlabelled) > 20 and unlabelled.kept.mean() >= 0.99 and unlabelled[unlabelled.lang != "en"].kept.mean() >= 0.95
    bad = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 0").select("doc_id").toPandas().doc_id
    assert rows[rows.doc_id.isin(bad)].kept.mean() < 0.9


def test_copies_do_not_narrow_the_rule(spark):
    draw = random.Random(4)
    text = lambda: " ".join(f"w{draw.randint(0, 300)}" for _ in range(80))
    rows = [(i, "x", t) for i, t in enumerate([text()] * 60 + [text() for _ in range(40)])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trusted = df.filter("doc_id % 2 = 0").select("doc_id")
    judged = quality.judge_against(df, trusted, quality.count_bins(df, trusted), group_col="lang")
    assert judged.filter("kept").count() == 100


def test_suffix_tree_scores(docs, texts):
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in enumerate(texts) if i not in held for w in [*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    found = suffix_tree.score_texts(docs, suffix_tree.held_out(F.col("doc_id"))).collect()
    assert len(found) == len(texts)
    for r in found:
        tokens = [*(texts[r["doc"]] or "").encode().lower().split(), "end"]
        assert r["held_out"] == (r["doc"] in held) and r["train_tokens"] == n and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] < 0


def test_suffix_tree_is_a_distribution_and_follows_the_longest_suffix():
    streams = suffix_tree._streams([b"abab abab abcd", b"abab xyz"] * 30)
    keys, lengths = suffix_tree._positions(streams, 3)
    assert lengths.sum() == len(keys) == sum(len(s) - 1 for s in streams)
    counted = suffix_tree._added([np.unique(keys, return_counts=True)])
    levels = []
    for k in (1, 2, 3):
        entry = ((counted[0] >> np.uint64(8 * (4 - k))) << np.uint64(8)) | (counted[0] & np.uint64(255))
        levels.append(suffix_tree._added([(entry, counted[1])]))
    tree = suffix_tree.build_tree(levels, divergence=0.01, prior=2.0)
    assert tree.states > 3
    for context in (b"aba", b"cab", b"zzz", b"\0\0\n"):
        base = sum(int(c) << (8 * (i + 1)) for i, c in enumerate(context))
        probabilities = 10 ** tree.log10(np.array([base | s for s in range(256)], np.uint64))
        assert probabilities.sum() == pytest.approx(1, abs=0.01)
    # The counts of a context, mixed with what its suffix says.
    contexts, rest, entries, logs = tree.levels[0]
    a = np.uint64(ord("a"))
    n = sum(s.count(b"a") for s in streams)
    n_ab = sum(s.count(b"ab") for s in streams)
    place, seen = helpers.find(entries, np.array([(int(a) << 8) | ord("b")], np.uint64))
    assert seen[0] and 10 ** logs[place[0]] == pytest.approx((n_ab + 2 * 10 ** tree.root[98]) / (n + 2))


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.link_documents(no_docs).count() == 0
    assert repeats.remove_repeats(no_docs).count() == 0
    assert leaks.find_leaks(no_docs, items).count() == 0
    assert quality.judge_quality(no_docs, quality.fit_ratio(no_docs, no_docs)).count() == 0
    assert suffix_tree.score_texts(no_docs, F.lit(False)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (9, text), (None, None)], "doc_id long, text string")
    linked = jaccard.link_documents(df).collect()
    assert len(linked) == 5 and {r["component"] for r in linked if r["n_shingles"]} == {3}
    removed = sorted((r["doc"] or 99, r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert removed == [(3, 0), (3, 0), (9, 40), (99, 0), (99, 40)]
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.lit(""), 256)).first()[0]


def test_words_of_equal_polynomial_hashes_differ():
    bits = [0]
    for _ in range(10):
        bits += [1 - x for x in bits]
    one, other = (bytes(97 + (x ^ flip) for x in bits) for flip in (0, 1))
    found, counts = helpers.word_hashes([one + b" " + other, b"", b"  Ab ab\tb ", one], lower=True)
    assert counts.tolist() == [2, 0, 3, 1]
    assert found[0] != found[1] and found[0] == found[5] and found[2] == found[3] != found[4]


@pytest.mark.parametrize("bits", [0, 3, 24])
def test_bucket_slices_cover_the_keys(bits):
    keys = np.sort(np.random.default_rng(bits).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    slices = list(helpers.bucket_slices(keys, bits))
    assert [k for _, s in slices for k in keys[s]] == keys.tolist()
    assert all({int(k) >> (64 - bits) for k in keys[s]} == {b} for b, s in slices)
    assert not helpers.bucket_slices(keys[:0], bits)


def test_rows_of_one_id_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert helpers.blocked(df, "doc_id", "text", 80, block_bytes=10).select("block").distinct().count() == 8


def test_kept_rows_are_whole(spark):
    draw = random.Random(7)
    rows = [(None if i % 5 == 0 else i // 2, "x", " ".join(f"w{draw.randint(0, 300)}" for _ in range(80)), i) for i in range(40)]
    rows += [(99, "x", "too short", 40), (99, None, None, 41), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, mark long")
    trusted = df.filter("doc_id % 2 = 0").select("doc_id")
    kept = quality.kept_rows(df, trusted, quality.count_bins(df, trusted), group_col="lang")
    assert kept.columns == df.columns
    assert sorted(r["mark"] for r in kept.collect()) == sorted([*range(40), rows[3][3]])
