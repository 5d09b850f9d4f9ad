"""Mixing, sharding, URL filter, HTML extraction and toxicity."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lustra.llm import html, mixing, shards, toxicity, urls


def filled(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100, None: 10}, {"x": 1000, "y": 1}, {"x": 0, "y": 5, "z": 9}, {"q": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert found == {s: pytest.approx(t) for s, t in filled(sizes).items()}


@pytest.mark.parametrize("rows_per_bin", [1, 50_000])
def test_mix(spark, docs, texts, rows_per_bin):
    quality = spark.createDataFrame([(i, 2.0) for i in range(0, len(texts), 3)], "doc_id long, weight double")
    found = mixing.mix_sources(docs, quality, rows_per_bin=rows_per_bin).collect()
    again = mixing.mix_sources(docs.repartition(5), quality, rows_per_bin=rows_per_bin).collect()
    key = lambda r: (r["row"]["doc_id"], r["times"])
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(texts)
    sizes = {}
    for r in found:
        assert r["size"] == len((r["row"]["text"] or "").encode().split()) and 0 <= r["times"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = filled(sizes)
    for s, target in targets.items():
        own = [r for r in found if r["source"] == s]
        taken, largest = sum(r["size"] * r["times"] for r in own), max(r["size"] for r in own)
        assert own[0]["target"] == pytest.approx(target) and abs(taken - target) <= largest


def test_good_documents_draw_smaller_keys(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0))
    keys = df.select((F.col("id") % 2).alias("odd"), mixing.sample_key(F.col("id"), F.col("w")).alias("key"))
    even, odd = (r["m"] for r in keys.groupBy("odd").agg(F.avg("key").alias("m")).orderBy("odd").collect())
    assert even == pytest.approx(0.25, rel=0.1) and odd == pytest.approx(1, rel=0.1)


def test_matrix_has_exact_margins():
    parts = [0, 5, 17, 100, 3]
    lines = shards.matrix(parts, 7)
    assert lines.sum(1).tolist() == parts and np.ptp(lines.sum(0)) <= 1 and (lines >= 0).all()


@pytest.mark.parametrize("rows_per_part", [3, 1000])
def test_shards(docs, texts, rows_per_part):
    found = shards.shuffle_shards(docs, shards=5, rows_per_part=rows_per_part).collect()
    assert sorted(r["row"]["doc_id"] for r in found) == list(range(len(texts)))
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shards.shuffle_shards(docs.repartition(7), shards=5, rows_per_part=rows_per_part).collect()
    place = lambda rows: {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert place(found) == place(again)


def test_shards_are_uniform(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = shards.shuffle_shards(df, shards=6, rows_per_part=500).select("row.doc_id", "shard").toPandas()
    counts = found.groupby([found.doc_id // 1000, "shard"]).size()
    assert len(counts) == 36 and ((counts - 1000 / 6) ** 2 / (1000 / 6)).sum() < 60


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@pytest.mark.parametrize("part_bytes", [20, 1 << 20])
def test_urls(spark, part_bytes):
    listed = [
        "http://A.Example.ORG/es/x?y#z", "https://example.org/en/123", "x://y.org/", "ftp://y.org", "http://q.com/fr/1", "q.com/fr/1",
        None, "", "http://", "http://com/de/", "http://xcom/de/", "http://a.com?/de/", "http://notexample.org/es/1", "http://é.com/fr/é",
    ]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(listed)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, ("org/", "allow"), (None, "block")], "entry string, verdict string")
    for r in urls.judge_urls(df, rules, part_bytes=part_bytes).collect():
        m = re.match(r"[^:]*?://([^/?#]*)([^?#]*)", r["row"]["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(e), e, v) for e, v in RULES if (f".{host}".endswith("." + e.partition("/")[0])) and path.startswith("/" + e.partition("/")[2])]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2])


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: len(x) % 3)
    array = urls.DigestArray({b"a.org/": True, b"b.org/": False, b"org/x": True})
    mapped = urls.MappedArray(array.n, array.data, array.shapes)
    assert mapped.longest([(b"z.b.org", b"/q"), (b"c.org", b"/q"), (b"", b"")]) == [(b"b.org/", False), None, None]


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain < 3 &amp; more", "plain < 3 & more"),
        ("<title>t</title><p>One<p>Two <b>b", "One\n\nTwo b"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>z", "- a\n- b\n  - c\n\nz"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>N<tr><td>Al<td>1</table>", "Name | N\nAl   | 1"),
        ("a<div hidden>no</div><script>x='</p>'</script><span style='display: none'>no</span>b", "ab"),
        ("<pre>a  b\n c</pre>", "a  b\n c"),
        ("a<br>b<!-- c -->d", "a\nbd"),
        ("<div>a</div><article><h1>H</h1><p>p</p></article>", "a\n\nH\n\np"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_visible_text(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<head><title>T</title>Hello <b>world</b>", "Hello world"),
        ("<head><title>T</title><a href=x>Home<p>One</a>", "Home\n\nOne"),
        ("<html><head>\n<meta charset=x><!-- c -->\n<style>s</style><noscript>n<img></noscript>\n<span>a</span>b</html>", "ab"),
        ("<head><template>t</template><custom-tag>c", "c"),
        ("<p>a<head>b</head>c", "abc"),
        ("<head></p></br>x", "x"),
        ("a<svg><title>t</title><defs><text>no</text></defs><path d='M0/'/><g><text x=1>One</text><text>Two <tspan>three</tspan></text></g>loose</svg>b", "a One Two three b"),
        ("<svg viewBox='0 0 1 1'><style/><path/><text display=none>no</text><foreignObject><div>in</div></foreignObject></svg>b", "in\nb"),
        ("<svg><path d=x><g><p>out", "out"),
        ("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math>", "x=1"),
        ("<map name=m><area href=x>where <a href=y>there</a></map>", "where there"),
    ],
)
def test_visible_text_after_heads_and_in_drawings(page, text):
    assert html.visible_text(page) == text


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "<p>x", "a"), (1, "<p>x", "a"), (2, None, "b")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in html.extract_text(df).collect()) == ["", "x", "x"]


@pytest.fixture(scope="module")
def characters(spark):
    words = "you are an idiot stupid loser moron and the other words in this text are plain and good".split()
    df = spark.createDataFrame([(" ".join(words[i:] + words[:i]),) for i in range(len(words))] * 3, "text string")
    return toxicity.count_characters(df)


@pytest.mark.parametrize("seen", ["1d10t", "i d i o t", "idiooot", "i.d.i.o.t", "!diot", "id*iot"])
def test_restore(characters, seen):
    assert toxicity.restore(f"you {seen} there", characters) == "you idiot there"


def test_plain_words_stay(characters):
    text = "plain words, 123 and 4.5 'quoted' a-b x @y"
    assert toxicity.restore(text, characters) == text


def test_toxicity(spark, characters):
    rows = [(i, f"text number {'abcdefghij'[i % 10] * 2}{i} " + ("you 1diot" if i % 4 == 0 else "is good")) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")
    evidence = toxicity.learn_evidence(df, labels, characters)
    found = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, characters, evidence).collect()}
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(200)) and found[900] == found[901] < 0.3
    none = toxicity.learn_evidence(df.limit(0), labels, characters)
    assert 0 <= none.score(set()) <= 1
