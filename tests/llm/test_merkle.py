"""Merkle manifest against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lustra.llm import merkle

COLUMNS = ["doc_id", "source", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def levels(nodes, fanout):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return found


def path(tree, at, fanout):
    steps = []
    for level in tree[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        steps.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        at //= fanout
    return steps


def expected(rows, fanout):
    """Sorted tuples of id, leaf, subroot, root, proof of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append(([r["doc_id"] for r in ordered], levels([leaf(r) for r in ordered], fanout)))
    top = levels([tree[-1][0] for _, tree in trees], fanout)
    return sorted(
        (str(i), tree[0][k], tree[-1][0], top[-1][0], str(path(tree, k, fanout) + path(top, g, fanout)))
        for g, (ids, tree) in enumerate(trees)
        for k, i in enumerate(ids)
    )


def found(manifest):
    return sorted(
        (str(r["id"]), r["leaf"], r["subroot"], r["root"], str([(s["place"], s["others"]) for s in r["proof"]]))
        for r in manifest.proofs().collect()
    )


@pytest.mark.parametrize(("fanout", "every"), [(8, 3), (2, 2), (3, 1)])
def test_same_as_plain_tree(docs, fanout, every):
    rows = docs.collect()
    manifest = merkle.build_manifest(docs, COLUMNS, group_col="source", fanout=fanout, every=every)
    assert found(manifest) == expected(rows, fanout)
    assert manifest.root() == expected(rows, fanout)[0][3]


def test_every_proof_leads_to_the_root_and_no_other_leaf_does(docs):
    manifest = merkle.build_manifest(docs, COLUMNS, group_col="source", extra={"n": F.length("text")})
    proofs = manifest.proofs()
    judged = proofs.select(
        (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"),
        (merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).alias("other"),
    ).collect()
    assert len(judged) == docs.count() and all(r["own"] and not r["other"] for r in judged)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["extra"]["n"] == (None if texts[r["id"]] is None else len(texts[r["id"]])) for r in proofs.collect())


def test_only_every_few_levels_are_stored_and_a_manifest_can_be_opened(spark, tmp_path):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("x").alias("text"))
    path = str(tmp_path / "manifest")
    built = merkle.build_manifest(rows, COLUMNS, group_col="source", path=path)
    stored = sorted(p.name for p in (tmp_path / "manifest" / "groups").iterdir())
    assert stored == ["level-0", "level-3", "level-6"]
    opened = merkle.open_manifest(spark, path)
    assert opened.root() == built.root()
    assert found(opened) == expected(rows.collect(), 8)


def test_nulls_repeats_and_equal_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, None, "a"), (1, None, "b"), (1, None, "b"), (2, "", ""), (3, "é", "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert found(merkle.build_manifest(docs, COLUMNS, group_col="source")) == expected(docs.collect(), 8)


def test_lone_leaf_is_the_root(spark):
    docs = spark.createDataFrame([(5, "s", "t")], "doc_id long, source string, text string")
    (row,) = merkle.build_manifest(docs, COLUMNS, group_col="source").proofs().collect()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf({"doc_id": 5, "source": "s", "text": "t"})
    assert row["proof"] == []


def test_no_rows(no_docs):
    manifest = merkle.build_manifest(no_docs, COLUMNS, group_col="source")
    assert manifest.root() is None and manifest.proofs().collect() == []


def test_text_ids_and_many_groups(spark):
    rows = [(f"k{i % 17}", f"s{i % 40}", f"t{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    manifest = merkle.build_manifest(docs, COLUMNS, group_col="source")
    proofs = manifest.proofs().collect()
    assert len(proofs) == 200 and len({r["subroot"] for r in proofs}) == 40 and len({r["root"] for r in proofs}) == 1
