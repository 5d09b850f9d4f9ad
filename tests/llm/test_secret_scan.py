"""Secret scans against patterns applied row by row, and what a second scan spares."""

import re

import pytest
from pyspark.sql import functions as F

from lustra.llm import secret_scan
from lustra.llm.secret_scan import Ledger, Rule, scan_versions

KEY = "AKIA" + "Q7" * 8
TEXTS = [
    'password = "hunter2hunter2"',
    "PassWord:abcdefghijkl and token=secret:abcdefghijklmn",
    "api_key=short apikey='abcdefghijkl.mno' API_KEY : xxxxxxxxxxxx",
    "paſſword=abcdefghijkl toKen=abcdefghijkl",
    f"é {KEY} AKIAAKIA AKIA{'Z' * 13} AKIA{'Z' * 14}",
    "0123456789abcdef 0123456789abcde DEADBEEFDEADBEEF deadbeefdeadbeefX",
    f"secret={KEY} {'ab' * 20}",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " xoxb-1234567890-ab AIza" + "B" * 35 + " sk_live_" + "x" * 20,
    "\U0001f600 token=" + "a" * 12,
    None,
    "",
    "token=" * 5_000 + "a" * 12,
    "password" + " " * 50_000,
]


def plain(text):
    """All findings by the wording of the rules."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [
        ("assign", assign, re.I | re.A, 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 0, 18),
        ("hex", "[0-9a-f]+", 0, 0, 16),
        *((r.kind, r.pattern, 0, 0, 0) for r in secret_scan.ISSUER_RULES),
    ]
    found = []
    for number, (kind, pattern, flags, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                found.append((m.start(), number, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def of(scan):
    return sorted(
        (str(r["row"][0]), r["blob"], [tuple(f) for f in r["findings"]]) for r in scan.rows.collect()
    )


@pytest.fixture
def secrets(spark):
    rows = [(i, t, "b", "t") for i, t in enumerate([*TEXTS, *TEXTS[:4], *TEXTS[:2]])]
    return spark.createDataFrame(rows, "doc_id long, text string, blob string, todo string").repartition(3)


def test_same_as_plain_patterns(spark, secrets):
    texts = {str(r["doc_id"]): r["text"] for r in secrets.collect()}
    found = of(scan_versions(secrets, Ledger.create(spark), secrets.columns))
    assert len(found) == len(texts)
    for key, _, findings in found:
        assert findings == plain(texts[key])


def test_a_blob_is_scanned_once(spark, secrets):
    ledger = Ledger.create(spark)
    first = scan_versions(secrets, ledger)
    blobs = {(t or "") for t in TEXTS}
    assert first.scanned.count() == len(blobs) * len(secret_scan.RULES) == ledger.scanned.count()
    again = scan_versions(secrets, ledger)
    assert again.scanned.count() == 0 and of(again) == of(first)

    newer = secrets.unionByName(secrets.limit(1).select("doc_id", F.lit("secret: new-new-new-new").alias("text"), "blob", "todo"))
    third = scan_versions(newer, ledger)
    assert third.scanned.select("blob").distinct().count() == 1
    assert len(of(third)) == len(of(first)) + 1
    assert ledger.scanned.count() == ledger.scanned.distinct().count()


def test_only_a_new_rule_version_runs_again(spark, secrets):
    ledger = Ledger.create(spark)
    old = (Rule("hex", "[0-9a-f]{16,}"), Rule("word", "hunter"))
    scan_versions(secrets, ledger, rules=old)
    new = (old[0], Rule("word", "hunter2", version=2))
    scan = scan_versions(secrets, ledger, rules=new)
    assert {r["rule"] for r in scan.scanned.collect()} == {"word@2"}
    words = [f for _, _, findings in of(scan) for f in findings if f[0] == "word"]
    assert words and all(end - start == 7 for _, start, end in words)


def test_an_interrupted_run_is_repeated(spark, secrets):
    ledger = Ledger.create(spark)
    whole = of(scan_versions(secrets, Ledger.create(spark)))
    broken = scan_versions(secrets, Ledger.create(spark))
    # Findings were written, the pairs were not.
    other = broken.rows.select("blob", F.explode("findings").alias("f")).filter("f.kind = 'hex'").distinct()
    other.select("blob", F.lit("hex@1").alias("rule"), "f.*").write.mode("append").parquet(f"{ledger.path}/findings")
    assert of(scan_versions(secrets, ledger)) == whole


def test_large_ledgers_meet_texts_by_shuffle(spark, secrets, monkeypatch):
    whole = of(scan_versions(secrets, Ledger.create(spark)))
    monkeypatch.setattr(secret_scan, "FEW_BYTES", 0)
    assert of(scan_versions(secrets, Ledger.create(spark))) == whole


def test_no_rows_and_null_ids(spark, secrets):
    ledger = Ledger.create(spark)
    assert scan_versions(secrets.filter("false"), ledger).rows.collect() == []
    assert ledger.scanned.count() == 0
    nameless = secrets.withColumn("doc_id", F.lit(None).cast("long"))
    assert len(of(scan_versions(nameless, ledger))) == secrets.count()
