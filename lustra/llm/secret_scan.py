"""Secret scans with a ledger, so that no text is scanned twice under the same rule.

Every version of every document is addressed by the sha256 of its text, the *blob*. The ledger, a folder of Parquet
tables, holds the pairs of blob and rule (a kind with its version) that were scanned, and what was found.
``scan_versions`` scans only pairs that the ledger lacks: of each blob one copy moves, however many
documents or versions hold it, and a rule that is new or has a new version is the only one that runs over
old blobs. The findings then come back to all documents that hold the blob, frequent blobs by a broadcast of
just these, so that a text that a third of all documents share is neither scanned nor joined in one task.

Findings are written before the pairs. A run that ends in between scans these pairs again; its findings are the same, and
equal ones count once. Lost executors repeat their tasks only. One run at a time may write to a ledger.

Cases: a null text is an empty one; an empty text is a blob without findings. Repeated ids are versions of one document and
each has its row, and so have equal rows. An empty table gives no rows and leaves the ledger as it is. Texts of any length are
scanned whole, in time that grows with their length. Places count code points, the end is the first one after the
match. Matches of one rule never overlap, those of different rules may. Columns that are not named are not read; the names of those
that are do not matter, as they are kept in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.operators.lookup import GROUP_ROWS, build_lookup, row_bytes
from lustra.session import materialize, new_scratch_path

#: Bytes of pending pairs that are broadcast, so that in a run with little news only texts with news move.
FEW_BYTES = 8 << 20
FINDINGS = "blob string, rule string, kind string, start int, end int"
SCANNED = "blob string, rule string"


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind of secret: of its leftmost matches those with a long enough ``group`` count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        for m in re.compile(self.pattern, flags).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: Fixed rules, in the order their kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Runs of 16 and more; shorter ones never match, so they need not be cut out first.
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Formats of common issuers.
ISSUER_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + ISSUER_RULES


@dataclass(frozen=True)
class Ledger:
    """The folder that remembers what was scanned, and what was found."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None) -> Ledger:
        """A new ledger without entries, in the shared folder unless a path is given."""
        ledger = cls(spark, path or new_scratch_path(spark, "secret-ledger"))
        for name, schema in (("findings", FINDINGS), ("scanned", SCANNED)):
            spark.createDataFrame([], schema).write.parquet(f"{ledger.path}/{name}")
        return ledger

    @property
    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")

    @property
    def findings(self) -> DataFrame:
        """Each finding once."""
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").distinct()

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


@dataclass(frozen=True)
class Scan:
    """``rows`` has ``row``, ``blob`` and ``findings`` of each document; ``scanned`` the pairs that were new."""

    rows: DataFrame
    scanned: DataFrame
    rules: tuple[Rule, ...] = field(default=RULES)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _pending(blobs: DataFrame, ledger: Ledger, rules: Sequence[Rule]) -> DataFrame:
    """``blob, todo``: the names of the rules that have not seen the blob."""
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = ledger.scanned.join(F.broadcast(_names(ledger.spark, rules)), "rule", "left_semi")
    seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.coalesce(F.array_except(names, F.col("seen")), names)
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)


def _names(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name,) for r in rules], "rule string")


def _texts(docs: DataFrame, text_col: str, pending: DataFrame) -> DataFrame:
    """``blob, text, todo`` of the pending blobs, each once."""
    texts = docs.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    listed = pending.select("blob", F.array_join("todo", ",").alias("todo"))
    size = listed.agg(F.sum(row_bytes(listed)).alias("n")).first()["n"] or 0
    if size <= FEW_BYTES:
        # Texts without anything new are left where they are.
        texts = texts.join(F.broadcast(listed), "blob")
        return texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    # Copies collapse before the shuffle, in which the texts then meet what is to be done.
    return texts.groupBy("blob").agg(F.first("text").alias("text")).join(listed.hint("shuffle_hash"), "blob")


def _scanner(rules: Sequence[Rule]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob, text, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in todo.split(","):
                    rule = by_name[name]
                    found += [(blob, name, rule.kind, *span) for span in rule.matches(text)]
            if found:
                columns = [pa.array(c) for c in zip(*found, strict=True)]
                columns[3:] = [c.cast(pa.int32()) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=["blob", "rule", "kind", "start", "end"])

    return scan


def scan_versions(
    docs: DataFrame,
    ledger: Ledger,
    columns: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
) -> Scan:
    """Scan what the ledger lacks and give each row of ``docs`` the findings of its blob.

    ``findings`` are structs of ``kind, start, end``, by start and then by the order of the rules.
    """
    versions = materialize(docs.select(F.struct(*columns).alias("row"), blob_of(F.col(text_col)).alias("blob")), "versions")
    blobs = versions.groupBy("blob").agg(F.count(F.lit(1)).alias(GROUP_ROWS))
    pending = materialize(_pending(blobs, ledger, rules), "pending-blobs")
    found = _texts(docs, text_col, pending).select("blob", "text", "todo").mapInArrow(_scanner(rules), FINDINGS)
    scanned = pending.select("blob", F.explode("todo").alias("rule"))
    ledger.add(found, scanned)
    return Scan(_joined(versions, blobs, ledger, rules), scanned, tuple(rules))


def _joined(versions: DataFrame, blobs: DataFrame, ledger: Ledger, rules: Sequence[Rule]) -> DataFrame:
    """Findings of the current rules, at all rows that hold the blob."""
    numbered = ledger.spark.createDataFrame([(r.name, i) for i, r in enumerate(rules)], "rule string, number int")
    current = ledger.findings.join(F.broadcast(numbered), "rule")
    place = F.struct("start", "number", "kind", "end")
    by_blob = current.groupBy("blob").agg(F.sort_array(F.collect_list(place)).alias("places"))
    spelt = F.transform("places", lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"]))
    # As text, since that is what the lookup can measure.
    table = by_blob.select("blob", F.array_join(spelt, ",").alias("spelt")).join(blobs, "blob")
    lookup = build_lookup(table, "blob", label="secret-findings")
    parts = F.split(F.col("spelt"), ",")

    def parsed(part: Column) -> Column:
        kind, start, end = (F.split(part, ":")[i] for i in range(3))
        return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return lookup.attach(versions).select(
        "row", "blob", F.coalesce(F.transform(parts, parsed), none).alias("findings")
    )


def spelt(findings: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the findings (of some kinds), comma-joined."""
    if kinds is not None:
        findings = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
