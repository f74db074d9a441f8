"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content.  The
ledger is a Parquet table of (blob, rules) pairs that were scanned, with their
findings; ``rules`` is a digest of the rules themselves, so changed rules are
new pairs.  A run scans only pairs the ledger lacks, appends them, and takes
all findings from the ledger, joined back to every path that holds the blob.
Without a ledger's path a run starts one of its own under the checkpoint
folder.

Every task drops its own copies of a blob before the shuffle, so a group that
holds a third of all rows sends one row per task; the join back is split by
the adaptive skew join if a digest is hot.  Texts stream through the tasks;
what a task holds is the digests it has seen.  Patterns take time in
proportion to the text: a run of a token's characters is tried once, from its
beginning.

NULL text counts as empty, and an empty text has no findings.  Repeated rows
each get the findings of their blob.  Offsets are code points.  ``scan`` names
the columns it adds as it is told to and replaces columns of these names;
``without_secrets`` keeps every column of the input.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

# Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "private_key", "jwt", "github", "slack"]
BASE_KINDS = KINDS[:3]

# Kind: (pattern, group whose length counts, least length).  Letters of the
# assign keywords match in either case, ASCII only.
RULES = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    # A token, not a part of one: each run of its characters is tried once.
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
}

SPAN = "struct<start:long,kind:int,stop:long>"
LEDGER = f"blob binary, rules string, spans array<{SPAN}>"


def rules_id(rules: dict = RULES) -> str:
    """A digest of the rules: their kinds in order, patterns, groups and lengths."""
    return hashlib.sha256(json.dumps([[k, *r] for k, r in rules.items()]).encode()).hexdigest()[:16]


def find(text: str, patterns) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding, in order."""
    out = []
    for k, (pattern, group, least) in enumerate(patterns):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    out.sort()
    return out


def blob_id(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def first_ones(batches):
    """The rows of each blob (first column) that a task sees first."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for blob in batch.column(0).to_pylist():
            keep.append(blob not in seen)
            seen.add(blob)
        if not all(keep):
            batch = batch.filter(pa.array(keep))
        yield batch


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was written there yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def append_unseen(docs: DataFrame, ledger_path: str, rules: dict = RULES, text_col: str = "text") -> None:
    """Scan the blobs of ``docs`` that the ledger lacks for these rules, and append them to it."""
    version = rules_id(rules)
    blobs = docs.select(blob_id(text_col).alias("blob"), F.col(text_col).cast("string").alias("text")).where(
        F.length("text") > 0
    )
    blobs = blobs.mapInArrow(first_ones, blobs.schema)
    known = read_ledger(docs.sparkSession, ledger_path).where(F.col("rules") == version)
    blobs = blobs.join(known.select("blob"), "blob", "left_anti").repartition("blob")
    patterns = [(re.compile(p, re.ASCII), group, least) for p, group, least in rules.values()]

    def scan_batch(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        for batch in first_ones(batches):
            found = [
                [{"start": a, "kind": k, "stop": b} for a, k, b in find(t.as_py(), patterns)] for t in batch.column(1)
            ]
            names = pa.array([version] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(found, kind)], ["blob", "rules", "spans"])

    blobs.mapInArrow(scan_batch, LEDGER).write.mode("append").parquet(ledger_path)


def free_name(taken, name: str) -> str:
    """``name``, with underscores in front until no column has it (in any case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def scan(
    docs: DataFrame,
    ledger_path: str | None = None,
    rules: dict = RULES,
    text_col: str = "text",
    blob_col: str = "blob",
    spans_col: str = "spans",
) -> DataFrame:
    """The rows of ``docs`` with ``blob`` and ``spans`` (by start, then kind), from the ledger."""
    spark = docs.sparkSession
    ledger_path = ledger_path or scratch_dir(spark, "secret-ledger")
    append_unseen(docs, ledger_path, rules, text_col)
    found = read_ledger(spark, ledger_path).where((F.col("rules") == rules_id(rules)) & (F.size("spans") > 0))
    keyed = docs.drop(spans_col).withColumn(blob_col, blob_id(text_col))
    theirs, spans = free_name(keyed.columns, "__blob"), free_name(keyed.columns, "__spans")
    # Two runs that append at once may both scan a blob.
    found = found.select(F.col("blob").alias(theirs), F.col("spans").alias(spans)).dropDuplicates([theirs])
    empty = F.array().cast(f"array<{SPAN}>")
    columns = [F.col(f"`{c}`") for c in keyed.columns]
    return keyed.join(found, F.col(f"`{blob_col}`") == F.col(theirs), "left").select(
        *columns, F.coalesce(F.col(spans), empty).alias(spans_col)
    )


def _joined(spans: Column, names: list[str]) -> Column:
    labels = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", labels[s["kind"]], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a checksum of their spans, and all spans."""
    spans = F.col("spans")

    def count(k):
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS))
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(_joined(base, KINDS), 256).alias("base_sha256"),
        _joined(spans, KINDS).alias("spans"),
    )


def masked(text: Column, spans: Column, mask: str = "<SECRET>") -> Column:
    """The text with every span replaced by ``mask``; overlapping spans become
    one.  A text without spans stays as it is."""
    # Folds the spans from left to right: the text so far, and where the rest begins.
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["done"])
            .otherwise(
                F.concat(
                    acc["done"],
                    F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.lit(mask),
                )
            )
            .alias("done"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def without_secrets(
    docs: DataFrame, ledger_path: str | None = None, text_col: str = "text", length_col: str | None = None, **how
) -> DataFrame:
    """The rows of ``docs``, all columns as they were, with the secrets of their
    text masked.  ``length_col`` names a column that has the text's length; it
    is counted again where the text changed."""
    blob, spans = (free_name(docs.columns, f"__secret_{x}") for x in ("blob", "spans"))
    scanned = scan(docs, ledger_path, text_col=text_col, blob_col=blob, spans_col=spans, **how)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    text = masked(columns[text_col], F.col(spans))
    changed = free_name(scanned.columns, "__secret_changed")
    rows = scanned.select(
        *[(text if c == text_col else x).alias(c) for c, x in columns.items()], (F.size(spans) > 0).alias(changed)
    )
    if length_col in columns:
        length = F.length(columns[text_col]).cast(docs.schema[length_col].dataType)
        columns[length_col] = F.when(F.col(changed), length).otherwise(columns[length_col]).alias(length_col)
    return rows.select(*columns.values())
