"""Secret scan over an incremental blob ledger (operator 7, native).

Every version of a text is content-addressed by its SHA-256. The ledger holds
which (blob, rule version) pairs have been scanned and what was found. A run
scans only pairs that the ledger lacks, once per blob however many paths hold
it, and joins the findings back to all paths. All of it is DataFrame work:
texts are hashed, grouped by blob, searched by the JVM's regular expressions,
and joined; positions follow from the lengths of the parts between matches.

``update_ledger`` keeps the ledger as a table in a folder: each run is landed as a
whole part, with a commit marker, so a run that died leaves nothing behind and its
pairs are scanned by the next. The registered query brings the documents in
as two generations, by source: the second scans only blobs that the first has not seen.

Defined results: null texts count as empty; repeated rows each get their
findings; an empty table gives no rows; overlapping findings of different
kinds are all reported, those of one kind are leftmost and do not overlap;
positions are code points, end exclusive. A pair that two runs scanned at the
same time counts once. Existing columns with the result's
names are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import table, text_or_empty
from tokenmill.session import scratch_path
from tokenmill.sources import io


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0       # the group whose length counts
    least: int = 1       # its least length; shorter matches are dropped
    hint: str = ""       # cheaper pattern that every match contains


# The three base rules in their order, then the rules that this scan adds.
RULES = (
    Rule("assign", 1,
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("service_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
)
BASE = ("assign", "access", "hex")

_SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _rule_spans(text: Column, rank: int, rule: Rule) -> Column:
    """Spans of one rule: the k-th match starts behind the parts and matches before it."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    size = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(found.alias("m"), size.alias("g"), F.slice(parts, F.lit(1), F.size(found)).alias("p"))
    walked = F.aggregate(
        rows, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["p"]) + F.length(r["m"])).alias("at"),
            F.when(F.length(r["g"]) >= rule.least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(r["p"])).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                (acc["at"] + F.length(r["p"]) + F.length(r["m"])).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(_SPANS))


def blob_id(text: str = "text") -> Column:
    """The content address: SHA-256 of the text's UTF-8 bytes."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def scan_new(docs: DataFrame, scanned: DataFrame | None = None, text: str = "text",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows ``(blob, kind, version, spans)`` for the pairs that
    ``scanned(blob, kind, version)`` lacks: each unseen blob is searched once."""
    blobs = docs.select(blob_id(text).alias("blob"), text_or_empty(text).alias("text"))
    if scanned is not None:
        have = scanned.join(F.broadcast(_pairs(docs.sparkSession, rules)), ["kind", "version"], "left_semi") \
            .groupBy("blob").agg(F.collect_set("kind").alias("have"))
        blobs = blobs.join(have, "blob", "left").filter(F.coalesce(F.size("have"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("have", F.array().cast("array<string>"))
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("have").alias("have"))
    todo = [F.when(~F.coalesce(F.array_contains("have", r.kind), F.lit(False)), F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
        _rule_spans(F.col("text"), k, r).alias("spans"))) for k, r in enumerate(rules)]
    return once.select("blob", F.explode(F.array_compact(F.array(*todo))).alias("r")).select("blob", "r.*")


LEDGER = "blob binary, kind string, version int, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All whole runs of the ledger at ``path``; an absent ledger is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [r.toString() for r in runs if r.getName().startswith("run-") and fs.exists(hadoop(r, "_SUCCESS"))]
    return spark.read.schema(LEDGER).parquet(*whole) if whole else spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the pairs of ``docs`` and ``rules`` that the ledger at ``path``
    lacks, add them to it as one run, and return the ledger's rows of ``rules``."""
    spark = docs.sparkSession
    io.land_if_absent(scan_new(docs, read_ledger(spark, path), text, rules), f"{path}/run-{uuid.uuid4().hex}")
    return read_ledger(spark, path).join(F.broadcast(_pairs(spark, rules)), ["kind", "version"], "left_semi")


def _pairs(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def findings_by_path(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``found``: all spans of its blob, by start and rule order."""
    per_blob = ledger.filter(F.size("spans") > 0).groupBy("blob") \
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))
    return docs.drop("found").withColumn("blob", blob_id(text)).join(per_blob, "blob", "left") \
        .withColumn("found", F.coalesce("found", F.array().cast(_SPANS)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ledger = scratch_path(spark, "ledger")
    later = F.xxhash64("source") % 2 == 0
    update_ledger(docs.filter(~later), ledger)
    got = findings_by_path(docs.select("doc_id", "text"), update_ledger(docs.filter(later), ledger))
    return got.select("doc_id", *[_count(k).alias(f"n_{k}") for k in BASE],
                      F.sha2(_joined(F.filter("found", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
                      _joined(F.col("found")).alias("spans"))
