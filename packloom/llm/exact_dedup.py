"""Exact dedup by distributed radix partitioning from the first byte on.

Texts of one length are a group at first. A round splits every group that is still alive by its next
digit, a stretch of bytes (the first 64, then 16 times as many each round); texts carry only the
bytes that are still to come. A digit that is shorter than the others of its round ends its text, so a group always
ends as a whole. Groups of one text, and groups whose texts have ended, leave. The digits are
compared as they are; no digest decides equality. (The SHA-256 in the result
only describes the text.)

A hot group costs no task more than its share: counts are pre-aggregated where rows
are read, and the way back to the rows is an equi-join of two tables, which Spark splits when skewed
(for that, the counts are a stored table: no aggregate may stand below the join).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, grown, table

FIRST_DIGIT, GROWTH = 64, 16


def _normalised(batches):
    for b in batches:
        text = pc.ascii_lower(pc.fill_null(b.column(1), ""))
        raw = text.cast(pa.binary())
        digests = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raw], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(raw), pa.int64()), digests, raw], ["doc_id", "n_bytes", "text_sha256", "body"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when they are identical after lower-casing A-Z. The largest id of a
    group stays. A null text counts as empty; empty texts are a group like any other.
    Repeated rows count one by one in group_size, and each row whose id is the group's
    keep_id is `kept`. Null ids rank below all others; a group with null ids alone has a
    null keep_id and keeps those rows. An empty table gives an empty result. Other
    columns of `docs` are not looked at, whatever their names.
    """
    kept = Stored(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    alive = rows.mapInArrow(_normalised, "doc_id long, n_bytes long, text_sha256 string, body binary").withColumn("group", F.col("n_bytes"))
    out = ["doc_id", "keep_id", "group_size", "text_sha256", "n_bytes"]
    done, width = [], first_digit
    while True:
        cut = alive.withColumn("digit", F.substring("body", 1, width))
        groups = cut.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).filter("group_size > 1")
        groups = kept.put(groups.withColumn("next", F.monotonically_increasing_id()))
        split = cut.join(grown(groups), ["group", "digit"], "left")
        open_ = F.col("next").isNotNull() & (F.octet_length("digit") == width)
        split = split.select(
            "doc_id", F.when(F.col("next").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "n_bytes",
            open_.alias("open"), F.when(open_, F.expr(f"substring(body, {width + 1})")).alias("body"), F.col("next").alias("group"),
        )
        split = kept.put(split)
        kept.drop(groups)
        done.append(split.filter("not open").select(*out))
        alive = split.filter("open").select("doc_id", "n_bytes", "text_sha256", "body", "group")
        if alive.isEmpty():
            break
        width *= growth
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op1_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(body) AS text_sha256, octet_length(encode(body)) AS n_bytes
FROM t WINDOW g AS (PARTITION BY body)
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
