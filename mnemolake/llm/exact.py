"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Texts are equal when identical without white space. One scan gives each row its length and prefix hash; groups of
one row end there. Only rows whose length and prefix occur again have their whole content hashed, and only those
meet in the last grouping. Rows of a common length or text are counted where they are read and never gathered.

Defined results: a missing text is an empty one, and empty texts equal each other; rows without doc_id take part
and lose ties; repeated rows form a group of which one row counts as kept; an empty table gives no row. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import SPACES, keyed, saved, text_of

PREFIX = 64


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACES + "+", "")


def duplicates(docs: DataFrame, *, prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    The row with the longest original text stays, of those the smallest doc_id. ``text_sha256`` is missing where no
    whole text had to be read, unless ``digest`` asks for it everywhere.
    """
    rows, key = keyed(docs)
    flat = rows.select(F.col(key).alias("row"), rows["doc_id"].alias("doc_id"), F.length(text_of(rows)).alias("chars"), compact(text_of(rows)).alias("flat"))
    marks = flat.select("row", F.length("flat").alias("size"), F.xxhash64(F.substring("flat", 1, prefix)).alias("head"))
    # one row per (length, prefix) that occurs again
    again = saved(marks.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "head"), "again").withColumn("open", F.lit(True))
    marked = flat.withColumn("size", F.length("flat")).withColumn("head", F.xxhash64(F.substring("flat", 1, prefix))).join(again, ["size", "head"], "left")
    whole = F.sha2(F.encode("flat", "utf-8"), 256)
    hashed = saved(marked.select("row", "doc_id", "chars", "size", "open", (whole if digest else F.when(F.col("open"), whole)).alias("text_sha256")), "hashed")
    first = F.struct(F.col("chars"), -F.col("row_order"), F.col("row"), F.col("doc_id"))
    # smallest doc_id first; a row without one comes after all others
    ordered = hashed.withColumn("row_order", F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")))
    groups = ordered.where("open").groupBy("size", "text_sha256").agg(F.max(first).alias("best"), F.count(F.lit(1)).alias("n"))
    found = hashed.join(groups, ["size", "text_sha256"], "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n")).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
