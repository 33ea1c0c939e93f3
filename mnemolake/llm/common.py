"""Shared helpers: written intermediate tables, unique row keys, the word rule, slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import run_folder

#: Fixed by the data contract: characters between words, and the pattern of a word.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Texts go to Python in batches of this many bytes, so that very long ones do not add up in a worker.
BATCH_BYTES = 4 << 20


def text_of(docs: DataFrame) -> Column:
    """The text of a document, a missing one read as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def small_batches(docs: DataFrame) -> None:
    """Bound the batches in which this session hands rows to Python."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost no rework."""
    path = f"{run_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, ordered: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row, never null and never twice, and that column's name.

    A doc_id that is already such a name is used as it is. If ids are missing or repeated, the table is
    written once with numbered rows, so every later read sees the same numbers. ``ordered``: numbers rise with
    doc_id, missing ones last, rows of one id in their order.
    """
    key = fresh(docs, "row_key")
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer") and odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("bigint")), key
    if ordered:
        row = fresh(docs, "row_number")
        docs = docs.withColumn(row, F.monotonically_increasing_id()).orderBy(F.col("doc_id").cast("bigint").asc_nulls_last(), row).drop(row)
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded text size, so that very long texts do not pile up in one step."""
    for batch in batches:
        texts = batch.column(column)
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(texts).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)
