"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch lists inserted, revised and deleted documents. It becomes signed entries: an insert adds a document and its
tokens, a delete takes back what the entries of that document add up to so far, a revision does both. Entries are
additive, so totals are sums of the batches' own sums, and nothing already stored is rewritten.

A batch is one folder, written by Spark's committer, and counts once its manifest exists. Committing an id again
does nothing if its content is the same and is refused if it is not; a half-written batch is written anew.

Defined results: missing source, language, text or version are groups of their own (text: no token); changes
without doc_id concern one nameless document; of several changes to one document and version in a batch, the last
by ``seq`` counts (at equal ``seq`` the largest row); deleting what is not there, or a second time, adds nothing;
inserting what is there counts as a revision; an empty batch commits and changes nothing. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import saved, slices, small_batches
from mnemolake.llm.subwords import encoder

KEY = ("source", "lang", "version")
ENTRY = "doc_id long, source string, lang string, version string, documents long, tokens long"
MANIFEST = "n long, print decimal(38,0)"
#: The name of the tokenizer that this library's counts come from when no other is given.
WORDS = "words"


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc, names = encoder(path), None
    for batch in slices(batches):
        names = names or [c for c in batch.schema.names if c != "text"]
        _, sizes = enc.encode(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes)], [*names, "tokens"])


def counted(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """(doc_id, source, lang, version, tokens): the number of ids of each whole text."""
    small_batches(docs)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.lit(version).alias("version"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _counted(b, tokenizer), "doc_id long, source string, lang string, version string, tokens long")


class Rollup:
    """Totals in a folder of the shared file system: ``entries/``, ``totals/`` and ``done/`` with a folder per batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, part: str, batch: str) -> str:
        return f"{self.root}/{part}/{batch}"

    def _batches(self) -> list[str]:
        """Committed batches: one name per batch, from the manifest folders."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/done")
        system = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not system.exists(folder):
            return []
        names = [s.getPath() for s in system.listStatus(folder)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in names if system.exists(marker(p, "_SUCCESS")))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [self._path(part, b) for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (seq, op, doc_id, source, lang, version, tokens) once; False if ``batch`` is stored already.

        ``op`` is ``insert``, ``revise`` or ``delete``; a delete needs no source, language or tokens.
        """
        changes = changes.select(F.col("seq").cast("bigint").alias("seq"), "op", F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "version", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"))
        changes = saved(changes, "changes")
        content = changes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*changes.columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("print"))
        mine = content.first()
        if batch in self._batches():
            if self.spark.read.schema(MANIFEST).parquet(self._path("done", batch)).first() != mine:
                raise ValueError(f"batch {batch!r} is stored with other content")
            return False
        last = changes.groupBy("doc_id", "version").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("c")).select("doc_id", "version", "c.op", "c.source", "c.lang", "c.tokens")
        last = saved(last, "last")
        wanted = last.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        stored = self.entries()
        mine_before = stored.join(wanted, stored["doc_id"].eqNullSafe(wanted["d"]) & stored["version"].eqNullSafe(wanted["v"]), "left_semi")
        held = mine_before.groupBy("doc_id", *KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
        back = held.select("doc_id", *KEY, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
        put = last.where("op in ('insert', 'revise')").select("doc_id", *KEY, F.lit(1).cast("bigint").alias("documents"), "tokens")
        back.unionByName(put).write.mode("overwrite").option("compression", "zstd").parquet(self._path("entries", batch))
        entries = self.spark.read.schema(ENTRY).parquet(self._path("entries", batch))
        entries.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(self._path("totals", batch))
        self.spark.createDataFrame([mine], MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._path("done", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens), groups that are empty by now left out."""
        parts = self._read("totals", "source string, lang string, version string, documents long, tokens long")
        return parts.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
