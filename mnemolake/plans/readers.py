"""Registered queries over file formats: the supplied tables written in each format and read back by its reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as t
from mnemolake.operators import ingest
from mnemolake.plans import bindings as b
from mnemolake.plans.registry import query
from mnemolake.plans.stored import _FACTS, _store
from mnemolake.session import run_folder
from mnemolake.sources import importers, records, tables

#: Records of one exported file: files stay small whatever the table's size.
FILE_ROWS = 100


def _documents_per_file(rows: DataFrame, number: str, document, path: str) -> None:
    """One JSON document of ``FILE_ROWS`` records per file, ``document`` an aggregate over its records."""
    file = F.floor(F.col(number) / FILE_ROWS)
    rows.groupBy(file.alias("file")).agg(document.alias("value")).repartition("file").write.partitionBy("file").text(path)


@query("stored_lookup", f"""
WITH {_FACTS} SELECT graph_id, semantic_id, text FROM stored WHERE semantic_id IN (0, 3)""")
def stored_lookup(spark, d) -> DataFrame:
    """Two facts of every graph looked up by id."""
    store = _store(spark, d)
    found = None
    for graph in store.graphs().collect():
        for node in (0, 3):
            row = store.get("semantic", graph["graph_id"], node).select("graph_id", "semantic_id", "text")
            found = row if found is None else found.unionByName(row)
    return found


@query("import_one_file", """
SELECT 'fact' AS kind, doc_id AS id, text, [doc_id // 2] AS links, n_chars % 2 = 0 AS is_active FROM documents
UNION ALL SELECT 'episode', doc_id, coalesce(source, ''), NULL, NULL FROM documents
UNION ALL SELECT 'procedure', doc_id, text, [doc_id], NULL FROM documents""")
def import_one_file(spark, d) -> DataFrame:
    """Documents exported as one-file graphs, a hundred to a file, and imported again."""
    path = f"{run_folder(spark)}/graphs"
    nothing = F.array().cast("array<struct<tag_id:bigint>>")
    item = lambda **fields: F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()]))
    doc = F.col("doc_id")
    graph = F.struct(
        item(episodic_id=doc, observation=F.col("source")).alias("episodic_nodes"),
        item(semantic_id=doc, semantic_memory=F.col("text"), is_active=F.col("n_chars") % 2 == 0, episodic_nodes=F.array(F.floor(doc / 2))).alias("semantic_nodes"),
        nothing.alias("tag_nodes"), nothing.alias("subgoal_nodes"),
        item(procedural_id=doc, procedural_memory=F.col("text"), episodic_id=doc).alias("procedural_nodes"),
    )
    _documents_per_file(b.table(spark, d, "documents"), "doc_id", F.to_json(graph), path)
    nodes = importers.read_one_file_graph(spark, path, "g")
    shaped = lambda kind, name, links, active: nodes[kind].select(F.lit(name).alias("kind"), F.col(f"{kind}_id").alias("id"), F.col("observation" if kind == "episodic" else "text").alias("text"), links.alias("links"), active.alias("is_active"))
    no_links, unknown = F.lit(None).cast("array<bigint>"), F.lit(None).cast("boolean")
    facts = shaped("semantic", "fact", F.col("episodic_ids"), F.col("is_active"))
    return facts.unionByName(shaped("episodic", "episode", no_links, unknown)).unionByName(shaped("procedural", "procedure", F.col("episodic_ids"), unknown))


@query("block_files", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || doc_id ELSE text END AS text, doc_id // 64 AS block FROM documents""")
def block_files(spark, d) -> DataFrame:
    """Documents kept in blocks of 64 ids; every third row is changed and the blocks are written again."""
    root = run_folder(spark)
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    tables.write_blocks(docs, "doc_id", 64, f"{root}/blocks")
    current = spark.read.parquet(f"{root}/blocks")
    changed = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("changed "), F.col("doc_id")))
    tables.upsert_blocks(current, changed, "doc_id", 64).drop("block").write.parquet(f"{root}/settled")
    tables.write_blocks(spark.read.parquet(f"{root}/settled"), "doc_id", 64, f"{root}/blocks")
    return spark.read.parquet(f"{root}/blocks").select("doc_id", "text", F.col("block").cast("bigint").alias("block"))


@query("usage_files", """
SELECT event_type AS phase, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS input_tokens FROM events GROUP BY event_type""")
def usage_files(spark, d) -> DataFrame:
    """Usage records appended in two lots as JSON lines and read back."""
    path = f"{run_folder(spark)}/usage"
    rows = b.table(spark, d, "events").select(F.lit("m").alias("model"), F.col("event_type").alias("phase"), F.col("user_id").alias("input_tokens"), "event_id")
    for half in (0, 1):
        records.append_usage(rows.where(F.col("event_id") % 2 == half).drop("event_id"), path)
    return records.read_usage(spark, path).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query("trajectory_files", """
SELECT conv_id::VARCHAR AS trajectory_id, count(*) AS n_steps, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def trajectory_files(spark, d) -> DataFrame:
    """Conversations as bench trajectories, one JSON line each."""
    path = f"{run_folder(spark)}/trajectories"
    step = F.struct("turn", F.coalesce("text", F.lit("")).alias("observation"), F.coalesce("role", F.lit("")).alias("action"))
    rows = b.table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("trajectory_id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows.withColumn("steps", F.transform("steps", lambda s: F.struct(s["observation"].alias("observation"), s["action"].alias("action")))).write.json(path)
    told = records.read_trajectories(spark, path)
    chars = F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["observation"]))
    return told.select("trajectory_id", F.size("steps").cast("bigint").alias("n_steps"), chars.alias("chars"))


@query("question_files", """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS position FROM documents)
SELECT 'q' || doc_id AS id, text AS answer, source AS title, string_split(text, chr(10)) AS sents, doc_id % 7 AS idx, position FROM placed WHERE position BETWEEN 10 AND 59""")
def question_files(spark, d) -> DataFrame:
    """Documents as question files of a hundred items; items 10 to 59 of each file."""
    path = f"{run_folder(spark)}/questions"
    said = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    lines = F.to_json(F.split("text", "\n", -1))
    text = F.concat(
        F.lit('{"_id": "q'), F.col("doc_id"), F.lit('", "question": "?", "answer": '), said(F.col("text")),
        F.lit(', "context": [['), said(F.col("source")), F.lit(", "), lines, F.lit(']], "supporting_facts": [['), said(F.col("source")), F.lit(", "), F.col("doc_id") % 7, F.lit("]]}"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("item")))), lambda x: x["item"])
    _documents_per_file(b.table(spark, d, "documents"), "doc_id", F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")), path)
    rows = records.sliced(records.read_questions(spark, path), 10, 59)
    first = F.col("context")[0]
    return rows.select("id", "answer", first["title"].alias("title"), first["sents"].alias("sents"), F.col("supporting_facts")[0]["idx"].cast("bigint").alias("idx"), F.col("position").cast("bigint").alias("position"))


@query("objective_files", """
SELECT source AS objective, text AS entry_text, 32 AS width FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 5 <> 0""")
def objective_files(spark, d) -> DataFrame:
    """Documents as entries keyed by objective; incomplete ones are left out, vectors made anew."""
    path = f"{run_folder(spark)}/objectives"
    vector = F.when(F.col("doc_id") % 5 != 0, F.array(F.lit(1.0)))
    b.table(spark, d, "documents").select(F.col("source").alias("objective"), F.col("text").alias("entry_text"), vector.alias("embedding")).write.json(path)
    return records.read_objectives(spark, path, refresh=True).select("objective", "entry_text", F.size("embedding").alias("width"))


@query("tag_input", r"""
SELECT doc_id, list_filter(list_transform(string_split(lang || ', ' || source || ' ,, ' || doc_id, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM documents""")
def tag_input(spark, d) -> DataFrame:
    """Typed tag lists: split on commas, trimmed, blanks dropped."""
    typed = F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(" ,, "), F.col("doc_id"))
    return b.table(spark, d, "documents").select("doc_id", t.tag_input(typed).alias("tags"))


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An embedder of the user's: length and first byte of a text's digest."""
    for batch in batches:
        vectors = [[float(len(x)), float(hashlib.sha256(x.encode()).digest()[0])] for x in batch["text"]]
        yield pd.DataFrame({"text_hash": batch["text_hash"], "embedding": vectors})


@query("user_embedder", """
SELECT doc_id, [length(text)::FLOAT, ('0x' || substr(sha256(text), 1, 2))::INT::FLOAT] AS embedding FROM documents WHERE text IS NOT NULL""")
def user_embedder(spark, d) -> DataFrame:
    """Vectors from a supplied function, computed once per distinct text."""
    rows = b.table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    embedded, _ = ingest.embed_texts(rows, "text", model="lengths", embedder=_lengths)
    return embedded.select("doc_id", "embedding")
