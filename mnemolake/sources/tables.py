"""Memory tables as partitioned Parquet: load, append, patch, create and drop graphs, in atomic versions."""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.operators.inspect import graph_stats
from mnemolake.session import checkpointed
from mnemolake.sources.commits import CommitLog, State

KEY = {name: ["graph_id", column] for name, column in schema.ID_COLUMN.items()} | {
    "edges": ["graph_id", "src_type", "src_id", "kind", "dst_type", "dst_id"]
}


class MemoryStore:
    """A folder of tables, each partitioned by ``graph_id`` so one graph is one pruned directory.

    Every change is a commit (``sources.commits``): readers see all of it or nothing, and earlier versions stay
    readable until ``vacuum``. Methods called inside ``transaction`` become one commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self._open: dict | None = None

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, name: str) -> bool:
        path, system = self._hadoop(self.path(name))
        return system.exists(path)

    # --- versions ---

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        return self.log.latest()

    def _state(self, version: int | None = None) -> State:
        return self._open["state"] if self._open and version is None else self.log.state(version)

    @contextmanager
    def transaction(self, batch: str | None = None) -> Iterator[None]:
        """All changes made inside are one commit on the version that was newest at the start.

        Reads inside see the changes made so far. Nothing is published if the block fails. ``batch`` is noted with
        the commit: see ``committed``. Raises ``CommitConflict`` if another writer changed the same graphs meanwhile.
        """
        if self._open is not None:
            yield
            return
        base = self.log.latest()
        self._open = {"base": base, "state": self.log.state(base), "entries": []}
        try:
            yield
            entry: dict = {"commit": uuid.uuid4().hex, "add": {}, "replace": {}, "patched": {}, "batch": batch}
            parts = self._open["entries"]
            if parts or batch:
                # each write has a folder of its own; as one entry they come into force together
                self.log.publish(base, entry | {"steps": parts, **_summary(parts)})
        finally:
            self._open = None

    def committed(self, batch: str) -> bool:
        """Whether a commit of this name is part of the store."""
        return batch in self._state().batches

    def _write(self, table: str, rows: DataFrame, *, replace: list[str] | None = None, patched: list[str] = ()) -> None:
        """Stage ``rows`` in a folder of their own, and with it that earlier rows of the graphs ``replace`` go."""
        commit = uuid.uuid4().hex
        folder = f"{self.path(table)}/commit={commit}"
        self._balanced(rows).write.partitionBy("graph_id").parquet(folder)
        path, system = self._hadoop(folder)
        graphs = sorted(n for n in (s.getPath().getName() for s in system.listStatus(path)) if n.startswith("graph_id="))
        entry = {"commit": commit, "add": {table: graphs} if graphs else {}, "replace": {table: replace} if replace else {}, "patched": {table: list(patched)} if patched else {}}
        self._open["state"].apply(entry)
        self._open["entries"].append(entry)

    def _take_out(self, before: State) -> None:
        """Undo the last ``_write``, which was on the state ``before``; its folder stays."""
        self._open["state"] = before
        self._open["entries"].pop()

    def _delete(self, table: str, entry: dict) -> None:
        """Delete the folder of a write that was undone."""
        path, system = self._hadoop(f"{self.path(table)}/commit={entry['commit']}")
        system.delete(path, True)

    def _folder_names(self, graph_ids: DataFrame) -> list[str]:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return [escape("graph_id", r["graph_id"]) for r in graph_ids.select("graph_id").distinct().collect()]

    def _graph_ids(self, folders: list[str]) -> DataFrame:
        """The graphs of folders as listed in the log: ``_folder_names`` the other way."""
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        names = [utils.unescapePathName(f.removeprefix("graph_id=")) for f in folders]
        return self.spark.createDataFrame([(None if n == utils.DEFAULT_PARTITION_NAME() else n,) for n in names], "graph_id string")

    def compact(self, table: str) -> None:
        """Rewrite a table's live rows into one folder per graph."""
        with self.transaction():
            self._write(table, self.load(table), replace=sorted(self._state().graphs(table)))

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the ``keep`` newest versions reads; no writer may be at work. Returns how many."""
        last = self.version()
        held = {(t, c) for v in range(max(0, last - keep + 1), last + 1) for t, commits in self.log.state(v).live.items() for c in commits}
        n = 0
        for table in (*schema.TABLES, "graphs"):
            path, system = self._hadoop(self.path(table))
            for status in system.listStatus(path) if system.exists(path) else ():
                name = status.getPath().getName()
                if name.startswith("commit=") and (table, name[7:]) not in held:
                    system.delete(status.getPath(), True)
                    n += 1
        return n

    # --- rows ---

    def load(self, table: str, graph_id: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or one graph of it, as of the newest version or an earlier one; an unwritten table is empty."""
        ddl = schema.GRAPHS if table == "graphs" else schema.TABLES[table]
        df = self._read(table, ddl, self._state(version).paths(table))
        return df if graph_id is None else df.where(F.col("graph_id") == graph_id)

    def _read(self, table: str, ddl: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ddl)
        base = self.path(table)
        df = self.spark.read.schema(f"{ddl}, commit string").option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])
        return df.select(*[f.split()[0] for f in _columns(ddl)])

    def load_all(self, graph_id: str | None = None, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.load(name, graph_id, version) for name in schema.TABLES}

    def begin_batch(self, batch_id: int, stream: str = "default") -> dict[str, DataFrame]:
        """The tables as they stood when this batch of this stream first began.

        The last id of every graph is written down before anything else, so a batch tried again numbers
        its rows as before and ``append`` finds them stored already. Each stream (and each new checkpoint of
        one, as it counts its batches from 0 again) needs a name of its own.
        """
        name = f"batches/{stream}/{batch_id}"
        path = f"{self.root}/{name}"
        if not self._exists(f"{name}/_SUCCESS"):
            last = None
            for name in schema.NODE_TABLES:
                ids = self.load(name).groupBy("graph_id").agg(F.max(schema.ID_COLUMN[name]).alias("last_id")).withColumn("node_type", F.lit(name))
                last = ids if last is None else last.unionByName(ids)
            last.write.mode("overwrite").parquet(path)
        seen = self.spark.read.parquet(path)
        out = {"edges": self.load("edges")}
        for name in schema.NODE_TABLES:
            limit = seen.where(F.col("node_type") == name).select("graph_id", "last_id")
            out[name] = self.load(name).join(limit, "graph_id").where(F.col(schema.ID_COLUMN[name]) <= F.col("last_id")).drop("last_id")
        return out

    def counts(self, graph_id: str | None = None) -> DataFrame:
        return graph_stats({n: self.load(n, graph_id) for n in schema.NODE_TABLES})

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], schema.TABLES[table]).schema
        return rows.select(
            *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        )

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows that are not stored yet, so a retried batch adds nothing twice.

        A stored row with the same key and other content is no retry: that is refused, never dropped. Columns that
        were patched since do not count: a row is the same if it is what was inserted.
        """
        self._appended(table, rows)

    def _appended(self, table: str, rows: DataFrame) -> list[str]:
        """``append``; the folders of the graphs that ``rows`` are of.

        The rows are written first, so they are computed once and settled. What is stored or repeated is looked for by key and
        hash in the files then; only if there is any are the rows written again without it.
        """
        key, ddl = KEY[table], schema.TABLES[table]
        with self.transaction():
            before, shaped = copy.deepcopy(self._state()), self._shaped(table, rows)
            self._write(table, shaped)
            entry = self._open["entries"][-1]
            graphs = entry["add"].get(table, [])
            fresh = self._read(table, ddl, [f"commit={entry['commit']}"] if graphs else [])
            repeated = bool(graphs) and not fresh.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
            kept = shaped.dropDuplicates(key) if repeated else fresh
            known = None
            if graphs and before.paths(table):
                fixed = [c for c in fresh.columns if c not in before.patched.get(table, ())]
                content = lambda df: F.xxhash64(*[df[c] for c in fixed])
                stored = self._read(table, ddl, before.paths(table))
                stored = stored.select(*key, content(stored).alias("_stored")).join(fresh.select("graph_id").distinct(), "graph_id", "left_semi")
                known = checkpointed(kept.select(*key, content(kept).alias("_content")).join(stored, key))
                clash = known.where("_stored <> _content").select(*key).first()
                if clash is not None:
                    self._take_out(before)
                    self._delete(table, entry)
                    raise ValueError(f"{table}: {clash.asDict()} is stored with other content")
                known = None if known.isEmpty() else known.select(*key)
            if repeated or known is not None:
                self._take_out(before)
                self._write(table, kept if known is None else kept.join(known, key, "left_anti"))
                self._delete(table, entry)
            self._freed()
        return graphs

    def _freed(self) -> None:
        """Let Spark delete the shuffle files of what is written: it does when the driver collects its garbage, which may be much later."""
        self.spark._jvm.System.gc()

    @staticmethod
    def _balanced(rows: DataFrame) -> DataFrame:
        """Few files per graph, and several for a graph too large for one."""
        return rows.hint("rebalance", "graph_id")

    def patch(self, table: str, patch: DataFrame) -> None:
        """Change the supplied non-null fields of existing rows; only touched graphs are rewritten."""
        fields = [c for c in patch.columns if c not in KEY[table]]
        with self.transaction():
            graphs = patch.select("graph_id").distinct()
            touched = sorted(set(self._folder_names(graphs)) & self._state().graphs(table))
            if not touched:
                return
            current = self.load(table)
            change = patch.select(*KEY[table], *[F.col(c).alias(f"_{c}") for c in fields])
            merged = current.join(graphs, "graph_id", "left_semi").join(change, KEY[table], "left")
            for c in fields:
                merged = merged.withColumn(c, F.coalesce(f"_{c}", c))
            self._write(table, merged.select(*current.columns), replace=touched, patched=fields)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Patch rows that exist, append the others."""
        shaped = checkpointed(self._shaped(table, rows))
        with self.transaction():
            self.patch(table, shaped.join(self.load(table).select(*KEY[table]), KEY[table], "left_semi"))
            self.append(table, shaped)

    def get(self, table: str, graph_id: str, node_id: int) -> DataFrame:
        """The row of one id (empty if absent)."""
        return self.load(table, graph_id).where(F.col(schema.ID_COLUMN[table]) == node_id)

    # --- graphs ---

    def create_graph(self, graph_ids: DataFrame) -> None:
        with self.transaction():
            new = graph_ids.select("graph_id").distinct().join(self.load("graphs"), "graph_id", "left_anti")
            self._write("graphs", new.withColumn("created_at", F.current_timestamp()))

    def graphs(self) -> DataFrame:
        return self.load("graphs").select("graph_id").distinct().orderBy("graph_id")

    def graph_exists(self, graph_id: str) -> bool:
        return not self.load("graphs").where(F.col("graph_id") == graph_id).isEmpty()

    def delete_graph(self, graph_id: str) -> None:
        """Drop a graph from every table, the recall log included; its files go with ``vacuum``."""
        name = self._folder_names(self.spark.createDataFrame([(graph_id,)], "graph_id string"))
        with self.transaction():
            entry = {"commit": uuid.uuid4().hex, "add": {}, "replace": {t: name for t in (*schema.TABLES, "graphs")}, "patched": {}}
            self._open["state"].apply(entry)
            self._open["entries"].append(entry)

    def save_insert(self, rows: dict[str, DataFrame], batch: str | None = None) -> None:
        """Write the output of ``build.insert_batch`` as one commit.

        Ids and links come from one state: ``rows`` read folders of the version they were built on, which never change. Each
        table is computed once and written where it stays. A ``batch`` that is committed already is left as it is.
        """
        if batch is not None and self.committed(batch):
            return
        with self.transaction(batch):
            graphs = {name: self._appended(name, rows[name]) for name in ("episodic", "semantic", "tag", "procedural", "edges")}
            self.upsert("subgoal", rows["subgoal"])
            self.create_graph(self._graph_ids(sorted({*graphs["semantic"], *graphs["episodic"]})))

    def save_consolidation(self, run: dict[str, DataFrame], batch: str | None = None) -> None:
        """Write the output of ``consolidate.consolidate`` as one commit: changed facts, merged facts and all their edges.

        A ``batch`` that is committed already is left as it is.
        """
        if batch is not None and self.committed(batch):
            return
        state = ["graph_id", "semantic_id", "is_active", "credibility"]
        stored = self.load("semantic").select("graph_id", "semantic_id", F.col("is_active").alias("_active"), F.col("credibility").alias("_credibility"))
        changed = run["facts"].select(*state).join(stored, ["graph_id", "semantic_id"]).where("is_active <> _active or credibility <> _credibility")
        settled = {name: checkpointed(df) for name, df in (("changed", changed.select(*state)), ("merged", run["merged"]), ("edges", run["edges"]))}
        with self.transaction(batch):
            self.patch("semantic", settled["changed"])
            self.append("semantic", settled["merged"])
            self.append("edges", settled["edges"])


def _columns(ddl: str) -> list[str]:
    """Column definitions of a flat DDL string."""
    return [c.strip() for c in re.split(r",\s*(?![^<]*>)", ddl)]


def _summary(steps: list[dict]) -> dict[str, dict[str, list[str]]]:
    """What all steps of a commit touch, for the check against other writers."""
    out: dict[str, dict[str, list[str]]] = {"add": {}, "replace": {}}
    for part in out:
        for step in steps:
            for table, graphs in step[part].items():
                out[part][table] = sorted({*out[part].get(table, []), *graphs})
    return out


def block_of(node_id: str, size: int):
    """Block number of an id in the numbered block-file layout."""
    return F.floor(F.col(node_id) / F.lit(size)).cast("bigint")


def write_blocks(rows: DataFrame, node_id: str, size: int, path: str) -> None:
    """Block-file layout: one partition per ``id // size``; rewriting a block replaces just that block.

    A block goes to one task and becomes one file, however many tasks hold rows of it.
    """
    rows.withColumn("block", block_of(node_id, size)).repartition("block").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("block").parquet(path)


def upsert_blocks(current: DataFrame, rows: DataFrame, node_id: str, size: int) -> DataFrame:
    """Contents of the blocks touched by ``rows``, new rows winning over old ones."""
    touched = rows.select(block_of(node_id, size).alias("block")).distinct()
    kept = current.join(touched, "block", "left_semi").drop("block").join(rows.select(node_id), node_id, "left_anti")
    return kept.unionByName(rows).withColumn("block", block_of(node_id, size))


def latest_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write per key."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
