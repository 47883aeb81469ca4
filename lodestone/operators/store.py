"""A graph store: nodes, edges, indexed files, notes and settings as a log of changes.

Every method is one commit of what it changes (see ``log``): readers see whole versions of all tables alike,
a file's update writes a file's rows, and no writer's change is lost, as a commit is only taken on top of the
version it was computed from.  Methods that are refused start again from the newer version; who reads for
himself takes a ``snapshot()``, and its ``commit`` raises ``Conflict`` if another writer came first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators.log import Change, Conflict, Kept, Snapshot, TableLog
from lodestone.tables import in_order

__all__ = ["Change", "Conflict", "GraphStore", "change_status", "insert", "upsert"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and new ones whose key they lack; of new rows with one key one."""
    return old.unionByName(absent(old, new, keys))


def absent(old: DataFrame, new: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """New rows whose key the old ones lack; of new rows with one key one."""
    keys = list(keys)
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def change_status(now: DataFrame, stored: DataFrame) -> DataFrame:
    """now(repository, file_path, file_hash) with status: new, changed or unchanged."""
    old = stored.select("repository", "file_path", F.col("file_hash").alias("__old"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("file_hash"), "changed").otherwise("unchanged")
    return now.join(old, ["repository", "file_path"], "left").withColumn("status", status).drop("__old")


def _of(repository: str):
    return F.coalesce("repository", F.lit("default")) == repository


class GraphStore(TableLog):
    TABLES = {
        "nodes": Kept(schemas.NODES, ("id",)),
        "edges": Kept(schemas.EDGES, ("src", "dst", "type")),
        "indexed_files": Kept(schemas.INDEXED_FILES, ("file_path", "repository")),
        "intents": Kept(schemas.INTENTS, ("id",)),
        "meta": Kept("key STRING, value STRING", ("key",)),
    }
    KEYS = {name: list(t.keys) for name, t in TABLES.items()}
    #: Commits of a table that readers merge before the streaming index folds them.
    MERGED = 32

    def write_all(self, tables: dict[str, DataFrame], read: int) -> int:
        """Replaces tables as a whole; refused unless ``read``, the version they were made from, is the last."""
        return self.snapshot(read).commit(Change(whole=tables))

    # Nodes and edges

    def insert_nodes(self, nodes: DataFrame) -> int:
        return self.change(lambda s: Change(put={"nodes": absent(s.read("nodes"), nodes, self.KEYS["nodes"])}))

    def insert_edges(self, edges: DataFrame) -> int:
        return self.change(lambda s: Change(put={"edges": absent(s.read("edges"), edges, self.KEYS["edges"])}))

    def apply_delta(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Nodes replace those of their id, edges are added unless they exist; edges of replaced nodes stay."""
        return self.change(lambda s: Change(put={"nodes": nodes.dropDuplicates(["id"]), "edges": absent(s.read("edges"), edges, self.KEYS["edges"])}))

    def replace_files(self, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
        """What is known of some files: files are rows of indexed_files; their old nodes and the edges that
        start at those go, and so do edges of others to nodes that aren't there again."""

        def made(s: Snapshot) -> Change:
            names = files.select("repository", "file_path").distinct()
            old = s.read("nodes").join(names, ["repository", "file_path"], "left_semi").select("id")
            new = nodes.dropDuplicates(["id"])
            known = s.read("edges")
            own = old.unionByName(new.select("id")).distinct()
            lost = old.join(new.select("id"), "id", "left_anti")
            gone = known.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(*self.KEYS["edges"])
            gone = gone.unionByName(known.join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*self.KEYS["edges"])).distinct()
            return Change(put={"nodes": new, "edges": edges.dropDuplicates(self.KEYS["edges"]), "indexed_files": files}, gone={"nodes": old, "edges": gone})

        return self.change(made)

    def replace_repository(self, repository: str, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
        """What is known of a repository.  Nodes that another repository has stay its own; edges are kept
        if both ends are nodes."""

        def made(s: Snapshot) -> Change:
            out = Change()
            other = {n: s.read(n).where(~_of(repository)) for n in ("nodes", "edges", "indexed_files")}
            for n in other:
                out.gone[n] = s.read(n).where(_of(repository)).select(*self.KEYS[n])
            out.put["nodes"] = absent(other["nodes"], nodes, self.KEYS["nodes"])
            ids = other["nodes"].select("id").unionByName(nodes.select("id")).distinct()
            ends = lambda c: ids.withColumnRenamed("id", c)
            both = edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
            out.put["edges"] = absent(other["edges"], both, self.KEYS["edges"])
            out.put["indexed_files"] = files.dropDuplicates(self.KEYS["indexed_files"])
            return out

        return self.change(made)

    def update_metadata(self, changes: DataFrame) -> int:
        """Replaces the metadata of nodes; changes: id, metadata."""
        own = changes.select("id", "metadata").dropDuplicates(["id"])
        return self.change(lambda s: Change(put={"nodes": s.read("nodes").drop("metadata").join(own, "id")}))

    def _without(self, s: Snapshot, ids: DataFrame) -> Change:
        """Nodes and every edge at them go."""
        edges, out = s.read("edges"), []
        for end in ("src", "dst"):
            out.append(edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*self.KEYS["edges"]))
        return Change(gone={"nodes": ids, "edges": out[0].unionByName(out[1]).distinct()})

    def delete_nodes(self, ids: DataFrame) -> int:
        return self.change(lambda s: self._without(s, ids.select("id").distinct()))

    def remove_file(self, path: str, repository: str = "default") -> int:
        def made(s: Snapshot) -> Change:
            own = (F.col("file_path") == path) & _of(repository)
            out = self._without(s, s.read("nodes").where(own).select("id"))
            out.gone["indexed_files"] = s.read("indexed_files").where(own)
            return out

        return self.change(made)

    def clear(self) -> int:
        return self.change(lambda s: Change(whole={n: self.spark.createDataFrame([], self.TABLES[n].schema) for n in ("nodes", "edges", "indexed_files")}))

    def clear_repository(self, repository: str) -> int:
        return self.change(lambda s: Change(gone={n: s.read(n).where(_of(repository)) for n in ("nodes", "edges", "indexed_files")}))

    def node(self, id: str) -> DataFrame:
        return self.read("nodes").where(F.col("id") == id)

    def nodes_of_file(self, path: str) -> DataFrame:
        return self.read("nodes").where(F.col("file_path") == path)

    def outgoing(self, id: str) -> DataFrame:
        return self.read("edges").where(F.col("src") == id)

    def incoming(self, id: str) -> DataFrame:
        return self.read("edges").where(F.col("dst") == id)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return self.read("nodes").where(F.lower("label").contains(text.lower()) | F.lower("id").contains(text.lower())).orderBy(F.length("label"), "id").limit(limit)

    # Files, settings, annotations

    def record_files(self, files: DataFrame) -> int:
        return self.change(lambda s: Change(put={"indexed_files": files.dropDuplicates(self.KEYS["indexed_files"])}))

    def intents_of_file(self, path: str) -> DataFrame:
        """The intents noted for a file, newest first."""
        return self.read("intents").where(F.col("file_path") == path).orderBy(F.desc("created_at"), F.desc("id"))

    def unmodified(self, files: DataFrame) -> DataFrame:
        """The files (repository, path, modified: timestamp) that were indexed after they were last
        modified; they need no hash."""
        old = self.read("indexed_files").select("repository", F.col("file_path").alias("path"), "indexed_at")
        return files.join(old, ["repository", "path"]).where("modified <= indexed_at").select(*files.columns)

    def export_json(self, path: str) -> None:
        """Nodes and edges as one folder of JSON lines, each with the name of its table."""
        parts = [self.read(n).select(F.lit(n).alias("table"), F.to_json(F.struct("*")).alias("row")) for n in ("nodes", "edges")]
        parts[0].unionByName(parts[1]).write.mode("overwrite").json(path)

    def import_json(self, path: str) -> None:
        """The nodes and edges of a folder that export_json wrote, in place of the store's own."""
        rows = self.spark.read.schema("table STRING, row STRING").json(path)
        parsed = lambda n: rows.where(F.col("table") == n).select(F.from_json("row", self.TABLES[n].schema).alias("r")).select("r.*")
        self.change(lambda s: Change(whole={n: parsed(n) for n in ("nodes", "edges")}))

    def stale(self, corpus: DataFrame) -> DataFrame:
        """repository, file_path, file_hash, status of each file of a corpus, by content hash."""
        now = corpus.select("repository", F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"))
        return change_status(now, self.read("indexed_files"))

    def set_meta(self, key: str, value: str) -> int:
        return self.change(lambda s: Change(put={"meta": self.spark.createDataFrame([(key, value)], self.TABLES["meta"].schema)}))

    def get_meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row.value if row else None

    def add_intents(self, intents: DataFrame) -> int:
        """intents without ids: numbered on from the largest, in the order of their texts."""
        own = in_order(intents, "created_at", "file_path", "query_text")

        def made(s: Snapshot) -> Change:
            last = s.read("intents").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            return Change(put={"intents": own.withColumn("id", F.col("nth") + F.lit(last).cast("long"))})

        return self.change(made)

    def delete_intent(self, id: int) -> int:
        return self.change(lambda s: Change(gone={"intents": self.spark.createDataFrame([(id,)], "id long")}))

    def search_intents(self, text: str, limit: int = 20) -> DataFrame:
        hit = F.lit(False)
        for c in ("query_text", "annotation", "file_path"):
            hit = hit | F.lower(c).contains(text.lower())
        return self.read("intents").where(hit).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

