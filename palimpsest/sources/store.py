"""A versioned table: states named by content, branches and tags, as rows of three Parquet tables.

``changes`` has one row for each page that a commit touched, in a folder of the commit;
``manifests`` one row for each commit; ``refs`` the history of every branch and tag, the
newest row of which counts. Forking, tagging and rewinding write one row of refs and no data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_OVERLAY_DEPTH
from ..errors import Conflict, InvalidPage, Missing, NoSuchRef, RefExists
from ..operators import versions

CHANGES = "page_no long, page_id string"
MANIFESTS = "manifest string, parent string, overlay_base string, depth int, page_count long, created_at_ms long"
REFS = "seq long, kind string, name string, manifest string"
ROOT = "0" * 64


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, pool: str):
        self.spark, self.path, self.pool = spark, f"{path.rstrip('/')}/pool={pool}", pool

    def _read(self, name: str, schema: str) -> DataFrame:
        # rows from JVM-side reading; a table that was never written is empty
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(conf).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def refs(self) -> DataFrame:
        """(kind, name, manifest), the newest of each; deleted ones are gone."""
        newest = self._read("refs", REFS).groupBy("kind", "name").agg(F.max_by("manifest", "seq").alias("manifest"))
        return newest.where("manifest is not null")

    def _move(self, kind: str, name: str, manifest: str | None) -> None:
        seq = self._read("refs", REFS).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        # only one writer can make the file of a number
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/moves/{seq}")
        if not place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).createNewFile(place):
            raise Conflict(f"another writer has made move {seq}")
        self._append("refs", [(seq, kind, name, manifest)], REFS)

    def _ref(self, kind: str, name: str) -> str | None:
        row = self.refs().where((F.col("kind") == kind) & (F.col("name") == name)).first()
        return row["manifest"] if row else None

    def head(self, branch: str) -> str:
        found = self._ref("branch", branch)
        if found is None:
            raise NoSuchRef(branch)
        return found

    def branch(self, name: str, at: str = ROOT) -> None:
        if self._ref("branch", name) is not None:
            raise RefExists(name)
        self._manifest(at)
        self._move("branch", name, at)

    def tag(self, name: str, at: str) -> None:
        """The same target again is fine, another one is not."""
        old = self._ref("tag", name)
        if old not in (None, at):
            raise RefExists(name)
        if old is None:
            self._manifest(at)
            self._move("tag", name, at)

    def rewind(self, branch: str, to: str) -> str:
        """Moves an existing branch; returns where it was."""
        old = self.head(branch)
        self._manifest(to)
        self._move("branch", branch, to)
        return old

    def restore(self, name: str, branch: str, at_ms: int) -> str:
        """A new branch at the newest state in another one's history that was made at ``at_ms`` or before; returns that state."""
        past = self._read("manifests", MANIFESTS).where(F.col("created_at_ms") <= at_ms).select(F.col("manifest").alias("node"))
        row = self.ancestors(self.head(branch)).join(past, "node").orderBy("distance").first()
        found = row["node"] if row else ROOT
        self.branch(name, found)
        return found

    def delete_branch(self, name: str) -> None:
        self.head(name)
        self._move("branch", name, None)

    def _manifest(self, manifest: str) -> dict:
        if manifest == ROOT:
            return {"manifest": ROOT, "parent": None, "overlay_base": None, "depth": 0, "page_count": 0}
        row = self._read("manifests", MANIFESTS).where(F.col("manifest") == manifest).first()
        if row is None:
            raise Missing(manifest)
        return row.asDict()

    def _chain(self, manifest: str) -> list[str]:
        """A manifest and those it lies on, newest first: at most ``MAX_OVERLAY_DEPTH`` + 1."""
        out: list[str] = []
        while manifest and manifest != ROOT:
            out.append(manifest)
            if len(out) > MAX_OVERLAY_DEPTH + 1:
                raise Missing(f"the chain of {out[0]} has no end")
            manifest = self._manifest(manifest)["overlay_base"]
        return out

    def as_of(self, manifest: str) -> DataFrame:
        """The map (page_no, page_id) of a state; reads the folders of its chain only."""
        parts = [self.spark.read.schema(CHANGES).parquet(f"{self.path}/changes/{m}").withColumn("hop", F.lit(hop)) for hop, m in enumerate(self._chain(manifest))]
        if not parts:
            return self.spark.createDataFrame([], CHANGES)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return versions.resolve(whole)

    def commit(self, branch: str, changes: DataFrame, now_ms: int, base: str | None = None) -> str:
        """Applies (page_no, page_id or null) to a branch and returns its new state, or the old one if nothing changes.

        ``base`` is the state that the changes were made on: a branch that has moved since is
        a ``Conflict``, and so is another writer's move at the same time. A page may be staged
        once. The changes are written first and the reference last, so a failure
        between leaves an unused folder.
        """
        head = self.head(branch)
        if base not in (None, head):
            raise Conflict(f"{branch} is at {head}, the changes are based on {base}")
        old = self._manifest(head)
        before = self.as_of(head)
        effects = versions.checkpointed(versions.derive(before, changes))
        delta = effects.agg(F.sum("delta").alias("d"), F.count_if(F.col("effect") != "none").alias("n"), F.count("*").alias("rows"), F.countDistinct("page_no").alias("pages")).first()
        if delta["rows"] != delta["pages"]:
            raise InvalidPage("a page is staged twice, or has no number")
        if not delta["n"]:
            return head
        flat = old["depth"] >= MAX_OVERLAY_DEPTH
        staged = effects.select("page_no", "page_id")
        rows = versions.checkpointed(versions.applied(before, staged)) if flat else staged
        each = rows.select("page_no", F.sha2(F.concat_ws(":", F.col("page_no").cast("string"), F.coalesce("page_id", F.lit("-"))), 256).alias("h"))
        manifest = hashlib.sha256("|".join([head, str(now_ms), str(flat), versions.digest(each)]).encode()).hexdigest()
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/{manifest}")
        depth = 0 if flat else old["depth"] + 1
        self._append("manifests", [(manifest, head, None if flat else head, depth, old["page_count"] + delta["d"], now_ms)], MANIFESTS)
        self._move("branch", branch, manifest)
        return manifest

    def ancestors(self, manifest: str) -> DataFrame:
        """(node, distance) along parents, from a state to the root."""
        edges = self._read("manifests", MANIFESTS).select(F.col("manifest").alias("child"), "parent")
        roots = self.spark.createDataFrame([(manifest,)], "node string")
        return versions.closure(edges, roots).select("node", "distance")

    def merge_base(self, a: str, b: str) -> str | None:
        return versions.merge_base(self.ancestors(a), self.ancestors(b)).first()["merge_base"]

    def diff(self, old: str, new: str) -> DataFrame:
        return versions.diff(self.as_of(old), self.as_of(new))

    def diff3(self, a: str, b: str) -> DataFrame:
        return versions.diff3(self.as_of(self.merge_base(a, b) or ROOT), self.as_of(a), self.as_of(b))

    def unreachable(self) -> DataFrame:
        """States that no branch or tag leads to, by parents and overlay bases: what may be removed."""
        m = self._read("manifests", MANIFESTS)
        edges = m.select(F.col("manifest").alias("child"), "parent").union(m.select("manifest", "overlay_base")).where("parent is not null").distinct()
        live = versions.flood(edges, self.refs().select("manifest").distinct()).select(F.col("node").alias("manifest"))
        return m.select("manifest").join(live, "manifest", "left_anti")
