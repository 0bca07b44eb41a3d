"""File-change streams: filtered, debounced, and folded into an index."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.functions.names import language_of
from quarry.operators.filters import hidden, ignored_dir, ignored_extension
from quarry.operators.symbols import extract_symbols
from quarry.sources.files import MAX_FILE_SIZE

SCHEMA = "project string, path string, ts timestamp, op string, size long, modified timestamp, content string"


def read_changes(spark: SparkSession, path: str, schema: str = SCHEMA, form: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger).load(path)


def filter_changes(changes: DataFrame, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The batch filters on each event; a change beyond the size limit counts as a delete, so no stale entry stays."""
    path = F.col("path")
    own = changes.where(~ignored_dir(path) & ~ignored_extension(path) & ~hidden(path))
    return own.withColumn("op", F.when(F.col("size") > max_file_size, "delete").otherwise(F.col("op")))


def debounce(changes: DataFrame, gap: str = "500 milliseconds", late: str | None = "10 seconds") -> DataFrame:
    """A path's burst becomes one event, its last state, once the gap has passed; late None: a batch."""
    own = changes.withWatermark("ts", late) if late else changes
    state = [c for c in changes.columns if c not in ("project", "path", "ts")]
    out = own.groupBy("project", "path", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", *state)).alias("e"), F.count("*").alias("n_events"))
    return out.select("project", "path", F.col("w.start").alias("burst_start"), "e.*", "n_events")


def latest(changes: DataFrame) -> DataFrame:
    """The last event of each path; by modified where it is set, so that a late older event changes nothing."""
    state = [c for c in changes.columns if c not in ("project", "path")]
    return changes.groupBy("project", "path").agg(F.max(F.struct(F.coalesce("modified", "ts").alias("at"), *state)).alias("e")).select("project", "path", *[F.col(f"e.{c}") for c in state])


def apply_changes(files: DataFrame, delta: DataFrame) -> DataFrame:
    """files (project, path, size, modified, language, content) after the last changes; an older change never replaces a newer file."""
    last = latest(delta)
    same = F.col("project").eqNullSafe(F.col("own")) & (F.col("path") == F.col("at_path"))
    held = files.selectExpr("project as own", "path as at_path", "modified as held")
    fresh = last.join(held, same, "left").where("held is null or coalesce(modified, ts) >= held").drop("own", "at_path", "held")
    rest = files.join(fresh.selectExpr("project as own", "path as at_path"), same, "left_anti")
    new = fresh.where("op != 'delete'").select("project", "path", "size", F.coalesce("modified", "ts").alias("modified"), language_of(F.col("path")).alias("language"), "content")
    return rest.unionByName(new)


class Index:
    """A files and a symbols table under a path, kept by project (a null project is one like others).

    A batch writes the new state of the projects that it touches to folders of its own, then one small file commits/<batch> that names
    them alone and ends with a row of its own kind.  Nothing is overwritten: a reader takes the last ended commit, so it never sees half a batch, and a crash
    before the commit leaves what was there.  A batch that is applied again is skipped.  Every `snapshot_every`th commit names all projects, so
    a reader folds few of them; versions and commits stay tables, never a list on the driver.  `vacuum` removes what no kept commit names.
    """

    FILES = "project string, path string, size long, modified timestamp, language string, content string"
    COMMIT = "kind string, batch long, project string, version string"

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 20):
        self.spark, self.path, self.snapshot_every = spark, path.rstrip("/"), snapshot_every

    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _listed(self, name: str) -> dict[str, int]:
        """The folders under a name, with the time at which each was made."""
        fs, path = self._hadoop(name)
        return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(path)} if fs.exists(path) else {}

    def commits(self) -> list[int]:
        """The batches whose commits have ended, in order."""
        found = sorted(int(x) for x in self._listed("commits") if x.isdigit())
        if not found:
            return []
        ended = self.spark.read.schema(self.COMMIT).json([f"{self.path}/commits/{x}" for x in found]).where("kind in ('end', 'full')")
        return sorted(r["batch"] for r in ended.select("batch").collect())

    def versions(self, batch: int | None = None) -> DataFrame:
        """project and version as of a batch, or as of the last one: what the last full commit before it names, after all later ones."""
        ended = [x for x in self.commits() if batch is None or x <= batch]
        if not ended:
            return self.spark.createDataFrame([], "project string, version string")
        rows = self.spark.read.schema(self.COMMIT).json([f"{self.path}/commits/{x}" for x in ended])
        full = rows.where("kind = 'full'").agg(F.max("batch")).first()[0]
        rows = rows.where("kind = 'project'").where(F.col("batch") >= F.lit(ended[0] if full is None else full))
        return rows.groupBy("project").agg(F.max_by("version", "batch").alias("version"))

    def current(self) -> tuple[int, dict[str | None, str]]:
        """(last batch, version of each project), for an index whose projects are few."""
        return (self.commits() or [-1])[-1], {r["project"]: r["version"] for r in self.versions().collect()}

    def table(self, name: str, versions: DataFrame) -> DataFrame:
        """The rows of the projects and versions named; version is the partition column, so other versions' folders are not read."""
        empty = self.spark.createDataFrame([], self.FILES)
        schema = empty.schema if name == "files" else extract_symbols(empty).schema
        if not self._listed(name):
            return self.spark.createDataFrame([], schema)
        held = StructType([*schema.fields, StructField("version", StringType())])
        # Folders of a batch that died hold no success mark, and no commit names them.
        all_ = self.spark.read.schema(held).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        wanted = versions.selectExpr("project as own", "version as at")
        return all_.join(wanted, F.col("project").eqNullSafe(F.col("own")) & (F.col("version") == F.col("at"))).select(*schema.names)

    def files(self, batch: int | None = None) -> DataFrame:
        return self.table("files", self.versions(batch))

    def symbols(self, batch: int | None = None) -> DataFrame:
        return self.table("symbols", self.versions(batch))

    def apply(self, delta: DataFrame, batch: int) -> None:
        """One batch of changes: only the projects in it are read and written."""
        ended = self.commits()
        if ended and batch <= ended[-1]:
            return
        version = f"{batch}-{uuid.uuid4().hex[:8]}"
        before, touched = self.versions(), delta.select(F.col("project").alias("own")).distinct()
        own = before.join(touched, F.col("project").eqNullSafe(F.col("own")), "left_semi")
        apply_changes(self.table("files", own), delta).write.parquet(f"{self.path}/files/version={version}")
        new = self.spark.read.schema(self.FILES).parquet(f"{self.path}/files/version={version}")
        paths = delta.selectExpr("project as own", "path as at").distinct()
        same = F.col("project").eqNullSafe(F.col("own")) & (F.col("path") == F.col("at"))
        kept = self.table("symbols", own).join(paths, same, "left_anti")
        again = extract_symbols(new.join(paths, same, "left_semi"))
        kept.unionByName(again).write.parquet(f"{self.path}/symbols/version={version}")
        rows = touched.selectExpr("'project' as kind", "own as project", f"'{version}' as version")
        full = len(ended) % self.snapshot_every == self.snapshot_every - 1
        if full:
            rows = rows.unionByName(before.join(touched, F.col("project").eqNullSafe(F.col("own")), "left_anti").selectExpr("'project' as kind", "project", "version"))
        end = self.spark.createDataFrame([("full" if full else "end", None, None)], "kind string, project string, version string")
        # The folder gets its success mark, and commits() its end row, when all rows are there.
        rows.unionByName(end).withColumn("batch", F.lit(batch).cast("long")).select("kind", "batch", "project", "version").coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{batch}")

    def vacuum(self, keep_commits: int = 2, min_age_seconds: float = 3600) -> list[str]:
        """Mark and sweep: removes the versions that none of the last commits' states names, and returns them.

        A reader of a state that is kept goes on reading it.  Folders younger than `min_age_seconds` stay, since a batch may be writing them.
        """
        ended = self.commits()
        marked: set[str] = set()
        for batch in ended[-max(1, keep_commits) :]:
            marked |= {r["version"] for r in self.versions(batch).select("version").distinct().collect()}  # as many as kept batches that still count
        gone = []
        for name in ("symbols", "files"):
            fs, _ = self._hadoop(name)
            for folder, made in self._listed(name).items():
                if folder.startswith("version=") and folder[8:] not in marked and time.time() - made / 1000 >= min_age_seconds:
                    fs.delete(self._hadoop(f"{name}/{folder}")[1], True)
                    gone.append(f"{name}/{folder}")
        return gone


def maintain_index(changes: DataFrame, index_path: str, checkpoint: str, once: bool = True, gap: str | None = None, late: str = "10 seconds"):
    """A streaming query that keeps an Index fresh.  With a gap, a path's burst is applied as one event once the gap has passed; else
    every micro-batch applies the last event of each path at once."""
    index = Index(changes.sparkSession, index_path)
    own = filter_changes(changes)
    if gap:
        own = debounce(own, gap, late).drop("burst_start", "n_events")
    writer = own.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: index.apply(df, batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
