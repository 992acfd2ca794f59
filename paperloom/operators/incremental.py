"""Processing only new or changed records, with a persisted, versioned state.

The state holds, for each key, the newest row seen (its place in the order of arrival) and a hash of the content that was
last processed. A run hashes the rows that arrived, joins them with the state, drops those older than what the state has
seen, and selects what is new or changed. It writes one folder, which is both its results and its change of the state,
and then publishes a manifest that names the folder, by one rename. A run that breaks off before the rename leaves no
trace but an unnamed folder; a run repeated after it finds its batch already named and does nothing. So nothing is
skipped, nothing is repeated, and results and state cannot differ.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.runtime import scratch

#: A state of more folders than this is written anew as one.
COMPACT_AFTER = 8


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class VersionedState:
    """A folder of manifests v1, v2, ...; each names the Parquet folders that make up the state of its version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def _at(self, version: int):
        return self._path(f"{self.path}/manifests/{version:09d}.json")

    def current(self) -> int:
        """The number of the last published version; 0 before the first."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return max((int(n[:9]) for n in names if len(n) == 14 and n[:9].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of: its batch, the folders of its state, the folder of its results."""
        version = self.current() if version is None else version
        if version == 0:
            return {"version": 0, "batch": None, "state": [], "result": None}
        stream = self._fs.open(self._at(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def new_folder(self, label: str) -> str:
        return f"{self.path}/{label}-{uuid.uuid4().hex}"

    def publish(self, base: int, batch: int | None, state: list[str], result: str | None) -> int:
        """Names `state` as version base + 1 in one rename that never replaces a version; Conflict if it is taken."""
        version, draft = base + 1, self._path(f"{self.path}/draft-{uuid.uuid4().hex}")
        if self.current() != base:
            raise Conflict(f"version {version} of {self.path} is taken")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "batch": batch, "state": state, "result": result}).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.valueOf("NONE")
        try:
            self._files.rename(draft, self._at(version), options)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is taken") from e
        return version

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """All rows of a version's state, several a key where a later run changed it; None for an empty state."""
        folders = (self.manifest() if manifest is None else manifest)["state"]
        return self.spark.read.schema(STATE).parquet(*folders) if folders else None

    def results(self) -> DataFrame:
        """(batch, and the fields of a row): what each published run processed."""
        folders = [m["result"] for v in range(1, self.current() + 1) if (m := self.manifest(v))["result"]]
        empty = self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(*folders) if folders else empty
        return rows.filter("now").select("batch", "file_id", "sha256", "form", "version")


#: seen_at, seen_id: the newest row seen of the file; sha256, form: the content last processed, null before; now: whether
#: the run of `version` processed it; form is a hash of size and modification time.
STATE = "file_id long, seen_at timestamp, seen_id long, sha256 string, form long, version long, batch long, now boolean"


def content_form(size: Column, mtime: Column) -> Column:
    """A hash of size and modification time, which stand for the content where its own hash is unknown; nulls count."""
    return F.xxhash64(size.isNull(), size, mtime.isNull(), mtime)


def same_content(a: str, b: str) -> Column:
    """Both hashes known and equal; where either is null, equal forms."""
    c = lambda side, k: F.col(f"{side}.{k}")
    known = c(a, "sha256").isNotNull() & c(b, "sha256").isNotNull()
    return F.when(known, c(a, "sha256") == c(b, "sha256")).otherwise(c(a, "form").eqNullSafe(c(b, "form")))


_FIRST_ID = -(2**63)


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each file, hashed: by arrived_at, then log_id. Partial aggregation, so a hot file costs no skew."""
    rows = log.filter(F.col("file_id").isNotNull() & F.col("arrived_at").isNotNull()).withColumn("seen_id", F.coalesce("log_id", F.lit(_FIRST_ID))).withColumn("form", content_form(F.col("size"), F.col("mtime")))
    newest = rows.groupBy("file_id").agg(F.max_by(F.struct("arrived_at", "seen_id", "sha256", "form", "status", "attempts"), F.struct("arrived_at", "seen_id")).alias("r"))
    return newest.select("file_id", F.col("r.arrived_at").alias("seen_at"), "r.seen_id", "r.sha256", "r.form", "r.status", "r.attempts")


def newest_state(rows: DataFrame) -> DataFrame:
    """One row a file of a state that several runs have written."""
    rest = ["seen_at", "seen_id", "sha256", "form", "version", "batch", "now"]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("file_id", "r.*")


def select_changes(delta: DataFrame, state: DataFrame | None, max_attempts: int = 3) -> DataFrame:
    """The rows of delta (latest()) that the state hasn't seen, with `now`: whether the file must be processed, being eligible
    and new or of other content than what was last processed; kept_sha256, kept_form are the latter's.

    A null status counts as eligible, null attempts as none.
    """
    eligible = F.coalesce(~F.col("d.status").isin("missing", "skipped"), F.lit(True)) & (F.coalesce("d.attempts", F.lit(0)) < max_attempts)
    if state is None:
        none = delta.alias("d").select("d.*", F.lit(None).cast("string").alias("kept_sha256"), F.lit(None).cast("long").alias("kept_form"), eligible.alias("now"))
        return none
    # Only the state's rows of files in delta are needed: as long as delta is small, the state isn't shuffled.
    touched = newest_state(state.join(delta.select("file_id"), "file_id", "left_semi"))
    joined = delta.alias("d").join(touched.alias("s"), F.col("d.file_id") == F.col("s.file_id"), "left")
    later = F.col("s.file_id").isNull() | (F.struct("d.seen_at", "d.seen_id") > F.struct("s.seen_at", "s.seen_id"))
    never = F.col("s.form").isNull()
    return joined.filter(later).select("d.*", F.col("s.sha256").alias("kept_sha256"), F.col("s.form").alias("kept_form"), (eligible & (never | ~same_content("d", "s"))).alias("now"))


def incremental_run(store: VersionedState, delta: DataFrame, batch: int | None = None, max_attempts: int = 3) -> DataFrame:
    """One run over delta, the rows that arrived since the run before (file_id, log_id, arrived_at, sha256, size, mtime, status,
    attempts). Returns the rows processed, from the published folder.

    batch: the run's number in a source that may repeat its last one; a batch that the state already holds changes nothing
    and returns what it gave then. Rows older than what the state has seen are dropped, whatever the run they come in; rows
    without file_id or arrived_at are no records. Files outside delta need no look.
    """
    manifest = store.manifest()
    if batch is not None and manifest["batch"] is not None and batch <= manifest["batch"]:
        return store.results().filter(F.col("batch") == batch)
    version = manifest["version"] + 1
    rows = select_changes(latest(delta), store.read(manifest), max_attempts)
    fresh = lambda k: F.when(F.col("now"), F.col(k)).otherwise(F.col(f"kept_{k}")).alias(k)
    folder = store.new_folder(f"run-{version:09d}")
    rows.select("file_id", "seen_at", "seen_id", fresh("sha256"), fresh("form"), F.lit(version).cast("long").alias("version"), F.lit(batch).cast("long").alias("batch"), "now").write.parquet(folder)
    state = [*manifest["state"], folder]
    if len(state) > COMPACT_AFTER:
        whole = store.new_folder(f"state-{version:09d}")
        newest_state(store.read({"state": state})).write.parquet(whole)
        state = [whole]
    store.publish(manifest["version"], batch if batch is not None else manifest["batch"], state, folder)
    return store.spark.read.schema(STATE).parquet(folder).filter("now").select("batch", "file_id", "sha256", "form", "version")


def replay(log: DataFrame, runs: DataFrame, max_attempts: int = 3, path: str | None = None) -> DataFrame:
    """(run_id, file_id) that each successful run of `runs` had to process, by incremental runs over `log` in order of time.

    `runs` is a stated list of runs. A run that isn't 'ok' leaves no trace. Rows without an arrival time are never seen.
    Without an ok run, or with an empty log, the result is empty. Repeated rows change nothing. path: where the arrivals
    and the state are kept.
    """
    spark = log.sparkSession
    path = path or scratch(spark, "incremental")
    ok = [(r.run_id, r.started_at) for r in runs.filter("outcome = 'ok' and started_at is not null").select("run_id", F.col("started_at").cast("timestamp")).distinct().orderBy("started_at", "run_id").collect()]
    fields = log.select(F.col("log_id").cast("long"), F.col("file_id").cast("long"), F.col("arrived_at").cast("timestamp"), F.col("sha256").cast("string"), F.col("size").cast("long"), F.col("mtime").cast("double"), F.col("status").cast("string"), F.col("attempts").cast("int"))
    if not ok:
        return spark.createDataFrame([], "run_id long, file_id long")
    # One pass sorts the log by run: each run then reads only its own folder.
    starts = F.array(*(F.lit(t) for _, t in ok))
    slotted = fields.filter(F.col("arrived_at").isNotNull()).withColumn("slot", F.size(F.filter(starts, lambda t: t < F.col("arrived_at")))).filter(F.col("slot") < len(ok))
    order = F.struct("arrived_at", F.coalesce("log_id", F.lit(_FIRST_ID)))
    rest = ["log_id", "arrived_at", "sha256", "size", "mtime", "status", "attempts"]
    newest = slotted.groupBy("slot", "file_id").agg(F.max_by(F.struct(*rest), order).alias("row")).select("slot", "file_id", "row.*")
    # Files of even size, as many a slot as its rows need.
    newest.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{path}/log")
    arrived = spark.read.schema(newest.schema).parquet(f"{path}/log")
    store = VersionedState(spark, f"{path}/state")
    for i in range(len(ok)):
        incremental_run(store, arrived.filter(F.col("slot") == i).drop("slot"), i, max_attempts)
    numbers = F.create_map(*(F.lit(x) for i, (run_id, _) in enumerate(ok) for x in (i, run_id)))
    return store.results().select(numbers[F.col("batch").cast("int")].alias("run_id"), "file_id")
