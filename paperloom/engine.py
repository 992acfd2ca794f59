"""The engine of a collection: folders are read into versioned tables, indexed, searched, reported on and evaluated.

A store is a folder with versions of the tables files, pages, parts and mails; a run writes a new version beside the old one
and publishes it in one rename, so that readers see a whole collection or the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import kind_by_extension
from paperloom.operators import collection as co
from paperloom.operators import expand as ex
from paperloom.operators import search as se
from paperloom.operators.incremental import VersionedState
from paperloom.operators.index import Index, build
from paperloom.operators.query import compile_queries
from paperloom.sources import readers as rd

FILES = "id long, root_id long, root string, relpath string, ext string, kind string, size long, mtime double, sha256 string, status string, error string, attempts int, pages int, ocr_pages int, text_chars long, min_conf double"
TABLES = {
    "files": FILES,
    "pages": "id long, file_id long, page_no int, text string, source string, ocr_conf double",
    "parts": "file_id long, part_no int, first_page int, n_pages int, kind string, name string, mime string, size long, sha256 string, mime_path string, note string, retryable boolean, content_revision int",
    "mails": "file_id long, subject string, sender string, recipients string, sent_at string, message_id string",
}
REVISION = 1


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Opens and reads files where the task runs; errors become values."""
    from pyarrow import fs

    for pdf in batches:
        rows = []
        for key, path, relpath in zip(pdf["key"], pdf["path"], pdf["relpath"]):
            try:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner) as f:
                    data = f.read()
                rows.append((key, hashlib.sha256(data).hexdigest(), rd.read_file(data, rd.kind_of(data), relpath)))
            except OSError as e:
                rows.append((key, None, {"mail": None, "pages": [], "parts": [], "error": f"{type(e).__name__}: {e}"[:200]}))
        yield pd.DataFrame({"key": [r[0] for r in rows], "sha256": [r[1] for r in rows], **{x: [r[2][x] for r in rows] for x in ("mail", "pages", "parts", "error")}})


class Engine:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self.state = VersionedState(spark, f"{self.store}/tables")

    def table(self, name: str) -> DataFrame:
        """A table of the current version; empty before the first run."""
        folders = self.state.manifest()["state"]
        return self.spark.read.schema(TABLES[name]).parquet(f"{folders[0]}/{name}") if folders else self.spark.createDataFrame([], TABLES[name])

    def roots(self) -> DataFrame:
        """(root_id, root, files) of the collection."""
        return self.table("files").groupBy("root_id", "root").agg(F.count_if(F.col("status") != "missing").alias("files"))

    def ingest(self, folders: list[str], confirm_missing: bool = False, limit: int | None = None) -> dict[str, int]:
        """One run over `folders`, a stated list: new and changed files are read, gone ones are marked unless too many are gone.

        limit: most files to read in this run; the others stay pending. Returns how many files changed in what way.
        """
        known = self.table("files")
        numbers = {r.root: r.root_id for r in known.select("root", "root_id").distinct().collect()}
        listing = None
        for folder in folders:
            numbers.setdefault(folder, max(numbers.values(), default=0) + 1)
            one = rd.scan(self.spark, folder).select(F.lit(numbers[folder]).cast("long").alias("root_id"), F.lit(folder).alias("root"), "path", "relpath", "size", "mtime")
            listing = one if listing is None else listing.unionByName(one)
        ours = known.filter(F.col("root_id").isin([numbers[f] for f in folders]))
        delta = co.scan_delta(ours, listing)
        held = delta.limit(0).select("root_id") if confirm_missing else co.held_back(delta).filter("held").select("root_id")
        change = delta.join(held.withColumn("held", F.lit(True)), "root_id", "left").withColumn("change", F.when((F.col("change") == "gone") & F.col("held"), "unchanged").otherwise(F.col("change"))).drop("held")
        rows = change.join(listing, ["root_id", "relpath"], "left").join(known.select("root_id", "relpath", F.col("id").alias("known_id")), ["root_id", "relpath"], "left")
        waiting = ours.filter("status = 'pending'").select("root_id", "relpath", F.lit(True).alias("waiting"))
        rows = rows.join(waiting, ["root_id", "relpath"], "left")
        todo = rows.filter("change in ('new', 'changed', 'restored') or (waiting and change = 'unchanged' and path is not null)")
        # Numbers are hashes of root and path: they need no counting through all files, and a file read again keeps its own.
        key = F.coalesce("known_id", F.xxhash64("root_id", "relpath").bitwiseAND(F.lit(2**62 - 1)))
        named = todo.withColumn("key", key).withColumn("ext", F.lower(F.regexp_extract("relpath", r"\.([^./]+)$", 1))).withColumn("kind", kind_by_extension(F.col("ext")))
        folder = self.state.new_folder("version")
        named = named.orderBy(F.when(F.col("kind") == "mail", 1).otherwise(0), "root_id", "relpath").limit(limit) if limit else named
        named.write.parquet(f"{folder}/todo")
        named = self.spark.read.parquet(f"{folder}/todo")
        named.select("key", "path", "relpath").mapInPandas(_read, f"key long, sha256 string, {rd.EXTRACTED}").write.parquet(f"{folder}/read")
        read = self.spark.read.schema(f"key long, sha256 string, {rd.EXTRACTED}").parquet(f"{folder}/read")
        self._write(folder, known, change, named, read)
        manifest = self.state.manifest()
        self.state.publish(manifest["version"], None, [folder], None)
        return {r.change: r.n for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}

    def _write(self, folder: str, known: DataFrame, change: DataFrame, named: DataFrame, read: DataFrame) -> None:
        done = read.select(F.col("key").alias("file_id"))
        got = read.select(F.col("key").alias("file_id"), F.posexplode("pages").alias("i", "p")).select(F.xxhash64("file_id", "p.page_no").bitwiseAND(F.lit(2**62 - 1)).alias("id"), "file_id", "p.page_no", "p.text", "p.source", F.lit(None).cast("double").alias("ocr_conf"))
        failed = read.filter("error is not null").select(F.col("key").alias("file_id"))
        # A file that can't be read now keeps its old pages.
        replaced = done.join(failed, "file_id", "left_anti")
        pages = co.without_files(self.table("pages"), replaced).unionByName(got)
        parts = read.select(F.col("key").alias("file_id"), F.explode("parts").alias("p")).select("file_id", "p.part_no", "p.first_page", "p.n_pages", "p.kind", "p.name", "p.mime", "p.size", "p.sha256", "p.mime_path", "p.note", F.lit(False).alias("retryable"), F.lit(REVISION).alias("content_revision"))
        mails = read.filter("mail is not null").select(F.col("key").alias("file_id"), "mail.*")
        pages.write.parquet(f"{folder}/pages")
        co.without_files(self.table("parts"), replaced).unionByName(parts).write.parquet(f"{folder}/parts")
        co.without_files(self.table("mails"), replaced).unionByName(mails).write.parquet(f"{folder}/mails")
        stats = co.file_statistics(self.spark.read.schema(TABLES["pages"]).parquet(f"{folder}/pages")).withColumnRenamed("file_id", "key")
        status = F.when(F.col("error").isNull(), "done").when(F.col("error").startswith("no reader"), "skipped").otherwise("error")
        fresh = named.drop("change").join(read.select("key", "sha256", "error"), "key").join(stats, "key", "left").select(F.col("key").alias("id"), "root_id", "root", "relpath", "ext", "kind", "size", "mtime", "sha256", status.alias("status"), "error", F.lit(1).alias("attempts"), F.col("pages").cast("int"), F.col("ocr_pages").cast("int"), "text_chars", "min_conf")
        old = known.join(fresh.select("id"), "id", "left_anti").join(change, ["root_id", "relpath"], "left")
        state = F.when(F.col("change") == "gone", "missing").when(F.col("change").isin("new", "changed", "restored"), "pending").otherwise(F.col("status"))
        old.withColumn("status", state).select(*fresh.columns).unionByName(fresh).write.parquet(f"{folder}/files")

    def remove_root(self, root: str) -> None:
        """A folder out of the collection, with the pages, parts and mails of its files."""
        gone = self.table("files").filter(F.col("root") == root).select(F.col("id").alias("file_id"))
        folder = self.state.new_folder("version")
        for name in TABLES:
            co.without_files(self.table(name), gone, "id" if name == "files" else "file_id").write.parquet(f"{folder}/{name}")
        self.state.publish(self.state.manifest()["version"], None, [folder], None)

    def index(self) -> Index:
        """The index of the current version, built if there is none yet."""
        folder = f"{self.store}/index-{self.state.current():09d}"
        path = self.state._path(f"{folder}/files/_SUCCESS")
        if self.state._fs.exists(path):
            return Index(self.spark, folder)
        return build(self.spark, folder, self.table("pages"), self.table("files"), self.table("parts"))

    def search(self, questions: list[tuple[int, str]], k: int = 10, synonyms: DataFrame | None = None) -> DataFrame:
        """The k best contents of each question, with path and snippet."""
        index = self.index()
        alts, groups = compile_queries(self.spark, questions)
        wide, n_parts = ex.expand(alts, groups, index.table("vocabulary"), ex.synonym_pairs(synonyms) if synonyms is not None else None)
        hits = se.search(index, wide, groups, n_parts, se.references(self.table("parts"), index.table("files")), k)
        terms = wide.filter(~F.col("alt").rlike("[*: ]")).groupBy("qid").agg(F.collect_set("alt").alias("terms"))
        named = hits.join(self.table("files").select(F.col("id").alias("file_id"), "root", "relpath", F.col("status").alias("state")), "file_id").join(terms, "qid", "left")
        shown = named.join(self.table("pages").select("file_id", "page_no", "text"), ["file_id", "page_no"]).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
        return se.snippets(shown).select("qid", "rank", "root", "relpath", "page_no", "score", "copies", "matched", "missing", (F.col("state") != "done").alias("outdated"), "snippet", "locations")

    def evaluate(self, questions: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """(metrics, rows) of a list of questions with the files they should find: rank, page and cause of each."""
        q = questions.withColumn("qid", F.xxhash64("suche", "datei").bitwiseAND(F.lit(2**31 - 1)).cast("int")).distinct()
        hits = self.search([(r.qid, r.suche) for r in q.select("qid", "suche").collect()], 50)
        targets = co.find_targets(q, self.table("files"))
        where = hits.select("qid", "rank", F.explode("locations").alias("l")).select("qid", "rank", "l.file_id", "l.page_no")
        found = where.join(targets, ["qid", "file_id"]).groupBy("qid", "file_id").agg(F.min(F.struct("rank", "page_no")).alias("f"))
        ranks = q.select("qid", "suche", "datei", "seite").join(targets, "qid", "left").join(found, ["qid", "file_id"], "left").select("qid", "suche", "datei", "file_id", "f.rank", (F.col("seite").isNull() | (F.col("f.page_no") == F.col("seite"))).alias("page_right"))
        return co.retrieval_metrics(ranks, k), ranks.join(co.causes(ranks, self.table("files"), k), "qid", "left")

    def report(self) -> dict[str, DataFrame]:
        """States, problems, copies, attachments and doubtful pages."""
        files = self.table("files")
        return {"status": files.groupBy("status", "kind").agg(F.count("*").alias("n")), "problems": co.problems(files), "duplicates": co.duplicate_count(files), "parts": co.part_statistics(self.table("parts")), "doubtful": co.doubtful_pages(self.table("pages"))}
