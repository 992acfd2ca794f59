"""Inverted index: postings of bodies and paths, vocabulary, and what the search must know of each page; as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import fold, index_terms, let, path_index_text, words
from paperloom.operators.collection import parts_of_pages, segments

#: Folders that the postings are spread over by term: a search opens only those of its terms.
BUCKETS = 64
# Words that stand where a document of several pages begins.
STARTS = ["seite 1 von", "blatt 1 von", "seite 1 1"]


def postings(pages: DataFrame, page: str = "page_id", file: str = "file_id", text: str = "text", typed: bool = True, parts: int | None = None) -> DataFrame:
    """(page, file, field, term, at): a row for each term of a page's body, with its positions. Null texts have none.

    Typed tokens follow the words, so that positions agree with the index text. Texts are shuffled once by page; their terms,
    several times as much, are then grouped in place, in so many partitions as `parts` says, or as the session has.
    """
    body = let(index_terms(F.col(text)), lambda x: F.concat(x["words"], x["extra"])) if typed else words(fold(F.col(text)))
    placed = pages.filter(F.length(text) > 0).select(page, file, text).repartition(*([parts] if parts else []), page)
    spread = placed.select(page, file, F.posexplode(body).alias("pos", "term"))
    return spread.groupBy(page, file, "term").agg(F.array_sort(F.collect_list("pos")).alias("at")).withColumn("field", F.lit("body"))


def path_postings(files: DataFrame, file: str = "id", path: str = "relpath", typed: bool = False) -> DataFrame:
    """(file, term, at) of the paths."""
    spread = files.select(F.col(file).alias("file_id"), F.posexplode(F.split(path_index_text(F.col(path), typed), " ")).alias("pos", "term")).filter("term <> ''")
    return spread.groupBy("file_id", "term").agg(F.array_sort(F.collect_list("pos")).alias("at"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df): on how many pages each term stands; a page has one row a term."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def importance(df: Column, n: Column | int, kind_weight: Column | float = 1.0, factor: Column | float = 1.0) -> Column:
    """kind weight · (0.4 + idf) · factor, idf = ln((n + 1) / (df + 1)) / ln(n + 1), or 1 for a single page."""
    n = n if isinstance(n, Column) else F.lit(n)
    idf = F.when(n > 1, F.ln((n + 1) / (df + 1)) / F.ln(n + 1)).otherwise(1.0)
    return F.lit(kind_weight) * (0.4 + idf) * F.lit(factor)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: An index without pages has no bucket to tell its columns.
POSTINGS = "page_id long, file_id long, term string, at array<int>, page_no int, bucket int"


class Index:
    """The tables of an index, read from its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(POSTINGS) if name == "postings" else self.spark.read
        return reader.parquet(f"{self.folder}/{name}")

    def posts(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, page_id, file_id, page_no, at), of the buckets that hold `terms` only: a stated query's, which are counted here."""
        posts = self.table("postings")
        if terms is None:
            return posts.drop("bucket")
        buckets = [r.b for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]
        return (posts.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else posts).drop("bucket")


def page_facts(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(page_id, file_id, page_no, segment, part_no, part_kind, part_sha, part_name, first_page): the document and the part of a mail
    that each page belongs to; nulls outside any part. pages: id, file_id, page_no, text."""
    own = pages.select(F.col("id").alias("page_id"), "file_id", "page_no", "text")
    said = F.concat(F.lit(" "), F.array_join(words(fold(F.col("text"))), " "), F.lit(" "))
    starts = let(said, lambda t: F.contains(t, F.lit(f" {STARTS[0]} ")) | F.contains(t, F.lit(f" {STARTS[1]} ")) | F.contains(t, F.lit(f" {STARTS[2]} ")))
    placed = segments(own.select("page_id", "file_id", "page_no", F.coalesce(starts, F.lit(False)).alias("starts")), F.col("starts")).drop("starts")
    if parts is None:
        return placed.select("*", F.lit(None).cast("int").alias("part_no"), *(F.lit(None).cast("string").alias(c) for c in ("part_kind", "part_sha", "part_name")), F.lit(None).cast("int").alias("first_page"))
    facts = parts.groupBy("file_id", "part_no").agg(F.min(F.struct(F.col("kind").alias("part_kind"), F.col("sha256").alias("part_sha"), F.col("name").alias("part_name"), "first_page")).alias("p")).select("file_id", "part_no", "p.*")
    inside = parts_of_pages(pages, parts).join(facts, ["file_id", "part_no"]).drop("file_id", "page_no")
    return placed.join(inside, "page_id", "left")


def build(spark: SparkSession, folder: str, pages: DataFrame, files: DataFrame, parts: DataFrame | None = None) -> Index:
    """Writes the index of pages (id, file_id, page_no, text), files (id, root_id, relpath, kind, status, sha256, mtime) and
    parts to `folder`. Rebuilding from stored pages is the same call again."""
    own = pages.select(F.col("id").alias("page_id"), "file_id", "page_no", "text")
    placed = page_facts(pages, parts)
    body = postings(own).drop("field").join(own.select("page_id", "page_no"), "page_id")
    typed = body.select(F.col("page_id").cast("long"), F.col("file_id").cast("long"), "term", "at", F.col("page_no").cast("int"))
    typed.withColumn("bucket", bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(4))).sortWithinPartitions("term", "page_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index = Index(spark, folder)
    sizes = index.posts().groupBy("page_id").agg(F.sum(F.size("at")).alias("tokens"))
    placed.join(sizes, "page_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).write.mode("overwrite").parquet(f"{folder}/pages")
    path_postings(files, typed=True).write.mode("overwrite").parquet(f"{folder}/paths")
    every = vocabulary(index.posts()).unionByName(index.table("paths").select("term").distinct().withColumn("df", F.lit(0).cast("long")))
    every.groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    files.select(F.col("id").alias("file_id"), "root_id", "relpath", "kind", "status", "sha256", "mtime").write.mode("overwrite").parquet(f"{folder}/files")
    return index
