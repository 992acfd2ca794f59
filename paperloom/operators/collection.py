"""State of a collection of files: scans against what is known, reuse of content, parts of mails, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCHABLE = ("done", "pending", "processing")
# The safeguard against mass deletion, and what counts as a blank or doubtful page.
GONE_SHARE, GONE_LEAST, BLANK_CHARS, LOW_CONFIDENCE, MAX_ATTEMPTS = 0.5, 20, 3, 0.5, 3


def scan_delta(known: DataFrame, listing: DataFrame) -> DataFrame:
    """(root_id, relpath, change): new, changed, restored, unchanged or gone, by size and modification time."""
    k, seen = known.alias("k"), listing.alias("s")
    same = F.col("k.size").eqNullSafe(F.col("s.size")) & F.col("k.mtime").eqNullSafe(F.col("s.mtime"))
    change = F.when(F.col("k.relpath").isNull(), "new").when(F.col("s.relpath").isNull(), "gone").when(F.col("k.status") == "missing", "restored").when(~same, "changed").otherwise("unchanged")
    on = (F.col("k.root_id") == F.col("s.root_id")) & (F.col("k.relpath") == F.col("s.relpath"))
    return k.join(seen, on, "full_outer").select(F.coalesce("k.root_id", "s.root_id").alias("root_id"), F.coalesce("k.relpath", "s.relpath").alias("relpath"), change.alias("change"))


def held_back(delta: DataFrame) -> DataFrame:
    """(root_id, known, gone, held): roots whose deletions wait for confirmation: all gone, or over GONE_SHARE of
    GONE_LEAST known files or more."""
    per = delta.filter("change <> 'new'").groupBy("root_id").agg(F.count("*").alias("known"), F.count_if(F.col("change") == "gone").alias("gone"))
    return per.withColumn("held", (F.col("gone") == F.col("known")) | ((F.col("known") >= GONE_LEAST) & (F.col("gone") > F.col("known") * GONE_SHARE)))


def donors(files: DataFrame, has_pages: DataFrame) -> DataFrame:
    """(file_id, donor_id): pending files whose content another file has already given pages to; the smallest id gives."""
    able = files.filter("status = 'done' and sha256 is not null").join(has_pages, F.col("id") == F.col("file_id"), "left_semi")
    first = able.groupBy("sha256").agg(F.min("id").alias("donor_id"))
    return files.filter("status = 'pending'").join(first, "sha256").filter("id <> donor_id").select(F.col("id").alias("file_id"), "donor_id")


def renames(files: DataFrame) -> DataFrame:
    """(missing_id, new_id): a missing file and the done one of the same root and content that took its place."""
    gone = files.filter("status = 'missing' and sha256 is not null").select("root_id", "sha256", F.col("id").alias("missing_id"))
    there = files.filter("status = 'done' and sha256 is not null").groupBy("root_id", "sha256").agg(F.min("id").alias("new_id"))
    return gone.join(there, ["root_id", "sha256"]).select("missing_id", "new_id")


def next_status(status: Column, event: Column, attempts: Column) -> Column:
    """Transition of a file's state; anything else leaves it."""
    return (F.when(event == "changed", "pending").when(event == "gone", "missing").when((event == "found") & (status == "missing"), "pending")
        .when((event == "start") & (status == "pending") & (attempts < MAX_ATTEMPTS), "processing").when((event == "finish") & (status == "processing"), "done")
        .when((event == "fail") & (status == "processing"), "error").when((event == "crash") & (status == "processing"), "pending")
        .when((event == "retry") & (status == "error") & (attempts < MAX_ATTEMPTS), "pending").otherwise(status))


def parts_of_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(page_id, file_id, page_no, part_no): the part whose page interval holds each page; the first if several do.

    Parts are spread over their pages, as far as the file has any, so that the join is one of equal keys whatever a file's size.
    """
    last = pages.groupBy("file_id").agg(F.max("page_no").alias("last"))
    real = parts.filter("first_page >= 1 and n_pages > 0").join(last, "file_id").withColumn("to", F.least(F.col("first_page") + F.col("n_pages") - 1, F.col("last"))).filter("first_page <= to")
    each = real.select("file_id", "part_no", F.explode(F.sequence("first_page", "to")).alias("page_no")).groupBy("file_id", "page_no").agg(F.min("part_no").alias("part_no"))
    return pages.select(F.col("id").alias("page_id"), "file_id", "page_no").join(each, ["file_id", "page_no"]).select("page_id", "file_id", "page_no", "part_no")


def mail_references(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(mail_id, file_id): files that stand apart from a mail with the content of one of its parts."""
    alone = files.filter("sha256 is not null").select(F.col("id").alias("file_id"), "sha256")
    own = parts.filter("sha256 is not null").select(F.col("file_id").alias("mail_id"), "sha256").distinct()
    return own.join(alone, "sha256").filter("mail_id <> file_id").select("mail_id", "file_id").distinct()


def file_statistics(pages: DataFrame) -> DataFrame:
    """(file_id, pages, ocr_pages, text_chars, min_conf) from the pages themselves."""
    scanned = F.col("source").isin("ocr", "text+ocr")
    return pages.groupBy("file_id").agg(F.count("*").alias("pages"), F.count_if(scanned).alias("ocr_pages"), F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("text_chars"), F.min("ocr_conf").alias("min_conf"))


def duplicate_count(files: DataFrame) -> DataFrame:
    """One row: how many done files repeat the content of another."""
    return files.filter("status = 'done' and sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def part_statistics(parts: DataFrame) -> DataFrame:
    """One row of counts over attachments: all, with pages, skipped, links, retryable, without a name, with a note."""
    own = parts.filter("part_no > 0")
    return own.agg(F.count("*").alias("attachments"), F.count_if(F.col("n_pages") > 0).alias("with_pages"), F.count_if(F.col("kind") == "skipped").alias("skipped"), F.count_if(F.col("kind") == "link").alias("links"), F.count_if(F.col("retryable")).alias("retryable"), F.count_if(F.col("name").isNull()).alias("unnamed"), F.count_if(F.col("note").isNotNull()).alias("noted"))


def doubtful_pages(pages: DataFrame) -> DataFrame:
    """(file_id, blank, low): numbers of blank pages and of those recognised with low confidence, of files with some text."""
    chars = F.coalesce(F.length(F.trim("text")), F.lit(0))
    flagged = pages.withColumn("blank", chars < BLANK_CHARS).withColumn("low", (F.col("ocr_conf") < LOW_CONFIDENCE) & (chars >= BLANK_CHARS))
    per = flagged.groupBy("file_id").agg(F.max(chars).alias("most"), F.array_sort(F.collect_list(F.when(F.col("blank"), F.col("page_no")))).alias("blank"), F.array_sort(F.collect_list(F.when(F.col("low"), F.col("page_no")))).alias("low"))
    return per.filter((F.col("most") > 0) & ((F.size("blank") > 0) | (F.size("low") > 0))).drop("most")


def problems(files: DataFrame) -> DataFrame:
    """(root_id, relpath, status, reason, priority) of files that need a look, errors first."""
    reason = F.concat_ws("; ", F.when(F.col("status") == "error", F.coalesce("error", F.lit("error"))), F.when(F.col("status") == "skipped", "not readable"), F.when(F.col("min_conf") < LOW_CONFIDENCE, "low confidence"), F.when((F.col("status") == "done") & (F.coalesce("text_chars", F.lit(0)) == 0), "no text"))
    priority = F.when(F.col("status") == "error", 0).when(F.col("status") == "skipped", 1).otherwise(2)
    return files.filter("status <> 'missing'").select("root_id", "relpath", "status", reason.alias("reason"), priority.alias("priority")).filter("reason <> ''")


def retrieval_metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row from (qid, rank), rank null where nothing was found: hits at 1, k and 20, misses and mean reciprocal rank."""
    return ranks.agg(F.count("*").alias("queries"), F.count_if(F.col("rank") == 1).alias("at_1"), F.count_if(F.col("rank") <= k).alias("at_k"), F.count_if(F.col("rank") <= 20).alias("at_20"), F.count_if(F.col("rank").isNull()).alias("missed"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"))


def causes(ranks: DataFrame, files: DataFrame, k: int = 5) -> DataFrame:
    """(qid, cause): why each question (qid, file_id, rank) doesn't have its file among the first k; ok where it has.

    The file's state is asked first: unread or unreadable files can't be found, then those without text; what is left is ranking.
    """
    f = files.select(F.col("id").alias("file_id"), "status", "text_chars")
    state = F.when(F.col("status").isNull() | F.col("status").isin("missing", "pending"), "index").when(F.col("status").isin("error", "skipped"), "format").when(F.coalesce("text_chars", F.lit(0)) == 0, "ocr").otherwise("ranking")
    return ranks.join(f, "file_id", "left").select("qid", F.when(F.col("rank") <= k, "ok").otherwise(state).alias("cause"))


def path_forms(path: Column) -> Column:
    """Forms under which a question may name a file: whole path, path without its first folder, bare name."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""))
    return F.array_distinct(F.array(flat, F.regexp_replace(flat, "^[^/]*/", ""), F.regexp_extract(flat, "[^/]*$", 0)))


def find_targets(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, file_id): the file that each question names, if one of its forms names exactly one."""
    keyed = files.select(F.col("id").alias("file_id"), F.explode(path_forms(F.col("relpath"))).alias("key"))
    q = questions.select("qid", F.lower(F.regexp_replace(F.regexp_replace("datei", r"\\", "/"), "/+$", "")).alias("key"))
    return q.join(keyed, "key").groupBy("qid").agg(F.countDistinct("file_id").alias("n"), F.min("file_id").alias("file_id")).filter("n = 1").select("qid", "file_id")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by `order`: an upsert's outcome."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


#: Rows of a file that a running sum takes at once.
BLOCK = 1024


def running_sum(rows: DataFrame, key: str, order: str, value: Column, out: str) -> DataFrame:
    """rows with `out`: the sum of value over the rows of the same key up to this one, by the whole number `order`, which is unique.

    Keys of any size: rows are summed in blocks of BLOCK places, and the blocks' sums, BLOCK times fewer, are summed in turn.
    """
    blocked = rows.withColumn("__b", F.floor(F.col(order) / BLOCK)).withColumn("__v", value)
    inside = F.sum("__v").over(Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = blocked.groupBy(key, "__b").agg(F.sum("__v").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(key, "__b", F.coalesce(before, F.lit(0)).alias("__c"))
    return blocked.withColumn("__i", inside).join(carried, [key, "__b"]).withColumn(out, F.col("__i") + F.col("__c")).drop("__b", "__v", "__i", "__c")


def segments(pages: DataFrame, start: Column, order: str = "page_no") -> DataFrame:
    """pages with `segment`: how many documents have begun in the file up to each page."""
    return running_sum(pages, "file_id", order, F.when(start, 1).otherwise(0), "segment")


# Errors that another try doesn't mend, the sample and share by which a moved folder is known, budgets of a mail, smallest
# image of a mail that isn't a logo.
PERMANENT = ("Passwort erforderlich", "password needed")
NOT_TRANSIENT = "passwort|password|beschädigt|damaged|unbekanntes format|nicht ausgewertet"
MOVED_SAMPLE, MOVED_SHARE, MOST_PARTS, LOGO_BYTES = 50, 0.8, 60, 10 << 10


def error_class(message: Column) -> Column:
    """permanent, transient or unknown: whether reading again may help; null for no error."""
    low = F.lower(message)
    transient = low.rlike(r"runtimeerror|timeouterror|oserror|permissionerror|connectionerror|blockingioerror|zeitüberschreitung|zeitlimit|timed out|temporarily|vorübergehend")
    return F.when(message.isNull(), F.lit(None)).when(low.rlike(NOT_TRANSIENT), "permanent").when(transient, "transient").otherwise("unknown")


def retries(files: DataFrame, parts: DataFrame, permanent: bool = False) -> DataFrame:
    """(file_id, reason) of files to read again: errors that may pass (or all), and read ones with parts that may be read now."""
    failed = files.filter("status = 'error'" + ("" if permanent else f" and coalesce(error, '') not in {PERMANENT}"))
    again = files.filter("status = 'done'").join(parts.filter("retryable").select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    return failed.select(F.col("id").alias("file_id"), F.lit("error").alias("reason")).unionByName(again.select(F.col("id").alias("file_id"), F.lit("part").alias("reason")))


def moved_roots(files: DataFrame, listing: DataFrame, sample: int = MOVED_SAMPLE) -> DataFrame:
    """(root_id, new_root, share): folders whose files lie under another one now, known by path, size and hash of a sample of each.

    listing: new_root, relpath, size, sha256 of folders that were found. A folder that more than one new one matches isn't moved by
    itself. The sample is drawn by hash; a root gives at most `sample` rows to the window.
    """
    read = files.filter("status = 'done' and sha256 is not null").select("root_id", "relpath", "size", "sha256", F.xxhash64("relpath").alias("h"))
    # The least hashes are found block by block before they are ordered by root.
    blocks = read.withColumn("b", F.pmod("h", F.lit(64)))
    few = blocks.withColumn("r", F.row_number().over(Window.partitionBy("root_id", "b").orderBy("h", "relpath"))).filter(F.col("r") <= sample)
    drawn = few.withColumn("r", F.row_number().over(Window.partitionBy("root_id").orderBy("h", "relpath"))).filter(F.col("r") <= sample)
    size = drawn.groupBy("root_id").agg(F.count("*").alias("n"))
    same = drawn.join(listing, ["relpath", "size", "sha256"]).filter("root_id <> new_root").groupBy("root_id", "new_root").agg(F.countDistinct("relpath").alias("same"))
    good = same.join(size, "root_id").withColumn("share", F.col("same") / F.col("n")).filter(F.col("share") >= MOVED_SHARE)
    return good.groupBy("root_id").agg(F.count("*").alias("m"), F.min("new_root").alias("new_root"), F.min("share").alias("share")).filter("m = 1").select("root_id", "new_root", "share")


def prunable_renames(files: DataFrame, has_pages: DataFrame) -> DataFrame:
    """(missing_id, new_id): renames() that lose no text: the new file has pages, or the old one has none."""
    paged = has_pages.select(F.col("file_id").alias("p")).distinct()
    pairs = renames(files).join(paged, F.col("missing_id") == F.col("p"), "left").withColumnRenamed("p", "old_pages")
    return pairs.join(paged, F.col("new_id") == F.col("p"), "left").filter("p is not null or old_pages is null").select("missing_id", "new_id")


def without_files(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """rows of pages, parts, mails or postings without those of the files in `gone` (file_id): one call a table is a cascade."""
    return rows.join(gone.select(F.col("file_id").alias(key)).distinct(), key, "left_anti")


def part_limits(parts: DataFrame, most: int = MOST_PARTS) -> DataFrame:
    """(file_id, kept, beyond): parts of each mail within the budget and beyond it; those beyond are counted, not lost from sight."""
    return parts.filter("part_no > 0").groupBy("file_id").agg(F.least(F.count("*"), F.lit(most)).alias("kept"), F.greatest(F.count("*") - most, F.lit(0)).alias("beyond"))


def logos(parts: DataFrame) -> DataFrame:
    """(file_id, part_no) of small images, which are taken for logos of signatures."""
    return parts.filter((F.col("kind") == "image") & (F.col("size") < LOGO_BYTES)).select("file_id", "part_no")


def placeholder_targets(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, part_no, target_id): the file in a mail's own folder that a placeholder names, by name in any case; the smallest id."""
    folder, name = lambda c: F.lower(F.regexp_extract(c, "^(.*/)?", 0)), lambda c: F.lower(F.regexp_extract(c, "[^/]*$", 0))
    mails = files.select(F.col("id").alias("file_id"), "root_id", folder(F.col("relpath")).alias("folder"))
    there = files.select(F.col("id").alias("target_id"), "root_id", folder(F.col("relpath")).alias("folder"), name(F.col("relpath")).alias("name"))
    links = parts.filter("kind = 'link' and name is not null").select("file_id", "part_no", F.lower("name").alias("name")).join(mails, "file_id")
    return links.join(there, ["root_id", "folder", "name"]).filter("target_id <> file_id").groupBy("file_id", "part_no").agg(F.min("target_id").alias("target_id"))


def outdated(files: DataFrame, parts: DataFrame, revision: int) -> DataFrame:
    """(file_id) of read mails with a part read by an older revision of the readers: they wait to be read again, their text stays."""
    old = parts.filter(F.coalesce("content_revision", F.lit(0)) < revision).select(F.col("file_id").alias("id")).distinct()
    return files.filter("kind = 'mail' and status = 'done'").join(old, "id", "left_semi").select(F.col("id").alias("file_id"))


def truncated_reuse(parts: DataFrame, files: DataFrame, note: str = "truncated") -> DataFrame:
    """(file_id, part_no) of parts that took their pages from a file which itself was cut short: same content, as many pages, and an
    error that says so. They must be read anew."""
    donors = files.filter(F.lower("error").contains(note) & F.col("kind").isin("pdf", "image", "word")).select("sha256", F.col("pages").alias("n_pages")).distinct()
    return parts.filter(F.col("kind").isin("pdf", "image", "word") & (F.col("n_pages") > 0)).join(donors, ["sha256", "n_pages"], "left_semi").select("file_id", "part_no")


def path_relation(a: Column, b: Column) -> Column:
    """same, inside (a lies in b), contains or apart, of two folder paths in any case."""
    flat = lambda c: F.concat(F.regexp_replace(F.lower(F.regexp_replace(c, r"\\", "/")), "/+$", ""), F.lit("/"))
    x, y = flat(a), flat(b)
    return F.when(x == y, "same").when(F.startswith(x, y), "inside").when(F.startswith(y, x), "contains").otherwise("apart")


def progress(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, arrived, seconds, per_minute): what arrived during each finished run and how fast. runs is a stated list."""
    spans = runs.filter("finished_at is not null").select("run_id", "started_at", "finished_at")
    known = spans.agg(F.collect_list(F.struct("run_id", "started_at", "finished_at"))).scalar()
    during = F.filter("known", lambda r: (F.col("arrived_at") >= r["started_at"]) & (F.col("arrived_at") < r["finished_at"]))
    met = log.select("log_id", "arrived_at").distinct().withColumn("known", known).select(F.explode(during).alias("r")).select("r.run_id")
    n = met.groupBy("run_id").agg(F.count("*").alias("arrived"))
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return spans.join(n, "run_id", "left").select("run_id", F.coalesce("arrived", F.lit(0)).alias("arrived"), took.alias("seconds"), F.round(F.coalesce("arrived", F.lit(0)) * 60 / took, 6).alias("per_minute"))


def newer_format(mine: str, theirs: str) -> bool:
    """Whether a store's format number, a decimal text of any length, is newer than the one known here; what is no number is."""
    return not theirs.isdecimal() or (len(theirs.lstrip("0")), theirs.lstrip("0")) > (len(mine.lstrip("0")), mine.lstrip("0"))


def shown_name(name: Column, most: int = 80) -> Column:
    """A name fit to be shown and written: control and format characters out, signs that folders forbid as _, its extension kept."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r"[\p{C}]", ""), r'[/\\:*?"<>|]', "_"))
    ext = F.regexp_extract(clean, r"\.[^.]{1,8}$", 0)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substr(clean, F.lit(1), F.lit(most - 1) - F.length(ext)), F.lit("…"), ext))
