"""Queries of text quality, reconciliation and upkeep of a collection, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import collection as co
from paperloom.operators import quality as qu
from paperloom.operators.index import postings
from paperloom.plans.retrieval import FOLD, PAGE_TERMS, _posts, query  # its registry takes these queries too
from paperloom.runtime import spread
from paperloom.runtime import table as T  # noqa: N812

_V = qu.VOWELS
_WORDS3 = "regexp_extract_all(text, '\\p{L}{3,}')"
_QUALITY = f"coalesce(len(list_filter({_WORDS3}, lambda w: regexp_matches(lower(w), '[{_V}]') and regexp_full_match(w, '\\p{{L}}(\\p{{Ll}}+|\\p{{Lu}}+)') and not regexp_matches(lower(w), '[^{_V}]{{5}}'))) / nullif(len({_WORDS3}), 0), 0)"
_TOKENS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: length(t) >= 3)"
_DAMAGED = f"coalesce(len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '[@|~\\^°`¦¬]|\\p{{L}}[0-9]+\\p{{L}}|\\p{{L}}[+!?=]\\p{{L}}'))) / nullif(len({_TOKENS}), 0), 0)"


@query("text_quality", f"select id, round({_QUALITY}, 6) as quality, round({_DAMAGED}, 6) as damaged from pages where text is not null")
def text_quality(spark, sf):
    pages = spread(T(spark, sf, "pages").filter("text is not null").select("id", "text"))
    return pages.select("id", F.round(qu.word_quality(F.col("text")), 6).alias("quality"), F.round(qu.damaged_share(F.col("text")), 6).alias("damaged"))


@query("page_sources")
def page_sources(spark, sf):
    """What each page's text would be made of by the kind of its layer, with images on recognised pages."""
    share = F.when(F.col("source").isin("ocr", "text+ocr"), 0.9).otherwise(0.0)
    return spread(T(spark, sf, "pages").select("id", "text", "source")).select("id", qu.page_source(qu.layer_kind(F.col("text")), share).alias("made_of"))


@query("error_classes", "select id, case when error is null then null when regexp_matches(lower(error), 'passwort|password|beschädigt|damaged|unbekanntes format|nicht ausgewertet') then 'permanent' when regexp_matches(lower(error), 'zeitüberschreitung|timed out|timeouterror') then 'transient' else 'unknown' end as class from files")
def error_classes(spark, sf):
    return T(spark, sf, "files").select("id", co.error_class(F.col("error")).alias("class"))


@query("retry_queue", "select id as file_id, 'error' as reason from files where status = 'error' and coalesce(error, '') not in ('Passwort erforderlich', 'password needed') union all select id, 'part' from files where status = 'done' and id in (select file_id from parts where retryable)")
def retry_queue(spark, sf):
    return co.retries(T(spark, sf, "files"), T(spark, sf, "parts"))


@query("cascade_delete", "select p.id from pages p join files f on f.id = p.file_id where f.root_id <> 1")
def cascade_delete(spark, sf):
    """Pages that stay after a root is removed."""
    gone = T(spark, sf, "files").filter("root_id = 1").select(F.col("id").alias("file_id"))
    return co.without_files(T(spark, sf, "pages"), gone).select("id")


@query("moved_roots", "select r as root_id, r + 100 as new_root, 1.0::double as share from (select distinct root_id as r from files where status = 'done' and sha256 is not null and root_id % 2 = 0)")
def moved_roots(spark, sf):
    """Folders of even number seen again under another one; those of odd number have other contents there."""
    f = T(spark, sf, "files")
    seen = f.select((F.col("root_id") + 100).alias("new_root"), "relpath", "size", F.when(F.col("root_id") % 2 == 0, F.col("sha256")).otherwise(F.sha2("relpath", 256)).alias("sha256"))
    return co.moved_roots(f, seen)


@query("prunable_renames", "with moved as (select id, root_id, sha256, case when id % 5 = 0 and sha256 is not null then 'missing' else status end as status from files), t as (select root_id, sha256, min(id) as new_id from moved where status = 'done' and sha256 is not null group by all) select m.id as missing_id, new_id from moved m join t using (root_id, sha256) where m.status = 'missing' and (new_id in (select file_id from pages) or m.id not in (select file_id from pages))")
def prunable_renames(spark, sf):
    """Copies of every fifth file taken as gone: their place is taken by the other copy."""
    f = T(spark, sf, "files").withColumn("status", F.when((F.col("id") % 5 == 0) & F.col("sha256").isNotNull(), "missing").otherwise(F.col("status")))
    return co.prunable_renames(f, T(spark, sf, "pages").select("file_id"))


@query("part_limits", "select file_id, least(count(*), 2) as kept, greatest(count(*) - 2, 0) as beyond from parts where part_no > 0 group by file_id")
def part_limits(spark, sf):
    return co.part_limits(T(spark, sf, "parts"), 2)


@query("logos", "select file_id, part_no from parts where kind = 'image' and size < 10240")
def logos(spark, sf):
    return co.logos(T(spark, sf, "parts"))


@query("placeholder_targets", "select p.file_id, p.part_no, min(t.id) as target_id from parts p join files m on m.id = p.file_id join files t on t.root_id = m.root_id and lower(regexp_extract(t.relpath, '^(.*/)?', 0)) = lower(regexp_extract(m.relpath, '^(.*/)?', 0)) and lower(regexp_extract(t.relpath, '[^/]*$', 0)) = lower(p.name) and t.id <> m.id where p.kind = 'link' group by all")
def placeholder_targets(spark, sf):
    return co.placeholder_targets(T(spark, sf, "parts"), T(spark, sf, "files"))


@query("outdated_mails", "select id as file_id from files where kind = 'mail' and status = 'done' and id in (select file_id from parts where coalesce(content_revision, 0) < 1)")
def outdated_mails(spark, sf):
    return co.outdated(T(spark, sf, "files"), T(spark, sf, "parts"), 1)


@query("truncated_reuse", "select p.file_id, p.part_no from parts p where p.kind in ('pdf', 'image', 'word') and p.n_pages > 0 and exists (select 1 from files f where f.sha256 = p.sha256 and f.pages = p.n_pages and f.kind in ('pdf', 'image', 'word'))")
def truncated_reuse(spark, sf):
    """With every file taken as cut short: the parts that share content and page count with one."""
    return co.truncated_reuse(T(spark, sf, "parts"), T(spark, sf, "files").withColumn("error", F.lit("Hinweis: truncated")))


@query("path_relations", "select a.id as a, b.id as b, case when x = y then 'same' when starts_with(x, y) then 'inside' when starts_with(y, x) then 'contains' else 'apart' end as relation from (select id, rtrim(lower(path), '/') || '/' as x from roots) a, (select id, rtrim(lower(path), '/') || '/' as y from roots) b where a.id < b.id")
def path_relations(spark, sf):
    """Every root, of a handful, against the later ones: the list is an array on each row, no join."""
    roots = T(spark, sf, "roots").select("id", "path")
    every = roots.agg(F.array_sort(F.collect_list(F.struct("id", "path")))).scalar()
    later = F.filter("every", lambda r: r["id"] > F.col("id"))
    return roots.withColumn("every", every).select(F.col("id").alias("a"), "path", F.explode(later).alias("o")).select("a", F.col("o.id").alias("b"), co.path_relation(F.col("path"), F.col("o.path")).alias("relation"))


@query("run_progress", "select run_id, count(distinct log_id) as arrived, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 as seconds, round(count(distinct log_id) * 60 / ((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 6) as per_minute from runs left join file_log on arrived_at >= started_at and arrived_at < finished_at where finished_at is not null group by run_id, started_at, finished_at")
def run_progress(spark, sf):
    return co.progress(T(spark, sf, "file_log"), T(spark, sf, "runs"))


@query("shown_names", "select file_id, part_no, case when length(c) <= 20 then c else c[:19 - length(e)] || '…' || e end as shown from (select file_id, part_no, c, regexp_extract(c, '\\.[^.]{1,8}$', 0) as e from (select file_id, part_no, trim(regexp_replace(regexp_replace(name, '\\p{C}', '', 'g'), '[/\\\\:*?\"<>|]', '_', 'g'), ' ') as c from parts where name is not null))")
def shown_names(spark, sf):
    return T(spark, sf, "parts").filter("name is not null").select("file_id", "part_no", co.shown_name(F.col("name"), 20).alias("shown"))


@query("id_high_water", "select 'files' as source, max(id) as last from files union all select 'pages', max(id) from pages union all select 'file_log', max(log_id) from file_log")
def id_high_water(spark, sf):
    """The last number given in each table, carried over so that none is given twice."""
    one = lambda name, key: T(spark, sf, name).agg(F.max(key).alias("last")).select(F.lit(name).alias("source"), "last")
    return one("files", "id").unionByName(one("pages", "id")).unionByName(one("file_log", "log_id"))


@query("question_categories", "select notiz as category, count(*) as n from eval_items group by notiz")
def question_categories(spark, sf):
    return T(spark, sf, "eval_items").groupBy(F.col("notiz").alias("category")).agg(F.count("*").alias("n"))


@query("question_overlap", "select distinct a.suche as suche from eval_items a join eval_items b on a.suche = b.suche where a.item_id % 2 = 0 and b.item_id % 2 = 1")
def question_overlap(spark, sf):
    """Questions that two lists share; lists to tune and to test on must share none."""
    q = T(spark, sf, "eval_items")
    return q.filter("item_id % 2 = 0").select("suche").intersect(q.filter("item_id % 2 = 1").select("suche"))


@query("ambiguous_questions", f"with {PAGE_TERMS}, q as (select item_id, unnest(list_distinct(regexp_extract_all({FOLD.format('suche')}, '[\\p{{L}}\\p{{N}}]+'))) as term from eval_items), n as (select item_id, count(*) as n from q group by item_id) select item_id, count(*) as pages from (select q.item_id, page_id from q join terms using (term) group by q.item_id, page_id having count(*) = (select n from n where n.item_id = q.item_id)) group by item_id having count(*) > 1")
def ambiguous_questions(spark, sf):
    """Questions all of whose words stand on several pages, and how many. The questions are a stated list."""
    q = T(spark, sf, "eval_items").select("item_id", F.array_distinct(tx.words(tx.fold(F.col("suche")))).alias("ws"))
    each = q.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("term"))
    whole = _posts(spark, sf).select("page_id", "term").join(each, "term").groupBy("item_id", "n", "page_id").agg(F.count("*").alias("met")).filter("met = n")
    return whole.groupBy("item_id").agg(F.count("*").alias("pages")).filter("pages > 1")


#: So many bytes of the page table, as it is stored, are built in one partition.
BUILD_BYTES = 2 << 20


@query("same_build", "select 0::bigint as differing")
def same_build(spark, sf):
    """Rows in which two builds of the same postings differ: none. Both are built from the pages, each in its own shuffle.

    They meet page by page where they were built; neither is written, and no row is shuffled again.
    """
    pages, row = T(spark, sf, "pages").withColumnRenamed("id", "page_id"), F.struct("file_id", "term", "at")
    # Partitions small enough for their terms to be sorted in memory.
    parts = max(spark.sparkContext.defaultParallelism, int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BUILD_BYTES)
    # Another text column, else Spark would take the first build's shuffle for the second.
    first, again = (postings(pages, text=text, typed=False, parts=parts).groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias(name)) for name, text, pages in (("a", "text", pages), ("b", "again", pages.withColumn("again", F.concat(F.lit(""), "text")))))
    a, b = (F.coalesce(x, F.array().cast("array<struct<file_id:bigint,term:string,at:array<int>>>")) for x in ("a", "b"))
    times = lambda rows, x: F.size(F.filter(rows, lambda y: y == x))
    apart = F.aggregate(F.array_union(a, b), F.lit(0), lambda n, x: n + F.abs(times(a, x) - times(b, x)))
    return first.join(again, "page_id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).agg(F.coalesce(F.sum(apart), F.lit(0)).cast("long").alias("differing"))


@query("first_locations", "select file_id, id as page_id, row_number() over (partition by file_id order by page_no)::int as place from pages qualify place = 1")
def first_locations(spark, sf):
    """The first page of each file, by aggregation instead of a sort of its pages."""
    return T(spark, sf, "pages").groupBy("file_id").agg(F.min_by("id", "page_no").alias("page_id")).select("file_id", "page_id", F.lit(1).alias("place"))


@query("limited_queue", "select id from files where status = 'pending' and attempts < 3 order by root_id, case when kind = 'mail' then 1 else 0 end, relpath, id limit 20")
def limited_queue(spark, sf):
    """The next twenty files to read: a run's own limit."""
    return T(spark, sf, "files").filter("status = 'pending' and attempts < 3").orderBy("root_id", F.when(F.col("kind") == "mail", 1).otherwise(0), "relpath", "id").limit(20).select("id")


@query("part_labels", "select p.id as page_id, case when part[1] = 0 then 'Mailtext' else 'Anhang ' || part[1] || ', Seite ' || (p.page_no - part[2] + 1) end as label from pages p join (select p.id, arg_min((q.part_no, q.first_page), q.part_no) as part from pages p join parts q on p.file_id = q.file_id and q.n_pages > 0 and p.page_no between q.first_page and q.first_page + q.n_pages - 1 group by p.id) x on x.id = p.id")
def part_labels(spark, sf):
    parts = T(spark, sf, "parts")
    placed = co.parts_of_pages(T(spark, sf, "pages"), parts).join(parts.select("file_id", "part_no", "first_page"), ["file_id", "part_no"])
    return placed.select("page_id", F.when(F.col("part_no") == 0, "Mailtext").otherwise(F.format_string("Anhang %d, Seite %d", "part_no", F.col("page_no") - F.col("first_page") + 1)).alias("label"))


@query("report_shares", "select status, count(*) as n, printf('%5.1f %%', round(count(*) * 100.0 / sum(count(*)) over (), 1)) as share from files group by status")
def report_shares(spark, sf):
    f = T(spark, sf, "files")
    total = f.agg(F.count("*")).scalar()
    return f.groupBy("status").agg(F.count("*").alias("n")).select("status", "n", F.format_string("%5.1f %%", F.round(F.col("n") * 100 / total, 1)).alias("share"))
