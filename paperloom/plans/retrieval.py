"""Queries of the document collection's own operators, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import collection as co
from paperloom.operators import expand as ex
from paperloom.operators import search as se
from paperloom.operators.index import Index, build, page_facts, path_postings, postings, vocabulary
from paperloom.operators.query import ALTS as ALTS_SCHEMA
from paperloom.operators.query import compile_queries, members
from paperloom.runtime import scratch, spread
from paperloom.runtime import table as T  # noqa: N812

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FOLD = "strip_accents(replace(replace(replace(replace(lower(nfc_normalize({})),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss'))"


def _words_of(column: str) -> str:
    return f"regexp_extract_all({FOLD.format(column)}, '[\\p{{L}}\\p{{N}}]+')"


PAGE_TERMS = f"terms as (select distinct id as page_id, file_id, page_no, unnest({_words_of('text')}) as term from pages)"
PAGE_SEQ = f"seq as (select id as page_id, {_words_of('text')} as ws from pages)"

#: A stated batch of weighted queries: qid, gid, term, weight.
ALTS = [(1, 1, "heizraum", 1.0), (1, 1, "keller", 0.75), (1, 2, "ventil", 1.0), (1, 2, "dichtung", 0.9), (2, 1, "rohrbruch", 1.0), (2, 2, "treppenhaus", 1.0), (2, 2, "hausflur", 0.85), (2, 3, "gutachter", 1.0), (3, 1, "wartung", 1.0), (3, 2, "heizungsanlage", 1.0), (3, 3, "statikum", 1.0), (4, 1, "schluessel", 1.0), (4, 2, "abholung", 1.0), (5, 1, "mieterin", 1.0), (5, 1, "mieter", 0.9), (5, 2, "guthaben", 1.0), (5, 3, "zaehlerstand", 0.75)]
GROUPS = sorted({(q, g) for q, g, _, _ in ALTS})
SQL_ALTS = "alts(qid, gid, term, weight) as (values " + ", ".join(f"({q}, {g}, '{t}', {w}::double)" for q, g, t, w in ALTS) + ")"
SQL_W = "w as (select qid, gid, page_id, file_id, page_no, max(weight) as w from alts join terms using (term) group by all)"
SQL_IMP = "n as (select count(*) as n from pages), imp as (select qid, gid, 0.4 + ln((n + 1) / (df + 1)) / ln(n + 1) as imp, df from (select qid, gid, count(distinct page_id) as df from w group by all), n)"
WORD_LIST = ["heizung", "wasser", "zaehler", "dichtung", "rechnung", "schluessel", "wartung", "schaden", "nummer", "mieter", "abrechnung", "zeichnung"]


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and the SQL that DuckDB must agree with."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _alts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALTS, "qid int, gid int, term string, weight double")


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, g, 1.0, 1.0) for q, g in GROUPS], "qid int, gid int, kind_weight double, factor double")


_WRITTEN: dict[tuple, str] = {}


def _once(spark: SparkSession, sf: str, what: str, write) -> str:
    """The folder of what `write` wrote for a folder of tables, once a session: an index is built once and searched often."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _WRITTEN:
        folder = scratch(spark, what)
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of words alone, without typed tokens, which SQL can follow."""
    pages = T(spark, sf, "pages").select(F.col("id").alias("page_id"), "file_id", "text")
    return spark.read.parquet(_once(spark, sf, "words", lambda folder: postings(pages, typed=False).repartitionByRange("term").sortWithinPartitions("term").write.parquet(folder)))


def index_of(spark: SparkSession, sf: str) -> Index:
    """The whole index of a folder of tables."""
    return Index(spark, _once(spark, sf, "index", lambda folder: build(spark, folder, T(spark, sf, "pages"), T(spark, sf, "files"), T(spark, sf, "parts"))))


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORD_LIST], "word string")


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    terms = T(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(tx.fold(F.col("text"))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


SQL_VOCAB = f"vocab as (select term, count(distinct doc_id) as df from (select doc_id, unnest({_words_of('text')}) as term from documents) group by term)"
SQL_WORDS = "words(word) as (values " + ", ".join(f"('{w}')" for w in WORD_LIST) + ")"


@query("fold_text", f"select doc_id, {FOLD.format('text')} as folded from documents")
def fold_text(spark, sf):
    return T(spark, sf, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("tokens_per_doc", f"select doc_id, len(t)::int as tokens, len(list_distinct(t))::int as kinds from (select doc_id, {_words_of('text')} as t from documents where text is not null)")
def tokens_per_doc(spark, sf):
    t = tx.words(tx.fold(F.col("text")))
    return T(spark, sf, "documents").filter("text is not null").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("kinds"))


@query("vocab_df", f"with {PAGE_TERMS} select term, count(distinct page_id) as df from terms group by term")
def vocab_df(spark, sf):
    return vocabulary(_posts(spark, sf))


@query("df_top20", f"with {PAGE_TERMS} select term, count(distinct page_id) as df from terms group by term order by df desc, term limit 20")
def df_top20(spark, sf):
    return vocabulary(_posts(spark, sf)).orderBy(F.desc("df"), "term").limit(20)


def _receipts(spark, sf) -> DataFrame:
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("d"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.translate(F.format_number((cents / 100).cast("long"), 0), ",", ".")
    amount = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("Rechnung RE-"), F.date_format("d", "yyyy"), F.lit("/"), F.col("o_orderkey"), F.lit(" vom "), F.date_format("d", "dd.MM.yyyy"), F.lit(" über "), amount, F.lit(" EUR"))
    return o.select("o_orderkey", line.alias("text"))


_CENTS = "round(o_totalprice * 100)::bigint"


@query("amount_tokens", f"select o_orderkey, unnest(['0amt' || ({_CENTS} // 100) || 'c' || lpad(({_CENTS} % 100)::varchar, 2, '0'), '0amt' || ({_CENTS} // 100)]) as token from orders")
def amount_tokens(spark, sf):
    return _receipts(spark, sf).select("o_orderkey", F.explode(tx.amount_tokens(F.col("text"))).alias("token"))


@query("page_amounts", """with m as (select id, rtrim(unnest(list_filter(regexp_extract_all(text, '[.,]?[0-9]+(?:[.,][0-9]+)*(?:,[-–][0-9]*)?[.,]?'), lambda x: regexp_full_match(x, '([0-9]+|[0-9]{1,3}([.][0-9]{3})+),[0-9]{1,2}[.]?|[0-9]{1,3}([.][0-9]{3})+[.][0-9]{2}|([0-9]+|[0-9]{1,3}(,[0-9]{3})+)[.][0-9]{2}'))), '.') as m from pages)
select distinct id, '0amt' || coalesce(nullif(ltrim(regexp_replace(regexp_extract(m, '^(.*)[.,]', 1), '[.,]', '', 'g'), '0'), ''), '0') || 'c' || rpad(regexp_extract(m, '[0-9]+$', 0), 2, '0') as token from m""")
def page_amounts(spark, sf):
    """Amounts with cents on every page."""
    return T(spark, sf, "pages").select("id", F.explode(tx.amount_tokens(F.col("text"))).alias("token")).filter(F.col("token").contains("c"))


_CHAINS = f"select id, string_split_regex(unnest(regexp_extract_all(' ' || {FOLD.format('text')}, '[^0-9.]([0-9]+ ?[.] ?[0-9]+ ?[.] ?[0-9]+)', 1)), '[ .]+') as f from pages union all select id, list_reverse(string_split(unnest(regexp_extract_all(' ' || {FOLD.format('text')}, '[^0-9]([0-9]{{4}}-[0-9]+-[0-9]+)', 1)), '-')) from pages"


@query("page_dates", f"select distinct id, '0dt' || y || lpad(m::varchar, 2, '0') || lpad(d::varchar, 2, '0') as token from (select id, case when length(f[3]) = 2 then f[3]::int + case when f[3]::int >= 70 then 1900 else 2000 end else f[3]::int end as y, f[2]::int as m, f[1]::int as d from ({_CHAINS}) where length(f[1]) <= 2 and length(f[2]) <= 2 and length(f[3]) in (2, 4)) where y between 1900 and 2099 and m between 1 and 12 and d between 1 and 31")
def page_dates(spark, sf):
    """Full numeric and ISO dates on every page."""
    chains = F.array_join(F.regexp_extract_all(tx.fold(F.col("text")), F.lit(tx.CHAIN), 0), " ; ")
    return T(spark, sf, "pages").select("id", F.explode(tx.date_tokens(chains)).alias("token")).filter(F.col("token").startswith("0dt")).distinct()


@query("page_mixed_ids", "select distinct id, '0id' || lower(m) as token from (select id, unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: regexp_matches(x, '^WV[0-9]{8}$'))) as m from pages)")
def page_mixed_ids(spark, sf):
    """Numbers of letters and digits in one, of one kind, on every page."""
    return T(spark, sf, "pages").select("id", F.explode(tx.id_tokens(F.col("text"))).alias("token")).filter(F.col("token").rlike("^0idwv[0-9]{8}$"))


@query("page_houses", f"select distinct id, '0hn' || s || n as token from (select id, regexp_extract(m, '([a-z]*(?:weg|allee|gasse|ufer|stieg|pfad))', 1) as s, regexp_extract(m, '([0-9]+)$', 1)::int as n from (select id, unnest(regexp_extract_all(' ' || {FOLD.format('text')} || ' ', '[^\\p{{L}}\\p{{N}}_]([a-z]*(?:weg|allee|gasse|ufer|stieg|pfad) [0-9]{{1,3}})[^0-9, /–-]', 1)) as m, from pages))")
def page_houses(spark, sf):
    """Streets with a single number on every page."""
    single = F.regexp_extract_all(F.concat(F.lit(" "), tx.fold(F.col("text")), F.lit(" ")), F.lit(r"(?<![\p{L}\p{N}_])([a-z]*(?:weg|allee|gasse|ufer|stieg|pfad) [0-9]{1,3})[^0-9, /–-]"), 1)
    return T(spark, sf, "pages").select("id", F.explode(F.flatten(F.transform(single, tx._houses_of_folded))).alias("token")).distinct()


@query("street_tokens", f"with t as (select id, {_words_of('text')} as ws from pages), w as (select id, unnest(ws) as w from t), j as (select id, unnest(list_prepend('', ws)) as a, unnest(ws) as b from t) select distinct id, case when ends_with(w, 'str') then w || 'asse' else w[:-5] end as token from w where (ends_with(w, 'strasse') and length(w) > 7) or regexp_matches(w, '^[\\p{{L}}]{{2,}}str$') union select id, a || e from j, (values ('strasse'), ('str')) s(e) where b in ('str', 'strasse') and regexp_matches(a, '^[\\p{{L}}]{{3,}}$')")
def street_tokens(spark, sf):
    """Other spellings of street words on every page, separate ones joined with the word before."""
    pages = spread(T(spark, sf, "pages").filter("text is not null").select("id", "text"))
    # Words are split once a page: street_tokens looks at them by place.
    return pages.select("id", F.explode(tx.let(tx.words(tx.fold(F.col("text"))), tx.street_tokens)).alias("token"))


@query("split_word_repairs", f"with t as (select id, {_words_of('text')} as ws from pages) select distinct id, a || b as token from (select id, unnest(ws) as a, unnest(list_append(ws[2:], '')) as b from t) where regexp_full_match(a, '\\p{{L}}+') and regexp_full_match(b, '\\p{{L}}+') and least(length(a), length(b)) <= 3 and greatest(length(a), length(b)) >= 4 and length(a) + length(b) >= 7")
def split_word_repairs(spark, sf):
    """Torn words put together on every page."""
    return T(spark, sf, "pages").filter("text is not null").select("id", F.explode(tx.split_word_repairs(tx.words(tx.fold(F.col("text"))))).alias("token"))


@query("date_tokens", "select o_orderkey, unnest(['0dt' || strftime(o_orderdate, '%Y%m%d'), '0mo' || strftime(o_orderdate, '%Y%m'), '0yr' || strftime(o_orderdate, '%Y')]) as token from orders")
def date_tokens(spark, sf):
    return _receipts(spark, sf).select("o_orderkey", F.explode(tx.date_tokens(F.col("text"))).alias("token"))


@query("id_tokens", "select o_orderkey, '0idre' || strftime(o_orderdate, '%Y') || o_orderkey as token from orders")
def id_tokens(spark, sf):
    own = F.filter(tx.id_tokens(F.col("text")), lambda t: t.startswith("0idre"))
    return _receipts(spark, sf).select("o_orderkey", F.explode(own).alias("token")).groupBy("o_orderkey").agg(F.max_by("token", F.length("token")).alias("token"))


@query("house_number_tokens", "select c_custkey, '0hn' || s || n as token from (select c_custkey, unnest(['lindenstr', 'lindenstrasse']) as s, c_custkey % 60 + 1 as a from customer), lateral (select unnest(range(a, a + 4)) as n)")
def house_number_tokens(spark, sf):
    n = F.col("c_custkey") % 60 + 1
    line = F.concat(F.lit("Objekt Lindenstraße "), n, F.lit("-"), n + 3, F.lit(" in Hohenlinde"))
    return T(spark, sf, "customer").select("c_custkey", F.explode(tx.house_number_tokens(line)).alias("token"))


@query("glued_parts", "select c_custkey, unnest(['anlage', (c_custkey + 10)::varchar]) as part from customer")
def glued_parts(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", F.explode(tx.glued_parts(F.array(F.concat(F.lit("anlage"), F.col("c_custkey") + 10)))).alias("part"))


@query("extra_tokens")
def extra_tokens(spark, sf):
    return spread(T(spark, sf, "pages").select("id", "text")).select("id", F.explode(tx.extra_tokens(F.col("text"))).alias("token"))


@query("path_index_text", "select id, array_to_string(" + _words_of("regexp_replace(regexp_replace(relpath, '\\.[^./\\\\]{1,5}$', ''), '[/\\\\_]', ' ', 'g')") + ", ' ') as path_text from files")
def path_index_text(spark, sf):
    return T(spark, sf, "files").select("id", tx.path_index_text(F.col("relpath")).alias("path_text"))


_ISO = "'^\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])($|[T ]\\d{2}:\\d{2})'"


@query("german_date", f"select file_id, case when regexp_matches(sent_at, {_ISO}) then sent_at[9:10] || '.' || sent_at[6:7] || '.' || sent_at[1:4] || case when length(sent_at) > 10 then ' ' || sent_at[12:16] else '' end else '' end as shown from mails")
def german_date(spark, sf):
    return T(spark, sf, "mails").select("file_id", tx.german_date(F.col("sent_at")).alias("shown"))


@query("plausible_share", "select id, round(case when len(w) > 0 then len(list_filter(w, lambda x: regexp_matches(lower(x), '[aeiouyäöüéèêáàâóòôúùûíìî]') and not regexp_matches(x, '\\p{Ll}\\p{Lu}') and not regexp_matches(lower(x), '[bcdfghjklmnpqrstvwxzß]{5,}'))) / len(w) end, 6) as share from (select id, regexp_extract_all(text, '\\p{L}{2,}') as w from pages)")
def plausible_share(spark, sf):
    return T(spark, sf, "pages").select("id", F.round(tx.plausible_share(F.col("text")), 6).alias("share"))


@query("kind_by_extension", "select id, case when lower(ext) = 'pdf' then 'pdf' when lower(ext) in ('png','jpg','jpeg','tif','tiff','heic','heif','bmp','gif','webp') then 'image' when lower(ext) = 'eml' then 'mail' when lower(ext) in ('doc','docx','dot','rtf','odt') then 'word' else 'unsupported' end as kind from files")
def kind_by_extension(spark, sf):
    return T(spark, sf, "files").select("id", tx.kind_by_extension(F.col("ext")).alias("kind"))


@query("and_query", f"with {PAGE_TERMS}, {SQL_ALTS}, {SQL_W} select m.* from (select qid, page_id, count(distinct gid) as matched from w group by all) m join (select qid, count(distinct gid) as n from alts group by qid) using (qid) where matched = n")
def and_query(spark, sf):
    n = _groups(spark).groupBy("qid").agg(F.count("*").alias("n"))
    return se.matching_pages(se.page_weights(_alts(spark), _posts(spark, sf)), n)


@query("leave_one_out", f"with {PAGE_TERMS}, {SQL_ALTS}, {SQL_W} select m.* from (select qid, page_id, count(distinct gid) as matched from w group by all) m join (select qid, greatest(count(distinct gid) - 1, 1) as n from alts group by qid) using (qid) where matched >= n")
def leave_one_out(spark, sf):
    n = _groups(spark).groupBy("qid").agg(F.count("*").alias("n"))
    return se.matching_pages(se.page_weights(_alts(spark), _posts(spark, sf)), n, 1)


@query("phrase_query", f"with {PAGE_SEQ} select page_id from seq where contains(' ' || array_to_string(ws, ' ') || ' ', ' wasseraustritt im heizraum ')")
def phrase_query(spark, sf):
    return se.phrase_pages(_posts(spark, sf), ["wasseraustritt", "im", "heizraum"])


@query("prefix_query", f"with {PAGE_TERMS} select page_id, count(distinct term) as terms from terms where starts_with(term, 'heiz') group by page_id")
def prefix_query(spark, sf):
    return _posts(spark, sf).filter(F.col("term").startswith("heiz")).groupBy("page_id").agg(F.count("term").alias("terms"))


@query("idf_importance", f"with {PAGE_TERMS}, {SQL_ALTS}, {SQL_W}, {SQL_IMP} select qid, gid, df, round(imp, 6) as imp from imp")
def idf_importance(spark, sf):
    n = T(spark, sf, "pages").count()
    w = se.page_weights(_alts(spark), _posts(spark, sf))
    return se.group_statistics(w, _groups(spark), n).select("qid", "gid", "df", F.round("imp", 6).alias("imp"))


@query("weighted_topk", f"with {PAGE_TERMS}, {SQL_ALTS}, {SQL_W}, {SQL_IMP} select * from (select qid, page_id, score, row_number() over (partition by qid order by score desc, page_id) as rank from (select qid, page_id, round(sum(imp * w) / any_value(total), 6) as score from w join imp using (qid, gid) join (select qid, sum(imp) as total from imp group by qid) using (qid) group by qid, page_id)) where rank <= 10")
def weighted_topk(spark, sf):
    n = T(spark, sf, "pages").count()
    w = se.page_weights(_alts(spark), _posts(spark, sf))
    stats = se.group_statistics(w, _groups(spark), n)
    total = stats.groupBy("qid").agg(F.sum("imp").alias("total"))
    score = w.join(stats.select("qid", "gid", "imp"), ["qid", "gid"]).groupBy("qid", "page_id").agg(F.sum(F.col("imp") * F.col("w")).alias("s")).join(total, "qid")
    ranked = score.select("qid", "page_id", F.round(F.col("s") / F.col("total"), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "page_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")


_PATH_TERMS = "paths as (select distinct id as file_id, unnest(" + _words_of("regexp_replace(regexp_replace(relpath, '\\.[^./\\\\]{1,5}$', ''), '[/\\\\_]+', ' ', 'g')") + ") as term from files)"
_IN_PART = "inpart as (select p.id as page_id, arg_min((q.part_no, q.kind, q.sha256), q.part_no) as part from pages p join parts q on p.file_id = q.file_id and q.n_pages > 0 and q.first_page >= 1 and p.page_no between q.first_page and q.first_page + q.n_pages - 1 group by p.id)"
SQL_HITS = f"""{PAGE_TERMS}, {_PATH_TERMS}, {SQL_ALTS}, {_IN_PART},
body as (select qid, gid, page_id, file_id, page_no, max(weight) as w from alts join terms using (term) group by all),
of_path as (select x.qid, x.gid, p.id as page_id, x.file_id, p.page_no, x.pw from (select qid, gid, file_id, max(weight) as pw from alts join paths using (term) group by all) x join pages p on p.file_id = x.file_id),
hits as (select qid, gid, page_id, file_id, page_no, case when coalesce(w, 0) < 1 and coalesce(pw * 0.7, 0) > coalesce(w, 0) then pw * 0.7 else coalesce(w, 0) end as w from body full join of_path using (qid, gid, page_id, file_id, page_no)),
n as (select count(*) as n from pages where file_id in (select id from files where status = 'done')),
imp as (select qid, gid, 0.4 + ln((n + 1) / (df + 1)) / ln(n + 1) as imp from (select qid, gid, count(*) as df from hits group by all), n),
seg as (select id as page_id, sum(case when regexp_matches(' ' || array_to_string({_words_of('text')}, ' ') || ' ', ' (seite 1 von|blatt 1 von|seite 1 1) ') then 1 else 0 end) over (partition by file_id order by page_no rows unbounded preceding) as seg from pages),
placed as (select h.*, seg, coalesce(part[1], -1) as part_no from hits h join seg using (page_id) left join inpart using (page_id)),
there as (select distinct qid, file_id, part_no, seg, page_no from placed),
win as (select t.qid, p.gid, t.file_id, t.part_no, t.seg, t.page_no, max(case when p.page_no = t.page_no then p.w else p.w * 0.8 end) as win from there t join placed p on t.qid = p.qid and t.file_id = p.file_id and t.part_no = p.part_no and t.seg = p.seg and p.page_no between t.page_no - 2 and t.page_no + 2 group by all),
page as (select w.qid, w.file_id, w.page_no, sum(imp * win) as win from win w join imp using (qid, gid) group by all),
own as (select qid, file_id, page_no, sum(imp * w) as own from placed join imp using (qid, gid) group by all),
scored as (select * from page join own using (qid, file_id, page_no)),
top as (select qid, file_id, max(win) as best from scored group by all),
best as (select qid, file_id, max(best) as best, arg_min(page_no, (-own, page_no)) as page_no from scored join top using (qid, file_id) where win >= best * 0.97 group by all)"""
SQL_SEARCH = f"""with {SQL_HITS},
ranked as (select b.qid, b.file_id, b.page_no, round(best / (select sum(imp) from imp i where i.qid = b.qid), 6) as score, coalesce(case when part[2] in ('pdf', 'image', 'word') then part[3] end, f.sha256, 'file:' || b.file_id) as key from best b join files f on f.id = b.file_id join pages p on p.file_id = b.file_id and p.page_no = b.page_no left join inpart on inpart.page_id = p.id where f.status in ('done', 'pending', 'processing')),
hits2 as (select qid, key, arg_min((file_id, page_no, score), (-score, file_id)) as h, count(*) as copies from ranked group by all)
select * from (select qid, row_number() over (partition by qid order by h[3] desc, h[1])::int as rank, h[1] as file_id, h[2] as page_no, h[3] as score, copies from hits2) where rank <= 10"""


def _members(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    return members(spark.createDataFrame([(q, g, 0, t, w) for q, g, t, w in ALTS], ALTS_SCHEMA), vocab)


@query("search_topk", SQL_SEARCH)
def search_topk(spark, sf):
    """The flagship: a batch of weighted queries over words of bodies and paths, ranked by file and content."""
    pages, files, posts = T(spark, sf, "pages"), T(spark, sf, "files"), _posts(spark, sf)
    facts = spark.read.parquet(_once(spark, sf, "facts", lambda folder: page_facts(pages, T(spark, sf, "parts")).write.parquet(folder)))
    each = _members(spark, posts.select("term").limit(0))
    body = se.group_hits(each.join(posts.join(facts.select("page_id", "page_no"), "page_id"), "term"), ["page_id", "file_id", "page_no"])
    path = se.group_hits(each.join(path_postings(files), "term"), ["file_id"], near=False)
    hits = se.blended(body, path, facts)
    done = pages.join(files.filter("status = 'done'").select(F.col("id").alias("file_id")), "file_id", "left_semi").count()
    labelled = _groups(spark).withColumn("label", F.concat_ws(":", "qid", "gid"))
    _, best, _ = se.score_files(hits, labelled, facts, done)
    visible = files.filter(F.col("status").isin(*se.SEARCHABLE)).select(F.col("id").alias("file_id"), "sha256")
    inner = F.when(F.col("part_kind").isin("pdf", "image", "word"), F.col("part_sha"))
    keyed = best.join(visible, "file_id").join(facts.select("file_id", "page_no", "part_kind", "part_sha"), ["file_id", "page_no"]).withColumn("score", F.round("score", 6)).withColumn("key", F.coalesce(inner, "sha256", F.concat(F.lit("file:"), "file_id")))
    found = keyed.groupBy("qid", "key").agg(F.min_by(F.struct("file_id", "page_no", "score"), F.struct(-F.col("score"), "file_id")).alias("h"), F.count("*").alias("copies"))
    order = Window.partitionBy("qid").orderBy(F.desc("h.score"), "h.file_id")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("qid", "rank", "h.file_id", "h.page_no", "h.score", "copies")


@query("candidate_pages", f"""with {PAGE_TERMS}, {SQL_ALTS}, {SQL_W}, n as (select qid, count(distinct gid) as n from w group by qid), m as (select qid, page_id, file_id, count(distinct gid) as m from w group by all), b as (select m.qid, n, count(*) filter (m = n) as whole from m join n using (qid) group by all), df as (select qid, gid, count(*) as df from w group by all)
select qid, page_id from m join b using (qid) where (m = n and n > 1) or (n between 3 and 8 and whole < 50 and m >= n - 1)
union select w.qid, w.page_id from w join (select qid, file_id from w join n using (qid) where n > 1 group by qid, file_id, n having count(distinct gid) = n) using (qid, file_id)
union select w.qid, w.page_id from w join df using (qid, gid) join b using (qid) where df <= 1500 or n = 1 or whole < 50""")
def candidate_pages(spark, sf):
    return se.candidate_pages(se.page_weights(_alts(spark), _posts(spark, sf)))


@query("bm25_topk", f"""with {PAGE_SEQ}, occ as (select page_id, unnest(ws) as term from seq), tf as (select page_id, term, count(*) as tf from occ group by all), len as (select page_id, sum(tf) as len from tf group by all), s as (select count(*) as n, avg(len) as mean from len), df as (select term, count(*) as df from tf group by all), {SQL_ALTS}
select * from (select qid, page_id, score, row_number() over (partition by qid order by score desc, page_id) as rank from (select qid, page_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from (select distinct qid, term from alts) join tf using (term) join df using (term) join len using (page_id), s group by all)) where rank <= 10""")
def bm25_topk(spark, sf):
    scored = se.bm25(_posts(spark, sf), _alts(spark)).select("qid", "page_id", F.round("score", 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "page_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")


@query("snippet_topk")
def snippet_topk(spark, sf):
    hits = search_topk(spark, sf).select("qid", "rank", "file_id", "page_no")
    terms = _alts(spark).groupBy("qid").agg(F.collect_list("term").alias("terms"))
    return se.snippets(hits.join(T(spark, sf, "pages").select("file_id", "page_no", "text"), ["file_id", "page_no"]).join(terms, "qid")).select("qid", "rank", "snippet")


SYNONYMS = ["heizung, therme, kessel", "wartung, inspektion, instandhaltung", "schluessel, schliessanlage", "muell, abfall, restmuell", "rechnung, faktura", "aufzug, fahrstuhl, lift", "hausmeister, hauswart"]


def _synonyms(spark: SparkSession) -> DataFrame:
    rows = [(i, t.strip(), 0.75) for i, line in enumerate(SYNONYMS) for t in line.split(",")]
    return ex.synonym_pairs(spark.createDataFrame(rows, "group_id int, term string, weight double"))


def searched(spark: SparkSession, sf: str, questions: list[tuple[int, str]], k: int = 10) -> DataFrame:
    """A stated batch of questions, compiled, expanded and ranked over the index."""
    index = index_of(spark, sf)
    alts, groups = compile_queries(spark, questions)
    wide, n_parts = ex.expand(alts, groups, index.table("vocabulary"), _synonyms(spark))
    return se.search(index, wide, groups, n_parts, se.references(T(spark, sf, "parts"), index.table("files")), k)


def _questions(spark: SparkSession, sf: str) -> list[tuple[int, str]]:
    return [(r.item_id, r.suche) for r in T(spark, sf, "eval_items").filter("suche is not null").select("item_id", "suche").orderBy("item_id").collect()]


@query("question_search")
def question_search(spark, sf):
    """The held-out questions as free text, expanded and ranked in one plan. The list has a fixed size."""
    return searched(spark, sf, _questions(spark, sf)).withColumn("locations", F.to_json("locations"))


@query("question_unknown")
def question_unknown(spark, sf):
    """Parts of the questions that no page and no path has."""
    alts, groups = compile_queries(spark, _questions(spark, sf))
    return se.unknown_groups(index_of(spark, sf), alts, groups)


@query("question_amounts", "select item_id, '0amt' || regexp_replace(m[:-4], '[.,]', '', 'g') || 'c' || m[-2:] as token from (select item_id, rtrim(unnest(list_filter(regexp_extract_all(suche, '[.,]?[0-9]+(?:[.,][0-9]+)*[.,]?'), lambda x: regexp_full_match(x, '([0-9]+|[0-9]{1,3}([.][0-9]{3})+),[0-9]{2}[.]?|[0-9]{1,3}([.][0-9]{3})+[.][0-9]{2}|([0-9]+|[0-9]{1,3}(,[0-9]{3})+)[.][0-9]{2}'))), '.') as m from eval_items)")
def question_amounts(spark, sf):
    alts, groups = compile_queries(spark, _questions(spark, sf))
    return alts.join(groups.filter("kind = 'amount'").select("qid", "gid"), ["qid", "gid"]).filter(F.col("alt").rlike("c[0-9]{2}$")).select(F.col("qid").alias("item_id").cast("long"), F.col("alt").alias("token"))


@query("question_numbers", "select item_id, '0idwv' || regexp_extract(suche, 'WV([0-9]{8})', 1) as token from eval_items where regexp_matches(suche, 'WV[0-9]{8}')")
def question_numbers(spark, sf):
    alts, _ = compile_queries(spark, _questions(spark, sf))
    return alts.filter(F.col("alt").rlike("^0idwv[0-9]{8}$")).select(F.col("qid").alias("item_id").cast("long"), F.col("alt").alias("token"))


def known_items(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, file_id, rank): for every mail its subject as a question, and where the mail is found. Mails of one subject share its
    question, which is asked once."""
    mails = T(spark, sf, "mails").filter("subject is not null").select("file_id", "subject")
    asked = [(n, r.subject) for n, r in enumerate(mails.select("subject").distinct().orderBy("subject").collect(), 1)]
    found = searched(spark, sf, asked, 50).select("qid", "rank", F.explode("locations.file_id").alias("file_id")).groupBy("qid", "file_id").agg(F.min("rank").alias("rank"))
    numbered = mails.join(spark.createDataFrame(asked, "qid int, subject string"), "subject")
    return numbered.join(found, ["qid", "file_id"], "left").select(F.col("file_id").alias("qid"), "file_id", "rank")


@query("known_item_metrics")
def known_item_metrics(spark, sf):
    return co.retrieval_metrics(known_items(spark, sf))


@query("known_item_causes")
def known_item_causes(spark, sf):
    """Why mails aren't found by their subjects, per question."""
    return co.causes(known_items(spark, sf), T(spark, sf, "files"))


@query("min_span", f"with {PAGE_SEQ}, p as (select page_id, i as pos, ws[i] as term from seq, lateral (select unnest(range(1, len(ws) + 1)) as i)), a as (select page_id, pos from p where term = 'wasseraustritt'), b as (select page_id, pos from p where term = 'ventil') select page_id, min(abs(a.pos - b.pos))::int as span from a join b using (page_id) group by page_id")
def min_span(spark, sf):
    two = _posts(spark, sf).filter(F.col("term").isin("wasseraustritt", "ventil")).groupBy("page_id").agg(F.collect_list("at").alias("lists")).filter(F.size("lists") == 2)
    return two.select("page_id", se.min_span(F.col("lists")).alias("span"))


@query("path_matches", "with t as (select distinct id as file_id, unnest(" + _words_of("regexp_replace(regexp_replace(relpath, '\\.[^./\\\\]{1,5}$', ''), '[/\\\\_]', ' ', 'g')") + ") as term from files) select file_id, round(max(case term when 'pruefprotokoll' then 0.7 when 'lageplan' then 0.63 end), 6) as w from t where term in ('pruefprotokoll', 'lageplan') group by file_id")
def path_matches(spark, sf):
    weight = F.when(F.col("term") == "pruefprotokoll", 1.0).otherwise(0.9) * se.PATH_FACTOR
    return path_postings(T(spark, sf, "files")).filter(F.col("term").isin("pruefprotokoll", "lageplan")).groupBy("file_id").agg(F.round(F.max(weight), 6).alias("w"))


@query("segment_ids", "select id, (sum(case when contains(text, 'Seite 1 von') then 1 else 0 end) over (partition by file_id order by page_no rows unbounded preceding))::bigint as segment from pages")
def segment_ids(spark, sf):
    return co.segments(T(spark, sf, "pages").select("id", "file_id", "page_no", F.coalesce(F.col("text").contains("Seite 1 von"), F.lit(False)).alias("starts")), F.col("starts")).select("id", "segment")


_CONTAINS = f"with {SQL_VOCAB}, {SQL_WORDS} select word, term, max(case when starts_with(term, word) then 0.85 when strpos(term, word) + length(word) - 1 = length(term) then 0.75 else 0.55 end)::double as weight from words join vocab on contains(term, word) and length(term) > length(word) where regexp_matches(term, '^[a-z]+$') group by all"


@query("containing_expand", _CONTAINS)
def containing_expand(spark, sf):
    return ex.containing(_words(spark), _vocab(spark, sf)).select("word", "term", "weight")


@query("bridge_expand", f"with {SQL_VOCAB}, {SQL_WORDS} select distinct word, term from words, lateral (select unnest(range(4, length(word) - 3)) as i), vocab where length(word) >= 8 and regexp_matches(term, '^[a-z]+$') and starts_with(term, word[1:i]) and ends_with(term, word[i+1:]) and length(term) > length(word)")
def bridge_expand(spark, sf):
    return ex.bridged(_words(spark), _vocab(spark, sf)).select("word", "term")


@query("plural_expand")
def plural_expand(spark, sf):
    return ex.plurals(_words(spark), _vocab(spark, sf))


@query("typo_candidates", f"with {SQL_VOCAB}, {SQL_WORDS} select word, term, damerau_levenshtein(word, term)::int as distance from words join vocab on length(word) <= 8 and regexp_matches(term, '^[a-z]+$') and length(term) >= 3 and term <> word and damerau_levenshtein(word, term) <= 1")
def typo_candidates(spark, sf):
    return ex.typos(_words(spark).filter("length(word) <= 8"), _vocab(spark, sf)).drop("df")


@query("typo_candidates_long")
def typo_candidates_long(spark, sf):
    return ex.typos(_words(spark).filter("length(word) > 8"), _vocab(spark, sf)).drop("df")


@query("decompound")
def decompound(spark, sf):
    return ex.decompounded(_words(spark).unionByName(spark.createDataFrame([("heizungsanlage",), ("wasserschaden",), ("rechnungsnummer",)], "word string")), _vocab(spark, sf))


@query("synonym_pairs", "with g(group_id, term, weight) as (values (1, 'heizung', 0.75::double), (1, 'heizanlage', 0.75::double), (1, 'therme', 0.6::double), (2, 'lift', 0.75::double), (2, 'aufzug', 0.75::double), (3, 'aufzug', 0.6::double), (3, 'lift', 0.6::double)) select a.term as a, b.term as b, max(greatest(a.weight, b.weight)) as weight from g a join g b using (group_id) where a.term <> b.term group by all")
def synonym_pairs(spark, sf):
    return ex.synonym_pairs(spark.createDataFrame([(1, "heizung", 0.75), (1, "heizanlage", 0.75), (1, "therme", 0.6), (2, "lift", 0.75), (2, "aufzug", 0.75), (3, "aufzug", 0.6), (3, "lift", 0.6)], "group_id int, term string, weight double"))


def _snapshots(spark, sf):
    """What a scan found before and finds now, derived from the file table by rule."""
    f = T(spark, sf, "files").select("id", "root_id", "relpath", "size", "mtime", "status")
    now = f.filter("id % 11 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return f.filter("id % 13 <> 0"), now.select("root_id", "relpath", "size", "mtime")


_DELTA = "delta as (select coalesce(k.root_id, s.root_id) as root_id, coalesce(k.relpath, s.relpath) as relpath, case when k.relpath is null then 'new' when s.relpath is null then 'gone' when k.status = 'missing' then 'restored' when k.size is distinct from s.size or k.mtime is distinct from s.mtime then 'changed' else 'unchanged' end as change from (select * from files where id % 13 <> 0) k full join (select root_id, relpath, case when id % 7 = 0 then size + 1 else size end as size, mtime from files where id % 11 <> 0) s on k.root_id = s.root_id and k.relpath = s.relpath)"


@query("scan_delta", f"with {_DELTA} select * from delta")
def scan_delta(spark, sf):
    return co.scan_delta(*_snapshots(spark, sf))


@query("held_back", f"with {_DELTA} select root_id, known, gone, gone = known or (known >= 20 and gone > known * 0.5) as held from (select root_id, count(*) as known, count(*) filter (change = 'gone') as gone from delta where change <> 'new' group by all)")
def held_back(spark, sf):
    return co.held_back(co.scan_delta(*_snapshots(spark, sf)))


@query("gone_files", "select k.id from (select * from files where id % 13 <> 0) k where not exists (select 1 from files s where s.id % 11 <> 0 and s.root_id = k.root_id and s.relpath = k.relpath)")
def gone_files(spark, sf):
    known, now = _snapshots(spark, sf)
    return known.join(now, ["root_id", "relpath"], "left_anti").select("id")


@query("reuse_by_hash", "with d as (select sha256, min(id) as donor_id from files where status = 'done' and sha256 is not null and id in (select file_id from pages) group by sha256) select id as file_id, donor_id from files join d using (sha256) where status = 'pending' and id <> donor_id")
def reuse_by_hash(spark, sf):
    return co.donors(T(spark, sf, "files"), T(spark, sf, "pages").select("file_id"))


@query("rename_pairs", "with t as (select root_id, sha256, min(id) as new_id from files where status = 'done' and sha256 is not null group by all) select f.id as missing_id, new_id from files f join t using (root_id, sha256) where f.status = 'missing'")
def rename_pairs(spark, sf):
    return co.renames(T(spark, sf, "files"))


_EVENT = "['changed','gone','found','start','finish','fail','crash','retry'][(log_id % 8)::int + 1]"


@query("next_status", f"select log_id, case when e = 'changed' then 'pending' when e = 'gone' then 'missing' when e = 'found' and status = 'missing' then 'pending' when e = 'start' and status = 'pending' and attempts < 3 then 'processing' when e = 'finish' and status = 'processing' then 'done' when e = 'fail' and status = 'processing' then 'error' when e = 'crash' and status = 'processing' then 'pending' when e = 'retry' and status = 'error' and attempts < 3 then 'pending' else status end as next from (select distinct log_id, status, attempts, {_EVENT} as e from file_log)")
def next_status(spark, sf):
    events = F.array(*(F.lit(x) for x in ["changed", "gone", "found", "start", "finish", "fail", "crash", "retry"]))
    log = T(spark, sf, "file_log").select("log_id", "status", "attempts").distinct()
    return log.select("log_id", co.next_status(F.col("status"), F.get(events, (F.col("log_id") % 8).cast("int")), F.col("attempts")).alias("next"))


@query("latest_state", "select file_id, status, size from (select *, row_number() over (partition by file_id order by arrived_at desc, log_id desc) as r from file_log) where r = 1")
def latest_state(spark, sf):
    log = T(spark, sf, "file_log").select("file_id", "log_id", "arrived_at", "status", "size")
    return co.latest(log, ["file_id"], ["arrived_at", "log_id"]).select("file_id", "status", "size")


@query("work_queue", "select id, row_number() over (partition by root_id order by case when kind = 'mail' then 1 else 0 end, id)::int as place from files where status = 'pending' and attempts < 3")
def work_queue(spark, sf):
    order = F.when(F.col("kind") == "mail", 1 << 50).otherwise(0) + F.col("id")
    waiting = T(spark, sf, "files").filter("status = 'pending' and attempts < 3").select("id", "root_id", order.alias("order"))
    return co.running_sum(waiting, "root_id", "order", F.lit(1), "place").select("id", F.col("place").cast("int").alias("place"))


@query("root_listing", "select r.id, r.path, count(f.id) as files from roots r left join files f on f.root_id = r.id group by all")
def root_listing(spark, sf):
    n = T(spark, sf, "files").groupBy("root_id").agg(F.count("*").alias("files"))
    return T(spark, sf, "roots").join(n, F.col("id") == F.col("root_id"), "left").select("id", "path", F.coalesce("files", F.lit(0)).alias("files"))


@query("page_in_part", "select p.id as page_id, p.file_id, p.page_no, min(q.part_no) as part_no from pages p join parts q on p.file_id = q.file_id and q.n_pages > 0 and p.page_no between q.first_page and q.first_page + q.n_pages - 1 group by all")
def page_in_part(spark, sf):
    return co.parts_of_pages(T(spark, sf, "pages"), T(spark, sf, "parts"))


@query("mail_references", "select distinct p.file_id as mail_id, f.id as file_id from parts p join files f on f.sha256 = p.sha256 where p.file_id <> f.id")
def mail_references(spark, sf):
    return co.mail_references(T(spark, sf, "parts"), T(spark, sf, "files"))


@query("file_statistics", "select file_id, count(*) as pages, count(*) filter (source in ('ocr', 'text+ocr')) as ocr_pages, coalesce(sum(length(trim(text, ' '))), 0)::bigint as text_chars, min(ocr_conf) as min_conf from pages group by file_id")
def file_statistics(spark, sf):
    return co.file_statistics(T(spark, sf, "pages"))


@query("status_histogram", "select status, kind, count(*) as n from files group by all")
def status_histogram(spark, sf):
    return T(spark, sf, "files").groupBy("status", "kind").agg(F.count("*").alias("n"))


@query("extension_histogram", "select lower(ext) as ext, count(*) as n from files group by all order by n desc, ext")
def extension_histogram(spark, sf):
    return T(spark, sf, "files").groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


@query("searchable_totals", "select count(*) as files, count(*) filter (kind = 'mail') as mails, count(*) filter (id in (select file_id from pages)) as with_pages, coalesce(sum(pages), 0)::bigint as pages from files where status in ('done', 'pending', 'processing')")
def searchable_totals(spark, sf):
    there = T(spark, sf, "pages").select("file_id").distinct().withColumn("there", F.lit(True))
    f = T(spark, sf, "files").filter(F.col("status").isin(*co.SEARCHABLE)).join(there, F.col("id") == F.col("file_id"), "left")
    return f.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "mail").alias("mails"), F.count_if(F.col("there")).alias("with_pages"), F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages"))


@query("duplicate_count", "select coalesce(sum(n - 1), 0)::bigint as duplicates from (select count(*) as n from files where status = 'done' and sha256 is not null group by sha256 having n > 1)")
def duplicate_count(spark, sf):
    return co.duplicate_count(T(spark, sf, "files"))


@query("dedup_groups", "select sha256, min(id) as leader, count(*) as copies from files where sha256 is not null group by sha256")
def dedup_groups(spark, sf):
    return T(spark, sf, "files").filter("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("leader"), F.count("*").alias("copies"))


@query("representative", "select sha256, arg_min(id, (case status when 'done' then 0 when 'pending' then 1 when 'processing' then 2 else 3 end, -mtime, id)) as file_id from files where sha256 is not null group by sha256")
def representative(spark, sf):
    rank = F.struct(F.when(F.col("status") == "done", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "processing", 2).otherwise(3), -F.col("mtime"), F.col("id"))
    return T(spark, sf, "files").filter("sha256 is not null").groupBy("sha256").agg(F.min_by("id", rank).alias("file_id"))


@query("part_statistics", "select count(*) as attachments, count(*) filter (n_pages > 0) as with_pages, count(*) filter (kind = 'skipped') as skipped, count(*) filter (kind = 'link') as links, count(*) filter (retryable) as retryable, count(*) filter (name is null) as unnamed, count(*) filter (note is not null) as noted from parts where part_no > 0")
def part_statistics(spark, sf):
    return co.part_statistics(T(spark, sf, "parts"))


@query("note_histogram", "select regexp_replace(note, '[0-9]+', '#', 'g') as reason, count(*) as n from parts where note is not null group by all")
def note_histogram(spark, sf):
    return T(spark, sf, "parts").filter("note is not null").groupBy(F.regexp_replace("note", "[0-9]+", "#").alias("reason")).agg(F.count("*").alias("n"))


@query("doubtful_pages", "with p as (select file_id, page_no, ocr_conf, coalesce(length(trim(text, ' ')), 0) as chars from pages) select file_id, coalesce(string_agg(page_no::varchar, ',' order by page_no) filter (chars < 3), '') as blank, coalesce(string_agg(page_no::varchar, ',' order by page_no) filter (ocr_conf < 0.5 and chars >= 3), '') as low from p group by file_id having max(chars) > 0 and (blank <> '' or low <> '')")
def doubtful_pages(spark, sf):
    return co.doubtful_pages(T(spark, sf, "pages")).select("file_id", F.array_join(F.col("blank").cast("array<string>"), ",").alias("blank"), F.array_join(F.col("low").cast("array<string>"), ",").alias("low"))


@query("problem_list", "select * from (select root_id, relpath, status, concat_ws('; ', case when status = 'error' then coalesce(error, 'error') end, case when status = 'skipped' then 'not readable' end, case when min_conf < 0.5 then 'low confidence' end, case when status = 'done' and coalesce(text_chars, 0) = 0 then 'no text' end) as reason, case status when 'error' then 0 when 'skipped' then 1 else 2 end as priority from files where status <> 'missing') where reason <> ''")
def problem_list(spark, sf):
    return co.problems(T(spark, sf, "files"))


@query("question_targets", "with k as (select id as file_id, unnest(list_distinct([p, regexp_replace(p, '^[^/]*/', ''), regexp_extract(p, '[^/]*$')])) as key from (select id, lower(relpath) as p from files)), q as (select id as qid, lower(regexp_extract(relpath, '[^/]*$')) as key from files where id % 50 = 0) select qid, min(file_id) as file_id from q join k using (key) group by qid having count(distinct file_id) = 1")
def question_targets(spark, sf):
    q = T(spark, sf, "files").filter("id % 50 = 0").select(F.col("id").alias("qid"), F.regexp_extract("relpath", "[^/]*$", 0).alias("datei"))
    return co.find_targets(q, T(spark, sf, "files"))


@query("cause_histogram", "select cause, count(*) as n from (select case when f.status = 'error' then 'format' when f.status = 'skipped' then 'format' when f.status in ('missing', 'pending') then 'index' when coalesce(f.text_chars, 0) = 0 then 'ocr' else 'ranking' end as cause from files f) group by cause")
def cause_histogram(spark, sf):
    cause = F.when(F.col("status").isin("error", "skipped"), "format").when(F.col("status").isin("missing", "pending"), "index").when(F.coalesce("text_chars", F.lit(0)) == 0, "ocr").otherwise("ranking")
    return T(spark, sf, "files").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("page_confidence", "select file_id, round(sum(ocr_conf * length(text)) / sum(length(text)), 6) as confidence from pages where ocr_conf is not null and length(text) > 0 group by file_id")
def page_confidence(spark, sf):
    n = F.length("text")
    return T(spark, sf, "pages").filter("ocr_conf is not null and length(text) > 0").groupBy("file_id").agg(F.round(F.sum(F.col("ocr_conf") * n) / F.sum(n), 6).alias("confidence"))


@query("part_budget", "select file_id, part_no, before + n_pages > 5 as truncated from (select file_id, part_no, n_pages, coalesce(sum(n_pages) over (partition by file_id order by part_no rows between unbounded preceding and 1 preceding), 0) as before from parts)")
def part_budget(spark, sf):
    run = co.running_sum(T(spark, sf, "parts").select("file_id", "part_no", "n_pages"), "file_id", "part_no", F.coalesce("n_pages", F.lit(0)), "upto")
    return run.select("file_id", "part_no", (F.col("upto") > 5).alias("truncated"))


@query("repeated_parts", "select file_id, part_no from (select file_id, part_no, sha256, row_number() over (partition by file_id, sha256 order by part_no) as r from parts where sha256 is not null and part_no > 0) where r > 1")
def repeated_parts(spark, sf):
    same = Window.partitionBy("file_id", "sha256").orderBy("part_no")
    return T(spark, sf, "parts").filter("sha256 is not null and part_no > 0").withColumn("r", F.row_number().over(same)).filter("r > 1").select("file_id", "part_no")
