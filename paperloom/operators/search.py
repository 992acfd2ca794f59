"""Ranked retrieval of a batch of weighted queries, as one plan.

A query is a set of groups; a group a set of weighted alternatives. A page's weight in a group is the greatest of the
alternatives it holds, or that its file's path holds at a discount; neighbouring pages of the same document lend theirs; a
file scores by its best page; files of one content are one hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.index import Index, importance
from paperloom.operators.query import members
from paperloom.runtime import cut

# Fixed values of the ranking.
NEIGHBOUR, REACH, PATH_FACTOR, NEAR_BEST = 0.8, 2, 0.7, 0.97
NEAR_PARTS, FAR_PARTS, PARTS_SPAN, MARKED = 0.9, 0.6, 8, 0.15
PROXIMITY, PROXIMITY_SPAN, TF_WEIGHT, REFERENCE_MARGIN, RERANKED = 0.03, 40, 0.002, 0.1, 300
#: So many live groups of a query count, the most important ones.
MOST_GROUPS = 12
SEARCHABLE = ("done", "pending", "processing")


def page_weights(alts: DataFrame, posts: DataFrame, page: str = "page_id") -> DataFrame:
    """(qid, gid, page, file_id, w): greatest weight of a group's alternatives on each page.

    alts: qid, gid, term, weight: a stated query set, whose size is checked by Spark's broadcast threshold.
    """
    return alts.join(posts.select(page, "file_id", "term"), "term").groupBy("qid", "gid", page, "file_id").agg(F.max("weight").alias("w"))


def group_statistics(weights: DataFrame, groups: DataFrame, n_pages: int, page: str = "page_id") -> DataFrame:
    """(qid, gid, df, imp) of the live groups, those with a page at all. weights: one row for each query, group and page."""
    df = weights.groupBy("qid", "gid").agg(F.count(page).alias("df"))
    return groups.join(df, ["qid", "gid"]).withColumn("imp", importance(F.col("df"), n_pages, F.col("kind_weight"), F.col("factor")))


def most_important(stats: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """The `most` groups of greatest importance of each query, the first ones among equals. A query has a handful of groups."""
    order = Window.partitionBy("qid").orderBy(F.desc("imp"), "gid")
    return stats.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")


def matching_pages(weights: DataFrame, n_groups: DataFrame, leave_out: int = 0, page: str = "page_id") -> DataFrame:
    """(qid, page, matched): pages that match all groups of a query but `leave_out`."""
    return weights.groupBy("qid", page).agg(F.countDistinct("gid").alias("matched")).join(n_groups, "qid").filter(F.col("matched") >= F.greatest(F.col("n") - leave_out, F.lit(1))).select("qid", page, "matched")


def candidate_pages(weights: DataFrame, enough: int = 50, frequent: int = 1500) -> DataFrame:
    """(qid, page_id): pages worth scoring: those with all groups; with all but one, of queries of three to eight groups where
    all are on fewer than `enough` pages; of files that have all groups on several pages; and those of each group on no more
    than `frequent` pages, or of any group where few pages have all or there is one group only.

    weights: (qid, gid, page_id, file_id, w). No group's pages are cut off. search() scores every page with any group, so
    that nothing depends on this choice; it is for plans that fetch pages one by one.
    """
    groups = weights.groupBy("qid", "gid").agg(F.count("page_id").alias("df"))
    size = groups.groupBy("qid").agg(F.count("*").alias("n"))
    by_page = weights.groupBy("qid", "page_id", "file_id").agg(F.countDistinct("gid").alias("m")).join(size, "qid")
    both = by_page.groupBy("qid").agg(F.count_if(F.col("m") == F.col("n")).alias("both"), F.first("n").alias("n"))
    relaxed = (F.col("n").between(3, 8)) & (F.col("both") < enough)
    pages = by_page.drop("n").join(both, "qid")
    near = pages.filter(((F.col("m") == F.col("n")) & (F.col("n") > 1)) | (relaxed & (F.col("m") >= F.col("n") - 1))).select("qid", "page_id")
    whole = weights.groupBy("qid", "file_id").agg(F.countDistinct("gid").alias("m")).join(size.filter("n > 1"), "qid").filter("m = n").select("qid", "file_id")
    of_files = weights.join(whole, ["qid", "file_id"], "left_semi").select("qid", "page_id")
    single = weights.join(groups, ["qid", "gid"]).join(both, "qid").filter((F.col("df") <= frequent) | (F.col("n") == 1) | (F.col("both") < enough)).select("qid", "page_id")
    return near.unionByName(of_files).unionByName(single).distinct()


def min_span(lists: Column) -> Column:
    """Length of the smallest window that covers one position of each list; null if a list is empty.

    For each position as the window's left end, the next of every other list; linear in the positions by lists.
    """
    flat = F.array_sort(F.flatten(lists))
    after = lambda start: F.transform(lists, lambda x: F.array_min(F.filter(x, lambda p: p >= start)))
    ends = F.transform(flat, lambda s: F.when(F.forall(after(s), lambda e: e.isNotNull()), F.array_max(after(s)) - s))
    return F.array_min(ends)


def _best(found: Column) -> list[Column]:
    """Of hits (weight, terms, at): the greatest weight, and the terms and positions of those within MARKED of it."""
    kept = F.filter(found, lambda x: x["weight"] >= F.array_max(F.transform(found, lambda y: y["weight"])) - MARKED)
    terms = F.array_distinct(F.flatten(F.transform(kept, lambda x: x["terms"])))
    return [F.array_max(F.transform(found, lambda x: x["weight"])).alias("w"), terms.alias("terms"), F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda x: x["at"])))).alias("at")]


def group_hits(rows: DataFrame, place: list[str], n_parts: DataFrame | None = None, near: bool = True) -> DataFrame:
    """(qid, gid, place..., w, terms, at): what each place holds of each group.

    rows: members joined with postings. A phrase needs its words in a row, "all:" each of its words; a group of parts
    (n_parts: qid, gid, n_parts) counts as well if all parts are there, more if they stand close together (`near`: positions
    are those of one text).
    """
    key = ["qid", "gid", "part", *place]
    one = rows.filter("shape = 'one'").select(*key, "weight", F.array("term").alias("terms"), "at")
    several = rows.filter("shape <> 'one'").groupBy(*key, "alt", "weight", "shape", "n").agg(F.collect_list(F.struct("i", "term", "at")).alias("ys"))
    several = several.filter(F.size(F.array_distinct(F.transform("ys", lambda y: y["i"]))) == F.col("n"))
    shifted = F.transform("ys", lambda y: F.transform(y["at"], lambda p: p - y["i"]))
    starts = F.aggregate(shifted, F.get(shifted, F.lit(0)), lambda a, x: F.array_intersect(a, x))
    run = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("n") - 1)))
    held = several.withColumn("run", F.when(F.col("shape") == "phrase", run).otherwise(F.flatten(F.transform("ys", lambda y: y["at"])))).filter(F.size("run") > 0)
    found = one.unionByName(held.select(*key, "weight", F.transform("ys", lambda y: y["term"]).alias("terms"), F.col("run").alias("at")))
    direct = found.groupBy(*key).agg(F.collect_list(F.struct("weight", "terms", "at")).alias("xs"))
    whole = direct.filter("part = 0").select("qid", "gid", *place, "xs")
    if n_parts is not None:
        parts = direct.filter("part > 0").select("qid", "gid", *place, *_best(F.col("xs")))
        met = parts.groupBy("qid", "gid", *place).agg(F.collect_list(F.struct("w", "terms", "at")).alias("ps")).join(n_parts, ["qid", "gid"]).filter(F.size("ps") == F.col("n_parts"))
        close = F.coalesce(min_span(F.transform("ps", lambda p: p["at"])) <= PARTS_SPAN, F.lit(False)) if near else F.lit(False)
        weight = F.array_min(F.transform("ps", lambda p: p["w"])) * F.when(close, NEAR_PARTS).otherwise(FAR_PARTS)
        hit = F.struct(weight.alias("weight"), F.flatten(F.transform("ps", lambda p: p["terms"])).alias("terms"), F.flatten(F.transform("ps", lambda p: p["at"])).alias("at"))
        whole = whole.unionByName(met.select("qid", "gid", *place, F.array(hit).alias("xs")))
        whole = whole.groupBy("qid", "gid", *place).agg(F.flatten(F.collect_list("xs")).alias("xs"))
    return whole.select("qid", "gid", *place, *_best(F.col("xs")))


def blended(body: DataFrame, path: DataFrame, pages: DataFrame) -> DataFrame:
    """(qid, gid, page_id, file_id, page_no, w, terms, at, in_path): body hits, or those of the file's path at PATH_FACTOR on each
    of its pages where they weigh more."""
    of_path = path.select("qid", "gid", "file_id", F.col("w").alias("pw"), F.col("terms").alias("pt")).join(pages.select("file_id", "page_id", "page_no"), "file_id")
    both = body.join(of_path, ["qid", "gid", "page_id", "file_id", "page_no"], "full_outer")
    own, far = F.coalesce("w", F.lit(0.0)), F.coalesce(F.col("pw") * PATH_FACTOR, F.lit(0.0))
    by_path = (own < 1) & (far > own)
    empty = F.array().cast("array<int>")
    return both.select("qid", "gid", "page_id", "file_id", "page_no", F.when(by_path, far).otherwise(own).alias("w"), F.when(by_path, F.col("pt")).otherwise(F.col("terms")).alias("terms"), F.when(by_path, empty).otherwise(F.col("at")).alias("at"), F.coalesce(by_path | F.arrays_overlap("terms", "pt"), F.lit(False)).alias("in_path"))


def neighbour_window(weights: DataFrame, segment: list[str], order: str = "page_no") -> DataFrame:
    """(qid, gid, segment..., page, win): on each page that has any group of the query, each group's own weight or NEIGHBOUR times
    the greatest within REACH pages of the same segment.

    Each weight is spread over the pages that it reaches and the greatest is kept, with partial aggregation: a file of any
    size is no task of its own, and nothing is sorted.
    """
    there = weights.select("qid", *segment, order).distinct()
    return reached(weights, segment, order).drop("w").join(there, ["qid", *segment, order], "left_semi")


def reached(weights: DataFrame, segment: list[str], order: str = "page_no") -> DataFrame:
    """(qid, gid, segment..., page, win, w): neighbour_window() on all pages within reach, with the group's own weight there or null."""
    reach = F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))).alias("d")
    spread = weights.select("qid", "gid", *segment, order, "w", reach)
    near = F.when(F.col("d") == 0, F.col("w")).otherwise(F.col("w") * NEIGHBOUR)
    moved = spread.select("qid", "gid", *segment, (F.col(order) + F.col("d")).alias(order), near.alias("win"), F.when(F.col("d") == 0, F.col("w")).alias("w"))
    return moved.groupBy("qid", "gid", *segment, order).agg(F.max("win").alias("win"), F.max("w").alias("w"))


def equal_groups(alts: DataFrame, n_parts: DataFrame | None = None) -> DataFrame:
    """(qid, gid, rq, rg): for each group of a batch the first one with the same alternatives, weights and number of parts: what a page
    holds of one, it holds of all of them."""
    same = alts.groupBy("qid", "gid").agg(F.array_sort(F.collect_list(F.struct("part", "alt", "weight"))).alias("same"))
    parts = F.lit(0).alias("n_parts") if n_parts is None else F.coalesce("n_parts", F.lit(0)).alias("n_parts")
    own = (same if n_parts is None else same.join(n_parts, ["qid", "gid"], "left")).select("qid", "gid", "same", parts)
    first = own.groupBy("same", "n_parts").agg(F.min(F.struct("qid", "gid")).alias("r"), F.collect_list(F.struct("qid", "gid")).alias("each"))
    return first.select("r", F.explode("each").alias("x")).select("x.qid", "x.gid", F.col("r.qid").alias("rq"), F.col("r.gid").alias("rg"))


def best_pages(scored: DataFrame, page: str = "page_no") -> DataFrame:
    """Of each query's file its best window score and the page shown: among those of NEAR_BEST of it the one of the
    greatest own score, then the lowest page.

    scored: qid, file_id, page, own, win. Two aggregations, no sort of a file's pages: a file of any size is one group.
    """
    top = scored.groupBy("qid", "file_id").agg(F.max("win").alias("best"))
    near = scored.join(top, ["qid", "file_id"]).filter(F.col("win") >= F.col("best") * NEAR_BEST)
    return near.groupBy("qid", "file_id").agg(F.max("best").alias("best"), F.min_by(page, F.struct(-F.col("own"), page)).alias(page))


def score_files(hits: DataFrame, groups: DataFrame, pages: DataFrame, n_pages: int, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The live groups (qid, gid, label, imp, n_live, rq, rg), the files (qid, file_id, page_no, score, wins), and the hits placed.

    hits: blended(); pages: page_id, segment, part_no; same: equal_groups(), if hits has only the first of equal groups. What pages
    hold and what is near is made once for each of these; a query only adds up. wins: the groups with a weight on or near the page shown.
    """
    if same is None:
        same = groups.select("qid", "gid", F.col("qid").alias("rq"), F.col("gid").alias("rg"))
    hits = hits.withColumnsRenamed({"qid": "rq", "gid": "rg"})
    df = hits.groupBy("rq", "rg").agg(F.count("page_id").alias("df"))
    of_each = groups.join(same, ["qid", "gid"]).join(df, ["rq", "rg"]).withColumn("imp", importance(F.col("df"), n_pages, F.col("kind_weight"), F.col("factor")))
    # Written once, as each is read several times below.
    stats = cut(most_important(of_each).select("qid", "gid", "label", "imp", "rq", "rg"), "groups")
    stats = stats.withColumn("bit", F.row_number().over(Window.partitionBy("qid").orderBy("gid")) - 1)
    total = stats.groupBy("qid").agg(F.sum("imp").alias("total"), F.count("*").alias("n_live"), F.array_sort(F.collect_list(F.struct("gid", "bit"))).alias("gids"))
    needed = hits.join(stats.select("rq", "rg").distinct(), ["rq", "rg"], "left_semi")
    placed = cut(needed.join(pages.select("page_id", "segment", F.coalesce("part_no", F.lit(-1)).alias("part_no")), "page_id"), "placed")
    within = ["file_id", "part_no", "segment"]
    near = cut(reached(placed.withColumnsRenamed({"rq": "qid", "rg": "gid"}), within).withColumnsRenamed({"qid": "rq", "gid": "rg"}), "near")
    # A query has MOST_GROUPS live groups at most: each is a bit.
    live = near.join(stats.select("qid", "rq", "rg", "imp", "bit"), ["rq", "rg"])
    bit = F.expr("shiftleft(1L, bit)")
    # Rounded, as the last digits of a sum depend on the order of its rows, and equal pages would not be equal.
    total_of = lambda c: F.round(F.sum(F.col("imp") * F.col(c)), 9).alias(c)
    sums = live.groupBy("qid", *within, "page_no").agg(total_of("win"), total_of("w").alias("own"), F.bit_or(bit).alias("bits"))
    scored = cut(sums.filter("own is not null").select("qid", "file_id", "page_no", "own", "win", "bits"), "pages")
    best = best_pages(scored).join(scored.select("qid", "file_id", "page_no", "bits"), ["qid", "file_id", "page_no"]).join(F.broadcast(total), "qid")
    wins = F.transform(F.filter("gids", lambda g: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), g["bit"])) != 0), lambda g: g["gid"])
    return stats.join(total.select("qid", "n_live"), "qid"), best.select("qid", "file_id", "page_no", (F.col("best") / F.col("total")).alias("score"), wins.alias("wins"), "n_live"), placed


def references(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(mail_id, file_id): files that a mail names: the target of a placeholder, or a file of its own with an attachment's content."""
    alone = files.filter("kind <> 'mail' or kind is null").select(F.col("file_id").alias("to_id"), "root_id", "relpath", "sha256")
    own = parts.filter("part_no > 0").join(files.select("file_id", F.col("root_id").alias("mail_root")), "file_id")
    links = own.filter("kind = 'link' and note is not null").join(alone, (F.lower("note") == F.lower("relpath")) & (F.col("mail_root") == F.col("root_id")))
    same = own.filter("kind in ('pdf', 'image', 'word') and sha256 is not null").select("file_id", "sha256").join(alone.filter("sha256 is not null"), "sha256")
    return links.select(F.col("file_id").alias("mail_id"), "to_id").unionByName(same.select(F.col("file_id").alias("mail_id"), "to_id")).filter("mail_id <> to_id").distinct().select("mail_id", F.col("to_id").alias("file_id"))


def content_keys(scored: DataFrame, refs: DataFrame | None) -> DataFrame:
    """scored (qid, file_id, score, wins, own_key, part_no) with `key`: its content's, or that of the file which a mail's body
    only names, if that file scores within REFERENCE_MARGIN and has every group that the mail has; `preferred` then names it."""
    if refs is None:
        return scored.select("*", F.col("own_key").alias("key"), F.lit(None).cast("long").alias("preferred"))
    mails = scored.filter("part_no = 0").select("qid", F.col("file_id").alias("mail_id"), F.col("score").alias("ms"), F.col("wins").alias("mw"))
    targets = mails.join(refs, "mail_id").join(scored.select("qid", "file_id", "score", "wins", "own_key"), ["qid", "file_id"])
    good = targets.filter((F.col("score") >= F.col("ms") - REFERENCE_MARGIN) & (F.size(F.array_except("mw", "wins")) == 0))
    chosen = good.groupBy("qid", "mail_id").agg(F.max_by(F.struct("file_id", "own_key"), F.struct("score", -F.col("file_id"))).alias("t"))
    joined = scored.join(chosen.withColumnRenamed("mail_id", "file_id"), ["qid", "file_id"], "left")
    return joined.select(*scored.columns, F.coalesce("t.own_key", "own_key").alias("key"), F.col("t.file_id").alias("preferred"))


def rank(scored: DataFrame, placed: DataFrame, groups: DataFrame, files: DataFrame, pages: DataFrame, k: int, rerank: int = RERANKED) -> DataFrame:
    """(qid, rank, file_id, page_no, score, copies, matched, missing, locations): the k best contents of each query.

    Of the best `rerank` contents the leading file's terms may raise the score: by PROXIMITY where they stand close together,
    and among equals by how often they occur. Then files go before mails that name them, and newer before older. The file shown
    is a current one before one that waits to be read again, the one that a mail names, and one that stands alone.
    """
    first = F.struct(-F.col("score"), "file_id")
    leaders = scored.groupBy("qid", "key").agg(F.min_by(F.struct("file_id", "page_no", "score"), first).alias("lead"), F.count("*").alias("copies"), F.max("preferred").alias("preferred"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_id", "page_no", "part_no", "wins"))).alias("members"))
    nth = Window.partitionBy("qid").orderBy(F.desc("lead.score"), "lead.file_id")
    top = leaders.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= rerank)
    page = pages.select("file_id", "page_no", "tokens")
    shown = top.select("qid", "key", F.col("lead.file_id").alias("file_id"), F.col("lead.page_no").alias("page_no"))
    own = shown.join(groups.select("qid", "rq", "rg", "imp"), "qid").join(placed, ["rq", "rg", "file_id", "page_no"]).join(page, ["file_id", "page_no"])
    tf = F.size("at") / (F.size("at") + 1.2 * (0.25 + 0.75 * (F.col("tokens") + 1) / 300))
    counted = F.col("imp") * (tf + F.when(F.col("in_path"), 0.5).otherwise(0.0))
    lists = F.collect_list(F.when((F.col("w") > 0) & (F.size("at") > 0), F.slice("at", 1, 200)))
    close = own.groupBy("qid", "key").agg(F.sum(counted).alias("tf"), F.count_if(F.col("w") > 0).alias("matched_n"), lists.alias("lists"))
    live = groups.groupBy("qid").agg(F.first("n_live").alias("n_live"), F.array_sort(F.collect_list(F.struct("gid", "label"))).alias("labels"))
    span = F.when(F.size("lists") >= 2, F.greatest(F.lit(0.0), 1 - min_span(F.col("lists")) / PROXIMITY_SPAN)).otherwise(0.0)
    ranked = top.join(close, ["qid", "key"]).join(live, "qid").withColumn("raised", F.col("lead.score") + PROXIMITY * F.coalesce(span, F.lit(0.0)) * F.col("matched_n") / F.col("n_live"))
    most = F.max("tf").over(Window.partitionBy("qid"))
    facts = files.select(F.col("file_id").alias("lead_id"), F.col("kind").alias("lead_kind"), F.col("mtime").alias("lead_mtime"))
    sorting = F.round(F.col("raised") + TF_WEIGHT * F.col("tf") / F.when(most > 0, most).otherwise(1.0), 6)
    ordered = ranked.withColumn("sorting", sorting).join(facts, F.col("lead.file_id") == F.col("lead_id"))
    place = Window.partitionBy("qid").orderBy(F.desc("sorting"), F.coalesce(F.col("lead_kind") == "mail", F.lit(False)), F.desc_nulls_last("lead_mtime"), "lead_id")
    best = ordered.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    # Only the members of the k best contents are looked at one by one.
    each = best.select("qid", "rank", "raised", "lead", "copies", "preferred", "labels", "members", F.explode("members").alias("m")).join(files.select(F.col("file_id").alias("mid"), "status"), F.col("m.file_id") == F.col("mid"))
    equal = -F.col("m.s") >= F.col("lead.score") - 1e-9
    choice = F.struct(F.when(F.col("status") == "done", 0).otherwise(1), F.when(F.col("m.file_id") == F.col("preferred"), 0).when(equal & (F.coalesce("m.part_no", F.lit(-1)) == -1), 1).otherwise(2), F.col("m.s"), F.col("m.file_id"))
    main = each.groupBy("qid", "rank").agg(F.min_by(F.struct("m", "raised", "lead", "copies", "labels", "members"), choice).alias("c"))
    is_lead = F.col("c.m.file_id") == F.col("c.lead.file_id")
    score = F.when(is_lead, F.col("c.raised")).otherwise(-F.col("c.m.s"))
    labels = lambda keep: F.transform(F.filter("c.labels", keep), lambda x: x["label"])
    return main.select("qid", "rank", F.col("c.m.file_id").alias("file_id"), F.col("c.m.page_no").alias("page_no"), F.round(score, 6).alias("score"), F.col("c.copies").alias("copies"), labels(lambda x: F.array_contains(F.col("c.m.wins"), x["gid"])).alias("matched"), labels(lambda x: ~F.array_contains(F.col("c.m.wins"), x["gid"])).alias("missing"), F.transform("c.members", lambda m: F.struct(m["file_id"].alias("file_id"), m["page_no"].alias("page_no"))).alias("locations"))


def search(index: Index, alts: DataFrame, groups: DataFrame, n_parts: DataFrame | None = None, refs: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The k best contents of each query of a stated batch; see rank() for the columns.

    alts: qid, gid, part, alt, weight; groups: qid, gid, label, kind_weight, factor; n_parts: qid, gid, n_parts of the groups
    that have parts; refs: references(). Every page with any group is scored. Only done, pending and processing files show.
    Queries without any live group have no rows.
    """
    same = cut(equal_groups(alts, n_parts), "same")
    first = same.filter("qid = rq and gid = rg").select("qid", "gid")
    each = cut(members(alts.join(first, ["qid", "gid"], "left_semi"), index.table("vocabulary")), "members")
    pages = index.table("pages")
    files = index.table("files").filter(F.col("status").isin(*SEARCHABLE))
    place = ["page_id", "file_id", "page_no"]
    body = group_hits(each.join(index.posts(each), "term"), place, n_parts)
    path = group_hits(each.join(index.table("paths"), "term"), ["file_id"], n_parts, near=False)
    hits = cut(blended(body, path, pages), "hits")
    done = index.table("files").filter("status = 'done'").select("file_id")
    n_pages = pages.join(done, "file_id", "left_semi").count()
    stats, best, placed = score_files(hits, groups, pages, n_pages, same)
    known = pages.select("file_id", "page_no", "part_no", "part_kind", "part_sha")
    inner = F.when(F.col("part_kind").isin("pdf", "image", "word"), F.col("part_sha"))
    key = F.coalesce(inner, F.col("sha256"), F.concat(F.lit("file:"), F.col("file_id")))
    scored = best.join(files.select("file_id", "sha256"), "file_id").join(known, ["file_id", "page_no"]).withColumn("own_key", key).select("qid", "file_id", "page_no", "score", "wins", "own_key", "part_no")
    scored = cut(scored, "scored")
    return rank(content_keys(scored, refs), placed, stats, files, pages, k)


def unknown_groups(index: Index, alts: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, gid, label): groups of which no page and no path has any term."""
    each = members(alts, index.table("vocabulary")).join(index.table("vocabulary").select("term"), "term", "left_semi")
    return groups.select("qid", "gid", "label").join(each.select("qid", "gid").distinct(), ["qid", "gid"], "left_anti")


def bm25(posts: DataFrame, alts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, page_id, score): Okapi BM25 of the queries' terms over body postings with positions; one plan, without a job before."""
    length = posts.groupBy("page_id").agg(F.sum(F.size("at")).alias("len"))
    n, mean = length.agg(F.count("*")).scalar(), length.agg(F.avg("len")).scalar()
    wanted = alts.select("qid", "term").distinct()
    met = posts.join(wanted, "term")
    df = met.select("term", "page_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.size("at")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    return met.join(F.broadcast(df), "term").join(length, "page_id").groupBy("qid", "page_id").agg(F.sum(part).alias("score"))


def phrase_pages(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Pages where the terms stand in a row: the first one's positions, shifted and intersected with the others'."""

    def shifted(by: int) -> Column:
        return F.transform("at", lambda p: p - by)

    out = None
    for i, term in enumerate(terms):
        one = posts.filter(F.col("term") == term).select("page_id", shifted(i).alias("at"))
        out = one if out is None else out.alias("a").join(one.alias("b"), "page_id").select("page_id", F.array_intersect("a.at", "b.at").alias("at")).filter(F.size("at") > 0)
    return out.select("page_id")
def make_snippet(text: str | None, terms: list[str], width: int = 260, lead: int = 50) -> str | None:
    """HTML of the passage of `text` that holds most different terms, hits marked and everything else escaped."""
    import html
    import re

    from paperloom.functions.text import fold_text

    if text is None:
        return None
    wanted = set(terms)
    hits = [(m.start(), m.end(), f) for m in re.finditer(r"[^\W_]+", text) if (f := fold_text(m.group())) in wanted]
    best, start, left = 0, 0, 0
    seen: dict[str, int] = {}
    for a, b, f in hits:
        seen[f] = seen.get(f, 0) + 1
        while b - hits[left][0] > width - lead:
            seen[hits[left][2]] -= 1
            if not seen[hits[left][2]]:
                del seen[hits[left][2]]
            left += 1
        if len(seen) > best:
            best, start = len(seen), max(0, hits[left][0] - lead)
    end = min(len(text), start + width)
    while start > 0 and text[start - 1].isalnum():
        start -= 1
    while end < len(text) and text[end].isalnum():
        end += 1
    out, at = [], start
    for a, b, _ in hits:
        if a >= at and b <= end:
            out += [html.escape(text[at:a]), "<mark>", html.escape(text[a:b]), "</mark>"]
            at = b
    out.append(html.escape(text[at:end]))
    return ("… " if start else "") + "".join(out).strip() + (" …" if end < len(text) else "")


def snippets(hits: DataFrame, text: str = "text", terms: str = "terms") -> DataFrame:
    """hits with `snippet`; meant for the few rows that are left of a ranking."""
    import pandas as pd

    def run(t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([make_snippet(x, list(y)) for x, y in zip(t, q)], dtype=object)

    run.__annotations__ = {"t": pd.Series, "q": pd.Series, "return": pd.Series}
    return hits.withColumn("snippet", F.pandas_udf(run, "string")(text, terms))
