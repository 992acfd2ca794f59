"""Problem 4: text recognised from scanned pages, repaired into continuous paragraphs.

All in SQL but for the canonical form of odd characters. Words, and the shapes of figures, are counted over all pages; rare
ones join frequent ones by differences of their anagram hash, one difference for each confusion of signs. Running headers
are edge lines that recur on the pages of a file; what a hyphen at a line's end means is decided by the counted words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.canonical import canonical_udf
from paperloom.runtime import broadcast_if_small, cut, spread

# Signs as they are misread, and what they stand for.
CONFUSIONS = [
    ("c", "e"), ("†", "t"), ("!", "i"), ("!", "l"), ("q", "g"), ("li", "h"), ("|", "l"), ("|", "I"), ("1", "l"), ("1", "I"), ("1", "i"),
    ("cl", "d"), ("b", "h"), ("0", "o"), ("0", "O"), ("vv", "w"), ("ii", "ü"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("5", "S"), ("5", "s"), ("8", "B"),
    ("B", "ß"), ("a'", "ä"), ("o'", "ö"), ("u'", "ü"), ("l", "I"), ("I", "l"), ("6", "G"), ("9", "g"), ("VV", "W"), ("f", "t"), ("n", "u"), ("u", "n"),
]
#: Signs that fall together when several confusions meet in a word: pairs first, then single ones.
TOGETHER = [("vv", "w"), ("VV", "W"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("a'", "a"), ("o'", "o"), ("u'", "u")]
SAME = {"i": "!|1lI", "c": "e", "t": "†f", "g": "q9", "b": "h", "o": "0Oö", "s": "5S", "B": "8ß", "G": "6", "u": "nü", "a": "ä"}
#: Letters read for figures, and the figures.
FIGURES = ("OolI|!SB", "00111158")
#: A word counts as a misreading of another that is at least so many times as frequent, and seen so often. A word with a sign
#: that no word has needs neither.
RATIO, LEAST = 8, 4
#: Edge lines looked at on either side of a page, and the share of a file's or a part's pages on which a running line recurs.
EDGE, SHARE = 3, 0.4

SCANNED = ("ocr", "text+ocr")
_SIGN = r"\p{L}\p{N}†|!'"
_TOKEN = rf"[{_SIGN}](?:[{_SIGN}.,/:-]*[{_SIGN}])?"
#: A run of signs with a letter, without quotes around it or an exclamation mark behind it.
_WORD = r"(?=[\p{N}†|!]*\p{L})[\p{L}\p{N}†|!](?:[\p{L}\p{N}†|!']*[\p{L}\p{N}†|])"
_N = r"[\dOolI|!SB]{1,4}"
PAGE_MARK = rf"^[-–—(\[·]?\s*(?:(?:[Ss5]e[il1!|]†?t?[ec]|[S5]\.|B[l1|]a[t†]{{2}}|Page|Pag(?:ina|\.)|p\.|Bl\.)\s*{_N}(?:\s*(?:von|vom|of|di|de|van|/)\s*{_N})?)\s*[-–—)\]·]?$"
_BARE = rf"^[-–—(\[·]?\s*({_N})\s*[-–—)\]·]?$"
_OF = rf"^[-–—(\[]?\s*({_N})\s*/\s*({_N})\s*[-–—)\]]?$"


def _digits(c: Column) -> Column:
    return F.translate(c, "OolI|!SB", "00111158")


#: A prime: hashes are sums in its remainders, which no number of signs of any script can overflow.
_PRIME = 2_305_843_009_213_693_951


def _sign_hash(sign: Column) -> Column:
    return F.pmod(F.xxhash64(sign), F.lit(_PRIME))


def anagram_hash(word: Column) -> Column:
    """Sum of a hash of each character: the same for any order of them; a difference of two is that of the signs they differ in."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, x: F.pmod(a + _sign_hash(x), F.lit(_PRIME)))


def _delta(wrong: str, right: str) -> Column:
    """What exchanging the signs adds to the anagram hash."""
    total = F.lit(0).cast("long")
    for c in right:
        total = F.pmod(total + _sign_hash(F.lit(c)), F.lit(_PRIME))
    for c in wrong:
        total = F.pmod(total + F.lit(_PRIME) - _sign_hash(F.lit(c)), F.lit(_PRIME))
    return total


def fall_together(word: Column) -> Column:
    """One form for all words that confusions turn into each other: each class of signs has one."""
    for a, b in TOGETHER:
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.translate(word, "".join(SAME.values()), "".join(k * len(v) for k, v in SAME.items()))


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with canonical text; a soft hyphen at a line's end, which shows there, becomes a sign of its own."""
    shown = F.regexp_replace("text", "­[​-‍⁠﻿]*(?=\r?\n|$)", "¬")
    odd = F.col("text").rlike(r"[^\x0a\x20-\x7eÄÖÜäöüß§€²³†¬–·]")
    base = pages.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("id").alias("page_id"), "file_id", "page_no", F.col("source").isin(*SCANNED).alias("scanned"), shown.alias("text"), odd.alias("odd")).withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    plain = base.filter(~F.col("odd"))
    form = canonical_udf(fold_case=False)
    return plain.unionByName(base.filter("odd").withColumn("text", form("text"))).drop("odd")


def tokens(text: Column) -> Column:
    """Words of text, of two signs or more, and shapes of figures: "#" and the token with each run of digits as one 0."""
    words = F.regexp_extract_all(text, F.lit(_WORD), 0)
    digits = lambda t: F.length(F.regexp_replace(t, r"[^0-9]", ""))
    mostly = lambda t: (digits(t) * 2 >= F.length(F.regexp_replace(t, "[.,/:-]", ""))) | ~t.rlike("[^0-9OolI|!SB.,/:-]")
    numbers = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), 0), lambda t: (F.length(t) > 1) & t.rlike("[0-9]") & mostly(t))
    shapes = F.transform(numbers, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "[0-9]+", "0")))
    return F.when(text.rlike("[0-9]"), F.concat(words, shapes)).otherwise(words)


def lines(pages: DataFrame) -> DataFrame:
    """A row for each line: its tokens, whether a word may be divided at its end or begin, and the two halves of that word."""
    # Blank lines are lines; only trailing and leading blanks go.
    rows = F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.coalesce(F.get("ls", i + 1), F.lit("")).alias("below"), F.coalesce(F.get("ls", i - 1), F.lit("")).alias("above")))
    flat = pages.withColumn("ls", F.transform(F.split("text", "\n"), F.trim)).select("page_id", "file_id", "page_no", "scanned", F.explode(rows).alias("r")).select("page_id", "file_id", "page_no", "scanned", "r.*")
    open_end, open_begin = r"[\p{L}†|!'015689][-¬]$", r"^[\p{L}†|!1580]"
    # A hyphen in an address is part of it.
    hyphen = lambda c: F.col(c).endswith("-") | F.col(c).endswith("¬")  # noqa: E731 - the cheap test goes first
    ends = hyphen("line") & F.col("line").rlike(open_end) & F.col("below").rlike(open_begin) & ~F.col("line").rlike(r"@\S*-$")
    begins = hyphen("above") & F.col("above").rlike(open_end) & F.col("line").rlike(open_begin) & ~F.col("above").rlike(r"@\S*-$")
    left = F.regexp_extract("line", rf"([{_SIGN}]+)[-¬]$", 1)
    rest = F.regexp_extract("below", rf"^[{_SIGN}]+", 0)
    flat = flat.withColumn("ends", ends).withColumn("begins", begins)
    return flat.withColumn("left", F.when(F.col("ends"), left)).withColumn("rest", F.when(F.col("ends"), F.regexp_replace(rest, r"[!']+$", ""))).withColumn("soft", F.col("line").endswith("¬")).drop("above")


def _inner(flat: DataFrame) -> DataFrame:
    """flat with `tokens` of each line but the halves at its ends."""
    body = F.when(F.col("ends"), F.regexp_replace("line", rf"[{_SIGN}]+[-¬]$", "")).otherwise(F.col("line"))
    body = F.when(F.col("begins"), F.regexp_replace(body, rf"^[{_SIGN}]+", "")).otherwise(body)
    return flat.withColumn("tokens", tokens(body))


def vocabulary(flat: DataFrame) -> DataFrame:
    """(word, n_all, n_ref): how often each token stands on all pages, and on those that weren't scanned; halves aside."""
    words = _inner(flat).select("scanned", F.explode("tokens").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n_all"), F.count_if(~F.col("scanned")).alias("n_ref"))


def misreadings(words: DataFrame) -> DataFrame:
    """(word, right): rare tokens and the frequent one each misreads.

    A word is spread over the confusions whose signs it holds; adding one's hash difference must give the hash of a frequent
    word, and exchanging the signs the word itself. Where several confusions meet, however many, their differences vanish
    once confusable signs fall together, and the forms must be equal. The same holds for shapes of figures. Corrections
    rank by fewest confusions, then by frequency, then by the word. Words of any length are looked at.
    """
    rare = words.filter("n_ref * 20 <= n_all").select("word", "n_all")
    frequent = words.select(F.col("word").alias("right"), F.col("n_all").alias("n_right"), "n_ref")
    figure = F.col("word").startswith("#")
    odd = F.col("word").rlike(r"[†|!]|\p{L}[0-9]\p{L}|^[0-9]\p{Ll}{2}|\p{Ll}'\p{Ll}")
    enough = F.col("n_right") >= F.when(odd, F.col("n_all")).otherwise(F.greatest(F.lit(LEAST), F.col("n_all") * RATIO))
    # Few letters are easily those of another word: figures in place of them don't make a word.
    lettered = F.length(F.regexp_replace("word", r"[^\p{L}]", "")) * 2 > F.length("word")
    word_like = ~figure & lettered & (F.length("word") >= 3)
    table = F.array(*(F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("right"), _delta(a, b).alias("d")) for a, b in CONFUSIONS))
    apt = F.filter(table, lambda t: F.instr(F.col("word"), t["wrong"]) > 0)
    spread_out = rare.filter(word_like).select("word", "n_all", anagram_hash(F.col("word")).alias("own"), F.explode(apt).alias("k"))
    moved = spread_out.select("word", "n_all", F.pmod(F.col("own") + F.col("k.d"), F.lit(_PRIME)).alias("h"), "k")
    good = frequent.filter((F.col("n_right") >= LEAST) | (F.col("n_ref") > 0) | (F.col("n_right") >= 2))
    hashed = good.filter(~F.col("right").startswith("#")).select("right", "n_right", anagram_hash(F.col("right")).alias("h"))
    # Equal hashes say equal letters; the signs must also stand in their places.
    changed = F.greatest(F.length("k.wrong"), F.length("k.right"))
    once = moved.join(hashed, "h").filter(enough & (F.col("word") != F.col("right")) & (F.levenshtein("word", "right") <= changed)).select("word", "right", "n_right", F.lit(1).alias("steps"))

    form = F.when(figure, F.concat(F.lit("#"), F.regexp_replace(F.translate(F.substr("word", F.lit(2)), FIGURES[0], "0" * len(FIGURES[0])), "0+", "0"))).otherwise(fall_together(F.col("word")))
    several = rare.filter(figure & F.col("word").rlike("[OolI|!SB]") | (word_like & (F.length("word") >= 5))).select("word", "n_all", form.alias("form"))
    forms = good.withColumnRenamed("right", "word").select(F.col("word").alias("right"), "n_right", form.alias("form"))
    met = several.join(forms, "form").filter((F.col("word") != F.col("right")) & F.when(figure, F.col("n_right") >= F.greatest(F.lit(LEAST), F.col("n_all") * RATIO)).otherwise(enough))
    far = met.select("word", "right", "n_right", F.greatest(F.lit(2), F.levenshtein("word", "right")).alias("steps"))
    return once.unionByName(far).groupBy("word").agg(F.min_by("right", F.struct("steps", -F.col("n_right"), "right")).alias("right"))


def divided_words(flat: DataFrame) -> DataFrame:
    """(left, rest, word, n): the distinct pairs of halves at line ends, what they make together, and how often."""
    pairs = flat.filter(F.col("ends") & (F.col("left") != "") & (F.col("rest") != "")).groupBy("left", "rest", "scanned", "soft").agg(F.count("*").alias("n"))
    return pairs.groupBy("left", "rest").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("scanned"), F.col("n")).otherwise(0)).alias("n_ref"), F.max("soft").alias("soft")).withColumn("word", F.concat("left", "rest"))


def judged_halves(pairs: DataFrame, words: DataFrame, wrong: DataFrame) -> DataFrame:
    """(left, rest, divided, right): whether the halves are one word divided at the line's end, and its correction if misread.

    The counted words decide: they are if the whole is a word, or misreads one; they aren't if the whole is unknown but the
    second half is a word by itself ("Heiz- und"); an unknown whole with an unknown small second half is a rare word. A
    soft hyphen shows only where a word is divided.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = words.select(F.col("word"), F.col("n_all").alias("n_word"))
    second = words.select(F.col("word").alias("rest"), F.col("n_all").alias("n_rest"))
    all_ = pairs.join(known, "word", "left").join(second, "rest", "left").join(wrong.select("word", "right"), "word", "left")
    small = F.col("rest").rlike(r"^(?:\p{Ll}|[†|!1580]\p{Ll})")
    # A word that misreads nothing and whose second half stands alone far oftener is two.
    whole = (n("n_word") > 0) & (n("n_word") * 50 >= n("n_rest"))
    divided = F.col("soft") | (small & (whole | F.col("right").isNotNull() | (n("n_rest") <= 1)))
    return all_.select("left", "rest", "word", divided.alias("divided"), "right")


def _fold(line: Column) -> Column:
    """One form for a line and its misreadings: confusable signs fall together."""
    x = F.lower(line)
    for a, b in (("'", ""), ("vv", "w"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("li", "h"), ("ii", "u")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.translate(x, "äöüß0|!1l5†q8cb", "aouhoiiiistgheh")
    return F.regexp_replace(x, r"\s+", " ")


def with_first_page(pages: DataFrame, parts: DataFrame | None) -> DataFrame:
    """pages with `first_page` of the part each lies in: 1 outside any part; where parts overlap, the latest start.

    Parts are spread over their pages, so that the join is one of equal keys whatever the size of a file.
    """
    if parts is None:
        return pages.withColumn("first_page", F.lit(1))
    last = pages.groupBy("file_id").agg(F.max("page_no").alias("last"))
    real = parts.filter((F.col("n_pages") >= 1) & (F.col("first_page") >= 1)).join(last, "file_id").withColumn("to", F.least(F.col("first_page") + F.col("n_pages") - 1, F.col("last"))).filter(F.col("first_page") <= F.col("to"))
    starts = real.select("file_id", "first_page", F.explode(F.sequence("first_page", "to")).alias("page_no")).groupBy("file_id", "page_no").agg(F.max("first_page").alias("first_page"))
    return pages.join(starts, ["file_id", "page_no"], "left").withColumn("first_page", F.coalesce("first_page", F.lit(1)))


def _edge_marks(text: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(page_id, i, kind) of page numbers and running lines, i from 0."""
    full = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line"))), lambda r: r["line"] != "")
    ends = F.array_distinct(F.concat(F.slice("f", 1, EDGE), F.slice("f", F.greatest(F.size("f") - EDGE + 1, F.lit(1)), EDGE)))
    # What is read several times below is written once: the pages' places, and the few lines at their edges.
    scanned = cut(with_first_page(text.filter("scanned").select("page_id", "file_id", "page_no"), parts), "scan-pages")
    edges = text.filter("scanned").select("page_id", "text").withColumn("f", full).filter(F.size("f") > 0).select("page_id", F.explode(ends).alias("e")).select("page_id", "e.*").join(scanned, "page_id")
    bare, a, b = (_digits(F.regexp_extract("line", p, g)).try_cast("int") for p, g in ((_BARE, 1), (_OF, 1), (_OF, 2)))
    in_part = F.col("page_no") - F.col("first_page") + 1
    near = lambda n, by: n.between(F.col("page_no") - by, F.col("page_no")) | n.between(in_part - by, in_part)
    # Only short lines are marks.
    number = (F.length("line") <= 40) & (F.col("line").rlike(PAGE_MARK) | (F.col("line").rlike(_BARE) & near(bare, 1)) | (F.col("line").rlike(_OF) & (a >= 1) & (a <= b) & near(a, 2)))
    bare_line = F.regexp_replace("line", r"(?i)[\s·|,–-]*(?:(?:seite|s\.|blatt|page)\s*)\d{1,4}(?:\s*(?:von|of|/)\s*\d{1,4})?[\s·|,–-]*", " ")
    edges = edges.withColumn("number", F.coalesce(number, F.lit(False))).withColumn("key", F.when(~F.col("number"), _fold(F.trim(bare_line)))).drop("line", "page_no")
    edges = cut(edges, "scan-edges")
    marks = edges.filter("number").select("page_id", "i", F.lit("page_number").alias("kind"))
    running = edges.filter("not number").select("page_id", "file_id", "first_page", "i", "key").filter(F.length("key") >= 4)
    # Each part may have running lines of its own, which are few among all pages of a file of many parts.
    within = ["file_id", "first_page"]
    part_total = scanned.groupBy(within).agg(F.countDistinct("page_id").alias("part_pages"))
    # A page lies in one part, so that the parts' counts add up to the file's.
    total = part_total.groupBy("file_id").agg(F.sum("part_pages").alias("pages"))
    # Few rows are left of a file of any size before its running lines are known.
    by_part = running.groupBy(*within, "key").agg(F.countDistinct("page_id").alias("part_n"))
    by_file = by_part.groupBy("file_id", "key").agg(F.sum("part_n").alias("n")).filter("n >= 2").join(total, "file_id")
    share = (F.col("n") >= F.col("pages") * SHARE) | ((F.col("part_n") >= 2) & (F.col("part_n") >= F.col("part_pages") * SHARE))
    seen = by_part.join(by_file, ["file_id", "key"]).join(part_total, within).filter(share).select(*within, "key")
    headers = running.join(seen, [*within, "key"], "left_semi").select("page_id", "i", F.lit("header").alias("kind"))
    return marks.unionByName(headers)


def kinds(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no, kind) of the scanned pages' lines: header, page_number, hyphen, misread; lines count from 1.

    Pages of other sources only lend their words. Null and empty texts have no lines. Page numbers and running lines are
    sought on the EDGE first and last lines that aren't blank; a running line recurs on SHARE of the scanned pages
    of its file or of one of its parts, two at least, misreadings and the page's own number aside. A number mark counts
    from the file's first page or from that of the page's part: attachments restart their numbering. A repeated row of a page gives its lines once.
    """
    text = cut(prepared(pages), "scan-text")
    flat, halves, wrong = _evidence(text)
    flat = flat.filter("scanned")
    edge_marks = cut(_edge_marks(text, parts), "scan-marks")
    ends = flat.filter("ends").join(halves, ["left", "rest"])
    hyphens = ends.filter("divided").select("page_id", "i", F.lit("hyphen").alias("kind"))
    found = _inner(flat).select("page_id", "i", F.explode(F.array_distinct("tokens")).alias("word")).join(wrong.select("word"), "word").select("page_id", "i")
    whole = ends.filter(F.col("divided") & F.col("right").isNotNull())
    left = whole.filter(~F.col("right").startswith(F.col("left"))).select("page_id", "i")
    rest = whole.filter(~F.col("right").endswith(F.col("rest"))).select("page_id", (F.col("i") + 1).alias("i"))
    # Halves that aren't one word are words by themselves.
    apart = ends.filter("not divided").select("page_id", F.explode(F.array(F.struct(F.col("left").alias("word"), F.col("i").alias("i")), F.struct(F.col("rest").alias("word"), (F.col("i") + 1).alias("i")))).alias("x")).select("page_id", "x.*")
    alone = apart.join(wrong.select("word"), "word").select("page_id", "i")
    misread = found.unionByName(left).unionByName(rest).unionByName(alone).distinct().withColumn("kind", F.lit("misread"))
    body = hyphens.unionByName(misread).join(edge_marks.select("page_id", "i").distinct(), ["page_id", "i"], "left_anti")
    return edge_marks.unionByName(body).select("page_id", (F.col("i") + 1).cast("int").alias("line_no"), "kind").distinct()


def _evidence(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines, the judged halves of words, and the misread tokens with their corrections; small tables are marked for broadcast."""
    flat = lines(spread(text))
    words = cut(vocabulary(flat), "scan-words")
    pairs = cut(divided_words(flat), "scan-halves")
    # The wholes of divided words are words as well, so that their misreadings are found.
    wholes = pairs.select("word", F.col("n").alias("n_all"), "n_ref")
    every = words.unionByName(wholes).groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_ref").alias("n_ref"))
    wrong = cut(misreadings(every), "scan-misreadings")
    halves = cut(judged_halves(pairs, words, wrong), "scan-judged")
    return flat, broadcast_if_small(halves), broadcast_if_small(wrong)


def _mended(token: Column, right: Column) -> Column:
    """The token as its correction has it: a word's is the word; a shape of figures says which letters are figures."""
    head = F.regexp_extract(right, "^#([^0]*)", 1)
    figures = F.concat(head, F.translate(F.substr(token, F.length(head) + 1), *FIGURES))
    return F.when(right.startswith("#"), figures).otherwise(right)


def paragraphs(pages: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(page_id, text) of the scanned pages as continuous paragraphs: page numbers and running lines gone, divided words
    joined, misread tokens replaced by the best-ranked correction, lines joined up to the next blank one."""
    text = cut(prepared(pages), "scan-text")
    flat, halves, wrong = _evidence(text)
    flat = flat.filter("scanned")
    gone = _edge_marks(text, parts).select("page_id", "i", F.lit(True).alias("gone")).distinct()
    kept = flat.select("page_id", "i", "line", "left", "rest").distinct().join(gone, ["page_id", "i"], "left").filter("gone is null")
    ends = kept.join(halves.filter("divided").select("left", "rest", F.lit(True).alias("joined")), ["left", "rest"], "left")
    # A divided line gives its hyphen away and runs into the next without a blank.
    shown = F.when(F.col("joined"), F.concat(F.regexp_replace("line", "[-¬]$", ""), F.lit("\u0001"))).otherwise(F.col("line"))
    one = ends.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("line")))).alias("ls"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    flowing = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "\u0001\n?", ""), r"(?<!\n)\n(?!\n)", " "), r"\n{2,}", "\n\n")
    whole = one.select("page_id", F.trim(flowing).alias("text"))
    raw = F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN), 0))
    shape = F.concat(F.lit("#"), F.regexp_replace("raw", "[0-9]+", "0"))
    pieces = whole.select("page_id", F.explode(raw).alias("raw")).select("page_id", "raw", F.explode(F.array_distinct(F.concat(F.array(shape), F.transform(F.split("raw", "[.,/:-]+"), lambda w: F.regexp_replace(w, r"^'+|[!']+$", ""))))).alias("word"))
    met = pieces.join(wrong, "word").select("page_id", F.when(F.col("word").startswith("#"), F.col("raw")).otherwise(F.col("word")).alias("word"), "right").withColumn("right", _mended(F.col("word"), F.col("right"))).distinct()
    used = met.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("word", "right"))).alias("fix"))
    put = F.aggregate(F.coalesce("fix", F.array().cast("array<struct<word:string,right:string>>")), F.col("text"), lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), f["word"], F.lit(r"\E(?![\p{L}\p{N}])")), F.regexp_replace(f["right"], r"([$\\])", r"\\$1")))
    return whole.join(used, "page_id", "left").select("page_id", put.alias("text"))
