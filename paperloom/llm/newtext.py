"""Problem 3: only what the sender of a mail newly wrote.

Two kinds of evidence decide on each line. Inheritance: the words of a mail are compared with the earlier mails of its
thread. Rolling-hash shingles, so chosen that a run of WINDOW_WORDS words shares one at least, give the ancestors; the texts
are then aligned, and runs of LEAST_RUN words or more in the same order are inherited, marked or not. Marks: quote
prefixes, lines that introduce or end quoted and forwarded messages, signature dividers, contact blocks and standing
notices, for what stands in no mail of the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.canonical import canonical
from paperloom.runtime import broadcast_if_small, cut

#: Words of a shingle, shingles of which one is kept at least, least length of an inherited run in words.
SHINGLE, WINDOW, LEAST_RUN = 5, 4, 8
WINDOW_WORDS = SHINGLE + WINDOW - 1

SUBJECT_MARK = re.compile(r"^\s*(?:(?:re|aw|antw|antwort|wg|fw|fwd|sv|vs|rv|tr|rif|enc|doorst|betr|r|i)\s*(?:\[\d+\]|\(\d+\)|\^\d+)?\s*:|\[\s*(?:ext|extern|external|externe mail|externe e-mail|extern mail|externer absender|spam|verdacht|suspected spam|\*+\s*spam\s*\*+)[^\]]{0,20}\]|\*{2,}\s*spam\s*\*{2,})\s*", re.I)

_DATE = r"(?:\d{1,2}\.\s?(?:\d{1,2}\.|[A-Za-zäöü]+)\s?\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\.? [A-Za-zäöü]+\.? \d{4}|[A-Z][a-z]+ \d{1,2}, \d{4})"
_WHEN = rf"(?:[A-Za-zäöü]{{2,10}}[.,]{{0,2}} (?:den )?)?{_DATE}(?:,? (?:um |at )?\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?: ?Uhr)?)?"
INTRO = [re.compile(p, re.I) for p in (
    rf"^am {_WHEN},? schrieb(?: [^.?!]{{2,120}})?:?$",
    rf"^on {_WHEN},? .{{2,120}} wrote:$",
    rf"^.{{2,80}} (?:schrieb|wrote|hat geschrieben) (?:am |on )?{_WHEN}:$",
    rf"^am {_WHEN},? .{{2,80}}:$",
    rf"^von: .{{2,80}} am {_WHEN}$",
    rf"^(?:le {_WHEN},? .{{2,80}} a écrit|il giorno {_WHEN},? .{{2,80}} ha scritto|op {_WHEN},? .{{2,80}} schreef).{{0,60}}:$",
)]
DIVIDED = re.compile(r"^[-_=*\s]{2,}\s*(?:ursprüngliche nachricht|original message|original-nachricht|originalnachricht|originele bericht|message d'origine|messaggio originale|weitergeleitete nachricht|forwarded message|anfang der weitergeleiteten nachricht|begin forwarded message|message transféré|messaggio inoltrato)\s*[-_=*\s]{0,}:?$", re.I)
CITED = re.compile(r"^[-_=*\s]{2,}\s*(?:zitat|quote)(?: anfang| start| begin)?\s*[-_=*\s]{2,}$", re.I)
CITED_END = re.compile(r"^[-_=*\s]{2,}\s*(?:zitat|quote|ende|end)[ a-z]*(?:ende|end)?[ a-z]*\s*[-_=*\s]{2,}$", re.I)
HEAD = re.compile(r"^\*?(von|from|de|da|van|gesendet|sent|datum|date|an|to|à|a|aan|cc|kopie|betreff|subject|objet|oggetto|onderwerp|antwort an|reply-to)\s*:\*?\s", re.I)
FIRST_HEAD = re.compile(r"^\*?(von|from)\s*:\*?\s", re.I)
PREFIX = re.compile(r"^\s{0,2}(?:>|[|:](?=[\s>|:]|$))")
MORE_THAN = re.compile(r"^>\s*\d[\d.,]*\s*(?:eur|euro|€|%|m²|m2|kg|stück|cm|mm|m|km|kwh|°c)\b", re.I)
SIGN_DIVIDER = re.compile(r"^(?:--\s?|[_*=-]{6,}|[-_*=]{2}\s*\n)$")
CLOSING = re.compile(r"^(?:(?:mit |viele |liebe |beste |freundliche |freundlichen |herzliche |schöne |best |kind |warm |many )*(?:freundlichen |besten |herzlichen |lieben )?(?:grüße|grüßen|gruß|gruss|grüsse|grüssen|regards|wishes|greetings)|mfg|vg|lg|hochachtungsvoll|sincerely|yours sincerely|yours faithfully|cheers|cordialement|bien cordialement|cordiali saluti|distinti saluti|met vriendelijke groet|groeten)(?: (?:aus|from) \w+)?[,.!]?$", re.I)
GREETING = re.compile(r"^(?:guten (?:tag|morgen|abend)|hallo|moin|sehr geehrte|liebe|lieber|dear|hello|hi|good (?:morning|afternoon)|bonjour|buongiorno|geachte|beste|servus|grüß gott)\b[^.?!]{0,60}[,!]?$", re.I)
NAME_LINE = re.compile(r"^(?:(?:Dr|Prof|Dipl)\.?[-\w]*\.? )*(?:[^\W\d_](?:[^\W\d_]|['-])*\.?)(?: (?:von|van|de|der|den|zu|[^\W\d_](?:[^\W\d_]|['-])*\.?)){0,3}$")
NOTICE = [re.compile(p, re.I) for p in (
    r"^(?:sent|gesendet|verschickt|envoyé|inviato|verzonden) (?:from|von|de|da|vanaf|via|mit)\b.{0,60}$",
    r"^von (?:unterwegs|meinem \w+|meiner \w+)\b.{0,30}(?:gesendet|geschrieben|verschickt)\.?$",
    r"^diese (?:nachricht|mail|e-mail) wurde (?:mobil|von|unterwegs|mit|auf)\b.{0,60}$",
    r"^(?:diese|die vorliegende) (?:e-mail|mail|nachricht)\b.{0,60}\b(?:vertraulich|ausschließlich|rechtlich geschützt)",
    r"^(?:this|the) (?:message|e-?mail|communication)\b.{0,80}\b(?:confidential|privileged|intended)",
    r"^if you (?:are not the|have received this)",
    r"^der inhalt (?:dieser \S+ )?ist (?:nur|ausschließlich|vertraulich)",
    r"^(?:wenn|falls|sollten) sie nicht der (?:richtige|vorgesehene|beabsichtigte)",
    r"^hinweis(?:e)? zum datenschutz\b",
    r"^(?:informationen|hinweise) zum datenschutz\b",
    r"^\[?(?:extern|external|ext|achtung|warnung|caution|vorsicht)\b\]?:?.{0,40}\b(?:außerhalb|externe[rn]?|outside|external|absender|anhäng|links)",
    r"^(?:bitte (?:denken|prüfen) sie|please consider).{0,60}(?:umwelt|environment|ausdruck|print)",
    r"^virenfrei|^this e-?mail (?:has been|was) (?:checked|scanned)|^diese e-?mail wurde.{0,40}viren",
)]
CONTACT = re.compile(r"^(?:(?:tel(?:efon|\.)?|fon|t|f|fax|mobil|handy|phone|mobile|m)\b\s*[.:]?\s*[+(\d][\d\s()/+.-]{5,}|(?:e-?mail|mail|web|internet)\s*:.+|sitz der gesellschaft\b.*|(?:amtsgericht|hrb|ust-?id|geschäftsführ)\b.*|[\w.+-]+\s*(?:@|\(at\)|\[at\])\s*[\w.-]+|.{3,50}\b\d+\s?[a-z]?(?:-\d+)?, \d{5} .+)$", re.I)


def subject_key(subject: str | None) -> str | None:
    """Subject without the marks of replying, forwarding and gateways: the name of the thread."""
    if subject is None:
        return None
    text = canonical(subject)
    while m := SUBJECT_MARK.match(text):
        text = text[m.end() :]
    return text.strip() or None


def marked_subject(subject: str | None) -> bool:
    return bool(subject) and SUBJECT_MARK.match(canonical(subject, fold_case=False)) is not None


def marked_subjects(s: pd.Series) -> pd.Series:
    return s.map(marked_subject)


def body_start(lines: list[str]) -> int:
    """Index of the first line below the header block; the number of lines if there is none."""
    return next((i + 1 for i, line in enumerate(lines) if not line.strip()), len(lines))


def _notice(line: str) -> bool:
    return any(p.match(line) for p in NOTICE)


def _head_block(lines: list[str], i: int) -> int:
    """Lines of the header block of a quoted message that begins at i; 0 if there is none."""
    if i >= len(lines) or not FIRST_HEAD.match(lines[i]):
        return 0
    n = 1
    while i + n < len(lines) and HEAD.match(lines[i + n]):
        n += 1
    return n if n >= 2 else 0


def _intro(lines: list[str], i: int) -> int:
    """Number of lines that introduce a quoted message at i; 0 if none does."""
    if (n := _head_block(lines, i)) > 0:
        return n
    line = lines[i]
    if DIVIDED.match(line) or re.match(r"^[_=-]{10,}$", line):
        j = i + 1
        while j < len(lines) and not lines[j]:
            j += 1
        n = _head_block(lines, j)
        return j - i + n if n else int(bool(DIVIDED.match(line)))
    for p in INTRO:
        if p.match(line):
            # "Am ... schrieb" may break before the name.
            if line.endswith("schrieb") and i + 1 < len(lines) and lines[i + 1].endswith(":"):
                return 2
            if line.endswith(":") or p is INTRO[4]:
                return 1
    # ... or within the name, the address.
    if i + 1 < len(lines) and lines[i + 1].endswith(":") and len(lines[i + 1]) < 90 and any(p.match(f"{line} {lines[i + 1]}") for p in INTRO[:2]):
        return 2
    return 0


def _contact_block(lines: list[str], i: int) -> int:
    """Lines of the block at i if it is a signature without a divider: short lines, at least one of them contact data."""
    n = 0
    while i + n < len(lines) and lines[i + n]:
        n += 1
    block = lines[i : i + n]
    if n > 1 and all(len(x) < 70 and not re.search(r"[.!?,;]$", x) for x in block) and any(CONTACT.match(x) for x in block[1:]):
        return n
    return 0


def classify(text: str, inherited: set[int] = frozenset()) -> list[bool]:
    """For each line of text, whether the sender newly wrote it. Header block and blank lines count as True."""
    raw = text.split("\n")
    lines = [canonical(x, fold_case=False).strip() for x in raw]
    new = [True] * len(lines)
    i = body_start(lines)
    closed = written = False
    quote = None  # of an unmarked quote: {"cited", "closed"}
    while i < len(lines):
        line = lines[i]
        if not line:
            i += 1
            continue
        if PREFIX.match(raw[i]) or PREFIX.match(line):
            near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if not (MORE_THAN.match(line) and not any(PREFIX.match(x) for x in near)) or quote or closed:
                new[i] = False
            else:
                written = True
            i += 1
            continue
        cited = CITED.match(line) and "ende" not in line.lower() and not re.search(r"\bend\b", line.lower())
        if cited or (n := _intro(lines, i)):
            n = 1 if cited else n
            new[i : i + n] = [False] * n
            i += n
            j = i
            while j < len(lines) and not lines[j]:
                j += 1
            # Marked quotes carry their own prefix; an unmarked one runs on.
            if cited or (j < len(lines) and not PREFIX.match(lines[j])):
                quote = {"cited": bool(cited), "closed": False}
            elif quote is None or not quote["cited"]:
                quote = None if not quote else quote
            continue
        if quote is not None:
            if quote["cited"]:
                if CITED_END.match(line):
                    quote = None
                new[i] = False
                i += 1
                continue
            # A quote above the reply ends with its closing formula; the reply begins with a greeting.
            if not written and not closed and quote["closed"] and GREETING.match(line):
                quote = None
                continue
            if CLOSING.match(line):
                quote["closed"] = True
            new[i] = False
            i += 1
            continue
        if _notice(line):
            while i < len(lines) and lines[i] and not (i > 0 and _intro(lines, i)):
                new[i] = False
                i += 1
            continue
        if SIGN_DIVIDER.match(line):
            closed = True
        elif not closed and (n := _contact_block(lines, i)):
            new[i : i + n] = [False] * n
            closed = True
            i += n
            continue
        if closed:
            new[i] = False
            i += 1
            continue
        if CLOSING.match(line):
            closed = True
            if i + 1 < len(lines) and NAME_LINE.match(lines[i + 1]):
                i += 1
        written = True
        i += 1
    for k in inherited:
        if k < len(new) and lines[k]:
            new[k] = False
    return new


_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _body_words(text: str) -> tuple[list[str], list[int]]:
    """Folded words of the body, and the line of each."""
    lines = text.split("\n")
    words, where = [], []
    for i in range(body_start(lines), len(lines)):
        found = _WORDS.findall(canonical(lines[i]))
        words += found
        where += [i] * len(found)
    return words, where


def shingles(words: list[str]) -> np.ndarray:
    """Rolling hashes of the runs of SHINGLE words."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    each = pd.util.hash_array(np.array(words, dtype=object))
    h = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h = (h * _MIX) ^ each[j : len(words) - SHINGLE + 1 + j]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def kept_shingles(words: list[str]) -> np.ndarray:
    """The least shingle of each WINDOW of them: equal runs of WINDOW_WORDS words have one in common, wherever they stand."""
    h = shingles(words)
    if len(h) <= WINDOW:
        return np.unique(h.min(keepdims=True)) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def aligned_runs(words: list[str], other: list[str]) -> list[tuple[int, int]]:
    """(start, length) in `words` of the runs that stand in `other` as well and in the same order, LEAST_RUN words or more.

    Equal shingles on one diagonal make a run; of the runs the chain of greatest total length is taken that goes forward in
    both texts.
    """
    a, b = shingles(words), shingles(other)
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a, side=x) for x in ("left", "right"))
    many = hi - lo
    pos = np.repeat(np.arange(len(a)), many)
    if not len(pos):
        return []
    there = order[np.repeat(lo, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)]
    by = np.lexsort((pos, pos - there))
    pos, there = pos[by], there[by]
    heads = np.flatnonzero(np.r_[True, (np.diff(pos - there) != 0) | (np.diff(pos) != 1)])
    sizes = np.diff(np.r_[heads, len(pos)]) + SHINGLE - 1
    runs = sorted((int(p), int(q), int(n)) for p, q, n in zip(pos[heads], there[heads], sizes) if n >= LEAST_RUN)
    best: list[tuple[int, int]] = []
    for i, (p, q, n) in enumerate(runs):
        before = max(((best[j][0], j) for j in range(i) if runs[j][0] + runs[j][2] <= p and runs[j][1] + runs[j][2] <= q), default=(0, -1))
        best.append((before[0] + n, before[1]))
    out, at = [], max(range(len(runs)), key=lambda i: best[i][0], default=-1)
    while at >= 0:
        out.append((runs[at][0], runs[at][2]))
        at = best[at][1]
    return out[::-1]


def inherited_lines(text: str, ancestors: list[str] | None) -> set[int]:
    """Lines whose words all lie in runs aligned with one of the ancestors' texts."""
    if ancestors is None or not len(ancestors):
        return set()
    words, where = _body_words(text)
    out: set[int] = set()
    for other in ancestors:
        covered = np.zeros(len(words), bool)
        for start, n in aligned_runs(words, _body_words(other)[0]):
            covered[start : start + n] = True
        lines: dict[int, bool] = {}
        for i, c in zip(where, covered):
            lines[i] = lines.get(i, True) and bool(c)
        out |= {i for i, c in lines.items() if c}
    return out


def _people(*columns: str):
    """Addresses in mail fields, in lower case."""
    text = F.concat_ws(" ", *(F.col(c) for c in columns))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}._+-]+@[\p{L}\p{N}.-]+"), 0), F.lower))


def inherited(base: DataFrame) -> DataFrame:
    """(row, lines): the lines that a mail has from any one of the earlier mails of its thread; rows without such lines are left out.

    base: row, file_id, message_id, sender, recipients, key, utc_ms, text, kept. A thread is a subject without its marks. An
    ancestor's sender has part in the mail, as far as both name addresses; other copies of the same message are none.

    All ancestors count, yet few pairs are aligned. Mails meet in blocks of a thread, an address and a shingle, and each is
    aligned with the earliest of each block first, which settles what a whole thread repeats. Any other ancestor can only add a
    line that is still open, and only if each word of it stands in a run of WINDOW_WORDS words that both have. So of each open
    line the word whose runs have the fewest bearers is taken: without a bearer the line is new, else the bearers are aligned,
    from the earliest on and in growing numbers, until the line is settled or none is left.
    """
    known = base.filter("key is not null and utc_ms is not null").select("row", "file_id", F.col("message_id").alias("m"), "key", "utc_ms", "kept", _people("sender").alias("by"), _people("sender", "recipients").alias("with"))
    # "": senders without an address; "*": all senders of a thread, for its mails that name no address at all.
    unnamed = known.filter(F.size("with") == 0).select("key").distinct().withColumn("unnamed", F.lit(True))
    no_one, any_one = F.array(F.lit("")), F.array(F.lit("*"))
    bears = F.when(F.size("by") == 0, no_one).otherwise(F.col("by"))
    bears = F.when(F.col("unnamed"), F.concat(bears, any_one)).otherwise(bears)
    asks = F.when(F.size("with") == 0, any_one).otherwise(F.array_union("with", no_one))
    circles = [F.transform(who, lambda x: F.xxhash64("key", x)).alias(name) for who, name in ((bears, "bears"), (asks, "asks"))]
    marked = cut(known.join(unnamed, "key", "left").select("row", "utc_ms", "kept", *circles), "shingles")

    bearing = _blocks(marked, "bears", "kept").select("b", "h", F.col("row").alias("anc"), F.col("utc_ms").alias("at"))
    earliest = bearing.groupBy("b").agg(F.min(F.struct("at", "anc")).alias("first"))
    shared = cut(_blocks(marked, "asks", "kept").join(earliest, "b").filter("first.at < utc_ms").select("row", "b", "h", "first.anc"), "shared")
    settled = cut(_aligned(base, known, shared.select("row", "anc").distinct()), "settled")

    own = shared.groupBy("row").agg(F.collect_set("h").alias("hs"))
    borne = bearing.join(shared.select("b").distinct(), "b", "left_semi").groupBy(F.col("anc").alias("row")).agg(F.collect_set("h").alias("hs"))
    nothing = F.array().cast("array<int>")
    texts, times = base.select("row", "text"), marked.drop("kept")
    windows, rarest = F.pandas_udf(_windows, "array<long>"), F.pandas_udf(_rarest, "lines array<int>, gs array<long>")
    having = cut(texts.join(borne, "row").select("row", windows("text", "hs", nothing).alias("gs")), "having").join(times, "row")
    having = _blocks(having, "bears", "gs").select("b", F.col("row").alias("anc"), F.col("utc_ms").alias("at"))
    still = texts.join(settled, "row", "left").withColumn("lines", F.coalesce("lines", nothing))
    wanted = still.join(own, "row").select("row", windows("text", "hs", "lines").alias("gs")).join(times, "row")
    many = having.groupBy("b").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    weighed = _blocks(wanted, "asks", "gs").join(many, "b").filter("at < utc_ms").groupBy("row", F.col("h").alias("g")).agg(F.sum("n").alias("n"))
    weighed = weighed.groupBy("row").agg(F.collect_list(F.struct("g", "n")).alias("found"))
    asked = still.join(weighed, "row").select("row", rarest("text", "found.g", "found.n", "lines").alias("r"))
    asked = asked.select("row", F.explode(F.arrays_zip("r.lines", "r.gs")).alias("r")).select("row", F.col("r.lines").alias("line"), F.array("r.gs").alias("gs"))
    asked = cut(_blocks(asked.join(times, "row"), "asks", "gs", "line"), "asked")
    in_order = F.row_number().over(Window.partitionBy("b").orderBy("at", "anc"))
    ranked = cut(having.join(asked.select("b").distinct(), "b", "left_semi").withColumn("rank", in_order), "ranked")
    last = ranked.agg(F.max("rank")).first()[0] or 0
    low, high = 0, 2
    while low < last:
        left = asked.join(settled.select("row", F.explode("lines").alias("line")), ["row", "line"], "left_anti")
        now = left.join(ranked.filter(f"rank > {low} and rank <= {high}"), "b").filter("at < utc_ms").select("row", "anc").distinct()
        settled = settled.unionByName(cut(_aligned(base, known, now), "settled"))
        low, high = high, 8 * high
    return settled.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def _blocks(mails: DataFrame, circles: str, hashes: str, *more: str) -> DataFrame:
    """(row, utc_ms, h, b): each hash of a mail in each of its circles of a thread and an address; b is the block of both."""
    each = mails.select("row", "utc_ms", *more, F.explode(circles).alias("circle"), hashes)
    return each.select("row", "utc_ms", *more, "circle", F.explode(hashes).alias("h")).select("row", "utc_ms", *more, "h", F.xxhash64("circle", "h").alias("b"))


def _aligned(base: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, lines): of the pairs (row, anc) those that may be mail and ancestor, aligned, and the lines inherited from any."""
    mine = known.select("row", "file_id", "m", "key", "utc_ms", "with")
    theirs = known.select(F.col("row").alias("anc"), F.col("file_id").alias("af"), F.col("m").alias("am"), F.col("key").alias("ak"), F.col("utc_ms").alias("at"), "by")
    met = (F.size("by") == 0) | (F.size("with") == 0) | F.arrays_overlap("by", "with")
    other = (F.col("ak") == F.col("key")) & (F.col("at") < F.col("utc_ms")) & (F.col("af") != F.col("file_id")) & ~F.coalesce(F.col("am") == F.col("m"), F.lit(False)) & met
    fit = cut(pairs.join(mine, "row").join(theirs, "anc").filter(other).select("row", "anc"), "pairs")
    earlier = base.select(F.col("row").alias("anc"), F.col("text").alias("earlier")).join(broadcast_if_small(fit), "anc")
    lines = earlier.join(base.select("row", "text"), "row").select("row", F.explode(F.pandas_udf(_lines, "array<int>")("text", "earlier")).alias("line"))
    return lines.groupBy("row").agg(F.collect_set("line").alias("lines"))


def judge(mails: DataFrame, pages: DataFrame, instants: DataFrame, marks: bool = True) -> DataFrame:
    """(file_id, subject, text, new) of every mail with a first page: for each of its lines whether it is newly written.

    mails: file_id, subject, sender, recipients, message_id; pages: file_id, page_no, text; instants: file_id, utc_ms. A mail
    without a subject or a time has no ancestors; a null text has no lines; with repeated rows of a mail each is judged.
    marks: whether the marks of quotes, signatures and notices count, beside what is inherited.
    """
    key = F.pandas_udf(_keys, "string")
    first = pages.filter("page_no = 1").select("file_id", "text")
    given = [F.col(c) if c in mails.columns else F.lit(None).cast("string").alias(c) for c in ("sender", "recipients")]
    base = mails.select("file_id", "subject", "message_id", *given).join(first, "file_id").filter(F.col("text").isNotNull()).join(instants.select("file_id", "utc_ms").distinct(), "file_id", "left").withColumn("key", key("subject"))
    base = cut(base.withColumn("kept", F.pandas_udf(_kept, "array<long>")("text")).withColumn("row", F.monotonically_increasing_id()), "mails")
    both = base.drop("kept").join(inherited(base), "row", "left")
    return both.select("file_id", "subject", "text", F.pandas_udf(_judge if marks else _inherit, "array<boolean>")("text", "lines").alias("new"))


def _keys(s: pd.Series) -> pd.Series:
    return s.map(subject_key)


def _kept(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: kept_shingles(_body_words(t)[0]))


def _runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each run of WINDOW_WORDS words its hash, made of those of its shingles, and the shingle that is kept of it."""
    h = shingles(words)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    g = np.zeros(len(view), np.uint64)
    for j in range(WINDOW):
        g = (g * _MIX) ^ view[:, j].view(np.uint64)
        g ^= g >> np.uint64(31)
    return g.view(np.int64), view.min(axis=1)


def _windows(texts: pd.Series, kept: pd.Series, settled: pd.Series) -> pd.Series:
    """The runs of WINDOW_WORDS words whose kept shingle is among `kept` and that have a word outside the settled lines."""

    def one(text, hs, lines):
        words, where = _body_words(text)
        g, least = _runs(words)
        if not len(g):
            return g
        to_settle = np.lib.stride_tricks.sliding_window_view(~np.isin(where, lines), WINDOW_WORDS).any(axis=1)
        return np.unique(g[to_settle & np.isin(least, hs)])

    return pd.Series([one(*x) for x in zip(texts, kept, settled)], index=texts.index, dtype=object)


def _rarest(texts: pd.Series, runs: pd.Series, bearers: pd.Series, settled: pd.Series) -> pd.DataFrame:
    """Of each line that is not settled and whose words all stand in runs that others bear: the runs of the word with the fewest bearers."""

    def one(text, gs, ns, lines):
        words, where = _body_words(text)
        g, _ = _runs(words)
        many = dict(zip(gs, ns))
        n = np.array([many.get(x, 0) for x in g], np.int64)
        # Bearers of the runs that a word stands in: those that begin at it or up to WINDOW_WORDS - 1 words before it.
        total = np.convolve(n, np.ones(WINDOW_WORDS, np.int64))
        where, out = np.array(where), set()
        for line in np.setdiff1d(where, lines):
            at = np.flatnonzero(where == line)
            w = at[total[at].argmin()]
            if total[w]:
                out.update((line, g[p]) for p in range(max(0, w - WINDOW_WORDS + 1), min(w + 1, len(g))) if n[p])
        return [x for x, _ in out], [x for _, x in out]

    return pd.DataFrame([one(*x) for x in zip(texts, runs, bearers, settled)], columns=["lines", "gs"])


def _lines(texts: pd.Series, earlier: pd.Series) -> pd.Series:
    return pd.Series([sorted(inherited_lines(t, [e])) for t, e in zip(texts, earlier)], index=texts.index, dtype=object)


def _judge(texts: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([classify(t, set() if gone is None else set(gone)) for t, gone in zip(texts, lines)])


def _inherit(texts: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([[i not in gone for i in range(len(t.split("\n")))] for t, x in zip(texts, lines) for gone in [set() if x is None else set(x)]])


def written_text(judged: DataFrame) -> DataFrame:
    """(file_id, subject, text): the bare subject and only the newly written lines, header block and others left out."""

    def run(texts: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for t, new in zip(texts, news):
            lines = t.split("\n")
            a = body_start(lines)
            out.append(re.sub(r"\n{3,}", "\n\n", "\n".join(x for x, n in zip(lines[a:], new[a:]) if n)).strip())
        return pd.Series(out)

    bare = F.pandas_udf(_bare, "string")
    return judged.select("file_id", bare("subject").alias("subject"), F.pandas_udf(run, "string")("text", "new").alias("text"))


def _bare(s: pd.Series) -> pd.Series:
    def one(v):
        while v and (m := SUBJECT_MARK.match(v)):
            v = v[m.end() :]
        return v

    return s.map(one)
