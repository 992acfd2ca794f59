"""Problem 1: text decoded with the wrong character encoding.

For every ordered pair of a true and a wrong encoding the garbled form of each sign is precomputed. A multi-pattern
automaton finds these forms; only the matched spans are replaced, so that correct text beside them stays. Forms of two or
more characters are evidence by themselves. A form of one printable character ("„" for "ä") may as well be meant, so it
counts only if the word repaired by one encoding pair is a word of the corpus that speaks against the one found: it is
more frequent, or as frequent and written with more frequent letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Single-byte encodings that a name may have had or a tool may have assumed.
CODECS = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "cp1254", "cp1257")
MARKS = "̧̀́̂̃̈̊̌"
LOST = "�"
_BLANK = {"\xa0", "\xad"}


@cache
def alphabet() -> str:
    """Every sign beyond ASCII that one of the encodings has: letters, and signs that names hold."""
    found = {c for name in CODECS for b in range(0x80, 0x100) if (c := bytes([b]).decode(name, "ignore"))}
    return "".join(sorted(c for c in found if unicodedata.category(c)[0] in "LPS"))


def _decoded(data: bytes, wrong: str) -> str | None:
    """data read in the wrong encoding; bytes that it leaves undefined stay as the control characters of that value."""
    out = []
    for b in data:
        try:
            c = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            c = chr(b)
        out.append(c)
    return "".join(out)


@cache
def garbled_forms() -> dict[str, list[tuple[str, str, bool]]]:
    """Garbled form -> (intended text, encoding pair, whether the form is evidence by itself)."""
    forms: dict[str, dict[tuple[str, str], bool]] = {}

    def add(form: str | None, meant: str, pair: str, strong: bool) -> None:
        if form and form != meant and not form.isascii() and not any(c in LOST for c in form):
            strong = strong and not (len(form) == 2 and form[1] in _BLANK)
            forms.setdefault(form, {}).setdefault((meant, pair), strong)

    for wrong in CODECS:
        for c in alphabet() + MARKS:
            # Letters of another script than Latin are too many for two signs to be evidence.
            sure = not c.isalpha() or unicodedata.name(c, "").startswith("LATIN")
            once = _decoded(c.encode("utf-8"), wrong)
            add(once, c, f"utf-8/{wrong}", sure)
            if once:
                add(_decoded(once.encode("utf-8"), wrong), c, f"utf-8/{wrong} twice", sure)
    for true in CODECS:
        for c in filter(str.isalpha, alphabet()):
            data = c.encode(true, "ignore")
            for wrong in CODECS:
                if data and wrong != true:
                    once = _decoded(data, wrong)
                    add(once, c, f"{true}/{wrong}", "\x80" <= once <= "\x9f" and unicodedata.name(c, "").startswith("LATIN"))
    return {f: [(m, p, s) for (m, p), s in x.items()] for f, x in forms.items()}


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for form, meant in garbled_forms().items():
        a.add_word(form, (len(form), meant))
    a.make_automaton()
    return a


def find(value: str) -> list[tuple[int, int, list[tuple[str, str, bool]]]]:
    """All candidate spans of value, the longest at each place, as (start, length, meanings); a lost character has none."""
    best: dict[int, tuple[int, list]] = {}
    for end, (n, meant) in automaton().iter(value):
        start = end - n + 1
        if start not in best or best[start][0] < n:
            best[start] = (n, meant)
    out, free = [], 0
    # A span inside a longer one is no candidate of its own.
    for start in sorted(best):
        n, meant = best[start]
        if start < free:
            continue
        sure = [m for m in meant if m[2]]
        out.append((start, n, sure or meant))
        free = start + n if sure else free
    return out + [(i, 1, []) for i, c in enumerate(value) if c == LOST]


def _word_at(value: str, pos: int) -> tuple[int, int]:
    """The run of letters and garbled signs around pos, as bounds."""
    ok = lambda c: c.isalpha() or (ord(c) > 126 and not c.isspace())
    a = b = pos
    turn = lambda i: value[i - 1].islower() and "A" <= value[i] <= "Z"  # noqa: E731 - "FußbodenRE": two words run together
    while a > 0 and ok(value[a - 1]) and not (a < pos and turn(a)):
        a -= 1
    while b < len(value) and ok(value[b]) and not (b > pos + 1 and turn(b)):
        b += 1
    return a, b


def proposals(value: str, letters: dict[str, int] | None = None) -> list[dict]:
    """For each encoding pair, each damaged word of value with all its spans of that pair replaced; equal words once.

    letters: how often each letter stands in the corpus' words; a repair of weak evidence uses no others. rarer: whether
    the letters put in are rarer than those found.
    """
    out: dict[tuple, dict] = {}
    spans = find(value)
    by_pair: dict[str, list[tuple]] = {}
    for start, n, meanings in spans:
        for meant, pair, strong in meanings:
            if strong or letters is None or all(c in letters for c in meant):
                by_pair.setdefault(pair, []).append((start, n, meant, strong))
    # Many pairs of encodings mean the same: the first by name speaks for them.
    distinct: dict[tuple, str] = {}
    for pair in sorted(by_pair):
        distinct.setdefault(tuple(by_pair[pair]), pair)
    count = lambda text: min((letters.get(c, 0) for c in text if not c.isascii()), default=0)
    for own, pair in distinct.items():
        words: dict[tuple, list] = {}
        for s in own:
            words.setdefault(_word_at(value, s[0]), []).append(s)
        for (a, b), inside in words.items():
            text, last = "", a
            for start, n, meant, _ in inside:
                if start >= last:
                    text += value[last:start] + meant
                    last = start + n
            text += value[last : max(last, b)]
            strong = any(s[3] for s in inside)
            rarer = letters is not None and count(text) <= count(value[a:b])
            key = (a, max(last, b), text)
            if key not in out or strong > out[key]["strong"]:
                out[key] = {"start": a, "stop": max(last, b), "word": text, "was": value[a : max(last, b)], "pair": pair, "strong": strong, "rarer": rarer}
    lost = [{"start": start, "stop": start + 1, "word": None, "was": None, "pair": "lost", "strong": True, "rarer": False} for start, _, meanings in spans if not meanings]
    return [*out.values(), *lost]


_PROPOSALS = "array<struct<start:int,stop:int,word:string,was:string,pair:string,strong:boolean,rarer:boolean>>"


def _apply(values: pd.Series, repairs: pd.Series) -> pd.Series:
    """values with the chosen spans replaced; NFC, since a mark garbled apart from its letter joins it again."""

    def one(v: str, spans) -> str:
        text, last = "", 0
        for s in sorted((s for s in spans if s["word"] is not None), key=lambda s: (s["start"], -s["stop"])):
            if s["start"] >= last:
                text += v[last : s["start"]] + unicodedata.normalize("NFC", s["word"])
                last = s["stop"]
        return text + v[last:]

    return pd.Series([one(v, r) if v is not None and r is not None else v for v, r in zip(values, repairs)])


def repair(df: DataFrame, column: str, known_words: DataFrame | None = None, min_known: int = 1) -> DataFrame:
    """df with `garbled` (boolean) and `repaired` (the value with every restorable span put right).

    known_words: (word, n) of text; by default the words of letters in `column` itself, damaged ones included. Every value's
    distinct text is looked at once, whole. Null and empty values are not garbled; rows, repeated ones included, stay;
    columns named `garbled` or `repaired` are replaced.
    """
    df = df.drop("garbled", "repaired")
    if known_words is None:
        words = df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("word"))
        known_words = words.filter(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))
    # As many rows as the corpus has different letters beyond ASCII.
    counted = known_words.select(F.explode(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]"), 0)).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect()
    letters = df.sparkSession.sparkContext.broadcast({r.c: r.n for r in counted})

    @F.pandas_udf(_PROPOSALS)
    def propose(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda v: proposals(v, letters.value) if v else [])

    known = known_words.filter(F.col("n") >= min_known)
    values = df.select(F.col(column).alias("__v")).filter(F.col("__v").rlike(r"[^\x00-\x7F]")).distinct()
    # Names are short and cost much for their size: as many tasks as cores, at least, whatever they weigh.
    values = values.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spans = values.withColumn("p", F.explode(propose("__v"))).select("__v", "p.*")
    judged = spans.join(known.select("word", F.col("n").alias("n_word")), "word", "left").join(known_words.select(F.col("word").alias("was"), F.col("n").alias("n_was")), "was", "left")
    was = F.coalesce("n_was", F.lit(0))
    better = (F.length("word") >= 3) & ((F.col("n_word") > was) | ((F.col("n_word") == was) & ~F.col("rarer")))
    judged = judged.filter(F.col("strong") | better)
    # At one place a repair that gives the most frequent known word goes first, then the order of the pairs' names.
    rank = F.struct(-F.coalesce("n_word", F.lit(0)), "pair", "word")
    chosen = judged.groupBy("__v", "start").agg(F.min_by(F.struct("start", "stop", "word", "pair"), rank).alias("s"))
    fixes = chosen.groupBy("__v").agg(F.collect_list("s").alias("__s")).withColumn("repaired", F.pandas_udf(_apply, "string")("__v", "__s")).drop("__s")
    out = df.join(fixes, df[column] == fixes["__v"], "left")
    return out.withColumn("garbled", F.col("__v").isNotNull()).withColumn("repaired", F.coalesce("repaired", F.col(column))).drop("__v")
