"""Problem 7: one form for text that looks the same but consists of different characters."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import cut

# Letters of other scripts and the Latin letters they look like, pair by pair.
LOOK_ALIKE = dict(zip(
    "аеорсухіѕјһԁԛԝѵАВЕКМНОРСТУХЅІЈԌΑΒΕΖΗΙΚΜΝΟΡΤΥΧονıɑɡ",
    "aeopcyxisjhdqwvABEKMHOPCTYXSIJGABEZHIKMNOPTYXoviag",
))
HYPHENS = "‐‑‒­"
KEEP = ("<super>", "<sub>", "<fraction>")


@cache
def _ignorable() -> str:
    """A character class of default-ignorable code points, from the standard's ranges."""
    ranges = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


class _Forms(dict):
    """Code point -> its form, filled as characters are met: translate() then runs at the speed of C."""

    def __init__(self, fixed: dict[int, str], keep_visible: bool):
        super().__init__(fixed)
        self.keep_visible = keep_visible

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = unicodedata.decomposition(c).split(" ")[0]
        # A reader sees the difference of raised, lowered and fraction characters (m² and m2).
        form = c if self.keep_visible and kind in KEEP else unicodedata.normalize("NFKC", c)
        self[point] = form if len(form) != 1 else dict.get(self, ord(form), form)
        return self[point]


@cache
def _forms(look_alikes: bool, keep_visible: bool) -> tuple[re.Pattern, _Forms]:
    fixed = {ord(c): " " for c in _BLANKS}
    if look_alikes:
        fixed |= {ord(c): x for c, x in LOOK_ALIKE.items()} | {ord(c): "-" for c in HYPHENS}
    return re.compile(_ignorable()), _Forms(fixed, keep_visible)


def canonical(text: str, fold_case: bool = True, look_alikes: bool = True, keep_visible: bool = True) -> str:
    """The one form of text: compatibility-normalised and composed, ignorable characters gone, blanks as spaces.

    fold_case: full case folding, for comparisons that ignore case. keep_visible: leave raised, lowered and fraction
    characters, whose plain forms look different. look_alikes: map letters of other scripts to the Latin ones they
    resemble.
    """
    if text.isascii():
        return text.replace("\t", " ").casefold() if fold_case else text.replace("\t", " ")
    invisible, forms = _forms(look_alikes, keep_visible)
    text = unicodedata.normalize("NFC", invisible.sub("", text)).translate(forms)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


def canonical_udf(fold_case: bool = True, look_alikes: bool = True, keep_visible: bool = True):
    """Arrow-batched canonical(); each distinct value of a batch is normalised once. Null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        done: dict = {}
        out = []
        for v in s:
            if v is not None and v not in done:
                done[v] = canonical(v, fold_case, look_alikes, keep_visible)
            out.append(None if v is None else done[v])
        return pd.Series(out, dtype=object)

    return run


def _mixed(df: DataFrame, key: str, column: str, within: list[str]) -> tuple[DataFrame, list[str]]:
    """(within..., h1, h2, id, v) of the rows in groups that read the same but hold different strings; the group's columns."""
    plain = r"^[\x20-\x7e\nÄÖÜäöüß§²³]*$"
    rows = df.select(F.col(key).alias("__id"), *within, F.col(column).alias("__v")).filter(F.col("__v").isNotNull())
    # Text of plain characters is its own canonical form: it needs no Python.
    easy = rows.filter(F.col("__v").rlike(plain)).withColumn("__c", F.col("__v"))
    hard = rows.filter(~F.col("__v").rlike(plain)).withColumn("__c", canonical_udf(fold_case=False)("__v"))
    seen = easy.unionByName(hard).filter(F.col("__c").rlike(r"[^\s]"))
    # Written once: the rows are read twice below, and the forms cost Python. A value is known by 128 bits of hash, as is a form.
    hashed = cut(seen.select("__id", *within, F.xxhash64("__c").alias("h1"), F.xxhash64(F.lit(7), "__c").alias("h2"), F.md5("__v").alias("v")), "same-looking")
    group = [*within, "h1", "h2"]
    mixed = hashed.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select(*group)
    # Groups of identical strings, however large, have dropped out; of the others each row is left once.
    return hashed.join(mixed, group, "left_semi").distinct(), group


def same_looking(df: DataFrame, key: str, column: str, within: list[str] | None = None) -> DataFrame:
    """(within..., id_a, id_b), id_a < id_b: the rows whose values read the same but are not identical strings.

    Values without a visible character, and nulls, form no pairs. Rows group by 128 bits of hash of the canonical form.
    Within a group distinct values meet, not rows: each pair of values is formed once and then takes the ids of either
    side, so that no pair of identical strings is ever formed and a value of many rows costs one row a pair that it is in.
    `key` should be unique; a row repeated as a whole counts once.
    """
    within = within or []
    rows, group = _mixed(df, key, column, within)
    rows = cut(rows, "same-looking-mixed")
    values = rows.select(*group, "v").distinct()
    pairs = values.withColumnRenamed("v", "va").join(values.withColumnRenamed("v", "vb"), group).filter("va < vb")
    one = pairs.join(rows.select(*group, F.col("v").alias("va"), F.col("__id").alias("a")), [*group, "va"])
    both = one.join(rows.select(*group, F.col("v").alias("vb"), F.col("__id").alias("b")), [*group, "vb"]).filter("a <> b")
    return both.select(*within, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_alike_classes(df: DataFrame, key: str, column: str, within: list[str] | None = None) -> DataFrame:
    """(within..., id, class_id, links): a row for each row of same_looking's groups, the smallest id of its group, and with how
    many rows it forms a pair. As many rows as the table at most, whatever the groups' sizes."""
    within = within or []
    rows, group = _mixed(df, key, column, within)
    size = rows.groupBy(*group).agg(F.min("__id").alias("class_id"), F.count("*").alias("n"))
    alike = rows.groupBy(*group, "v").agg(F.count("*").alias("own"))
    joined = rows.join(alike, [*group, "v"]).join(size, group)
    return joined.select(*within, F.col("__id").alias("id"), "class_id", (F.col("n") - F.col("own")).alias("links"))
