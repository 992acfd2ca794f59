"""How good the text of a page is, and what follows: keep its text layer, add recognised text, or take that alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import let

# Shortest text layer, least share of plausible words, most damaged words, most odd characters, image share from
# which text is recognised, and when recognition is tried again.
LEAST_CHARS, LEAST_QUALITY, MOST_DAMAGED, MOST_ODD, IMAGE_SHARE = 25, 0.5, 0.12, 0.1, 0.15
RETRY_CHARS, RETRY_CONFIDENCE, LEAST_CONFIDENCE = 40, 0.45, 0.05
VOWELS = "aeiouyäöüéèàáóíú"
DAMAGED_SIGNS = "@|~^°`¦¬"
# Least area, and longer and shorter side in pixels, of an image that is recognised by itself; how many a page; resolution.
CROP_AREA, CROP_SIDES, CROPS, DPI = 0.02, (250, 120), 6, 300


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\s ]", ""))


def word_quality(text: Column) -> Column:
    """Share of words of three letters or more that look like words: a vowel, no change of case inside, four consonants in a row at most; 0 without any."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}{3,}"), 0)
    fine = lambda w: F.lower(w).rlike(f"[{VOWELS}]") & w.rlike(r"^\p{L}(?:\p{Ll}+|\p{Lu}+)$") & ~F.lower(w).rlike(f"[^{VOWELS}]{{5}}")
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, fine)) / F.size(ws)).otherwise(0.0))


def damaged_share(text: Column) -> Column:
    """Share of tokens of three characters or more that recognition has mangled: signs inside, figures or signs between letters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: F.length(t) >= 3)
    bad = lambda t: t.rlike(rf"[{DAMAGED_SIGNS.replace('^', chr(92) + '^')}]|\p{{L}}\d+\p{{L}}|\p{{L}}[+!?=]\p{{L}}")
    return let(tokens, lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, bad)) / F.size(ts)).otherwise(0.0))


def odd_chars(text: Column) -> Column:
    """Number of control, format, private and replacement characters; blanks aside."""
    return F.length(F.regexp_replace(text, r"[^\p{C}�]|[\s\u0085]", ""))


def layer_kind(text: Column) -> Column:
    """clean, short (too short to stand alone, but sound) or poor; a null text is poor."""
    n, sound = visible_chars(text), odd_chars(text) <= MOST_ODD * visible_chars(text)
    right = damaged_share(text) <= MOST_DAMAGED
    worded = (word_quality(text) >= LEAST_QUALITY) | ~text.rlike(r"\p{L}{3}")
    clean = (n >= LEAST_CHARS) & sound & right & (word_quality(text) >= LEAST_QUALITY)
    short = n.between(1, LEAST_CHARS - 1) & text.rlike(r"[\p{L}\p{N}]{3}") & sound & right & worded
    return F.when(clean, "clean").when(short, "short").otherwise("poor")


def page_source(layer: Column, image_share: Column) -> Column:
    """text, text+ocr or ocr: what a page's text is to be made of, by its layer's kind and the share of images on it."""
    return F.when((layer == "clean") & (image_share < IMAGE_SHARE), "text").when(layer.isin("clean", "short"), "text+ocr").otherwise("ocr")


def better_reading(first: Column, second: Column) -> Column:
    """Of two recognitions (struct text, confidence) of one image the second, if the first is short or doubtful and the second has
    more characters by confidence."""
    weight = lambda r: visible_chars(r["text"]) * F.greatest(r["confidence"], F.lit(LEAST_CONFIDENCE))
    doubtful = (visible_chars(first["text"]) < RETRY_CHARS) | (first["confidence"] < RETRY_CONFIDENCE)
    return F.when(doubtful & (weight(second) > weight(first)), second).otherwise(first)


def reading_lines(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, line_no, text, confidence) of recognised words (page, x, y, height, text, confidence): words whose heights overlap by half
    or more are one line, from left to right; its confidence is weighted by length. A page is the group; it is one image."""
    down = Window.partitionBy(page).orderBy("y", "x")
    gap = (F.col("y") - F.lag("y").over(down)) >= F.lag("height").over(down) * 0.5
    numbered = boxes.filter(F.length("text") > 0).withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("line_no", F.sum("new").over(down).cast("int"))
    n = F.length("text")
    each = F.array_sort(F.collect_list(F.struct("x", "text")))
    return numbered.groupBy(page, "line_no").agg(F.array_join(F.transform(each, lambda w: w["text"]), " ").alias("text"), (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"))


def image_share(boxes: list[tuple[float, float, float, float]]) -> float:
    """Share of a page under images (x0, y0, x1, y1 in shares of the page); overlaps count twice, 1 at most."""
    return min(1.0, sum((c - a) * (d - b) for a, b, c, d in boxes))


def crops(boxes: list[tuple[float, float, float, float]], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Images of a page (in points) to recognise one by one: pieces that touch are one; the largest CROPS that are no icons, as one reads."""
    near_x, near_y = 1 / max(width, 1.0), 1 / max(height, 1.0)
    whole = [list(b) for b in boxes]
    grown = True
    while grown:
        grown, merged = False, []
        for b in whole:
            mate = next((m for m in merged if b[0] <= m[2] + near_x and m[0] <= b[2] + near_x and b[1] <= m[3] + near_y and m[1] <= b[3] + near_y), None)
            if mate is None:
                merged.append(b)
            else:
                mate[:] = [min(mate[0], b[0]), min(mate[1], b[1]), max(mate[2], b[2]), max(mate[3], b[3])]
                grown = True
        whole = merged
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    sides = lambda b: sorted(((b[2] - b[0]) * width * DPI / 72, (b[3] - b[1]) * height * DPI / 72))
    apt = [tuple(b) for b in whole if area(b) >= CROP_AREA and sides(b)[1] >= CROP_SIDES[0] and sides(b)[0] >= CROP_SIDES[1]]
    return sorted(sorted(apt, key=area, reverse=True)[:CROPS], key=lambda b: (b[1], b[0]))
