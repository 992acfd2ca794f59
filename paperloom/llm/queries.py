"""Queries of the training-data problems of this subpackage, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import canonical, fmindex, langid, mojibake, newtext, personal, scans, tokenize
from paperloom.functions.timestamps import normalize_timestamps
from paperloom.runtime import cut, table


def _names(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "files").select(F.lit("files.relpath").alias("field"), F.col("id").alias("file_id"), F.lit(-1).alias("part_no"), F.col("relpath").alias("value"))
    parts = table(spark, sf, "parts").select(F.lit("parts.name").alias("field"), "file_id", "part_no", F.col("name").alias("value"))
    return files.unionByName(parts)


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every garbled name with the intended one, as far as it can be restored."""
    return mojibake.repair(_names(spark, sf), "value").filter("garbled").select("field", "file_id", "part_no", "value", "repaired")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repair(_names(spark, sf), "value").filter("garbled").select("field", "file_id", "part_no").distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = canonical.same_looking(table(spark, sf, "pages"), "id", "text").select(F.lit("pages.text").alias("field"), "id_a", "id_b")
    files = canonical.same_looking(table(spark, sf, "files"), "id", "relpath", ["root_id"]).select(F.lit("files.relpath").alias("field"), "id_a", "id_b")
    return pages.unionByName(files)


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every page and path that another one resembles, with its class and its number of such others."""
    pages = canonical.look_alike_classes(table(spark, sf, "pages"), "id", "text").select(F.lit("pages.text").alias("field"), "id", "class_id", "links")
    files = canonical.look_alike_classes(table(spark, sf, "files"), "id", "relpath", ["root_id"]).select(F.lit("files.relpath").alias("field"), "id", "class_id", "links")
    return pages.unionByName(files)


def p7_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The one form of every path, case-folded, and of every page's text, whose case is kept as it is part of the wording."""
    files = table(spark, sf, "files").select(F.lit("files.relpath").alias("field"), "id", canonical.canonical_udf()("relpath").alias("canonical"))
    pages = table(spark, sf, "pages").select(F.lit("pages.text").alias("field"), "id", canonical.canonical_udf(fold_case=False)("text").alias("canonical"))
    return pages.unionByName(files)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(table(spark, sf, "documents"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that come back from their ids."""
    return tokenize.decode(tokenize.encode(table(spark, sf, "documents")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return fmindex.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("item_id", "doc_id")


def p9_removed(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with leaks, without the leaked passages."""
    documents = table(spark, sf, "documents")
    return fmindex.remove(documents, fmindex.leaks(documents, table(spark, sf, "eval_items")))


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document and paragraph."""
    return langid.identify(table(spark, sf, "documents")).select("doc_id", "para_no", "lang", F.round("confidence", 6).alias("confidence"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.corrections(langid.identify(table(spark, sf, "documents"))).select("doc_id", "para_no", "lang")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    mails = table(spark, sf, "mails")
    return newtext.judge(mails, table(spark, sf, "pages"), normalize_timestamps(mails.select("file_id", "sent_at"), "sent_at"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = _judged(spark, sf).select("file_id", F.posexplode("new").alias("i", "new")).filter("not new")
    body = lines.select(F.lit("pages.text").alias("field"), "file_id", (F.col("i") + 1).cast("int").alias("line_no"))
    marked = F.pandas_udf(newtext.marked_subjects, "boolean")
    subjects = table(spark, sf, "mails").filter(F.col("subject").isNotNull() & marked("subject"))
    return body.unionByName(subjects.select(F.lit("mails.subject").alias("field"), "file_id", F.lit(0).alias("line_no"))).distinct()


def p3_written(spark: SparkSession, sf: str) -> DataFrame:
    """Subject and text of every mail, reduced to what its sender newly wrote."""
    return newtext.written_text(_judged(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.kinds(table(spark, sf, "pages"), table(spark, sf, "parts"))


def p4_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The scanned pages as continuous, repaired paragraphs."""
    return scans.paragraphs(table(spark, sf, "pages"), table(spark, sf, "parts"))


def _personal(spark: SparkSession, sf: str):
    pages, mails = table(spark, sf, "pages"), table(spark, sf, "mails")
    names = personal.name_words(mails.select("sender"), mails.select("recipients"), pages.select("text"))
    return pages, mails, spark.sparkContext.broadcast(personal.trained()), cut(names, "names")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pages, mails, model, names = _personal(spark, sf)
    out = personal.find(pages, "id", "text", model, names).select(F.lit("pages.text").alias("field"), F.col("id").alias("rec_id"), "kind", "value")
    for column in ("sender", "recipients"):
        found = personal.find(mails, "file_id", column, model, names).filter("kind <> 'address'")
        out = out.unionByName(found.select(F.lit(f"mails.{column}").alias("field"), F.col("file_id").alias("rec_id"), "kind", "value"))
    return out


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' texts, senders and recipients with typed placeholders in place of personal data."""
    pages, mails, model, names = _personal(spark, sf)
    out = personal.masked(pages, "id", "text", model, names).select(F.lit("pages.text").alias("field"), F.col("id").alias("rec_id"), "text")
    for column in ("sender", "recipients"):
        shown = personal.masked(mails, "file_id", column, model, names, leave=("address",))
        out = out.unionByName(shown.select(F.lit(f"mails.{column}").alias("field"), F.col("file_id").alias("rec_id"), F.col(column).alias("text")))
    return out


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
QUERIES |= {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
QUERIES |= {"p3_found": p3_found, "p3_written": p3_written}
QUERIES |= {"p9_found": p9_found, "p9_removed": p9_removed, "p10_found": p10_found, "p10_languages": p10_languages}
QUERIES |= {"p1_found": p1_found, "p1_repaired": p1_repaired, "p7_found": p7_found, "p7_classes": p7_classes, "p7_canonical": p7_canonical, "p8_ids": p8_ids, "p8_decoded": p8_decoded}
# Problem 9 in SQL: words with those divided at a line's end, each one word if the items have it, else two; runs of twelve.
_FOLD = "replace(replace(replace(replace(strip_accents(lower(nfc_normalize({}))), 'ß', 'ss'), 'ae', 'a'), 'oe', 'o'), 'ue', 'u')"
_PIECE = "[\\p{L}\\p{N}]+"
_WORD = _PIECE + "(?:[-‐‑¬\u00ad][ \\t]*\\r?\\n[ \\t]*" + _PIECE + ")?"
_BARE = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_LEAKS = f"""item as (select distinct item_id, list_transform(regexp_extract_all(nfc_normalize(passage), '{_WORD}'), lambda w: {_FOLD.format(_BARE.format('w'))}) as ws from eval_items where passage is not null),
vocab as (select list_distinct(flatten(list(ws))) as v from item),
grams as (select distinct item_id, array_to_string(ws[i:i + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from item)),
doc as (select doc_id, nfc_normalize(text) as t from documents where text is not null),
parts as (select doc_id, regexp_extract_all(t, '{_WORD}') as m, string_split_regex(t, '{_WORD}') as sep, v from doc, vocab),
units as (select doc_id, sep[1] as head, flatten(list_transform(range(1, len(m) + 1), lambda k: case when len(regexp_extract_all(m[k], '{_PIECE}')) > 1 and not list_contains(v, {_FOLD.format(_BARE.format('m[k]'))}) then [{{'r': regexp_extract_all(m[k], '{_PIECE}')[1], 's': string_split_regex(m[k], '{_PIECE}')[2]}}, {{'r': regexp_extract_all(m[k], '{_PIECE}')[2], 's': sep[k + 1]}}] else [{{'r': m[k], 's': sep[k + 1]}}] end)) as u from parts),
folded as (select doc_id, head, u, list_transform(u, lambda x: {_FOLD.format(_BARE.format('x.r'))}) as ws from units),
met as (select item_id, doc_id, i from (select doc_id, i, array_to_string(ws[i:i + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from folded)) join grams using (g))"""
#: Decoding must give the text back, so the documents themselves are what SQL compares with.
ORACLE: dict[str, str] = {
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_found": f"with {_LEAKS} select distinct item_id, doc_id from met",
    "p9_removed": f"""with {_LEAKS}, gone as (select doc_id, list_distinct(flatten(list(range(i, i + 12)))) as k from met group by doc_id),
pieces as (select doc_id, head, u, k, unnest(range(1, len(u) + 1)) as n from folded join gone using (doc_id))
select doc_id, any_value(head) || string_agg(case when list_contains(k, n) then '' else u[n].r end || case when list_contains(k, n) and list_contains(k, n + 1) then '' else u[n].s end, '' order by n) as text from pieces group by doc_id""",
}
