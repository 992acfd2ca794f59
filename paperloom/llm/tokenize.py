"""Problem 8: encoding a whole corpus with a public byte-level tokenizer.

Pre-tokens are found by the JVM; each distinct pre-token of the corpus is encoded once, and its ids are joined back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import cut

TOKENIZERS = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
_BLANK = r"\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of the vocabulary: contractions, words, numbers, signs with a leading space, then blanks.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Most bytes of pre-tokens and their ids that are broadcast; the others are joined by a shuffle.
HOT_BYTES = 32 << 20


def _encode_words(blob):
    """An Arrow UDF that encodes distinct pre-tokens in one batch call; the tokenizer is built once a worker."""

    @F.pandas_udf("array<int>")
    def run(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(blob.value)
        tok.encode_special_tokens = True
        for s in words:
            yield pd.Series([e.ids for e in tok.encode_batch(list(s), add_special_tokens=False)])

    return run


def _hot_from(words: DataFrame, most: int) -> int | None:
    """The least number of documents from which on all pre-tokens together have `most` bytes at most; None if all have."""
    bits = F.floor(F.log2("df")).cast("int")
    size = F.sum(F.octet_length("w") + 4 * F.size("ids") + 48)
    total = 0
    # One row for each power of two; the most frequent first.
    for r in words.groupBy(bits.alias("b")).agg(size.alias("bytes")).orderBy(F.desc("b")).collect():
        total += r.bytes
        if total > most:
            return 2 ** (r.b + 1)
    return None


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens; a null or empty text has an empty list.

    vocabulary: a tokenizer file that the driver reads; the executors get it as a broadcast of its fixed size. `key` must
    be unique. The distinct pre-tokens are counted with partial aggregation, encoded once each and written. The ids come
    back in two ways: those of the most frequent pre-tokens, counted and up to hot_bytes, as a broadcast onto the texts,
    which are shuffled once by key and stay in place; those of the rare ones, which are no hot keys, by a shuffle on the
    pre-token. Either way each text is put together by position.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    texts = df.select(F.col(key).alias("__k"), F.col(column).alias("__t"))
    full = texts.filter(F.length("__t") > 0)
    found = F.regexp_extract_all("__t", F.lit(PATTERN), 0)
    counted = full.select(F.explode(F.array_distinct(found)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    words = cut(counted.select("w", "df", _encode_words(blob)("w").alias("ids")), "tokens")
    least = _hot_from(words, hot_bytes)
    placed = full.repartition("__k").select("__k", F.posexplode(found).alias("pos", "w"))
    in_order = lambda x: F.array_sort(F.collect_list(x))
    pair = F.struct("pos", "ids")
    if least is None:
        parts = placed.join(F.broadcast(words.select("w", "ids")), "w").groupBy("__k").agg(in_order(pair).alias("x"))
    else:
        hot = words.filter(F.col("df") >= least).select("w", "ids")
        near = placed.join(F.broadcast(hot), "w", "left")
        # A document's place for a rare pre-token stays open here and is filled from the other side.
        own = near.groupBy("__k").agg(in_order(F.when(F.col("ids").isNotNull(), pair)).alias("x"))
        rare = full.select("__k", F.posexplode(found).alias("pos", "w")).join(F.broadcast(hot.select("w")), "w", "left_anti")
        far = rare.join(words.filter(F.col("df") < least).select("w", "ids").hint("shuffle_hash"), "w").groupBy("__k").agg(F.collect_list(pair).alias("y"))
        both = own.join(far, "__k", "left")
        parts = both.select("__k", F.when(F.col("y").isNull(), F.col("x")).otherwise(F.array_sort(F.concat("x", "y"))).alias("x"))
    ids = parts.select("__k", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))
    empty = texts.filter(F.coalesce(F.length("__t"), F.lit(0)) == 0).select("__k", F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(empty).select(F.col("__k").alias(key), "ids")


def token_bytes(spark, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, bytes) of the vocabulary: its fixed size is the bound of every broadcast of it."""
    import base64

    with open(vocabulary, "rb") as f:
        rows = [(int(n), bytearray(base64.b64decode(b))) for b, n in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): ids are joined with the token-byte table and their bytes put together in order."""
    table = token_bytes(coded.sparkSession)
    spread = coded.select(F.col(key).alias("__k"), F.posexplode("ids").alias("pos", "id"))
    joined = spread.join(F.broadcast(table), "id")
    hexed = joined.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("b")))).alias("x"))
    text = hexed.select("__k", F.decode(F.unhex(F.concat_ws("", F.transform("x", lambda y: y["b"]))), "UTF-8").alias("text"))
    return coded.select(F.col(key).alias("__k")).join(text, "__k", "left").select(F.col("__k").alias(key), F.coalesce("text", F.lit("")).alias("text"))
