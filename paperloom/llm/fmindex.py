"""Problem 9: passages of held-out evaluation items inside training documents.

Each training shard gets an FM-index over its word ids: a Burrows-Wheeler transform held in a wavelet matrix, whose ranks
answer backward searches of all test phrases at once, and sampled suffix positions to locate what was found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[-‐‑¬­][ \t]*\r?\n[ \t]*[^\W_]+)?")
PIECE = re.compile(r"[^\W_]+")
#: Symbols of one index, distance of sampled suffixes, words of a block of items, phrases searched at once.
SHARD_WORDS, SAMPLE, BLOCK_WORDS, SEARCHED = 600_000, 16, 4_000_000, 200_000


def fold_word(word: str) -> str:
    """One form for case, accents, ä/ae, ö/oe, ü/ue and ß/ss."""
    word = word.casefold()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def passage_words(text: str) -> list[str]:
    out = []
    for m in WORD.finditer(unicodedata.normalize("NFC", text)):
        out.append(fold_word("".join(PIECE.findall(m.group()))))
    return out


class Vocabulary:
    """Ids from 1 of the test items' words; every other word is 0, a break that no phrase crosses."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self._seen: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.ids) + 1

    def encode(self, raw: str) -> list[int]:
        """Ids of one match of WORD. A word divided at a line end is one word if that is a word of the items."""
        got = self._seen.get(raw)
        if got is None:
            pieces = PIECE.findall(raw)
            whole = self.ids.get(fold_word("".join(pieces)), 0)
            got = [whole] if whole or len(pieces) == 1 else [self.ids.get(fold_word(p), 0) for p in pieces]
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[raw] = got
        return got


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Sorted suffixes of seq by prefix doubling; only suffixes still tied are sorted again. Each 0 differs from all others."""
    n = len(seq)
    zeros = seq == 0
    key = np.where(zeros, np.cumsum(zeros) - 1, zeros.sum() + seq.astype(np.int64))
    order = np.argsort(key, kind="stable")
    heads = np.r_[True, key[order][1:] != key[order][:-1]]
    start = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = order[~(heads & np.r_[heads[1:], True])]
    k = 1
    while len(tied):
        after = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 2) + after, kind="stable")
        tied, after = tied[by], after[by]
        old = rank[tied]
        group = np.r_[True, old[1:] != old[:-1]]
        head = group | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(group, at, 0))
        place = np.maximum.accumulate(np.where(head, at, 0))
        rank[tied] = old + (place - first)
        tied = tied[~(head & np.r_[head[1:], True])]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]  # the suffix at 0 is preceded by the last symbol, always a break
        self.count = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            level = np.r_[level[bit == 0], level[bit == 1]]
        # A walk back must not cross a break, since breaks are sorted by place: what follows one is sampled too.
        marked = (sa % sample == 0) | (bwt == 0)
        self.marked = np.r_[0, np.cumsum(marked)].astype(np.int32)
        self.samples = sa[marked]

    def _map(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = ones[at]
            at = np.where((symbols >> b) & 1, zeros + one, at - one)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """count[symbol] + the symbol's rank before `at`."""
        return self.count[symbols] + self._map(symbols, at) - self._map(symbols, np.zeros_like(at))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the half-open interval of suffixes that begin with each row of phrases."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(width - 1, -1, -1):
            c = phrases[live, j]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi[lo >= hi] = lo[lo >= hi]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions in the text of these suffixes, walking back to the next sampled one."""
        at, out, steps = at.copy(), np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            here = at[live]
            hit = self.marked[here + 1] > self.marked[here]
            out[live[hit]] = self.samples[self.marked[here[hit]]] + steps[live[hit]]
            live = live[~hit]
            here, symbol = at[live], np.zeros(len(live), np.int64)
            for ones, zeros in zip(self.ones, self.zeros):
                one = ones[here]
                bit = ones[here + 1] - one
                symbol = symbol * 2 + bit
                here = np.where(bit == 1, zeros + one, here - one)
            at[live] = self.step(symbol, at[live])
            steps[live] += 1
        return out


def _shards(batches: Iterator[pd.DataFrame], vocabulary: Vocabulary, limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a shard, where each begins, its sequence of ids (breaks run together), and the first and the next word
    number of each symbol. Words are numbered as they are printed: a word divided at a line end has two numbers."""
    keys, starts, seq, word, after = [], [], [], [], []
    for pdf in batches:
        for key, text in zip(pdf["__k"], pdf["__t"]):
            if not text:
                continue
            keys.append(key)
            starts.append(len(seq))
            n, last = 0, 0
            for raw in WORD.findall(unicodedata.normalize("NFC", text)):
                ids = vocabulary.encode(raw)
                # One id for several pieces is a divided word read as one.
                width = len(PIECE.findall(raw)) if len(ids) == 1 else 1
                for i in ids:
                    if i or last:
                        seq.append(i)
                        word.append(n)
                        after.append(n + width)
                    last = i
                    n += width
            if last:
                seq.append(0)
                word.append(n)
                after.append(n)
            if len(seq) >= limit:
                yield keys, np.array(starts), np.array(seq, np.int64), np.array(word), np.array(after)
                keys, starts, seq, word, after = [], [], [], [], []
    if seq:
        yield keys, np.array(starts), np.array(seq, np.int64), np.array(word), np.array(after)


def _merged(spans: set[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], b)
        else:
            out.append({"start": a, "stop": b})
    return out


def _blocks(items: DataFrame, item: str, passage: str, words: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Names and words of the items with a passage long enough, in blocks of at most BLOCK_WORDS words or one item."""
    rows = items.select(item, passage).filter(F.col(passage).isNotNull() & F.col(item).isNotNull()).distinct().orderBy(item, passage)
    names, texts, load = [], [], 0
    for name, text in rows.toLocalIterator():
        found = passage_words(text)
        if len(found) < words:
            continue
        if names and load + len(found) > BLOCK_WORDS:
            yield names, texts
            names, texts, load = [], [], 0
        names.append(name)
        texts.append(found)
        load += len(found)
    if names:
        yield names, texts


def _windows(sizes: list[int], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of `words` words begins in the items laid end to end, and the item it belongs to."""
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    count = np.array(sizes) - words + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner], owner


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", passage: str = "passage", words: int = 12) -> DataFrame:
    """(item, key, spans): each document that holds at least `words` successive words of an item's passage, with the
    leaked spans as word numbers from 0, half-open and merged.

    The items are a stated query set. They pass the driver in blocks of BLOCK_WORDS words, each a broadcast of that size;
    the words they use are one more, bounded by the languages' vocabulary. Documents are read once and need no shuffle: a
    task indexes its own rows, SHARD_WORDS symbols at a time, and searches all blocks in each index. Null or empty texts
    and passages, and passages shorter than `words`, have no leaks; a repeated row gives one result.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[key]
    item_kind = dict(items.dtypes)[item]
    schema = f"`{item}` {item_kind}, `{key}` {kind}, spans array<struct<start:int,stop:int>>"
    known: dict[str, int] = {}
    blocks = []
    for names, texts in _blocks(items, item, passage, words):
        flat = np.array([known.setdefault(w, len(known) + 1) for ws in texts for w in ws], np.int32)
        blocks.append(spark.sparkContext.broadcast((names, [len(ws) for ws in texts], flat)))
    if not blocks:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(known)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shared.value)
        for keys, starts, seq, word, after in _shards(batches, vocabulary, SHARD_WORDS):
            index = FMIndex(seq, len(vocabulary))
            for block in blocks:
                names, sizes, flat = block.value
                begin, owner = _windows(sizes, words)
                spans: dict[tuple, set] = {}
                for at in range(0, len(begin), SEARCHED):
                    lo, hi = index.search(flat[begin[at : at + SEARCHED, None] + np.arange(words)].astype(np.int64))
                    some = np.flatnonzero(hi > lo)
                    size = (hi - lo)[some]
                    which = np.repeat(some, size)
                    pos = index.locate(np.repeat(lo[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                    doc = np.searchsorted(starts, pos, side="right") - 1
                    for o, d, a, b in zip(owner[at + which], doc, word[pos], after[pos + words - 1]):
                        spans.setdefault((names[o], keys[d]), set()).add((int(a), int(b)))
                if spans:
                    yield pd.DataFrame({item: [a for a, _ in spans], key: [b for _, b in spans], "spans": [_merged(s) for s in spans.values()]})

    texts = documents.select(F.col(key).alias("__k"), F.col(column).alias("__t")).filter(F.length("__t") > 0)
    return texts.mapInPandas(search, schema).dropDuplicates([item, key])


def _without(text: str, spans) -> str:
    """text (composed) without the words of these spans; what stands between two removed words goes as well."""
    text = unicodedata.normalize("NFC", text)
    cuts = sorted((s["start"], s["stop"]) for s in spans)
    out, last, c, before = [], 0, 0, False
    for n, m in enumerate(PIECE.finditer(text)):
        while c < len(cuts) and cuts[c][1] <= n:
            c += 1
        gone = c < len(cuts) and cuts[c][0] <= n
        if gone:
            if not before:
                out.append(text[last : m.start()])
            last = m.end()
        before = gone
    return "".join(out) + text[last:]


def remove(documents: DataFrame, found: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text) of the documents with leaks, without the leaked spans of all items."""
    cuts = found.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("__s"))

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, _merged({(s["start"], s["stop"]) for s in x})) for t, x in zip(texts, spans)], dtype=object)

    return documents.select(key, column).join(cuts, key).select(key, F.pandas_udf(run, "string")(column, "__s").alias(column))
