"""Problem 10: the language of documents and of their paragraphs.

One interpolated Kneser-Ney model of characters per language, all in common sorted arrays of n-gram hashes: a row holds
the log probabilities in every language, so that one binary search scores a character in all of them. The language of
least cross-entropy per character is chosen, unless the text is too short or fits none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import spread

ORDER = 5
#: Bound of the sample the models are fitted on: pieces of labelled text per language, chosen by hash, and their characters.
SAMPLE_PIECES, PIECE = 400, 1000
#: Every so many-th paragraph of the sample is held out to calibrate on.
HELD_OUT = 5
#: Shortest text that is given a language, in letters.
LEAST_LETTERS = 8
# Spellings of the labels, beside code, code with region ("de-AT", "fr_FR") and any case.
LABELS = {
    "de": ["ger", "deu", "deutsch", "german", "allemand", "tedesco", "duits"],
    "en": ["eng", "english", "englisch", "anglais", "inglese", "engels"],
    "fr": ["fra", "fre", "french", "französisch", "franzoesisch", "français", "francais", "francese", "frans"],
    "it": ["ita", "italian", "italienisch", "italiano", "italien", "italiaans"],
    "nl": ["nld", "dut", "dutch", "niederländisch", "niederlaendisch", "nederlands", "néerlandais", "neerlandais", "olandese", "holländisch", "flemish", "flämisch", "vlaams"],
}


def label_code(column):
    """The language that a label names, as a code; null for a label that names none of LABELS."""
    low = F.lower(F.trim(column))
    out = None
    for code, names in LABELS.items():
        is_it = low.isin(code, *names) | low.rlike(rf"^({code}|{names[0]}|{names[1]})[-_][a-z]{{2,4}}$")
        out = F.when(is_it, code) if out is None else out.when(is_it, code)
    return out


_NOT_LETTER = re.compile(r"[\W\d_]+")


def squeeze(text: str) -> str:
    """Letters in lower case, everything between them as one space."""
    return " " + _NOT_LETTER.sub(" ", text.lower()).strip() + " "


def paragraphs(text: str) -> list[str]:
    """The paragraphs of text: runs of lines between blank lines."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in re.split(r"\n\s*\n", text) if p.strip()]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n - 1 on."""
    h = np.full(max(0, len(codes) - n + 1), np.uint64(n), np.uint64)
    for j in range(n):
        h = (h ^ codes[j : len(codes) - n + 1 + j]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _grams_at(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The same for the n characters that end at each of these places."""
    h = np.full(len(ends), np.uint64(n), np.uint64)
    for j in range(n):
        h = (h ^ codes[ends - (n - 1) + j]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Models:
    """Interpolated Kneser-Ney models, as sorted hash arrays by order."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, discount: float = 0.75):
        self.languages = sorted(texts)
        self.order = order
        per = {}
        for lang in self.languages:
            codes = _codes("\x00".join(texts[lang]) or " ")
            per[lang] = codes
        size = len(np.unique(np.concatenate(list(per.values())))) + 1
        k = len(self.languages)
        self.unseen = np.full(k, -np.log(size), np.float32)
        self.keys, self.logp, self.ctx, self.gamma = {}, {}, {}, {}
        lower = None
        for n in range(1, order + 1):
            stats = []
            for lang in self.languages:
                codes = per[lang]
                if n == order:
                    gram, first, count = np.unique(_grams(codes, n), return_index=True, return_counts=True)
                else:  # continuation counts: how many different characters stand before
                    longer, at = np.unique(_grams(codes, n + 1), return_index=True)
                    gram, first, count = np.unique(_grams(codes, n)[at + 1], return_index=True, return_counts=True)
                    first = at[first] + 1
                context = _grams(codes, n - 1)[first] if n > 1 else np.zeros(len(gram), np.uint64)
                tail = _grams(codes, n - 1)[first + 1] if n > 1 else None
                stats.append((gram, count, context, tail))
            keys = np.unique(np.concatenate([s[0] for s in stats]))
            contexts = np.unique(np.concatenate([s[2] for s in stats]))
            own, total, kinds = np.zeros((len(keys), k)), np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            context_of, tail_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for i, (gram, count, context, tail) in enumerate(stats):
                at, c = np.searchsorted(keys, gram), np.searchsorted(contexts, context)
                own[at, i] = count
                context_of[at] = context
                if tail is not None:
                    tail_of[at] = tail
                np.add.at(total[:, i], c, count)
                np.add.at(kinds[:, i], c, 1)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            c = np.searchsorted(contexts, context_of)
            low = np.exp(lower(tail_of)) if lower else np.full((len(keys), k), 1.0 / size)
            p = np.where(total[c] > 0, np.maximum(own - discount, 0) / np.maximum(total[c], 1), 0.0) + gamma[c] * low
            self.keys[n], self.logp[n] = keys, np.log(p).astype(np.float32)
            self.ctx[n], self.gamma[n] = contexts, np.log(gamma).astype(np.float32)
            lower = lambda h, n=n: self._exact(n, h)

    def _exact(self, n: int, h: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams by hash; what the tables don't have falls to the floor of the vocabulary."""
        at = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
        return np.where((self.keys[n][at] == h)[:, None], self.logp[n][at], self.unseen)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character but the first, in every language, by the longest n-gram known.

        What stands alike before a character costs alike: each distinct run of ORDER characters is looked up once.
        """
        every = np.arange(1, len(codes))
        if len(codes) <= self.order:
            return self._score_at(codes, every)
        _, first, again = np.unique(_grams(codes, self.order), return_index=True, return_inverse=True)
        out = np.empty((len(codes) - 1, len(self.languages)), np.float32)
        out[: self.order - 2] = self._score_at(codes, every[: self.order - 2])
        out[self.order - 2 :] = self._score_at(codes, first + self.order - 1)[again]
        return out

    def _score_at(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The same for the characters at these places."""
        out = np.zeros((len(places), len(self.languages)), np.float32)
        left = np.arange(len(places))
        for n in range(self.order, 0, -1):
            ready = left[places[left] >= n - 1]
            early = left[places[left] < n - 1]
            grams = _grams_at(codes, places[ready], n)
            at = np.minimum(np.searchsorted(self.keys[n], grams), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == grams
            out[ready[hit]] += self.logp[n][at[hit]]
            miss = ready[~hit]
            if n > 1 and len(miss):
                context = _grams_at(codes, places[miss] - 1, n - 1)
                at = np.minimum(np.searchsorted(self.ctx[n], context), len(self.ctx[n]) - 1)
                known = self.ctx[n][at] == context
                out[miss[known]] += self.gamma[n][at[known]]
            elif len(miss):
                out[miss] += self.unseen + self.gamma[1][0]
            left = np.concatenate([early, miss])
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each squeezed text in each language, and its number of letters."""
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        starts = np.r_[0, ends[:-1]]
        each = np.vstack([np.zeros((1, len(self.languages)), np.float32), self.score(codes)])
        sums = np.add.reduceat(each, starts, axis=0)
        length = ends - starts
        letters = np.add.reduceat((codes != 32).astype(np.int64), starts)
        return -sums / np.maximum(length, 1)[:, None], letters

    def calibrate(self, held_out: list[tuple[str, str]], seed: int = 7) -> None:
        """Confidence and rejection, from fragments of held-out text of known language.

        Confidence: a character's evidence isn't independent of its neighbours', so that the logarithms are divided by the
        one number under which the held-out fragments are likeliest. Rejection: for each class of length the greatest cost a
        character that a text may have, between that of the fragments and that of the same letters in random order; a
        rejected fragment weighs as much as ten accepted pieces of noise.
        """
        rng = np.random.default_rng(seed)
        texts, truth = [], []
        for text, lang in held_out:
            words = text.split()
            for n in {1, 2, 3, 5, 8, 13, len(words)}:
                if n <= len(words):
                    texts.append(" " + " ".join(words[:n]) + " ")
                    truth.append(self.languages.index(lang))
        self.scale, self.limits = 3.0, np.full(MOST_BITS, np.inf)
        if not texts:
            return
        h, letters = self.entropies(texts)
        truth, classes = np.array(truth), _length_class(letters)
        enough = letters >= LEAST_LETTERS
        total = h * np.maximum(letters, 1)[:, None]
        likely = lambda t: float(np.mean((total[np.arange(len(truth)), truth] / t + np.log(np.exp(-(total - total.min(axis=1, keepdims=True)) / t).sum(axis=1)) - total.min(axis=1) / t)[enough])) if enough.any() else t
        self.scale = float(min(np.geomspace(0.5, 50, 60), key=likely))
        noise, _ = self.entropies(["".join(" " if c == " " else x for c, x in zip(t, rng.permutation(list(t.replace(" ", "a"))))) for t in texts])
        for k in range(MOST_BITS):
            own = classes == k
            if own.sum() >= 20:
                good, bad = np.sort(h[own].min(axis=1)), np.sort(noise[own].min(axis=1))
                at = np.concatenate([good, [good[-1] * 1.2]])
                lost = 1 - np.searchsorted(good, at, side="right") / len(good)
                let_in = np.searchsorted(bad, at, side="right") / len(bad)
                best = int(np.argmin(10 * lost + let_in))
                # Halfway to the next noise above it.
                above = bad[np.searchsorted(bad, at[best], side="right") :]
                self.limits[k] = (at[best] + max(above[0], at[best])) / 2 if len(above) else at[best] * 1.2
        # A longer class that was too rare takes the limit of the one below.
        for k in range(1, MOST_BITS):
            if np.isinf(self.limits[k]):
                self.limits[k] = self.limits[k - 1]

    def decide(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language (None if rejected), confidence and letters of each text."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, np.int64)
        h, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        gap = (h - h.min(axis=1, keepdims=True)) * np.maximum(letters, 1)[:, None] / self.scale
        confidence = 1 / np.exp(-gap).sum(axis=1)
        ok = (letters >= LEAST_LETTERS) & (h.min(axis=1) <= self.limits[_length_class(letters)])
        return [self.languages[b] if k else None for b, k in zip(best, ok)], confidence, letters

    def reliability(self, texts: list[tuple[str, str]], bins: tuple[float, ...] = (0.5, 0.8, 0.95, 0.99, 1.01)) -> list[tuple[float, int, float, float]]:
        """(upper bound, texts, mean confidence, share of right languages) of each class of confidence."""
        got, sure, _ = self.decide([t for t, _ in texts])
        out, low = [], 0.0
        for high in bins:
            own = [i for i in range(len(texts)) if low <= sure[i] < high and got[i]]
            if own:
                out.append((high, len(own), float(np.mean(sure[own])), sum(got[i] == texts[i][1] for i in own) / len(own)))
            low = high
        return out


MOST_BITS = 8


def _length_class(letters: np.ndarray) -> np.ndarray:
    """0 below 16 letters, 1 below 32, and so on; the last class is open."""
    return np.clip(np.log2(np.maximum(letters, 1)).astype(int) - 3, 0, MOST_BITS - 1)


def sampled(documents: DataFrame, key: str, column: str, label: str, pieces: int) -> dict[str, list[str]]:
    """Paragraphs by the language that their label names, of at most about `pieces` pieces of PIECE characters each.

    Pieces are cut from the whole of every labelled text and chosen by hash, so that no part of a text is left out.
    """
    known = documents.select(F.col(key).alias("k"), F.col(column).alias("t"), label_code(F.col(label)).alias("l")).filter("l is not null and length(t) > 0")
    n = F.ceil(F.length("t") / PIECE).cast("int")
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.sum(n).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, m in counts.items() for x in (lang, min(1.0, pieces / m))))
    each = known.select("k", "l", "t", share[F.col("l")].alias("share"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    drawn = each.filter(F.pmod(F.xxhash64("k", "i"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("l", F.substr("t", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("t"))
    texts: dict[str, list[str]] = {}
    for r in drawn.orderBy("l", "t").collect():
        texts.setdefault(r.l, []).extend(x for p in paragraphs(r.t) if len(x := squeeze(p)) > LEAST_LETTERS)
    return {lang: ps for lang, ps in texts.items() if ps}


def fit(documents: DataFrame, key: str = "doc_id", column: str = "text", label: str = "lang", sample: int = SAMPLE_PIECES) -> Models | None:
    """Models from a sample of labelled text, calibrated on a part that they haven't seen; None if no text has a label.

    Labels may be wrong: models of lower order judge the sample's paragraphs in three rounds, and the models are fitted on
    those that agree with their label.
    """
    texts = sampled(documents, key, column, label, sample)
    if not texts:
        return None
    # Short contexts are shared by all of a language's texts, so that a minority of wrong labels costs each of its
    # characters; long ones would repeat a wrongly labelled text as well as a right one. Hence short ones judge first.
    agreed = texts
    for order in (2, 3, 3):
        judge = Models(agreed, order)
        judge.calibrate([])
        agreed = {lang: [p for p, got in zip(ps, judge.decide(ps)[0]) if got == lang] or ps for lang, ps in texts.items()}
    known = {lang: [p for i, p in enumerate(ps) if i % HELD_OUT or len(ps) < HELD_OUT] for lang, ps in agreed.items()}
    models = Models(known)
    models.held_out = [(p, lang) for lang, ps in agreed.items() for p in ps[::HELD_OUT]]
    models.calibrate(models.held_out)
    return models


def identify(documents: DataFrame, models: Models | None = None, key: str = "doc_id", column: str = "text", label: str = "lang") -> DataFrame:
    """(key, para_no, lang, confidence, label, doc_lang): a row for each document (para_no 0) and each paragraph from 1.

    A document's language is the one of most letters of its paragraphs. lang is null for a text without words or one
    that fits no language, and for all texts if none has a label to learn from; null and empty texts have only the row of
    the document. label is the code that the given label names, null if it names none. One pass without a shuffle; a
    repeated row is judged each time.
    """
    models = models or fit(documents, key, column, label)
    if models is not None:
        models.held_out = []
    shared = documents.sparkSession.sparkContext.broadcast(models)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for pdf in batches:
            # Slices bound what is held at once, whatever the length of the texts.
            split = [paragraphs(t) if t else [] for t in pdf["t"]]
            texts = [squeeze(p) for ps in split for p in ps]
            langs, sure, letters = [], [], []
            at, load = 0, 0
            for i, t in enumerate(texts, 1):
                load += len(t)
                if load > 300_000 or i == len(texts):
                    got = models.decide(texts[at:i]) if models else ([None] * (i - at), np.zeros(i - at), np.zeros(i - at, np.int64))
                    langs += got[0]
                    sure += got[1].tolist()
                    letters += got[2].tolist()
                    at, load = i, 0
            rows, at = [], 0
            for k, ps, label in zip(pdf["k"], split, pdf["l"]):
                own = range(at, at + len(ps))
                weight: dict[str, int] = {}
                for i in own:
                    if langs[i]:
                        weight[langs[i]] = weight.get(langs[i], 0) + letters[i]
                main = max(sorted(weight), key=weight.get) if weight else None
                # The share of the main language, by confidence, is the document's.
                trust = sum(sure[i] * letters[i] for i in own if langs[i] == main) / max(1, sum(weight.values())) if main else 0.0
                rows.append((k, 0, main, trust, label, main))
                rows += [(k, i - at + 1, langs[i], sure[i], label, main) for i in own]
                at += len(ps)
            yield pd.DataFrame(rows, columns=["k", "para_no", "lang", "confidence", "label", "doc_lang"])

    source = spread(documents.select(F.col(key).alias("k"), F.col(column).alias("t"), label_code(F.col(label)).alias("l")))
    return source.mapInPandas(run, f"k {kind}, para_no int, lang string, confidence double, label string, doc_lang string").withColumnRenamed("k", key)


def corrections(judged: DataFrame) -> DataFrame:
    """Of identify()'s rows, those to correct: a document whose label is missing or names another language, and each
    paragraph in another language than its document."""
    wrong = (F.col("para_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    other = (F.col("para_no") > 0) & (F.col("lang") != F.col("doc_lang"))
    return judged.filter(F.col("lang").isNotNull() & (wrong | other))
