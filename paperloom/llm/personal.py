"""Problem 5: personal information in free text.

A linear-chain conditional random field over word-shape features, trained on the labelled table, marks the spans; Viterbi
decoding runs in numpy over many texts at once. Patterns of addresses and numbers, and the names that the corpus' own
mailboxes confirm, are features among others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import STREET_ENDINGS, fold, fold_text
from paperloom.llm.canonical import canonical
from paperloom.runtime import BROADCAST_BYTES, cut, spread

KINDS = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
WINDOW = (-2, -1, 0, 1, 2)
#: Words and endings seen less often in the labelled table say no more than that they are rare.
LEAST_SEEN = 4

_INNER = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u0300-\u0308\u034f"
TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{_INNER}])*|_|[^\w\s]")
_SPACED = re.compile(rf"(\s*)({TOKEN.pattern})")

_LOCAL = rf"[^\W_](?:[\w.+{_INNER}-]*[\w{_INNER}])?"
_AT, _DOT = r"(?:\s?(?:@|＠|\(at\)|\[at\]|\(ät\)|\{at\}| at )\s?)", r"(?:\.|．|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\[punkt\]\s?| dot )"
EMAIL = re.compile(rf"{_LOCAL}{_AT}(?:[\w{_INNER}]+(?:[-‐‑][\w{_INNER}]+)*{_DOT})+[^\W\d_]{{2,}}[{_INNER}]*", re.I)
_AT_SIGN = re.compile(_AT, re.I)
PHONE = re.compile(rf"(?<![\w/.‐‑-])(?:[+＋]|\(?[0０])[\d{_INNER}]*(?:[\s\xa0]?[/()‐‑-]?[\s\xa0]?[/()‐‑-]?[\d{_INNER}]+\)?)+(?![\w@])")
ID_NUMBER = re.compile(rf"(?<!\w)(?:[A-ZΑ-ΩА-Я]{{2}}\d{{2}}(?:\s?[\dA-Z]{{4}}){{2,7}}(?:\s?[\dA-Z]{{1,3}})?|\d{{2,3}}\s?/\s?\d{{3}}\s?/\s?\d{{4,5}}|\d{{2}}\s?\d{{6}}\s?[A-Z]\s?\d{{3}}|\d{{2}}\s?\d{{3}}\s?\d{{3}}\s?\d{{3}}|(?=[A-Z\d]*\d)[A-ZΑ-ΩА-Я][A-ZΑ-ΩА-Я\d]{{8,9}})(?!\w)")
#: A mailbox: two or three capitalised words, and the part of the address before the sign.
MAILBOX = re.compile(r"([A-ZÄÖÜÉ][\w'-]*\.?(?:,? [A-ZÄÖÜÉ][\w'-]*\.?){1,2})\"? ?[<(\[]([\w.+-]+) ?(?:@|\(at\)|\[at\])")
PATTERNS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER}
NUMBER = re.compile(r"^\s*\d{1,4}(?:\s?[a-zA-Z](?![\w]))?(?:\s?[-–‐‑/]\s?\d{1,4}(?:\s?[a-zA-Z](?![\w]))?)?(?![-–‐‑/.]?\d)")

# Words before a name, of firms' forms, and before a street's name.
TITLES = set("herr herrn frau fr hr dr prof dipl ing med familie fam mr mrs ms miss signor signora monsieur madame mme mevrouw meneer eheleute".split())
TITLES |= {t.replace(a, b) for t in TITLES if len(t) > 3 for a, b in (("e", "c"), ("rn", "m"), ("u", "n"), ("rr", "n"))}  # as they are misread
FORMS = set("gmbh ag kg ohg gbr ev ltd inc mbh co".split())
BEFORE_STREET = set("am an auf bei beim den der dem hinter im in unter vor zu zum zur alte alten alter lange langer neuen via rue piazza".split())
_STREET = re.compile(rf"(?:{'|'.join(STREET_ENDINGS)}|straße|kai|promenade|siedlung|straat|laan|street|road|avenue)$")


def shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 6)}"
    out = re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_A-ZÄÖÜ]+", "x", re.sub(r"[A-ZÄÖÜ]", "X", word)))
    return re.sub(r"X{2,}", "XX", out)


def features(word: str, gap: str, marks: str) -> list[str]:
    """Features of a token by itself: word, shape, ending, what stands before it, and the marks it bears."""
    low = word.lower()
    kind = "t" if low in TITLES else "f" if low in FORMS else "p" if low in BEFORE_STREET else "s" if len(low) > 2 and _STREET.search(low) else ""
    own = [f"m:{m}" for m in marks.split()]
    return ["b", f"w:{low}" if not word.isdigit() else "w:#", f"s:{shape(word)}", f"e3:{low[-3:]}", f"g:{gap}", f"sg:{shape(word)}{gap}", f"k:{kind}{shape(word)[:2]}", *own, f"ms:{marks}:{shape(word)}"]


@lru_cache(100_000)
def _canonical_word(word: str) -> str:
    return canonical(word, fold_case=False)


def tokens(text: str, names: dict[str, str] | None = None) -> tuple[list[tuple[str, str, str]], list[tuple[int, int]]]:
    """(canonical token, gap before it, marks) and bounds; the gap is '' (none), ' ', '  ' (several) or a line break.

    Marks: which pattern the token begins or goes on with, and whether it is known as a given name or surname.
    """
    marked: dict[int, str] = {}
    inside: list[tuple[int, int, str]] = []
    free = 0
    for m in _AT_SIGN.finditer(text):
        # The address begins in the word before the sign.
        start = max(free, text.rfind(" ", 0, m.start()) + 1, text.rfind("\n", 0, m.start()) + 1)
        if (found := EMAIL.search(text, start)) and found.start() <= m.start() < found.end():
            inside.append((*found.span(), "email"))
            free = found.end()
    if any(c.isdigit() for c in text):
        inside += [(*m.span(), "phone") for m in PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 16]
        inside += [(*m.span(), "id_number") for m in ID_NUMBER.finditer(text)]
    if "<" in text or "(" in text:
        for m in MAILBOX.finditer(text):
            name, local = fold_text(m[1]), fold_text(m[2])
            owned = any(len(w) > 2 and w in local for w in re.findall(r"[^\W\d_]+", name))
            inside.append((*m.span(1), "owner" if owned else "other"))
    keys, bounds, last = [], [], 0
    inside.sort()
    open_: list[tuple[int, int, str]] = []
    at, n = 0, len(inside)
    for m in _SPACED.finditer(text):
        word = m[2]
        if not word.isascii():
            word = _canonical_word(word)
            if not word:
                continue
        a, b = m.span(2)
        # Signs that are no tokens may stand before the blanks.
        space = m[1] if m.start() == last else text[last:a]
        gap = space if space in ("", " ") else "\n" if "\n" in space else "  "
        own = ""
        if at < n or open_:
            while at < n and inside[at][0] <= a:
                open_.append(inside[at])
                at += 1
            if open_:
                open_ = [x for x in open_ if x[1] > a]
                own = " ".join([f"{'B' if x[0] == a else 'I'}{x[2]}" for x in open_])
        if names and word[0].isupper() and (known := names.get(word.lower())):
            own = f"{own} {known}" if own else known
        keys.append((word, gap if last else "\n", own))
        bounds.append((a, b))
        last = b
    return keys, bounds


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class CRF:
    """Weights for each feature at each offset of the window, and transitions between labels."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def fit(self, table, names: dict[str, str] | None = None, epochs: int = 80, rate: float = 0.15, l2: float = 1e-4) -> CRF:
        """Full-batch conditional likelihood by Adam; forward and backward run over all sentences at once."""
        data = []
        for text, spans in table:
            keys, bounds = tokens(text, names)
            y = []
            for a, b in bounds:
                hit = next(((s, k) for s, e, k in spans if s <= a < e), None)
                y.append(0 if hit is None else LABELS.index(f"{'B' if a == hit[0] else 'I'}-{hit[1]}"))
            if keys:
                data.append((keys, y))
        data.sort(key=lambda d: len(d[0]))
        seen: dict[str, int] = {}
        for keys, _ in data:
            for k in keys:
                for f in features(*k):
                    seen[f] = seen.get(f, 0) + 1
        self.ids = {f: i for i, f in enumerate(["w:?", *(f for f, n in seen.items() if n >= LEAST_SEEN or f[0] not in "we")])}
        nf, nl, off = len(self.ids) + 1, len(LABELS), len(WINDOW)
        n, longest = len(data), max(len(d[0]) for d in data)
        width = max(len(self._known(k)) for keys, _ in data for k in keys)
        x = np.full((n, longest + 4, width), nf - 1)
        y = np.zeros((n, longest), int)
        mask = np.zeros((n, longest), bool)
        for i, (keys, labels) in enumerate(data):
            for t, k in enumerate(keys):
                own = self._known(k)
                x[i, t + 2, : len(own)] = own
            y[i, : len(keys)] = labels
            mask[i, : len(keys)] = True
        at = np.nonzero(mask)
        length = mask.sum(axis=1)
        # The features in force at each token, as rows of one long weight table.
        active = np.concatenate([x[at[0], at[1] + 2 + o] * off + j for j, o in enumerate(WINDOW)], axis=1)
        order = np.argsort(active, axis=None, kind="stable")
        used, first = np.unique(active.ravel()[order], return_index=True)
        owner = order // active.shape[1]
        w, trans, begin = np.zeros((nf * off, nl)), np.zeros((nl, nl)), np.zeros(nl)
        gold = np.zeros((n, longest, nl))
        gold[at[0], at[1], y[at]] = 1
        pair = np.zeros((nl, nl))
        np.add.at(pair, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        start = np.bincount(y[:, 0], minlength=nl)
        m1, m2 = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        for epoch in range(1, epochs + 1):
            e = np.zeros((n, longest, nl))
            e[at] = w[active].sum(axis=1)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + begin
            # Sentences are sorted by length: from the k-th on they still run at t.
            for t in range(1, longest):
                k = np.searchsorted(length, t, side="right")
                alpha[k:, t] = _logsumexp(alpha[k:, t - 1, :, None] + trans, 1) + e[k:, t]
            z = _logsumexp(alpha[np.arange(n), length - 1], 1)
            expected = np.zeros((nl, nl))
            for t in range(longest - 2, -1, -1):
                k = np.searchsorted(length, t + 1, side="right")
                right = (e[k:, t + 1] + beta[k:, t + 1])[:, None, :] + trans
                beta[k:, t] = _logsumexp(right, 2)
                expected += np.exp(alpha[k:, t, :, None] + right - z[k:, None, None]).sum(axis=0)
            p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
            diff = (p - gold)[at]
            grad_w = np.zeros_like(w)
            grad_w[used] = np.add.reduceat(diff[owner], first, axis=0)
            grad_w[(nf - 1) * off :] = 0
            grads = [grad_w / n + l2 * w, (expected - pair) / n + l2 * trans, (p[:, 0].sum(axis=0) - start) / n]
            for i, (value, g) in enumerate(zip((w, trans, begin), grads)):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                value -= rate * (1 - (epoch - 1) / epochs) * (m1[i] / (1 - 0.9**epoch)) / (np.sqrt(m2[i] / (1 - 0.99**epoch)) + 1e-8)
        # What fills the places of missing features is no evidence.
        w[(nf - 1) * off :] = 0
        # An I follows only a B or I of its kind.
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                trans[[i for i, x in enumerate(LABELS) if x[2:] != label[2:] or x == "O"], j] = -1e4
                begin[j] = -1e4
        self.w = w.reshape(nf, off, nl).astype(np.float32)
        self.trans, self.begin = trans.astype(np.float32), begin.astype(np.float32)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_table")}

    def _known(self, key: tuple[str, str, str]) -> list[int]:
        """Numbers of the token's features; a word too rare to be known is just that."""
        return [self.ids["w:?"] if i is None else i for f in features(*key) if (i := self.ids.get(f)) is not None or f[:2] == "w:"]

    def _row(self, key: tuple[str, str, str]) -> int:
        """Row of the token in the table of scores; row 0 is no token."""
        got = self._rows.get(key)
        if got is None:
            if len(self._rows) + 1 == len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            got = self._rows[key] = len(self._rows) + 1
            self._table[got] = self.w[self._known(key)].sum(axis=0)
        return got

    def label(self, sequences: list[list[tuple[str, str]]]) -> list[np.ndarray]:
        """Viterbi labels of each sequence; sequences of like length go together."""
        nl = len(LABELS)
        if len(getattr(self, "_rows", ())) > 200_000 or not hasattr(self, "_rows"):
            self._rows, self._table = {}, np.zeros((4096, len(WINDOW), nl), np.float32)
        out: list = [None] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            # Long sequences go in smaller company: what is held at once is bounded but for one text.
            own = order[at : at + 1024]
            while len(own) > 1 and len(own) * len(sequences[own[-1]]) > 400_000:
                own = own[: len(own) // 2]
            at += len(own)
            length = np.array([len(sequences[i]) for i in own])
            longest = int(length[-1])
            rows = np.zeros((len(own), longest + 4), np.int64)
            for r, i in enumerate(own):
                rows[r, 2 : 2 + length[r]] = [self._row(k) for k in sequences[i]]
            e = self._table[rows[:, :longest], 0]
            for j in range(1, len(WINDOW)):
                e += self._table[rows[:, j : j + longest], j]
            score = e[:, 0] + self.begin
            back = np.zeros((longest, len(own), nl), np.int8)
            for t in range(1, longest):
                # Sequences are sorted by length: only the tail still runs.
                k = int(np.searchsorted(length, t, side="right"))
                step = score[k:, :, None] + self.trans
                back[t, :k] = np.arange(nl)
                back[t, k:] = step.argmax(axis=1)
                score[k:] = step.max(axis=1) + e[k:, t]
            best = score.argmax(axis=1)
            path = np.zeros((longest, len(own)), np.int64)
            each = np.arange(len(own))
            for t in range(longest - 1, -1, -1):
                path[t] = best
                best = back[t, each, best]
            for r, i in enumerate(own):
                out[i] = path[: length[r], r]
        return [np.zeros(0, np.int64) if x is None else x for x in out]


def _around(pattern: re.Pattern, text: str, a: int, b: int, reach: int) -> tuple[int, int] | None:
    """The first match of pattern near a..b that overlaps it."""
    low = max(0, a - reach)
    for m in pattern.finditer(text, low, min(len(text), b + reach)):
        if m.start() < b and m.end() > a:
            return m.span()
    return None


def snap(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """Exact bounds of the value of `kind` that the span a..b marks; None if nothing there has its form."""
    if kind == "phone":
        got = _around(PHONE, text, a, b, 25)
        return got if got and 7 <= sum(c.isdigit() for c in text[got[0] : got[1]]) <= 16 else None
    if kind in PATTERNS:
        return _around(PATTERNS[kind], text, a, b, 80)
    if kind == "address":
        m = re.search(r"\d", text[a:b])
        head = a + m.start() if m else b
        tail = NUMBER.match(text[head:]) if m else re.match(r"^[\s\xa0]+(?=\d)", text[b:]) and NUMBER.match(text[b:])
        return (a, head + tail.end()) if tail and "  " not in text[a:head] and any(c.isupper() for c in text[a:head]) else None
    # A name ends with its last capitalised word.
    capital = [m.end() for m in re.finditer(rf"[^\W\d_](?:[\w'{_INNER}])*", text[a:b]) if _canonical_word(m.group())[:1].isupper()]
    b = a + capital[-1] if capital else a
    return (a, b) if sum(c.isalpha() for c in text[a:b]) > 2 and "\n\n" not in text[a:b] else None


def spans(texts: list[str], model: CRF, names: dict[str, str] | None = None) -> list[list[tuple[int, int, str]]]:
    """Values in each text: bounds and kind, in order and without overlap. Each text is one sequence, whatever its length."""
    read = [tokens(t, names) for t in texts]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, path in enumerate(model.label([keys for keys, _ in read])):
        text, bounds, free, t = texts[i], read[i][1], 0, 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            u = t + 1
            kind = LABELS[path[t]][2:]
            while u < len(path) and LABELS[path[u]] == f"I-{kind}":
                u += 1
            got = snap(text, bounds[t][0], bounds[u - 1][1], kind)
            if got and got[0] >= free:
                out[i].append((*got, kind))
                free = got[1]
            t = u
    return out


#: The same for the JVM.
_MAILBOX = r"(\p{Lu}[\p{L}'-]*\.?(?:,? \p{Lu}[\p{L}'-]*\.?){1,2})\"? ?[<(\[]([\p{L}\p{N}.+_-]+) ?(?:@|\(at\)|\[at\])"


def name_words(*columns: DataFrame) -> DataFrame:
    """(word, kind) of the names that mailboxes confirm: lg for given names, ls for surnames, as they are used more often.

    columns: frames of one column of text. A mailbox's name counts if its surname stands in the address before the sign,
    umlauts written out; the other words are given names then. All mailboxes of the corpus are read; parts of double names
    count one by one.
    """
    out = None
    for c in columns:
        text = F.col(c.columns[0])
        found = c.filter(text.rlike("[<(\\[]")).select(F.explode(F.regexp_extract_all(text, F.lit(_MAILBOX), 0)).alias("m"))
        out = found if out is None else out.unionByName(found)
    boxes = out.groupBy("m").agg(F.count("*").alias("n")).select("n", F.regexp_extract("m", _MAILBOX, 1).alias("name"), fold(F.regexp_extract("m", _MAILBOX, 2)).alias("local"))
    words = F.split(F.regexp_replace("name", ",", ""), " ")
    turned = boxes.withColumn("ws", F.when(F.col("name").contains(","), F.reverse(words)).otherwise(words)).withColumn("last", F.element_at("ws", -1))
    sure = turned.filter(F.exists(F.split(fold(F.col("last")), "-"), lambda p: (F.length(p) >= 3) & F.contains(F.col("local"), p)))
    parts = lambda c: F.split(c, "-")
    each = F.concat(F.transform(parts(F.col("last")), lambda w: F.struct(F.lower(w).alias("word"), F.lit(1).alias("s"))), F.transform(F.filter(F.flatten(F.transform(F.slice("ws", 1, F.size("ws") - 1), parts)), lambda w: ~w.endswith(".")), lambda w: F.struct(F.lower(w).alias("word"), F.lit(0).alias("s"))))
    counted = sure.select("n", F.explode(each).alias("x")).filter(F.length("x.word") >= 2).groupBy("x.word").agg(F.sum(F.when(F.col("x.s") == 1, F.col("n")).otherwise(0)).alias("s"), F.sum("n").alias("all"))
    return counted.select("word", F.when(F.col("s") * 2 >= F.col("all"), "ls").otherwise("lg").alias("kind"))


def _table_names(table, seed: int = 3) -> dict[str, str]:
    """Names of the labelled table as a corpus would confirm them: most, but not all, and a few words that are none."""
    rng, out = Random(seed), {}
    for text, marked in table:
        for a, b, kind in marked:
            if kind == "name":
                words = [w for w in re.split(r"[ ,]+", text[a:b]) if not w.endswith(".")]
                turned = words[::-1] if "," in text[a:b] else words
                for i, w in enumerate(turned):
                    for part in w.lower().split("-"):
                        if rng.random() < 0.85:
                            out.setdefault(part, "ls" if i == len(turned) - 1 else "lg")
        for w in re.findall(r"\b[A-ZÄÖÜ]\w+", text):
            if rng.random() < 0.004:
                out.setdefault(w.lower(), "ls")
    return out


@cache
def trained() -> CRF:
    from paperloom.llm.labelled import sentences

    table = sentences()
    return CRF().fit(table, _table_names(table))


def _prepared(df: DataFrame, column: str, names: DataFrame | None, key: str):
    """df(key, __t, __n): the known names among each text's words, or none where they all fit a broadcast, which is then given."""
    source = df.withColumn("__t", F.col(column))
    if names is None:
        return source.withColumn("__n", F.lit(None).cast("map<string,string>")), None
    names = cut(names, "names")
    if (names.agg(F.sum(F.octet_length("word") + 24)).first()[0] or 0) <= BROADCAST_BYTES // 4:
        return source.withColumn("__n", F.lit(None).cast("map<string,string>")), df.sparkSession.sparkContext.broadcast({r.word: r.kind for r in names.collect()})
    # Too many names to be held by every worker: each text takes its own along.
    words = F.array_distinct(F.transform(F.regexp_extract_all("__t", F.lit(r"\p{Lu}[\p{L}\p{N}]+"), 0), F.lower))
    own = source.select(key, F.explode(words).alias("word")).join(names, "word").groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "kind")))).alias("__n"))
    return source.join(own, key, "left"), None


def find(df: DataFrame, key: str, column: str, model=None, names: DataFrame | None = None) -> DataFrame:
    """(key, kind, value): the personal data in `column`, each value once per row.

    model: a broadcast of a trained CRF; names: name_words() of the corpus. Null and empty texts hold none; repeated rows
    give their values once. Texts are read whole.
    """
    model = model or df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[key]
    source, shared = _prepared(df.select(key, column).filter(F.length(column) > 0), column, names, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict = {}
            for k, t, found in _marked(pdf, model.value, shared):
                rows |= {(k, label, t[a:b]): None for a, b, label in found}
            yield pd.DataFrame(list(rows), columns=["k", "kind", "value"])

    found = spread(source.select(F.col(key).alias("k"), "__t", "__n")).mapInPandas(run, f"k {kind}, kind string, value string")
    return found.select(F.col("k").alias(key), "kind", "value")


def _marked(pdf: pd.DataFrame, model: CRF, shared) -> Iterator[tuple]:
    """(key, text, spans) of a batch; texts with names of their own are read with these."""
    for at in range(0, len(pdf), 2000):
        part = pdf.iloc[at : at + 2000]
        texts = ["" if t is None else t for t in part["__t"]]
        if shared is not None or part["__n"].isna().all():
            found = spans(texts, model, None if shared is None else shared.value)
        else:
            found = [spans([t], model, dict(n) if n is not None else None)[0] for t, n in zip(texts, part["__n"])]
        yield from zip(part["k"], texts, found)


def masked(df: DataFrame, key: str, column: str, model=None, names: DataFrame | None = None, leave: tuple[str, ...] = ()) -> DataFrame:
    """(key, column) with every value in `column` replaced by a placeholder of its kind, such as [NAME]; null stays null.

    leave: kinds that are no personal data in this column and stay as they are. Repeated rows stay.
    """
    model = model or df.sparkSession.sparkContext.broadcast(trained())
    kind = dict(df.dtypes)[key]
    source, shared = _prepared(df.select(key, column), column, names, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (k, t, found), given in zip(_marked(pdf, model.value, shared), pdf["__t"]):
                for a, b, label in reversed([x for x in found if x[2] not in leave]):
                    t = f"{t[:a]}[{label.upper()}]{t[b:]}"
                out.append((k, None if given is None else t))
            yield pd.DataFrame(out, columns=["k", "t"])

    shown = spread(source.select(F.col(key).alias("k"), "__t", "__n")).mapInPandas(run, f"k {kind}, t string")
    return shown.select(F.col("k").alias(key), F.col("t").alias(column))
