"""Ranking over a small index: one corpus, several questions; rules and weights by example, parts against brute force."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import expand as ex
from paperloom.operators import search as se
from paperloom.operators.index import build
from paperloom.operators.query import compile_queries

FILLER = " ".join(f"fuellwort{i}x" for i in range(60))
#: relpath -> kind, texts of its pages, sha256, status
FILES = {
    "a/Akte1.pdf": ("pdf", ["Kesselwartung im Lindenweg 7, Betrag 120,50 EUR"], "s1", "done"),
    "a/Akte2.pdf": ("pdf", ["Kesselwartung im Lindenweg 9, Betrag 99,00 EUR"], "s2", "done"),
    "Dachrinne/Notiz.pdf": ("pdf", ["Hier steht nichts davon"], "s3", "done"),
    "b/Text.pdf": ("pdf", ["Die Dachrinne ist undicht"], "s4", "done"),
    "b/nah.pdf": ("pdf", [f"Zaun und Pforte {FILLER}"], "s5", "done"),
    "b/fern.pdf": ("pdf", [f"Zaun {FILLER}", "x", "x", "x", f"Pforte {FILLER}"], "s6", "done"),
    "c/Abfallentsorgung.pdf": ("pdf", ["Restmuell und andere Gebuehren nahe"], "s7", "done"),
    "c/weit.pdf": ("pdf", [f"Restmuell {FILLER} Gebuehren"], "s8", "done"),
    "d/Kopie1.pdf": ("pdf", ["Sonderfall Marmorplatte"], "dup", "done"),
    "d/Kopie2.pdf": ("pdf", ["Sonderfall Marmorplatte"], "dup", "pending"),
    "e/weg.pdf": ("pdf", ["Marmorplatte verschwunden"], "s9", "missing"),
    "f/Sammlung.pdf": ("pdf", ["Seite 1 von 1 Gutachten", "Seite 1 von 1 Ziegelbruch", "Ziegelbruch Fortsetzung"], "s10", "done"),
    "g/Mail.eml": ("mail", ["Betreff: Anlage Torantrieb", "Torantrieb Messprotokoll ausfuehrlich"], "s11", "done"),
    "g/Torantrieb.pdf": ("pdf", ["Torantrieb Messprotokoll ausfuehrlich"], "att", "done"),
    "h/Nur.eml": ("mail", ["Verweis auf Fensterliste"], "s12", "done"),
    "h/Fensterliste.pdf": ("pdf", ["Fensterliste und alle Masse"], "fen", "done"),
    "i/Jahr.pdf": ("pdf", ["Abrechnung vom 3.4.2020 und vom 5.6.2021"], "s13", "done"),
    "i/Etage.pdf": ("pdf", ["Wohnung im zweiten Stock rechts"], "s14", "done"),
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files, pages, page = [], [], 0
    for i, (path, (kind, texts, sha, status)) in enumerate(FILES.items(), 1):
        files.append((i, 1, path, kind, status, sha, float(i)))
        for n, text in enumerate(texts, 1):
            page += 1
            pages.append((page, i, n, text, 0))
    ids = {p: i for i, p in enumerate(FILES, 1)}
    f = spark.createDataFrame(files, "id long, root_id long, relpath string, kind string, status string, sha256 string, mtime double")
    p = spark.createDataFrame(pages, "id long, file_id long, page_no int, text string, part_no int").drop("part_no")
    parts = spark.createDataFrame([(ids["g/Mail.eml"], 0, 1, 1, "body", None, None, None), (ids["g/Mail.eml"], 1, 2, 1, "pdf", "T.pdf", "att", None), (ids["h/Nur.eml"], 0, 1, 1, "body", None, None, None), (ids["h/Nur.eml"], 1, None, 0, "link", "Fensterliste.pdf", None, "h/Fensterliste.pdf")], "file_id long, part_no int, first_page int, n_pages int, kind string, name string, sha256 string, note string")
    return build(spark, str(tmp_path_factory.mktemp("index")), p, f, parts), parts, ids


QUESTIONS = {1: "Lindenweg 7", 2: "Dachrinne", 3: "Zaun Pforte", 4: "Muellgebuehren", 5: "Marmorplatte", 6: "Gutachten Ziegelbruch", 7: "Torantrieb Messprotokoll", 8: "Fensterliste", 9: "2020/2021", 10: "2. OG", 11: "Kesselwartnug", 12: "Xylofon Marmorplatte", 13: "120,50 EUR", 14: "Nirgendwo", 15: '"Ziegelbruch Fortsetzung"', 16: "Kessel"}


@pytest.fixture(scope="module")
def hits(spark, index):
    ix, parts, ids = index
    alts, groups = compile_queries(spark, list(QUESTIONS.items()))
    synonyms = ex.synonym_pairs(spark.createDataFrame([(1, "muell", 0.75), (1, "restmuell", 0.75)], "group_id int, term string, weight double"))
    wide, n_parts = ex.expand(alts, groups, ix.table("vocabulary"), synonyms)
    rows = se.search(ix, wide, groups, n_parts, se.references(parts, ix.table("files"))).collect()
    names = {i: p for p, i in ids.items()}
    out = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((names[r.file_id], r))
    return out


def order(hits, qid):
    return [n for n, _ in hits.get(qid, [])]


def test_house_numbers_and_amounts(hits):
    assert order(hits, 1)[0] == "a/Akte1.pdf" and hits[1][0][1].score > hits[1][1][1].score and order(hits, 13)[0] == "a/Akte1.pdf"


def test_text_goes_before_path(hits):
    assert order(hits, 2) == ["b/Text.pdf", "Dachrinne/Notiz.pdf"] and hits[2][1][1].score < 0.8


def test_terms_far_apart_count_less(hits):
    assert order(hits, 3) == ["b/nah.pdf", "b/fern.pdf"] and hits[3][0][1].score - hits[3][1][1].score > 0.05


def test_parts_of_a_compound(hits):
    assert order(hits, 4)[:2] == ["c/Abfallentsorgung.pdf", "c/weit.pdf"] and hits[4][0][1].score > hits[4][1][1].score


def test_copies_are_one_hit_and_missing_files_none(hits):
    top = hits[5][0]
    assert order(hits, 5) == ["d/Kopie1.pdf"] and top[1].copies == 2 and len(top[1].locations) == 2


def test_neighbours_belong_to_the_same_document(hits):
    """The page before the mark lends nothing; matched and missing parts are told."""
    row = hits[6][0][1]
    assert row.page_no in (1, 2) and row.score < 0.7 and len(row.matched) == 1 and len(row.missing) == 1


def test_attachment_and_file_are_one_hit_led_by_the_file(hits):
    assert order(hits, 7)[0] == "g/Torantrieb.pdf" and hits[7][0][1].copies == 2


def test_a_mail_that_only_names_a_file_stands_below_it(hits):
    assert order(hits, 8) == ["h/Fensterliste.pdf"] and hits[8][0][1].copies == 2


def test_periods_and_floors(hits):
    assert order(hits, 9) == ["i/Jahr.pdf"] and hits[9][0][1].score == pytest.approx(1.0, abs=0.04) and order(hits, 10) == ["i/Etage.pdf"]


def test_misspelt_unknown_and_missing_words(spark, index, hits):
    assert order(hits, 11)[:2] == ["a/Akte1.pdf", "a/Akte2.pdf"] or order(hits, 11)[:2] == ["a/Akte2.pdf", "a/Akte1.pdf"]
    assert order(hits, 12) == ["d/Kopie1.pdf"] and hits[12][0][1].score == pytest.approx(1.0) and 14 not in hits
    alts, groups = compile_queries(spark, [(1, "Xylofon Marmorplatte")])
    assert [r.label for r in se.unknown_groups(index[0], alts, groups).collect()] == ["xylofon"]


def test_phrases_and_beginnings(hits):
    assert order(hits, 15) == ["f/Sammlung.pdf"] and hits[15][0][1].page_no == 3 and set(order(hits, 16)) == {"a/Akte1.pdf", "a/Akte2.pdf"} and hits[16][0][1].score == pytest.approx(0.85, abs=0.01)


def test_windows_equal_brute_force(spark):
    rows = [(1, g, 1, s, p, float((p * g) % 3 + 1)) for g in (1, 2) for s, p in ((0, 1), (0, 2), (0, 4), (1, 5), (1, 7), (1, 12)) if (p + g) % 4]
    got = {(r.gid, r.page_no): r.win for r in se.neighbour_window(spark.createDataFrame(rows, "qid int, gid int, file_id int, segment int, page_no int, w double"), ["file_id", "segment"]).collect()}
    want = {}
    for s, p in {(r[3], r[4]) for r in rows}:
        for g in (1, 2):
            near = [w if q == p else 0.8 * w for _, h, _, t, q, w in rows if h == g and t == s and abs(q - p) <= 2]
            if near:
                want[g, p] = max(near)
    assert got == want


def test_the_most_important_groups_count(spark):
    stats = spark.createDataFrame([(1, g, 1.0 / g) for g in range(1, 15)], "qid int, gid int, imp double")
    assert {r.gid for r in se.most_important(stats).collect()} == set(range(1, 13))


def test_words_inside_and_unknown_compounds(spark):
    vocab = spark.createDataFrame([("bezirksschornsteinfegermeister", 3), ("tuerschloss", 4), ("wohnungstuer", 2), ("oeffnung", 5), ("oeffnungszeit", 1)], "term string, df long")
    q = spark.createDataFrame([("schornsteinfger",), ("tueroeffnung",)], "word string")
    assert [r.term for r in ex.fuzzy_inside(q, vocab).collect()] == ["bezirksschornsteinfegermeister"]
    assert [(r.word, r.left, r.right) for r in ex.split_unknown(q, vocab).collect()] == [("tueroeffnung", "tuer", "oeffnung")]
    assert ex.partial_ratio("abc", "xxabcxx") == 100.0 and ex.partial_ratio("abcd", "zzzz") == 0.0


def test_forms_of_words(spark):
    vocab = spark.createDataFrame([(t, 1) for t in ("konten", "haus", "thermen", "mieter")], "term string, df long")
    q = spark.createDataFrame([("konto",), ("haeuser",), ("therme",), ("mieter",)], "word string")
    assert {(r.word, r.term) for r in ex.plurals(q, vocab).collect()} == {("konto", "konten"), ("haeuser", "haus"), ("therme", "thermen")}


def test_empty_index(spark, tmp_path):
    pages = spark.createDataFrame([], "id long, file_id long, page_no int, text string")
    files = spark.createDataFrame([], "id long, root_id long, relpath string, kind string, status string, sha256 string, mtime double")
    ix = build(spark, str(tmp_path / "i"), pages, files)
    alts, groups = compile_queries(spark, [(1, "Keller 2020"), (2, "")])
    wide, n_parts = ex.expand(alts, groups, ix.table("vocabulary"))
    assert se.search(ix, wide, groups, n_parts).count() == 0 and F is not None


def test_every_mail_with_a_subject_is_asked_for(spark, tmp_path):
    from paperloom.plans import retrieval

    rows = {
        "files": ([(i, 1, f"m/{i}.eml", "mail", "done", f"s{i}", float(i), 9) for i in range(1, 5)], "id long, root_id long, relpath string, kind string, status string, sha256 string, mtime double, text_chars long"),
        "pages": ([(i, i, 1, t) for i, t in enumerate(["Betreff: Dachrinne", "Betreff: Dachrinne", "Betreff: Torantrieb", "Nichts davon"], 1)], "id long, file_id long, page_no int, text string"),
        "parts": ([], "file_id long, part_no int, first_page int, n_pages int, kind string, name string, sha256 string, note string"),
        "mails": ([(1, "Dachrinne"), (2, "Dachrinne"), (3, "Torantrieb"), (4, None)], "file_id long, subject string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.file_id: (r.qid, r.rank) for r in retrieval.known_items(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3} and sorted([got[1][1], got[2][1]]) == [1, 2] and got[3] == (3, 1)


def test_equal_groups_are_looked_up_once(spark):
    """Groups of the same alternatives and parts have one representative; another weight or number of parts makes another one."""
    alts = spark.createDataFrame([(q, 1, 0, a, w) for q, a, w in ((1, "dach", 1.0), (2, "dach", 1.0), (3, "dach", 0.9), (4, "dach", 1.0))] + [(2, 2, 0, "zaun", 1.0)], "qid int, gid int, part int, alt string, weight double")
    n_parts = spark.createDataFrame([(4, 1, 2)], "qid int, gid int, n_parts int")
    got = {(r.qid, r.gid): (r.rq, r.rg) for r in se.equal_groups(alts, n_parts).collect()}
    assert got == {(1, 1): (1, 1), (2, 1): (1, 1), (3, 1): (3, 1), (4, 1): (4, 1), (2, 2): (2, 2)}
