"""Quality of text, reconciliation and upkeep on small fixtures."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import collection as co
from paperloom.operators import quality as qu


@pytest.mark.parametrize("text,kind", [
    ("Die Rechnung ueber die Wartung der Heizung liegt bei.", "clean"), ("RE-2021/00487", "short"), ("xKqZa bcdfg hhjkl qwrtz mnbvc xcvbn asdfg", "poor"),
    ("Kro5tebn1ux9 qvmlzt@kn |iegt be!m Kr0n ~ Haus und die Mauer", "poor"), ("", "poor"), (None, "poor"), ("ab", "poor"),
])
def test_layers(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(qu.layer_kind(F.col("t"))).first()[0] == kind


def test_choice_of_source_and_reading(spark):
    rows = [("clean", 0.0), ("clean", 0.5), ("short", 0.0), ("poor", 0.0)]
    got = spark.createDataFrame(rows, "k string, s double").select(qu.page_source(F.col("k"), F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == ["text", "text+ocr", "text+ocr", "ocr"]
    df = spark.createDataFrame([(("ab", 0.9), ("abcdef", 0.8)), (("a" * 50, 0.9), ("b" * 90, 0.9)), (("a" * 50, 0.2), ("b" * 60, 0.3))], "a struct<text:string,confidence:double>, b struct<text:string,confidence:double>")
    assert [r.x.text[0] for r in df.select(qu.better_reading(F.col("a"), F.col("b")).alias("x")).collect()] == ["a", "a", "b"] and df.select(qu.better_reading(F.col("a"), F.col("b")).alias("x")).first().x.text == "abcdef"


def test_lines_of_recognised_words(spark):
    rows = [(1, 50.0, 10.0, 10.0, "Welt", 0.5), (1, 0.0, 11.0, 10.0, "Hallo", 1.0), (1, 0.0, 30.0, 10.0, "unten", 0.7), (2, 0.0, 0.0, 5.0, "", 0.1)]
    got = qu.reading_lines(spark.createDataFrame(rows, "page_id int, x double, y double, height double, text string, confidence double")).orderBy("line_no").collect()
    assert [(r.text, round(r.confidence, 3)) for r in got] == [("Hallo Welt", round((5 + 2) / 9, 3)), ("unten", 0.7)]


def test_crops():
    strips = [(0.1, 0.1 + i / 10, 0.5, 0.2 + i / 10) for i in range(3)]
    assert qu.crops([*strips, (0.9, 0.9, 0.91, 0.91), (0.6, 0.0, 0.9, 0.05)], 595, 842) == [(0.1, 0.1, 0.5, pytest.approx(0.4))]
    assert qu.image_share([(0, 0, 1, 0.7), (0, 0, 1, 0.7)]) == 1.0 and qu.crops([], 595, 842) == []


def test_placeholders_and_cut_donors(spark):
    files = spark.createDataFrame([(1, 1, "a/M.eml", "mail", None, None, None), (2, 1, "a/Plan.PDF", "pdf", "s", 7, "Hinweis: truncated after 7 pages"), (3, 1, "b/plan.pdf", "pdf", "t", 7, None)], "id long, root_id long, relpath string, kind string, sha256 string, pages int, error string")
    parts = spark.createDataFrame([(1, 1, "link", "plan.pdf", None, 0), (1, 2, "pdf", "x", "s", 7), (1, 3, "pdf", "y", "s", 6), (1, 4, "pdf", "z", "t", 7), (1, 5, "link", None, None, 0)], "file_id long, part_no int, kind string, name string, sha256 string, n_pages int")
    assert [tuple(r) for r in co.placeholder_targets(parts, files).collect()] == [(1, 1, 2)]
    assert [tuple(r) for r in co.truncated_reuse(parts, files).collect()] == [(1, 2)]


def test_moved_roots_of_two_places_stay(spark):
    files = spark.createDataFrame([(1, f"{i}.pdf", i, f"s{i}", "done") for i in range(200)] + [(2, f"x{i}", 1, f"u{i}", "done") for i in range(3)], "root_id long, relpath string, size int, sha256 string, status string")
    seen = [(9, f"{i}.pdf", i, f"s{i}" if i % 10 else "other") for i in range(200)] + [(k, f"x{i}", 1, f"u{i}") for i in range(3) for k in (7, 8)]
    got = co.moved_roots(files, spark.createDataFrame(seen, "new_root long, relpath string, size int, sha256 string")).collect()
    assert [(r.root_id, r.new_root) for r in got] == [(1, 9)] and 0.8 <= got[0].share < 1


def test_relations_formats_and_names(spark):
    rows = [("/a/b", "/A/b/", "same"), ("/a/b/c", "/a/b", "inside"), ("/a", "/a/b", "contains"), ("/a/bc", "/a/b", "apart")]
    got = spark.createDataFrame(rows, "a string, b string, r string").select("r", co.path_relation(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.r == r.x for r in got)
    assert co.newer_format("9", "10") and not co.newer_format("10", "9") and co.newer_format("10", "x") and not co.newer_format("10", "010")
    name = spark.createDataFrame([("a​/b:" + "x" * 90 + ".pdf",)], "n string").select(co.shown_name(F.col("n")).alias("x")).first().x
    assert name.startswith("a_b_x") and name.endswith("….pdf") and len(name) == 80


def test_running_sums_of_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id % 2 as k", "id as n", "id % 7 as v")
    got = {r.n: r.s for r in co.running_sum(rows, "k", "n", F.col("v"), "s").collect()}
    total = [0, 0]
    for n in range(5000):
        total[n % 2] += n % 7
        assert got[n] == total[n % 2]


def test_builds_that_differ_are_told(spark, tmp_path, monkeypatch):
    """The second build is one of its own: a row that only one of both has, and one with other positions, are counted."""
    from paperloom.operators.index import postings
    from paperloom.plans import retrieval, upkeep

    built = []

    def second_differs(pages, *args, **kw):
        built.append(1)
        rows = postings(pages, *args, **kw)
        return rows if len(built) % 2 else rows.filter("term <> 'keller'").withColumn("at", F.when(F.col("term") == "dach", F.array(F.lit(9))).otherwise(F.col("at")))

    spark.createDataFrame([(1, 1, 1, "Keller und Dach"), (2, 1, 2, "Keller"), (3, 2, 1, None)], "id long, file_id long, page_no int, text string").write.parquet(f"{tmp_path}/pages.parquet")
    assert upkeep.same_build(spark, str(tmp_path)).first().differing == 0
    for module in (retrieval, upkeep):
        monkeypatch.setattr(module, "postings", second_differs, raising=False)
    built.clear()
    assert upkeep.same_build(spark, f"{tmp_path}/").first().differing == 4 and len(built) == 2


def test_builds_shuffle_texts_only_in_partitions_by_size(spark, tmp_path):
    from paperloom.plans import upkeep

    spark.createDataFrame([(1, 1, 1, "Keller")], "id long, file_id long, page_no int, text string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = upkeep.same_build(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
