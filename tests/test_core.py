"""Text functions, timestamps, incremental runs and search on small fixtures."""

from datetime import datetime, timedelta, timezone
from random import Random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.timestamps import normalize_timestamps
from paperloom.operators import collection as co
from paperloom.operators import expand as ex
from paperloom.operators import search as se
from paperloom.operators.incremental import COMPACT_AFTER, Conflict, VersionedState, incremental_run, replay
from paperloom.operators.index import postings


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["Müller", "Müller", "MÜLLER"])
def test_fold_agrees_on_spellings(spark, text):
    assert value(spark, tx.fold, text) == "mueller" == tx.fold_text(text)


def test_fold_of_null_and_exact(spark):
    assert value(spark, tx.fold, None) is None
    assert value(spark, tx.fold_exact, "ﬁn ² É") == "fin 2 e"


@pytest.mark.parametrize("text", ["1.234,50 EUR", "1234,5", "EUR 1,234.50", "1.234.50", "1 234,50"])
def test_amount_forms_share_a_token(spark, text):
    assert "0amt1234c50" in value(spark, tx.amount_tokens, text)


def test_amount_edges(spark):
    assert value(spark, tx.amount_tokens, "12,- Euro") == ["0amt12c00", "0amt12"]
    assert value(spark, tx.amount_tokens, "250 EUR") == ["0amt250"]
    assert value(spark, tx.amount_tokens, "am 12.03.2024") == []


@pytest.mark.parametrize("text", ["3.4.2021", "2021-04-03", "3. April 2021", "03.04.21"])
def test_date_forms(spark, text):
    assert value(spark, tx.date_tokens, text) == ["0dt20210403", "0mo202104", "0yr2021"]


def test_months_alone_and_impossible_days(spark):
    assert value(spark, tx.date_tokens, "im April 2021") == ["0mo202104", "0yr2021"]
    assert value(spark, tx.date_tokens, "31.02.2021")[0] == "0dt20210231"
    assert value(spark, tx.date_tokens, "32.13.2021") == []


@pytest.mark.parametrize("text", ["RE-2021/123", "RE 2021-123", "RE 2021 123"])
def test_id_spellings_share_a_token(spark, text):
    assert "0id2021123" in value(spark, tx.id_tokens, text)


def test_house_numbers(spark):
    assert set(value(spark, tx.house_number_tokens, "Lindenstraße 3-5")) == {f"0hnlinden{s}{n}" for s in ("str", "strasse") for n in (3, 4, 5)}


def test_path_text(spark):
    assert value(spark, tx.path_index_text, "Größe/Plan_20240131.pdf") == "groesse plan 20240131 0dt20240131 0mo202401 0yr2024"


def test_sniff(spark):
    heads = {"pdf": b"\n %PDF-1.7", "png": b"\x89PNG\r\n\x1a\n", "zip": b"PK\x03\x04", None: b"hello", "tnef": b"\x78\x9f\x3e\x22%PDF-"}
    got = spark.createDataFrame([(bytearray(b),) for b in heads.values()], "b binary").select(tx.sniff(F.col("b")).alias("k")).collect()
    assert [r.k for r in got] == list(heads)


CASES = {
    "2025-05-04T19:53:00+02:00": datetime(2025, 5, 4, 17, 53, tzinfo=timezone.utc), "20200329T042158Z": datetime(2020, 3, 29, 4, 21, 58, tzinfo=timezone.utc),
    "Sun, 23 Feb 2020 13:30:00 EST": datetime(2020, 2, 23, 18, 30, tzinfo=timezone.utc), "22 Apr 23 15:07 GMT": datetime(2023, 4, 22, 15, 7, tzinfo=timezone.utc),
    "Dienstag, 17. November 2020 um 07:48 Uhr": datetime(2020, 11, 17, 6, 48, tzinfo=timezone.utc), "5/23/2019 5:46:58 PM": datetime(2019, 5, 23, 15, 46, 58, tzinfo=timezone.utc),
    "12/16/2020 12:30:25 AM": datetime(2020, 12, 15, 23, 30, 25, tzinfo=timezone.utc), "31.08.21 19:04": datetime(2021, 8, 31, 17, 4, tzinfo=timezone.utc),
    "1664301985": datetime.fromtimestamp(1664301985, timezone.utc), "1572148107501": datetime.fromtimestamp(1572148107, timezone.utc) + timedelta(milliseconds=501),
    "2020-01-27T20:51:48+0545": datetime(2020, 1, 27, 15, 6, 48, tzinfo=timezone.utc), "2022-10-22 13:31:09 UTC+2": datetime(2022, 10, 22, 11, 31, 9, tzinfo=timezone.utc),
    "2021-02-28T12:48:57.835920571Z": datetime(2021, 2, 28, 12, 48, 57, 835000, tzinfo=timezone.utc), "26.10.2025, 02:31 MEZ": datetime(2025, 10, 26, 1, 31, tzinfo=timezone.utc),
    "2020-10-25 02:14:15": None, "31.03.2019 02:30": None, "32.13.2023 25:61": None, "16.10.2024": None, "": None, None: None, "gestern": None, "2024-02-30T10:00:00+01:00": None,
    "2023-02-29 10:00:00": None, "2024-01-01T10:00:00 XYZ": None,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(CASES)], "id long, sent_at string, __utc string")
    got = {r.id: r.utc_ms for r in normalize_timestamps(df, "sent_at").collect()}
    for i, (text, want) in enumerate(CASES.items()):
        assert got[i] == (None if want is None else int(want.timestamp() * 1000 + 0.5)), text


def test_timestamps_against_zone_rules(spark):
    """Every half hour around the changes of a year: only repeated and skipped hours are left out; policies fill them."""
    zone, rows = ZoneInfo("Europe/Berlin"), []
    for start in (datetime(2024, 3, 31, 0, 0), datetime(2024, 10, 27, 0, 0), datetime(2024, 7, 1, 0, 0)):
        rows += [start + timedelta(minutes=30 * k) for k in range(10)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"),) for t in rows], "s string")
    plain = [r.utc_ms for r in normalize_timestamps(df, "s").collect()]
    early = [r.utc_ms for r in normalize_timestamps(df, "s", ambiguous="earlier", nonexistent="shift").collect()]
    late = [r.utc_ms for r in normalize_timestamps(df, "s", ambiguous="later").collect()]
    for t, p, e, x in zip(rows, plain, early, late):
        utc = {t.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        real = sorted(u for u in utc if u.astimezone(zone).replace(tzinfo=None) == t)
        assert p == (int(real[0].timestamp() * 1000) if len(real) == 1 else None)
        if real:
            assert e == int(real[0].timestamp() * 1000) and x == int(real[-1].timestamp() * 1000)
        else:
            assert e is not None and x is None


LOG = "log_id long, file_id long, size long, mtime double, sha256 string, status string, attempts int, arrived_at timestamp, extra string"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, outcome string"
T0 = datetime(2024, 1, 1)


def brute(rows, runs):
    rows = sorted({r for r in rows if r[7] is not None and r[1] is not None}, key=lambda r: (r[7], r[0] if r[0] is not None else -(2**63)))
    done, out = {}, set()
    for run in sorted((r for r in runs if r[3] == "ok"), key=lambda r: (r[1], r[0])):
        newest = {r[1]: r for r in rows if r[7] <= run[1]}
        for f, r in newest.items():
            old = done.get(f)
            same = old and (old[4] == r[4] if old[4] and r[4] else (old[2], old[3]) == (r[2], r[3]))
            if r[5] not in ("missing", "skipped") and (r[6] or 0) < 3 and not same:
                done[f] = r
                out.add((run[0], f))
    return out


def test_replay_against_brute_force(spark):
    rnd = Random(5)
    rows = [(i, None if i % 71 == 0 else rnd.choice([1, 1, 1, *range(2, 12)]), rnd.randrange(3), float(rnd.randrange(2)), rnd.choice([None, "a", "b"]), rnd.choice(["pending", "missing", "skipped", "error", None]), rnd.choice([0, 1, 3, None]), None if i % 50 == 0 else T0 + timedelta(hours=rnd.randrange(60)), "x") for i in range(400)]
    rows += rows[:40]
    runs = [(k, T0 + timedelta(hours=6 * k), None, "ok" if k % 3 else "failed") for k in range(9)]
    got = replay(spark.createDataFrame(rows, LOG), spark.createDataFrame(runs, RUNS)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, runs)


def test_replay_of_empty_tables(spark):
    empty, runs = spark.createDataFrame([], LOG), [(1, T0, None, "ok")]
    assert replay(empty, spark.createDataFrame(runs, RUNS)).count() == 0
    assert replay(empty, spark.createDataFrame([], RUNS)).count() == 0


def row(log_id, file_id, sha, hour, status="pending", attempts=0):
    return (log_id, file_id, 5, 1.0, sha, status, attempts, T0 + timedelta(hours=hour), "")


def test_run_broken_off_before_the_swap_is_repeated(spark, tmp_path):
    store = VersionedState(spark, str(tmp_path / "state"))
    delta = spark.createDataFrame([row(1, 7, "a", 0)], LOG)
    publish, store.publish = store.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        incremental_run(store, delta, 0)
    assert store.current() == 0 and store.results().count() == 0
    store.publish = publish
    assert incremental_run(store, delta, 0).count() == 1 and store.current() == 1
    assert incremental_run(store, delta, 1).count() == 0 and store.results().count() == 1


def test_run_repeated_after_the_swap_keeps_its_results(spark, tmp_path):
    store = VersionedState(spark, str(tmp_path / "state"))
    delta = spark.createDataFrame([row(1, 7, "a", 0)], LOG)
    for _ in range(2):
        assert [r.file_id for r in incremental_run(store, delta, 4).collect()] == [7]
        assert store.current() == 1 and [(r.batch, r.file_id) for r in store.results().collect()] == [(4, 7)]


def test_late_rows_older_than_the_state_are_dropped(spark, tmp_path):
    store = VersionedState(spark, str(tmp_path / "state"))
    runs = [[row(5, 7, "b", 9), row(6, 8, "x", 9, "missing")], [row(1, 7, "a", 3), row(2, 8, "y", 3)], [row(7, 8, "y", 10), row(8, 7, "b", 10)], [row(9, 7, None, 11)]]
    got = [{r.file_id for r in incremental_run(store, spark.createDataFrame(x, LOG), i).collect()} for i, x in enumerate(runs)]
    assert got == [{7}, set(), {8}, set()]


def test_two_writers_of_one_version(spark, tmp_path):
    store, other = (VersionedState(spark, str(tmp_path / "state")) for _ in range(2))
    publish = store.publish

    def late(*args):
        incremental_run(other, spark.createDataFrame([row(2, 8, "b", 0)], LOG))
        return publish(*args)

    store.publish = late
    with pytest.raises(Conflict):
        incremental_run(store, spark.createDataFrame([row(1, 7, "a", 0)], LOG))
    assert store.current() == 1 and [r.file_id for r in store.results().collect()] == [8]


def test_state_survives_compaction(spark, tmp_path):
    store = VersionedState(spark, str(tmp_path / "state"))
    for i in range(COMPACT_AFTER + 3):
        assert incremental_run(store, spark.createDataFrame([row(i, i % 2, "a", i)], LOG), i).count() == (i < 2)
    assert len(store.manifest()["state"]) <= COMPACT_AFTER and store.results().count() == 2


def test_stream_of_runs(spark, tmp_path):
    from paperloom.streaming.incremental import start

    source = str(tmp_path / "in")
    store = VersionedState(spark, str(tmp_path / "state"))
    for rows in ([row(1, 7, "a", 0)], [row(2, 7, "a", 1), row(3, 8, "b", 1)]):
        spark.createDataFrame(rows, LOG).write.mode("append").parquet(source)
        start(spark.readStream.schema(LOG).parquet(source), store, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.batch, r.file_id) for r in store.results().collect()) == [(0, 7), (1, 8)]


def test_snippet_marks_and_escapes():
    s = se.make_snippet("<b> Das Ventil & der Heizraum", ["ventil", "heizraum"])
    assert "<mark>Ventil</mark> &amp;" in s and s.startswith("&lt;b&gt;") and se.make_snippet(None, []) is None


def test_typos_equal_brute_force(spark):
    terms = ["dichtung", "dihctung", "dichtun", "dichtunx", "abdichtung", "wartung", "leitung", "rechnungsnumer", "rechnungsnummer", "rehcnungsnumer"]
    words = ["dichtung", "rechnungsnummer", "leitung"]
    vocab = spark.createDataFrame([(t, 1) for t in terms], "term string, df long")
    got = {(r.word, r.term) for r in ex.typos(spark.createDataFrame([(w,) for w in words], "word string"), vocab).collect()}
    assert got == {(w, t) for w in words for t in terms if w != t and ex.osa(w, t, 2) <= (1 if len(w) <= 8 else 2)}


def test_decompound_and_plurals(spark):
    vocab = spark.createDataFrame([("heizung", 5), ("anlage", 3), ("dichtungen", 2), ("schaeden", 1)], "term string, df long")
    q = spark.createDataFrame([("heizungsanlage",), ("dichtung",), ("schaden",)], "word string")
    assert [(r.left, r.right) for r in ex.decompounded(q, vocab).collect()] == [("heizung", "anlage")]
    assert {(r.word, r.term) for r in ex.plurals(q, vocab).collect()} == {("dichtung", "dichtungen")}


def test_min_span(spark):
    df = spark.createDataFrame([([[1, 9, 20], [12, 30], [10]],), ([[1], []],)], "x array<array<int>>")
    assert [r.s for r in df.select(se.min_span(F.col("x")).alias("s")).collect()] == [3, None]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "id long, file_id long, page_no int, text string, source string, ocr_conf double")
    assert co.file_statistics(pages).count() == 0 and co.doubtful_pages(pages).count() == 0
    assert postings(pages.withColumnRenamed("id", "page_id")).count() == 0


def pages_folder(spark, folder, texts):
    """A folder of tables that has pages only, one file of one page for each text."""
    spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts, 1)], "id long, file_id long, page_no int, text string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_separate_street_words_are_joined(spark, tmp_path):
    from paperloom.plans import retrieval

    folder = pages_folder(spark, tmp_path, ["Linden Straße 5, Gartenstr. 7", "Haupt Str. 3", "Am 3 str", None])
    got = {(r.id, r.token) for r in retrieval.street_tokens(spark, folder).collect()}
    assert got == {(1, "lindenstrasse"), (1, "lindenstr"), (1, "gartenstrasse"), (2, "hauptstrasse"), (2, "hauptstr")}


def test_street_tokens_split_a_page_into_words_once(spark, tmp_path):
    from paperloom.plans import retrieval

    plan = retrieval.street_tokens(spark, pages_folder(spark, tmp_path, ["Haupt Str. 3"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
