"""A folder read, indexed, searched, changed and read again, by the engine and by its commands."""

from paperloom.__main__ import parser, run
from paperloom.engine import Engine
from test_sources import container, mail, pdf


def test_a_collection(spark, tmp_path, capsys):
    root, store = tmp_path / "in", str(tmp_path / "store")
    (root / "a").mkdir(parents=True)
    (root / "a/r.pdf").write_bytes(pdf("Rechnung Kesselwartung", "zweite Seite"))
    (root / "a/kopie.pdf").write_bytes(pdf("Rechnung Kesselwartung", "zweite Seite"))
    (root / "m.eml").write_bytes(mail())
    (root / "kaputt.pdf").write_bytes(b"%PDF-1.4 nichts")
    (root / "x.bin").write_bytes(b"\0")
    (root / "notiz.txt").write_text("Schornstein gefegt")
    engine = Engine(spark, store)
    folder = str(root)
    assert engine.ingest([folder]) == {"new": 6}
    states = {r.relpath: r.status for r in engine.table("files").collect()}
    assert states == {"a/r.pdf": "done", "a/kopie.pdf": "done", "m.eml": "done", "kaputt.pdf": "error", "x.bin": "skipped", "notiz.txt": "done"}
    hits = engine.search([(1, "Kesselwartung"), (2, "Größe"), (3, "Xylofon")]).orderBy("qid", "rank").collect()
    assert [(h.qid, h.relpath, h.copies) for h in hits][0][2] == 2 and hits[1].relpath == "m.eml" and "<mark>" in hits[0].snippet and not [h for h in hits if h.qid == 3]
    (root / "notiz.txt").write_text("Schornstein verrusst und neu gefegt")
    (root / "a/kopie.pdf").unlink()
    assert engine.ingest([folder]) == {"unchanged": 4, "changed": 1, "gone": 1}
    assert engine.state.current() == 2 and {r.relpath for r in engine.table("files").filter("status = 'missing'").collect()} == {"a/kopie.pdf"}
    assert [h.copies for h in engine.search([(1, "Kesselwartung")]).collect()] == [1] and engine.search([(1, "verrusst")]).count() == 1
    (tmp_path / "q.csv").write_text("suche;datei;seite\nKesselwartung;r.pdf;1\nverrusst;notiz.txt;\nnirgends;m.eml;\n", encoding="utf-8")
    for line in (["report", "--csv", str(tmp_path / "p.csv")], ["test", str(tmp_path / "q.csv"), "--json", str(tmp_path / "e.json")], ["search", "Schornstein"], ["roots", "--remove", folder]):
        run(spark, parser().parse_args(["--store", store, *line]))
    assert "kaputt.pdf" in (tmp_path / "p.csv").read_text() and '"at_1":2' in (tmp_path / "e.json").read_text()
    assert "notiz.txt, page 1" in capsys.readouterr().out and engine.table("pages").count() == 0 and container()


def test_mass_deletion_waits_and_a_limit_leaves_files_pending(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.txt").write_text(f"Text {i}")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.ingest([str(root)], limit=3)
    assert engine.table("files").count() == 3 and engine.ingest([str(root)]) == {"new": 1, "unchanged": 3}
    for i in range(4):
        (root / f"{i}.txt").unlink()
    (root / "neu.txt").write_text("neu")
    engine.ingest([str(root)], confirm_missing=False)
    assert engine.table("files").filter("status = 'done'").count() == 5
    engine.ingest([str(root)], confirm_missing=True)
    assert engine.table("files").filter("status = 'done'").count() == 1
