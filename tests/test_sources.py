"""Readers on generated messages, containers and files."""

import io
import json
import struct
import zipfile
import zlib
from email.message import EmailMessage

import pytest

from paperloom.sources import readers as rd
from paperloom.sources import tnef
from paperloom.sources.pdf import pdf_pages


def mail() -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"], m["Message-ID"] = "Größe", "A <a@b.example>", "c@d.example", "Mon, 7 Jan 2019 12:03:59 +0100", "<1@x>"
    m.set_content("Guten Tag")
    m.add_alternative("<p>Guten <b>Tag</b></p>", subtype="html")
    m.add_attachment("eins\fzwei".encode(), maintype="text", subtype="plain", filename="n.txt")
    m.add_attachment("eins\fzwei".encode(), maintype="text", subtype="plain", filename="kopie.txt")
    m.add_attachment(b"PK\x03\x04kaputt", maintype="application", subtype="zip", filename="x.docx")
    return m.as_bytes()


def test_mail():
    got = rd.read_mail(mail())
    assert got["mail"]["subject"] == "Größe" and got["mail"]["sent_at"] == "2019-01-07T12:03:59+01:00"
    assert [p["text"].strip() for p in got["pages"]][1:] == ["eins", "zwei"] and "Guten Tag" in got["pages"][0]["text"]
    assert [(p["first_page"], p["n_pages"]) for p in got["parts"]] == [(1, 1), (2, 2), (None, 0), (None, 0)]
    assert got["parts"][2]["note"] == "same as part 1" and got["parts"][3]["note"].startswith("unreadable")


def test_formats():
    assert rd.html_to_text("<head><title>x</title></head><p>a&amp;b</p><table><tr><td>1</td><td>2</td></tr></table>") == "a&b\n\n\t1\t2"
    assert rd.rtf_to_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Gr\'fc\u223?e\par Zeile}") == "Grüße\nZeile"
    assert rd.unwrap_flowed("eins \nzwei\n> a \n> b\n-- \nx") == "eins zwei\n> a b\n-- \nx"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>eins</w:t><w:br w:type="page"/><w:t>zwei</w:t></w:r></w:p></w:body></w:document>')
    assert rd.pages_of(rd.docx_text(b.getvalue())) == ["eins", "zwei\n"]
    assert rd.decode("Grüße".encode("cp1252")) == "Grüße" == rd.decode("Grüße".encode())


def test_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/m.eml").write_bytes(mail())
    (tmp_path / "a/k.eml").write_bytes(mail())
    (tmp_path / "a/.hidden").write_text("x")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    assert {r.relpath for r in rd.scan(spark, str(tmp_path)).collect()} == {"a/m.eml", "a/k.eml", "b.bin"}
    files = spark.createDataFrame([("a/m.eml", bytearray(mail())), ("a/k.eml", bytearray(mail())), ("b.bin", bytearray(b"\x00"))], "relpath string, content binary")
    got = {r.relpath: r for r in rd.extract(files).collect()}
    assert len(got["a/m.eml"].pages) == 3 == len(got["a/k.eml"].pages) and got["b.bin"].error


def test_lists(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Suche;Datei;Seite\n"a;b";x.pdf;2\n;y.pdf;1\nc;z.pdf;0\n', encoding="utf-8")
    assert [tuple(r) for r in rd.read_questions(spark, str(tmp_path / "q.csv")).collect()] == [("a;b", "x.pdf", 2, None)]
    (tmp_path / "s.txt").write_text("Lift, Aufzug # x\n# nur so\nHeizung = Therme\n", encoding="utf-8")
    assert {r.term for r in rd.read_synonyms(spark, str(tmp_path / "s.txt")).collect()} == {"lift", "aufzug", "heizung", "therme"}
    assert {r.weight for r in rd.read_synonyms(spark, str(tmp_path / "s.txt")).collect()} == {0.75}
    (tmp_path / "w.txt").write_text("~ Haus, Objekt\n", encoding="utf-8")
    assert {(r.term, r.weight) for r in rd.read_synonyms(spark, str(tmp_path / "w.txt")).collect()} == {("haus", 0.6), ("objekt", 0.6)}
    (tmp_path / "c.csv").write_text("\ufeffquery,file\nx,y.pdf\n", encoding="utf-8")
    assert [tuple(r) for r in rd.read_questions(spark, str(tmp_path / "c.csv")).collect()] == [("x", "y.pdf", None, None)]
    (tmp_path / "d.csv").write_text("suche;datei;Datei\nx;y;z\n", encoding="utf-8")
    with pytest.raises(ValueError):
        rd.read_questions(spark, str(tmp_path / "d.csv"))


def test_written_files_are_whole_and_stay(spark, tmp_path):
    df = spark.createDataFrame([("ö;x.pdf", "error", "kaputt"), ("a.pdf", "skipped", None)], "relpath string, status string, reason string")
    path = str(tmp_path / "p.csv")
    assert rd.write_problems(df, path) == 2
    assert (tmp_path / "p.csv").read_bytes().decode("utf-8-sig").split("\r\n")[:3] == ["Datei;Status;Grund", "a.pdf;skipped;", '"ö;x.pdf";error;kaputt']
    with pytest.raises(FileExistsError):
        rd.write_problems(df, path)
    assert rd.write_problems(df.limit(0), path, replace=True) == 0
    with pytest.raises(ValueError):
        rd.write_problems(df, path, most=1)
    rd.write_evaluation(spark.createDataFrame([(2, 1)], "queries int, at_1 int"), spark.createDataFrame([(1, "ok")], "qid int, cause string"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"summary": {"queries": 2, "at_1": 1}, "rows": [{"qid": 1, "cause": "ok"}]}


def attribute(level: int, number: int, value: bytes) -> bytes:
    return struct.pack("<BII", level, number, len(value)) + value + struct.pack("<H", sum(value) & 0xFFFF)


def props(*rows) -> bytes:
    out = struct.pack("<I", len(rows))
    for kind, number, value in rows:
        out += struct.pack("<HH", kind, number)
        out += value if kind == 3 else struct.pack("<II", 1, len(value)) + value + b"\0" * (-len(value) % 4)
    return out


RTF = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")


def container(*attachments, body=b"Guten Tag", extra=b"") -> bytes:
    out = struct.pack("<IH", 0x223E9F78, 1) + attribute(1, 0x9007, struct.pack("<II", 1252, 0)) + attribute(1, 0x8004, "Größe".encode("cp1252") + b"\0") + attribute(1, 0x800C, body) + extra
    for name, data in attachments:
        out += attribute(2, 0x9002, b"\0" * 14) + attribute(2, 0x8010, name.encode("cp1252") + b"\0") + attribute(2, 0x800F, data) + attribute(2, 0x9005, props((0x1F, 0x3707, f"{name}.txt".encode("utf-16-le"))))
    return out


def test_container():
    got = tnef.parse(container(("a", b"eins"), ("b", b"zwei"), extra=attribute(1, 0x9003, props((3, 0x3705, b"\1\0\0\0"), (0x102, 0x1009, RTF)))))
    assert got["subject"] == "Größe" and [(x["name"], x["data"]) for x in got["attachments"]] == [("a.txt", b"eins"), ("b.txt", b"zwei")] and not got["notes"]
    assert got["rtf"] == "{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n" and rd.rtf_to_text(got["rtf"]).strip() == "hello world"
    assert rd.read_file(container(("a", b"eins\fzwei")), "tnef", "winmail.dat")["pages"][1]["text"] == "eins"
    inner = container(("x", b"innen"))
    nested = container() + attribute(2, 0x9002, b"\0" * 14) + attribute(2, 0x9005, props((3, 0x3705, b"\5\0\0\0"), (0x0D, 0x3701, b"\0" * 16 + inner)))
    assert [p["text"].splitlines()[-1] for p in rd.read_file(nested, "tnef", "w.dat")["pages"]] == ["Guten Tag", "Guten Tag", "innen"]


@pytest.mark.parametrize("n", range(0, 120, 7))
def test_damaged_containers_never_raise(n):
    whole = container(("a", b"eins"), extra=attribute(1, 0x9003, props((0x102, 0x1009, RTF))))
    for data in (whole[:n], whole[:n] + b"\xff" * 9 + whole[n + 9 :], b"", RTF[:n]):
        assert isinstance(tnef.parse(data)["notes"], list) and isinstance(tnef.decompress_rtf(data)[0], bytes)


def test_wrapped_and_damaged_rich_text():
    assert tnef.decompress_rtf(struct.pack("<IIII", 17, 5, 0x414C454D, 0) + b"{abc}") == (b"{abc}", None)
    assert tnef.decompress_rtf(RTF[:12] + b"\0\0\0\0" + RTF[16:])[1] == "checksum of rich text" and tnef.decompress_rtf(RTF[:30])[1]


def test_html_inside_rich_text():
    source = r"{\rtf1\ansi\fromhtml1 {\*\htmltag64 <p>}\htmlrtf {\htmlrtf0 Gr\'fc\'dfe {\*\htmltag84 <b>}an\htmlrtf \b\htmlrtf0 {\*\htmltag92 </b>} alle\htmlrtf }\htmlrtf0 {\*\htmltag72 </p>}}"
    assert rd.html_to_text(rd.rtf_html(source)) == "Grüße an alle" and rd.rtf_html(r"{\rtf1 x}") is None


def pdf(*pages: str, extra: bytes = b"") -> bytes:
    out = [b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Count %d /Kids [%s]>> endobj" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))))]
    for i, text in enumerate(pages):
        ops = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm " + b" 0 -14 Td ".join(b"(%s) Tj" % x.replace("(", "\\(").replace(")", "\\)").encode("cp1252") for x in text.split("\n")) + b" ET" if text else b"0 0 m"
        data = zlib.compress(ops)
        out += [b"%d 0 obj <</Type /Page /Parent 2 0 R /Contents %d 0 R>> endobj" % (10 + 2 * i, 11 + 2 * i), b"%d 0 obj <</Length %d /Filter /FlateDecode>> stream\n" % (11 + 2 * i, len(data)) + data + b"\nendstream endobj"]
    return b"%PDF-1.4\n" + b"\n".join(out) + b"\ntrailer <</Root 1 0 R" + extra + b">>"


def test_pdf():
    assert pdf_pages(pdf("Grüße (alle)\nzweite Zeile", "", "drei")) == ["Grüße (alle)\nzweite Zeile", "", "drei"]
    assert rd.read_file(pdf("eins"), "pdf", "x.pdf")["pages"] == [{"page_no": 1, "text": "eins", "source": "text"}]
    assert rd.read_file(pdf("eins", extra=b" /Encrypt 9 0 R"), "pdf", "x.pdf")["error"] == "password needed"
    assert rd.read_file(pdf("eins")[:40], "pdf", "x.pdf")["error"] and rd.read_file(b"%PDF-1.4", "pdf", "x.pdf")["error"]
    cmap = b"1 beginbfchar <0041> <00C4> endbfchar 1 beginbfrange <0042> <0044> <0078> endbfrange"
    page = pdf("x").replace(b"/Contents", b"/Resources <</Font <</F1 90 0 R>>>> /Contents") + b"\n90 0 obj <</ToUnicode 91 0 R>> endobj\n91 0 obj <<>> stream\n" + cmap + b"\nendstream endobj"
    assert pdf_pages(page.replace(b"zz", b""))[0] == "" and pdf_pages(pdf("A")) == ["A"]


def test_charset_that_is_declared_wrong():
    assert rd.decode("Größe für alle".encode("cp1252"), "utf-8") == "Größe für alle" and rd.decode("Größe ".encode() * 3 + b"\xff", "UTF-8") == "Größe " * 3 + "\ufffd"
