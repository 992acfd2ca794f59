"""The small labelled table that problem 5's model is trained on: sentences of clubs, schools, shops and surgeries.

Sentences are patterns; slots in braces are filled in turn, names and numbers by rule, so that no value comes twice. Slots
with a kind (KINDS) are spans of that kind; the others only vary the text around them. Sentences, names, firms and streets
are none of the test tables'.
"""

from __future__ import annotations

import re
from random import Random

KINDS = {"N": "name", "S": "name", "C": "name", "E": "email", "B": "email", "P": "phone", "I": "id_number", "J": "id_number", "A": "address"}

GIVEN = "Thomas Sabine Michael Petra Andreas Ursula Peter Monika Wolfgang Karin Klaus Renate Jürgen Brigitte Stefan Susanne Christian Claudia Frank Martina Markus Andrea Daniel Birgit Tobias Heike Sven Katrin Ayşe Mehmet Giulia Marco Élise Luc Sofie Pieter Emma Liam Olga Pavel Björn Zoltán".split()
FAMILY = "Müller Schmidt Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hartmann Lange Werner Krause Lehmann Köhler Huber".split()
FIRST, SECOND = "Arbeits Sommer Winter Kinder Schul Sport Auto Brief Buch Licht Holz Stadt Land Wert Zeit Tages Haupt Neben Musik Tier".split(), "plan raum fest karte liste zahl stelle frage preis bericht gerät kurs heft kasse probe gruppe sitzung ausgabe meldung reise".split()
TRADES = "Buchhandlung Autohaus Bäckerei Zahntechnik Reisebüro Spedition Optik Druckerei Gärtnerei Musikschule Apotheke Fahrschule Möbelhaus Weinhandel Tierklinik Sportverein Fotostudio Schreinerei Verlag Brauerei".split()
FORMS = ["", " GmbH", "", " AG", "", " OHG", " KG", "", " e.V."]
ENDINGS = "straße str. weg gasse allee ring ufer pfad stieg steig platz damm -Straße -Weg -Ring -Platz -Stieg -Allee".split()
AT_STREET = "Am Markt|An der Linde|Zum Bahnhof|Auf dem Hügel|Hinter der Mauer|Unter den Eichen|Im Winkel|Alte Gasse|Vor dem Tor|Am Neuen Graben|Bei den Mühlen|Zur Alten Post".split("|")
AT = "Am|An der|Zum|Auf dem|Hinter den|Unter den|Im|Zur|Bei den|Vor dem|Auf der|Am Alten".split("|")
MONTHS = "Januar März Mai August Oktober Dezember".split()
VERBS = "leitet prüft verlegt lehnt plant übernimmt bestellt wechselt ändert verteilt druckt beendet meldet verlässt erhält schließt".split()
NOUNS = "Nebel Frost Hitze Lärm Staub Ankunft Abfahrt Mittag Papier Vorkasse Rabatt Porto Steuer Schnee Sturm Musik Kaffee Licht Strom Wind Fracht Zoll".split()
LABELLED = ["IBAN {I}", "IBAN: {I}", "Konto: {I}", "Konto {I}", "Steuernummer {I}", "Steuernr. {I}", "IdNr. {I}", "Steuer-ID {I}", "Personalausweis {I}", "Ausweis-Nr. {I}", "Sozialversicherungsnummer {I}", "SV-Nummer {I}", "Rentenversicherungsnr. {I}"]

PATTERNS = """Am Empfang wartet {N} auf die Gäste.
Die Probe leiten {N} und {N} gemeinsam.
Zur Sitzung kamen {N} und {N} pünktlich. Notiz {r}
Fragen beantwortet {N}, zu erreichen unter {P}. Das Heft kostet {m}.
Die Anmeldung nimmt {N} entgegen, Telefon\\n{P}. Notiz {r}.
Das Paket liegt bei {N} in der {A} für Sie.
Das Buch bekommt {N} in der {A} wieder. Die {n} beginnt um acht.
Auf Wunsch von Frau {S} fällt die {n} am {d} aus.
Auf Wunsch von Herrn {S} fällt der {n} am {d} aus.
Laut Frau Dr. {S} genügt die {n}.
Laut Herrn\\nDr. {S} genügt die {n} bis {d}.
Liebe Frau {S},\\n\\ndanke für die {n}.
Lieber Herr {S},\\n\\nder {n} findet statt.
Sehr geehrter Herr Prof. {S},\\n\\ndie {n} ist fertig.
Sehr geehrte Frau Dr. {S},\\n\\nbitte zahlen Sie {m} bis {d}.
Sehr geehrte Damen und Herren,\\n\\nder Vorstand wählt {f} für die {n}.
Hallo zusammen,\\n\\nunser {n} über {m} ist bis {d} gültig. Notiz {r}.
Bewerbungen gehen an {E} oder mit der Post an {A}. Der Eintritt ist frei.
Bewerbungen gehen an\\n{E} oder mit der Post an\\n{A}. Notiz {r}
Der Beirat hat mit großer Mehrheit {f} für den {n} gewählt.
Der Vorstand schlägt vor,\\n{f} mit dem {n} zu\\nbetrauen.
Das Konzert im Haus {A} hat am {d} {f} veranstaltet.
Das Treffen im Haus\\n{A} haben am {d}\\n{f} und die {n} bezahlt. Notiz {r}
Das Abonnement {r} endet mit Ablauf des {d}.
Geben Sie bei der Zahlung die Nummer {r} an. Porto kommt hinzu.
Für die {n} stellen wir Ihnen {m} in Rechnung.
Der {n} für {M} 2021 kostet {m}. Wir schreiben Ihnen bald.
In der {n} standen am {d} genau 74118 Bände.
Verschickt wurden 6120 Stück {n} und 14 kg Papier.
In der {n} hat es geregnet, warum weiß noch niemand.
Kaffee- und Teepause sind am Nachmittag. Notiz {r}
Ein Kind fragt nach der {n}, vor allem am Morgen.
Wert alt\\n417\\nWert neu\\n20311
1  {n}  2 Std  {m}
2  {n} im Saal  5 Std  {m}
Breite 12 m, Hälfte ½
Bericht der {n} {r}\\nSeite 2 von 9
{f} · {n}\\n{f}, Altdorf
Geheim – {r}\\nAkte {f}
Auskunft am Schalter · {f}
{f} – {r}
Mappe {r} · {f}\\nS. 12
Quittung {r}\\n{f}\\n{A}, 00417 Altdorf
{f}\\n{A}\\n00417 Neustadt\\n\\nQuittung {r}
{f}\\n{A}, 00811 Neustadt\\nTel. {P}
{f}\\n{A}\\n\\nQuittung {r}
Bis bald\\n{N}\\n\\n-- \\n{N}\\n{f}\\n{A}, 00811 Neustadt\\nTelefon {P}\\n{E}
Viele Grüße\\n{N}\\n\\n{f}\\n{A}, 00811 Neustadt\\nT {P}\\nE-Mail: {E}\\nSitz: Altdorf, {r}
Best wishes\\n{N}\\n\\n{N}\\n{f}\\nFon {P}\\n{E}
VG\\n{N}\\n\\nSent with my tablet
Gruß\\n{N}\\n\\n> LG\\n> {N}
Schöne Grüße\\n{N}\\n\\n________________\\n{N}\\n{f}\\nMobil: {P}
Schöne Grüße\\n\\n{f}\\nMobil: {P}
Freundlich grüßt\\n{N}\\n\\n{f}\\nTel.: {P}\\nE-Mail: {E}
Am {d} um 09:12 schrieb {N} <{B}>:\\n> Hallo,\\n>
Am {d} 18:40 schrieb\\n{N} <{B}>:\\n> Hallo,
On 2017-02-11, {N} wrote:\\n> Hello,
{N} schrieb am {d}:\\n> Hallo,
Am {d} 07:31, {N}:\\nHallo,
Von: {N} am {d} 12:05\\nHallo,
Betreff: {n}\\nVon: {N} <{B}>\\nAn: {N} <{B}>\\nDatum: {d} 12:05
Betreff: AW: {n}\\nVon: {E}\\nAn: "{C}" <{B}>, {E}\\nDatum: {d} 07:31
Betreff: {n} {r}\\nVon: {f} <{E}>\\nAn: {f} <{E}>; {N} ({B})
Betreff: (leer)\\nVon: "{C}" <{B}>\\nAn: <{E}>, {N} <{B}>
*Von:* {N} <{B}>\\n*Datum:* Montag, {d} 12:05\\n*An:* {N}\\n*Betreff:* {n}
From: {N} <{B}>\\nSent: Sonntag, {d} 07:31\\nTo: {N}\\nSubject: {n}
Von: {N} <{B}>\\nGesendet: Mittwoch, {d} 18:40\\nAn: {N}\\nBetreff: {n}
Gesendet: Freitag, {d} 07:31\\nAn: {N}
Sent: Montag, {d} 12:05\\nTo: {N}\\nSubject: {n}
{N} <{B}>
{N} <{B}>
"{C}" <{B}>
"{C}" <{B}>
<{E}>
{E}
{N} ({B})
{f} <{E}>
{f} <{E}>, {N} <{B}>
"{C}" <{B}>, {f} <{E}>; {E}
{N} <{B}>; "{C}" <{B}>; <{E}>
{L}\\nTel. {P}, {E}
{L}\\nDen Beitrag zahlt der Verein.
{m} samt Porto.\\n\\n{L}\\nTel. {P}
1  {n}  {h} Std  {m}\\n{L}
1  {n}  {h} Std  {m}\\n2  {n}  {h} Std  {m}\\n{L}\\nTel. {P}
an. Notiz {r}\\n\\n{L}
an. Notiz {r}\\n\\n{L}\\nTel. {P}
{L}
{L}
Tel. {P}, {E}
Telefon {P} und Fax {P}
Mitgliedsnummer {r}, Bestellung {r}, Los {r}
Bestellung {r}\\nZur Sitzung kamen {N} und {N} pünktlich.
Wahrscheinlich hat ein alter Schrank die {n} gestört. Fragen beantwortet {N}, zu erreichen unter {P}.
The nurse did not open the {n} because {N} had left. After a talk with {N} the class moved to {d}.
The concert at {A} was given by {f} on {d}.
Send the form until {d} and state number {r}. The price of {m} holds until {d}.
Before the books arrive we write to you. For the {n} you pay {m} in all.
Am {d} schrieb ich Ihnen schon, dass die {n} fehlt.
Von: Küste, An: Gipfel – so heißt der Weg auf der Karte.
HINWEIS: unbekannter Absender.\\n\\nHallo,
This text is secret and may be protected by law.
Wenn Sie nicht gemeint sind, löschen Sie diesen Brief.
-----Alter Brief-----
---------- Kopie ---------
Wenn die {n} da ist, geht die Arbeit weiter. Offen bleibt die {n} von {m}.
Die Garantie läuft ab {d} drei Jahre. Hin- und Rückfahrt zahlt der Gast selbst.
Die {n} zeigt einen Rest von {m} für den Verein. Leider stören Blätter den {n}.
{n} {r}\\nAuf Wunsch von Frau {S} fällt der {n} auf den 3.\\n{M} 2018.
Das Kind {N}, zu Hause {A}, ruft man unter {P} an.
Laut Buch {r} vertrat {N} den Lehrer. Am {d} las {N} neben der {n} ein Blatt.
> gelesen.\\n>\\n> Viele Grüße\\n> {N}\\n>\\n> -----Alter Brief-----
> Schöne Grüße\\n> {N}\\n>\\n> {N} schrieb am {d}:
>>Gruß\\n>>{N}
| LG\\n| {N}
: Best wishes\\n: {N}
auf den {d}.\\n\\n{N}\\n{f}\\n{A}, 00811 Neustadt
auf den {d}.\\n\\n-- \\n{N}\\n{f}\\nT {P}
zu melden.\\n\\n{f}\\nTelefon {P}\\nSitz: Altdorf, {r}
{n} {r}\\n{f} · {n}\\nSeite 4
Bericht {r}\\nDie Probe leiten {N} und {N} gemeinsam.
Die {n} im Haus {A} hat am {d} {f}\\nbezahlt. Der {n} zeigt einen Rest.
Akte {f}\\n{f}, Altdorf
Fragen beantwortet {N}, zu erreichen unter\\n{P}. Gebühren gibt es keine.
> Fragen beantwortet {N}, zu erreichen unter {P}.
| Hallo,\\n|\\n| Ein Gast meldet Regen in der {n}.
Viele Grüße\\n\\n-- \\n{f}\\nTelefon {P}\\nSitz: Altdorf, {r}
Best wishes\\n\\n-- \\n{N}\\n{f}\\nTel.: {P}\\n{E}
Laut Frau Dr. Notiz {r}\\n{S} genügt die {n}.
> Gruß\\n> {N}\\n\\nHallo,\\n\\ndie Garantie läuft ab {d}.
LG\\n{N}\\n\\nDruckt man diesen Brief, kostet das Papier.
Gruß\\n\\nNur für den Empfänger.
Grüße\\n{N}\\n\\nVom Tablet geschickt
Verschickt wurden 6120 Stück\\n{n} und 14\\nkg Papier. Notiz {r}
zum {d}. Am 6. {M} 2019 war die {n}.\\nBogen 3
Bogen 5\\nWenn die {n} da ist, hören Sie von uns.
Typ Ω-31, Händler {f}
Händler {f}, Ware {r}
Das Paket liegt bei {N} im Hof {A} für Sie. Notiz {r}
Die {n} und die {n} gehören {f}. Der Gast {N} fragt nach.
Bericht vom {d} über {n}, {n} und {n}
Nach der {n} rufen {N} und Frau {S} unter {P} an.
Frau {S} {v} den {n}, Herr {S} {v} die {n}.
Heute {v} Frau {S} die {n} und Herr Dr. {S} {v} den {n}.
Herr {S} {v} alles auf den {d}. Notiz {r}
Nach einem Gespräch mit Frau {S} {v} der Verein die {n}.
Nach einem Gespräch mit Herrn {S} {v} sich die {n} auf den {d}.
Mit {N} {v} die {n}, mit Frau {S} {v} der {n}.
Die {n} stört bei {w}, besonders mit {w} und nach {w}.
Der {n} kostet {m} einschließlich {w}, ohne {w} eine Summe von {m}.
Ein Preis von {m} oder von {m} samt {w} gilt am 14. {M} 2020.
Der Zug kam am 17. {M} um {h} Uhr mit {h} Wagen und {r} an.
Gemessen wurden am {d} in der {n} von {w} genau 417 Stück und bei der {n} 88 kg.
Beim {n} am {h}. {M} fehlten {h} Karten; siehe Blatt {h} und Tafel 12.
- {h} -
Bogen {h} von 12
{h}/14
Das Paket liegt bei {N} in der {A} zur Mitnahme.
Das Paket liegt bei {N} in der {A} zur Mit-\nnahme.
Post geht an {E} oder an {A}. Die {n} beginnt um acht.
Die {n} im Haus {A} wurde am {d} von {f} bezahlt.
Die {n} am {A} wird von {f} bezahlt. Notiz {r}
Quittung {q}, Vorgang {q}, Mappe {q}
Das Abonnement {q} endet am {d}, das Heft {q} schon heute.
Bitte nennen Sie die Quittungsnummer {q}. Porto kommt hinzu.
{w} {q}\n{f} · {n}
Zu erreichen unter {P}. Notiz {r}
Fragen an {N}, zu erreichen unter {P}.\nNotiz {r}
Rufen Sie {P} an oder schreiben Sie an {E}.
{L}\nFon {P}
Steuer-ID {J}
IdNr. {J}\nTel. {P}, {E}
IdNr. {J}
Akte {f}\\n- 417 -
{f}\\n- 83 -
Der Gast fand die Tür im {n}.\\n\\nDie {n} beginnt um acht.
Wir suchen einen neuen {n}.\\n\\nDen {n} zahlt der Verein.
Besonders laut ist es bei {w}.\\n\\nDie {n} kostet {m}.
Achten Sie auf {w} und {n}.\\n\\nHallo,
Vorsicht mit {n}.\\n\\nLiebe Gäste,
Mit Frau Dr. {S} {v} sich der {n} auf den {d}.
Nach einem Gespräch mit Hcrrn {S} {v} sich die {n} auf den {d}.
Nach einem Gespräch mit\\nHerm {S} {v} sich die {n}.
Objekt {A} – Mappe {r}\\n\\nHin- und Rückfahrt
Haus {A} – Mappe {q}    Bogen 3
{f} <{E}>; {f} <{E}>
Von: {f} <{E}>\\nAn: {N} <{B}>
Gruß\\n{N}\\n\\n{N} schrieb am {d}:\\n> Hallo,
Herzlich\\n{N}\\n\\n{N}\\n{f}\\n{A}, 00811 Neustadt
Viele Grüße\\n{N}\\n\\n{N}\\n{f}\\nFon {P}
{n} fehlt.\\n\\nLG\\n{N}\\n\\n{N}\\n{f}\\nTel.: {P}
Sehr geehrte Frau {S},\\n\\n> Die {n} fehlt.
Sehr geehrte Frau {S},\\n\\nIm {n} {v} der Verein die {n}.
Sehr geehrter Herr {S},\\n\\n| Der {n} {v} den {n}.
{n} fehlt. Notiz {r}.\\n\\nGruß\\n{N}\\n\\n-- \\n{f}\\n{A}\\nTelefon {P}
Am {d} 07:31, {N}:\\nGuten Abend,
{f}\\n{A}, 00417 Neustadt\\n\\nQuittung {q}
{f}\\n{A}, 00811 Neustadt\\nMobil: {P}\\n{E}
Das Paket liegt bei {N} in der {A} für Sie. Der Eintritt ist frei.
Die {n} im Haus {A} wurde am {d} von {f} bezahlt.
{f}\\nFon {P}\\n\\n-----Alter Brief-----
Fragen an {N}, zu erreichen unter {P}. Die {n} beginnt um acht.
Fragen an {N}, zu erreichen unter\\n{P}. Porto kommt hinzu.""".split("\n")


class _Values:
    """Values of each slot by rule; none comes twice but for the short lists."""

    def __init__(self, seed: int):
        self.rng = Random(seed)
        self.last = ("Petra", "Koch")

    def _digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def _syllables(self) -> str:
        r = self.rng
        word = "".join(r.choice(["b", "d", "f", "g", "kr", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w", "sch", "z"]) + r.choice(["a", "e", "i", "o", "u", "ä", "ei", "au"]) for _ in range(r.randint(2, 3)))
        return (word + r.choice(["", "n", "r", "k", "tz", "mann", "er", "ner", "hoff"])).capitalize()

    def surname(self) -> str:
        own = lambda: self.rng.choice(FAMILY) if self.rng.random() < 0.3 else self._syllables()
        return f"{own()}-{own()}" if self.rng.random() < 0.12 else own()

    def take(self, slot: str) -> str:
        r, d = self.rng, self._digits
        pick = r.choice
        given = pick(GIVEN) if r.random() < 0.6 else self._syllables()
        if slot in "NSC":
            self.last = (given, family := self.surname())
            return family if slot == "S" else f"{family}, {given}" if slot == "C" else f"{given[0]}. {family}" if r.random() < 0.2 else f"{given} {family}"
        plain = lambda s: s.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "á": "a", "ş": "s"}))
        if slot in "EB":
            # A mailbox bears the name of its owner; other addresses do not.
            owner = self.last if slot == "B" and r.random() < 0.93 else (given, self.surname())
            s, g = plain(owner[1].split("-")[0]), plain(owner[0])
            local = pick([f"{s}+kurs", f"{g}.{s}", f"{g[0]}.{s}", f"{g}_{s}{r.randint(1, 99)}", s, f"{s}-{g}"])
            at, dot = pick([("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", ".")])
            host = pick([f"{plain(self._syllables())}.test", f"mail.{plain(self._syllables())}.test", f"post-{plain(self._syllables())}.test", f"{plain(self._syllables())}.invalid"])
            mail = f"{local}{at}{host.replace('.', dot)}"
            return mail.upper() if r.random() < 0.08 else mail
        if slot == "f":
            brand, trade = self._syllables(), pick(TRADES)
            return pick([f"{trade} {brand}{pick(FORMS)}", f"{brand} {trade}{pick(FORMS)}", f"{brand} {trade}", f"{trade} {brand}", f"{brand} & {self._syllables()} {pick(['KG', 'OHG', 'GmbH'])}"])
        if slot == "A":
            end = pick(ENDINGS)
            at = lambda: pick(AT_STREET) if r.random() < 0.3 else f"{pick(AT)} {self._syllables()}"
            street = at() if r.random() < 0.4 else (self._syllables() if r.random() < 0.6 else pick(FIRST)) + (end if not end.startswith("-") or r.random() < 0.8 else f" {end[1:]}")
            n = str(r.randint(1, 190) if r.random() < 0.7 else r.randint(1, 9))
            return f"{street} {pick([n, n, f'{n}-{int(n) + r.randint(2, 60)}', n + pick('abcd'), n + ' ' + pick('abcd'), f'{n}-{int(n) + r.randint(2, 60)}'])}"
        if slot == "P":
            area, number = pick(["30", "40", "221", "69", "89", "711"]), d(7)
            mobile = pick(["151", "160", "171", "176", "157"])
            return pick([f"+49 {area} {number}", f"(0{area}) {number[:4]} {number[4:]}", f"0049{area}{number}", f"0{area}/{number}", f"0{area} / {number[:4]} {number[4:]}", f"+49 (0){area} {number[:4]} {number[4:]}", f"0{mobile}-{number}", f"0{area} {number}", f"+49{mobile}{number}", f"(0{mobile}) {number[:3]} {number[3:]}", f"0{mobile}/{number}", f"0{area}{number}", f"0{area}-{number}", f"0049 {area} {number}"])
        if slot == "I":
            four = lambda n: " ".join(d(4) for _ in range(n))
            return pick([f"DE{d(20)}", f"DE{d(2)} {four(4)} {d(2)}", f"AT{d(2)} {four(4)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}/{d(3)}/{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"L{d(1)}{pick('CFGHJK')}{d(1)}{pick('LMNPRT')}{pick('VWXYZ')}{d(2)}{pick('CFGH')}", f"T{d(8)}", f"{pick('CFGHJKLMN')}{d(2)}{pick('PRTVWX')}{d(5)}", f"{d(2)} {d(6)} {pick('ABDHMKSW')} {d(3)}", f"{d(8)}{pick('ABDHMKSW')}{d(3)}"])
        if slot == "J":
            return pick([d(11), "0" + d(10), f"{d(2)} {d(3)} {d(3)} {d(3)}"])
        if slot == "q":
            return pick([f"MV{d(8)}", f"BQ{r.randint(2012, 2026)}{d(4)}", f"LS{d(7)}", f"RG-{r.randint(2015, 2026)}-{d(5)}", f"MN {d(6)}"])
        if slot == "d":
            day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(2012, 2026)
            return pick([f"{day:02d}.{month:02d}.{year}", f"{day}. {pick(MONTHS)} {year}", f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year % 100:02d}", f"{day} March {year}"])
        if slot == "m":
            n = f"{r.randint(1, 999)}"
            return pick([f"{r.randint(1, 9)}.{n.zfill(3)},{d(2)} €", f"{n},{d(2)} EUR", f"€{n}.{d(2)}", f"{n},{d(2)} Euro"])
        if slot == "r":
            return pick([f"{pick(['RG', 'AB', 'LS', 'MV'])}-{r.randint(2015, 2026)}-{d(5)}", f"{pick(['RG', 'MN'])} {d(6)}", f"MV{d(8)}", f"{d(4)}/{d(2)}", f"{d(3)}.{d(3)}.{d(2)}", f"{d(2)}-{d(10)}", f"{d(4)}-0-{d(9)}", f"{d(2)}-{d(3)}-{d(2)}", f"{r.randint(2015, 2026)}-{d(3)}", f"HRA {d(5)}", f"VR {d(4)}", d(6)])
        if slot == "n":
            return pick(FIRST) + pick(SECOND)
        if slot in "vw":
            return pick(VERBS if slot == "v" else NOUNS)
        return pick(MONTHS) if slot == "M" else str(r.randint(1, 9))


def _worn(text: str, n: int) -> str:
    """text with every third longer word misread or divided at a line's end, so that the model doesn't lean on whole words."""
    count = iter(range(n, 10**6))

    def wear(m: re.Match) -> str:
        word, i = m.group(), next(count)
        if i % 3:
            return word
        at = 3 + i % 4
        return [word.replace("e", "c", 1), f"{word[:at]}-\n{word[at:]}", word.replace("i", "!", 1), f"{word[:at]}¬\n{word[at:]}"][i // 3 % 4]

    return re.sub(r"[^\W\d_]{6,}", wear, text)


def sentences(rounds: int = 5, seed: int = 1, patterns: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of the table: every pattern `rounds` times, each time filled anew, every other time worn; some patterns
    only, to hold others out."""
    values, out = _Values(seed), []
    for n in range(rounds):
        for pattern in patterns or PATTERNS:
            pattern = pattern.replace("\\n", "\n").replace("{L}", values.rng.choice(LABELLED))
            text, spans = "", []
            for piece in re.split(r"(\{\w\})", pattern):
                if re.fullmatch(r"\{\w\}", piece):
                    value = values.take(piece[1])
                    if piece[1] in KINDS:
                        spans.append((len(text), len(text) + len(value), KINDS[piece[1]]))
                    text += value
                else:
                    text += _worn(piece, n) if n % 2 else piece
            out.append((text, spans))
    return out
