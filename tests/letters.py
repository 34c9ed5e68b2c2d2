"""Invented business letters whose sender, supplier and references are known."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Firm:
    id: int
    name: str
    street: str
    town: str
    domain: str
    printed: tuple[str, ...] = ()
    agency_of: int | None = None
    iban: str = ""
    vat: str = ""
    short: str = ""  # how somebody may have typed it


def iban(bank: int, account: int) -> str:
    body = f"{bank:08d}{account:010d}"
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def firm(k: int, line: str, agency_of: int | None = None) -> Firm:
    name, street, town, domain, short, *printed = line.split("; ")
    return Firm(k, name, street, town, domain, tuple(printed), agency_of, iban(10_000_000 + 7919 * k, 123_456 + 31 * k), f"DE{100_000_000 + 7_654_321 * k}", short)


KNOWN = [
    firm(k, line)
    for k, line in enumerate(
        """Krüger Bürobedarf GmbH; Lindenstraße 8; 10117 Berlin; krueger-buero.de; Krüger Büro; Krueger Buerobedarf GmbH; Krüger Bürobedarf
Talheimer Maschinenbau GmbH & Co. KG; Werkstraße 21; 70190 Stuttgart; talheimer-maschinen.de; Talheimer Maschinenbau; Talheimer Maschinenbau; TALHEIMER MASCHINENBAU GmbH & Co.KG
Stadtwerke Altenau AG; Energieplatz 1; 38707 Altenau; stadtwerke-altenau.de; Stadtwerke Altenau; Stadtwerke Altenau
Immobilien Fuchs e.K.; Marktplatz 5; 79100 Freiburg; immobilien-fuchs.de; Fuchs Immobilien; Immobilien Fuchs
Bäckerei Sommer e.K.; Mühlenweg 3; 20099 Hamburg; baeckerei-sommer.de; Sommer Bäckerei; Baeckerei Sommer e.K.; Bäckerei Sommer
Südwind Logistik AG; Hafenstraße 77; 28199 Bremen; suedwind-logistik.de; Südwind; Südwind Logistik
Delta Werbetechnik UG; Gewerbepark 9; 50668 Köln; delta-werbetechnik.de; Delta Werbetechnik; Delta Werbetechnik
Telenetz Business Services GmbH; Netzallee 4; 60313 Frankfurt; telenetz-business.de; Telenetz Business; Telenetz Business Services
Dr. Lang Steuerberatungsgesellschaft mbH; Kanzleiweg 2; 80333 München; lang-steuer.de; Lang Steuerberatung; Dr. Lang Steuerberatung mbH
Berger & Töchter Getränkehandel OHG; Brauereiweg 6; 93049 Regensburg; berger-getraenke.de; Berger Getränke; Berger und Töchter Getränkehandel OHG
Harbour Supplies Ltd; 14 Quay Road; D02 X285; harbour-supplies.ie; Harbour Supplies; Harbour Supplies Limited
Gartenbau Winter GmbH; Parkallee 13; 01069 Dresden; gartenbau-winter.de; Winter Gartenbau; Gartenbau Winter""".splitlines()
    )
]
AGENCIES = [
    firm(
        20 + k, line, of
    )
    for k, (line, of) in enumerate(
        (
            ("Forderungskontor Inkasso Nordwest GmbH; Inkassoweg 1; 76135 Karlsruhe; inkasso-nordwest.de; Forderungskontor Inkasso; Forderungskontor Inkasso Nordwest GmbH", 1),
            ("Rechtsanwälte Adler & Partner mbB; Kaiserallee 40; 68165 Mannheim; adler-partner.de; Adler Rechtsanwälte; Adler & Partner Rechtsanwälte mbB", 5),
            ("Rhein-Forderungsmanagement AG; Königsallee 9; 40215 Düsseldorf; rhein-fm.de; Rhein Forderungsmanagement; Rhein Forderungsmanagement AG", 0),
        )
    )
]
STRANGERS = [
    firm(40 + k, line)
    for k, line in enumerate(
        """Vogel Elektrotechnik GmbH; Stromweg 3; 04107 Leipzig; vogel-elektro.de; -; Vogel Elektrotechnik GmbH
Fischhandel Ostsee GmbH & Co. KG; Kaikante 2; 27474 Cuxhaven; fischhandel-ostsee.de; -; Fischhandel Ostsee GmbH & Co.KG
Haustechnik Maurer; Wasserstraße 14; 34119 Kassel; haustechnik-maurer.de; -; Haustechnik Maurer
Wäscherei Blütenweiß GmbH; Sauberweg 6; 30161 Hannover; bluetenweiss.de; -; Waescherei Bluetenweiss GmbH
Sonnenhof Versicherungsmakler AG; Policenring 11; 90403 Nürnberg; sonnenhof-vm.de; -; Sonnenhof Versicherungsmakler AG""".splitlines()
    )
]
OWN = ("Bergblick Hotels GmbH", "Hotel Bergblick", "Hotel Talfried", "Strandhotel Kranich")
OWN_ADDRESS = ("Bergstraße 1", "87629 Füssen-Hopfen")
# Letters that poor scans confuse, and how references are labelled.
SWAPS = {"ü": "u", "ö": "o", "ä": "a", "l": "1", "o": "0", "m": "rn", "ß": "B", "e": "c", "i": "l", "n": "r"}
LABELS = {
    "customer_number": ("Kundennummer", "Kunden-Nr.", "Ihre Kundennummer", "Kd.-Nr.", "Kundennr."),
    "contract_number": ("Vertragsnummer", "Vertrags-Nr.", "Vertragskonto", "Mietvertrag Nr."),
    "letter_number": ("Schreibennummer", "Schreiben-Nr.", "Unser Zeichen"),
    "order_number": ("Bestellnummer", "Ihre Bestellung Nr.", "Auftragsnummer"),
}


@dataclass
class Letter:
    text: str
    kind: str
    author: Firm
    supplier: Firm
    printed: str
    refs: dict[str, str] = field(default_factory=dict)


def head(rng: random.Random, f: Firm, printed: str, style: int) -> list[str]:
    to = [*rng.choice(([OWN[0], rng.choice(OWN[1:])], [rng.choice(OWN[1:])], [OWN[0], "Buchhaltung"])), *OWN_ADDRESS]
    phone, mail = f"Tel. 0{rng.randint(30, 899)} {rng.randint(100_000, 999_999)}", f"info@{f.domain}"
    return {
        0: [printed, f"{f.street}, {f.town}", f"{phone} · {mail}", "", *to, ""],
        1: [f"Internet: www.{f.domain}   E-Mail: {mail}", phone, "", f"{printed} · {f.street} · {f.town}", *to, ""],
        2: [*to, "", printed, f.street, f.town, f"{phone} · {mail}", ""],
        3: [*to, ""],
        4: [printed.upper(), "Ihr zuverlässiger Partner seit 1985", f"{f.street}, {f.town}", "", *to, ""],
        5: [f"{printed}                         Seite 1 von 2", f"{f.street}  ·  {f.town}", "", *to, ""],
    }[style]


def foot(rng: random.Random, f: Firm, printed: str, style: int) -> list[str]:
    number = " ".join(f.iban[k : k + 4] for k in range(0, len(f.iban), 4))
    bank = rng.choice(("Sparkasse", "Volksbank", "Handelsbank"))
    return {
        0: ["", f"{printed} | Geschäftsführer: Max Muster | Amtsgericht {f.town.split()[-1]} HRB {rng.randint(1000, 99_999)}", f"USt-IdNr.: {f.vat}", f"Bankverbindung: {bank} · IBAN {number}"],
        1: ["", f"Bankverbindung: {bank}", f"IBAN: {number}", f"USt-IdNr. {f.vat}"],
        2: ["", f"{printed}  www.{f.domain}", f"IBAN {number}"],
    }[style]


def references(rng: random.Random, refs: dict[str, str], layout: int) -> list[str]:
    told = [(rng.choice(LABELS[k]), v) for k, v in refs.items()]
    if layout == 0:
        return [f"{label}: {v}" for label, v in told]
    if layout == 1:
        return [x for label, v in told for x in (f"{label}:", v)]
    if layout == 2:
        return ["   ".join(label for label, _ in told), "   ".join(v for _, v in told)]
    return ["      ".join(f"{label}: {v}" for label, v in told[k : k + 2]) for k in range(0, len(told), 2)]


def invoice(rng: random.Random, f: Firm) -> Letter:
    printed = rng.choice((f.name, f.name, *f.printed))
    refs = {"customer_number": rng.choice((f"{rng.randint(10_000, 99_999)}", f"KD-{rng.randint(1000, 99_999)}"))}
    if rng.random() < 0.4:
        refs["contract_number"] = rng.choice((f"V-{rng.randint(100_000, 999_999)}", f"{rng.randint(1_000_000, 9_999_999)}", f"VT/{rng.randint(10, 99)}/{rng.randint(100, 999)}"))
    if rng.random() < 0.3:
        refs["order_number"] = f"B-{rng.randint(10_000, 99_999)}"
    style, net = rng.choice((0, 0, 1, 1, 2, 3, 4, 5)), rng.randint(50, 5000)
    lines = head(rng, f, printed, style) + ["Rechnung", "", f"Rechnungsnummer: RE-{rng.randint(2023, 2025)}-{rng.randint(100, 9999)}", "Rechnungsdatum: 12.03.2025"]
    lines += references(rng, refs, rng.choice((0, 0, 1, 2, 3)))
    lines += ["", "Pos.  Beschreibung            Menge   Preis", f"1     Leistung nach Vereinbarung  1   {net},00 €", "", f"Nettobetrag:   {net},00 €", "", "Zahlbar innerhalb von 14 Tagen ohne Abzug."]
    return Letter("\n".join(lines + foot(rng, f, printed, rng.choice((0, 0, 1, 2)) if style != 3 else rng.choice((0, 2)))), "invoice", f, f, printed, refs)


def dunning(rng: random.Random, f: Firm) -> Letter:
    printed = rng.choice((f.name, *f.printed))
    refs = {"customer_number": f"{rng.randint(10_000, 99_999)}", "letter_number": f"M-{rng.randint(10_000, 99_999)}"}
    lines = head(rng, f, printed, rng.choice((0, 1, 2, 4, 5))) + [rng.choice(("Zahlungserinnerung", "1. Mahnung", "Letzte Mahnung")), "Datum: 01.06.2025", ""]
    lines += references(rng, refs, rng.choice((0, 0, 1, 3))) + ["", "zu unserer Rechnung RE-2025-77 vom 17.04.2025", "Hauptforderung: 815,00 €", "Mahngebühr: 5,00 €", "", "Bitte zahlen Sie bis zum 11.06.2025."]
    return Letter("\n".join(lines + foot(rng, f, printed, rng.choice((0, 1, 2)))), "first_dunning", f, f, printed, refs)


def collection(rng: random.Random, agency: Firm, creditor: Firm) -> Letter:
    printed = rng.choice((agency.name, *agency.printed))
    refs = {"file_number": rng.choice((f"INK-{rng.randint(2023, 2025)}-{rng.randint(10_000, 99_999)}", f"{rng.randint(100, 999)}/{rng.randint(23, 25)}", f"AZ {rng.randint(10, 99)}-{rng.randint(1000, 9999)}")), "claim_number": f"F{rng.randint(100_000, 999_999)}", "customer_number": f"{rng.randint(10_000, 99_999)}"}
    lines = head(rng, agency, printed, rng.choice((0, 1, 2, 4))) + ["Inkassoschreiben", "Datum: 01.07.2025", "", f"Aktenzeichen: {refs['file_number']}", f"Forderungsnummer: {refs['claim_number']}"]
    lines += [f"{rng.choice(('Mandant', 'Gläubiger', 'im Auftrag von', 'Auftraggeber'))}: {creditor.name}", f"Kundennummer beim Gläubiger: {refs['customer_number']}", "", f"wir vertreten die Interessen von {creditor.name}. Offen ist die Rechnung RE-2024-12."]
    lines += ["Hauptforderung: 1.815,00 €", "Inkassokosten: 49,00 €", "", "Zahlen Sie bis zum 08.07.2025."]
    return Letter("\n".join(lines + foot(rng, agency, printed, rng.choice((0, 1, 2)))), "collection_letter", agency, creditor, printed, refs)


def noisy(rng: random.Random, text: str, name: str, rate: float) -> str:
    """The lines that show the sender's name as a poor scan reads them."""
    out = []
    for line in text.split("\n"):
        if name.lower()[:8] in line.lower():
            line = "".join((SWAPS[c.lower()].upper() if c.isupper() else SWAPS[c.lower()]) if c.lower() in SWAPS and rng.random() < rate else c for c in line)
        out.append(line)
    return "\n".join(out)


def letters(noise: float = 0.0, seed: int = 5) -> list[Letter]:
    """72 letters: known suppliers, strangers, agencies."""
    rng, damage = random.Random(seed), random.Random(seed + 1)
    out = [make(rng, f) for f in KNOWN for make in (invoice, invoice, invoice, dunning)] + [make(rng, f) for f in STRANGERS for make in (invoice, invoice, dunning)]
    out += [collection(rng, a, KNOWN[a.agency_of]) for a in AGENCIES for _ in range(3)]
    for letter in out if noise else ():
        letter.text = noisy(damage, letter.text, letter.printed, noise)
    return out
