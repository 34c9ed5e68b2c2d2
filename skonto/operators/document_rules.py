"""Patterns by which business documents are recognised.

Fixed values: kinds of documents with weighted patterns, labels of references, amounts and dates.
"""

from __future__ import annotations

CLASSES = {
    "invoice": (
        (r"^\s*(?:tax\s+)?(?:rechnu\s?ng|invoice|facture|fattura|factura|factuur|faktura|beleg|honorarnote|honorarrechnung|abrechnung|kundenrechnung|sammelrechnung|schlussrechnung|teilrechnung|abschlagsrechnung|handwerkerrechnung|proforma(?:\s*-?\s*rechnung)?|rechnungskopie|rechnungsduplikat)\b(?!.*\d[.,]\d{2}\b)(?:\s*(?:nr\.?|nummer|no\.?|n°|#|vom|du|del|dated)\b.*|\s*[-–:(/].*)?\s*$", 6),
        (r"\brechnungs(?:nummer|datum|betrag|nr|summe)\b", 3),
        (r"\bbeleg\s?-?\s?(?:nr|nummer|datum|no)\b", 3),
        (r"\b(?:faktura|abrechnungs|honorar)\s?-?\s?(?:nr|nummer|datum)\b", 3),
        (r"\binvoice\s*(?:no\b|number|date|#|total)", 3),
        (r"\b(?:invoice|rechnung|facture|fattura|factura|factuur|faktura)\b", 1.5),
        (r"\bfacture\s*(?:n[°ºo]|no|nr|num)|\bdate\s+de\s+facture|\bmontant\s+(?:ht|ttc)\b|\btotal\s+(?:ht|ttc)\b|\bnet\s+à\s+payer\b", 3),
        (r"\bfattura\s*(?:n|nr|num)|\bdata\s+fattura|\bimponibile\b|\btotale\s+(?:documento|fattura)\b", 3),
        (r"\bfactura\s*(?:n|nº|núm|num)|\bbase\s+imponible\b|\btotal\s+factura\b|\bfecha\s+de\s+factura\b", 3),
        (r"\bfactuur(?:nummer|datum)\b|\bsubtotaal\b|\bbtw\b", 3),
        (r"\b(?:tax\s+invoice|pro\s?-?\s?forma)\b", 3),
        (r"\bzahlbar\s+(?:bis|innerhalb|binnen|sofort|netto)\b", 1),
        (r"\b(?:due date|payment due|amount due|amount payable|balance due|grand total|subtotal)\b", 1),
        (r"\b(?:mwst|ust|vat|tva|iva)\b|\b(?:umsatzsteuer|mehrwertsteuer)\b", 0.8),
        (r"\bnetto\b|\bnettobetrag\b|\bnet amount\b", 1.2),
        (r"\bbrutto\b|\bbruttobetrag\b", 1.2),
        (r"\b(?:zwischensumme|gesamtbetrag|endsumme|zahlungsziel|zahlungsbedingungen)\b", 0.8),
        (r"\bleistungsdatum\b|\blieferdatum\b|\bleistungszeitraum\b", 1),
        (r"\bbankverbindung\b|\bUSt-?Id", 0.5),
        (r"\bzzgl\.?\s*\d{1,2}(?:[.,]\d+)?\s*%", 1),
        (r"^\s*(?:angebot|kostenvoranschlag|auftragsbestätigung|bestellung|offerte|quotation|quote|estimate|devis|preventivo|presupuesto|proposal)\b", -8),
    ),
    "credit_note": ((r"^\s*gutschrift\b", 7), (r"\bgutschrifts(?:nummer|betrag)\b", 4), (r"\bcredit note\b", 6), (r"\bstornorechnung\b", 4), (r"\bgutgeschrieben\b", 1.5)),
    "payment_reminder": (
        (r"\bzahlungserinnerung\b", 8),
        (r"\bpayment reminder\b|\bfriendly reminder\b", 8),
        (r"\bfreundliche[nr]?\s+erinnerung\b", 5),
        (r"\berinnerung\b", 2),
        (r"\bversehentlich\b|\bübersehen\b", 2),
        (r"\bmahnung\b", 1),
    ),
    "first_dunning": (
        (r"^\s*(?:1\.?|erste)\s*mahnung\b", 10),
        (r"(?<!gebühr )(?<!gebühren )(?<!kosten )\b(?:1\.?|erste)\s*mahnung\b", 3),
        (r"\bfirst\s+(?:dunning|reminder|notice)\b", 8),
        (r"\bmahnung\b", 3),
        (r"\bmahngebühr", 1.5),
    ),
    "second_dunning": (
        (r"^\s*(?:2\.?|zweite)\s*mahnung\b", 10),
        (r"(?<!gebühr )(?<!gebühren )(?<!kosten )\b(?:2\.?|zweite)\s*mahnung\b", 3),
        (r"\bsecond\s+(?:dunning|reminder|notice)\b", 8),
    ),
    "final_dunning": (
        (r"^\s*(?:3\.?|dritte)\s*mahnung\b", 10),
        (r"^\s*letzte\s+mahnung\b", 10),
        (r"(?<!gebühr )(?<!gebühren )(?<!kosten )\b(?:3\.?|dritte)\s*mahnung\b", 3),
        (r"\bletzte\s+mahnung\b", 4),
        (r"\bletzte[rn]?\s+aufforderung\b", 6),
        (r"\bfinal\s+(?:notice|demand|reminder|dunning)\b", 8),
        (r"\bletztmalig\b|\bletzte\s+frist\b", 3),
    ),
    "collection_letter": (
        (r"\binkassoschreiben\b", 9),
        (r"\binkasso\b", 3),
        (r"\bforderungsaufstellung\b", 5),
        (r"\binkassokosten\b|\binkassogebühr", 5),
        (r"\bzum\s+einzug\s+übergeben\b|\babgetreten\b|\bforderungsübergang\b", 4),
        (r"\bdebt\s+collection\b|\bcollection\s+agency\b", 7),
        (r"\brechtsanwaltsvergütung\b|\brvg\b", 3),
        (r"\bmandant", 1.5),
        (r"\bwir\s+vertreten\b", 4),
    ),
    "court_order": (
        (r"^\s*mahnbescheid\b", 10),
        (r"\bmahnbescheid\b", 5),
        (r"\bvollstreckungsbescheid\b", 8),
        (r"\bmahngericht\b|\bamtsgericht\b", 3),
        (r"\bwiderspruch\s+einlegen\b", 4),
        (r"\bgerichtskosten\b", 2),
        (r"\bpayment order\b|\bcourt order\b", 6),
    ),
    "bank_statement": (
        (r"\bzahlungsbestätigung\b|\bzahlungsbeleg\b|\büberweisungsbeleg\b|\bbuchungsbestätigung\b", 7),
        (r"\bkontoauszug\b", 7),
        (r"\bbank statement\b|\bpayment confirmation\b|\bremittance advice\b", 7),
        (r"\büberweisung\s+wurde\s+ausgeführt\b", 4),
        (r"\bausführungsdatum\b|\bbuchungsdatum\b", 2),
        (r"\bverwendungszweck\b", 2),
        (r"\bempfänger\b|\bbeneficiary\b", 1),
    ),
    "delivery_note": (
        (r"^\s*lieferschein\b", 8),
        (r"\blieferscheinnummer\b", 6),
        (r"\bdelivery note\b|\bpacking slip\b", 8),
        (r"\bwarenempfang\b|\bware\s+wurde\b", 2),
    ),
}
TITLE_LINES, TITLE_BONUS = 16, 1.5

REFERENCES = {
    "processing_number": r"bearbeitungs\s?-?\s?(?:nummer|nr\.?|zeichen)|processing\s+(?:no\.?|number)",
    "file_number": r"aktenzeichen|akten\s?-?\s?(?:nummer|nr\.?)|geschäftszeichen|geschäfts\s?-?\s?(?:nummer|nr\.?)|\baz\.?(?=\s*[:\s])|file\s+(?:no\.?|number|reference)",
    "case_number": r"vorgangs\s?-?\s?(?:nummer|nr\.?)|fallnummer|fall\s?-?\s?nr\.?|ticket\s?(?:nummer|nr\.?)?|case\s+(?:no\.?|number|id)",
    "claim_number": r"forderungs\s?-?\s?(?:nummer|nr\.?|referenz)|claim\s+(?:no\.?|number|ref(?:erence)?)",
    "customer_number": r"kunden\s?-?\s?(?:nummer|nr\.?|konto(?:\s?-?\s?nr\.?)?|id)|kd\.?\s?-?\s?(?:nummer|nr\.?)|kundenkonto|customer\s+(?:no\.?|number|id|account)|client\s+(?:no\.?|number|id)|account\s+(?:no\.?|number)",
    "mandate_number": r"mandats\s?-?\s?(?:nummer|nr\.?|referenz)|mandate\s+(?:no\.?|number|reference)",
    "debtor_number": r"debitoren\s?-?\s?(?:nummer|nr\.?|konto)|schuldner\s?-?\s?(?:nummer|nr\.?)|debtor\s+(?:no\.?|number)",
    "order_number": r"bestell\s?-?\s?(?:nummer|nr\.?)|bestellung\s*(?:nummer|nr\.?)?|auftrags\s?-?\s?(?:nummer|nr\.?)|auftrag\s*(?:nummer|nr\.?)|order\s+(?:no\.?|number)|purchase\s+order(?:\s+(?:no\.?|number))?|p\.?o\.?\s+(?:no\.?|number)",
    "contract_number": r"vertrags\s?-?\s?(?:nummer|nr\.?|konto(?:\s?-?\s?nr\.?)?)|vertrag\s*(?:nummer|nr\.?)|vertragskonto|miet(?:vertrags)?\s?-?\s?(?:nummer|nr\.?)|mietvertrag\s*(?:nummer|nr\.?)?|pacht\s?-?\s?vertrag\s*(?:nummer|nr\.?)?|polic(?:en|e)\s?-?\s?(?:nummer|nr\.?)|versicherungs\s?-?\s?(?:schein\s?-?\s?)?(?:nummer|nr\.?)|abo(?:nnement)?\s?-?\s?(?:nummer|nr\.?)|contract\s+(?:no\.?|number|id)|agreement\s+(?:no\.?|number)|schadens?\s?-?\s?(?:nummer|nr\.?)",
    "letter_number": r"schreibens?\s?-?\s?(?:nummer|nr\.?)|brief\s?-?\s?(?:nummer|nr\.?)|dokument(?:en)?\s?-?\s?(?:nummer|nr\.?)|unser\s+zeichen|unsere\s+referenz|our\s+(?:ref(?:erence)?|reference\s+no\.?)|letter\s+(?:no\.?|number)",
    "payment_reference": r"zahlungs\s?-?\s?referenz(?:nummer)?|payment\s+reference",
    "other": r"ihr\s+zeichen|ihre\s+referenz|your\s+(?:ref(?:erence)?|reference\s+no\.?)|referenz(?:nummer)?|reference",
}
INVOICE_NUMBER = r"rechnungs\s?-?\s?(?:nummer|nr\.?)|rechnung\s+(?:nr\.?|nummer|no\.?)|re\.?\s?-?\s?nr\.?|invoice\s+(?:no\.?|number|#)|belegnummer|gutschriftsnummer"

AMOUNTS = {
    "gross": r"rechnungsbetrag|gutschriftsbetrag|bruttobetrag|gesamtbetrag|endbetrag|zahlbetrag|total\s+amount\s+due|amount\s+due|gesamtsumme|summe\s+brutto|gesamt|total",
    "net": r"nettobetrag|nettosumme|summe\s+netto|zwischensumme|net\s+amount|subtotal",
    "vat": r"(?:zzgl\.?|inkl\.?)?\s*\d{1,2}(?:[.,]\d+)?\s*%\s*(?:mwst\.?|ust\.?|mehrwertsteuer|umsatzsteuer|vat)|mwst\.?|mehrwertsteuer|umsatzsteuer|vat(?:\s*\d{1,2}\s*%)?",
    "principal": r"offene[rn]?\s+hauptforderung|hauptforderung|ursprüngliche\s+forderung|offene\s+forderung|forderungsbetrag|offener\s+betrag|rechnungsbetrag|outstanding\s+amount|open\s+amount|principal|capital",
    "fees": r"mahngebühr(?:en)?|mahnkosten|mahnspesen|bearbeitungsgebühr|reminder\s+fee|dunning\s+fee",
    "interest": r"verzugszinsen|zinsforderung|zinsen|interest",
    "flat_fee": r"verzugspauschale|pauschalbetrag|pauschale|flat\s+fee",
    "collection_costs": r"inkassokosten|inkassogebühr(?:en)?|rechtsanwaltskosten|rechtsanwaltsvergütung|anwaltskosten|auslagenpauschale|collection\s+costs?",
    "court_costs": r"gerichtskosten|gerichtsgebühr(?:en)?",
    "remaining": r"noch\s+zu\s+zahlen|restforderung|restbetrag|offener\s+gesamtbetrag|verbleibend(?:er\s+betrag)?|zu\s+zahlender\s+betrag|remaining\s+balance",
    "already_paid": r"abzüglich\s+zahlung(?:en)?(?:\s+vom\s+[\d.]+)?|bereits\s+gezahlt|bereits\s+geleistete\s+zahlung(?:en)?|zahlungseingang|bereits\s+beglichen|zahlung(?:en)?\s+erhalten|payment\s+received|already\s+paid",
    "total_claimed": r"gesamtforderung|forderung\s+gesamt|summe\s+der\s+forderung|gesamtbetrag|gesamtsumme|zahlbetrag|insgesamt|total\s+(?:claim|due|amount)|gesamt|total",
    "payment_amount": r"überweisungsbetrag|zahlungsbetrag|betrag|amount|zahlbetrag",
}
DATES = {
    "document": r"rechnungsdatum|briefdatum|ausstellungsdatum|belegdatum|invoice\s+date|mahndatum|gutschriftsdatum|^[ \t]*date(?=[ \t]*:)|^[ \t]*datum(?=[ \t]*:)",
    "payment": r"ausführungsdatum|buchungsdatum|zahlungsdatum|wertstellung|valuta|booking\s+date|payment\s+date",
    "due": r"zahlbar\s+bis|fällig(?:keit(?:sdatum)?)?(?:\s+am)?|zahlungsziel|due\s+date|payment\s+due|pay\s+by|zahlen\s+sie\s+(?:bitte\s+)?(?:den\s+betrag\s+)?bis(?:\s+(?:spätestens|zum))?|bis\s+spätestens|zahlungsfrist|frist(?:\s+bis)?|zahlbar\s+(?:bis\s+)?zum|spätestens\s+bis|deadline",
}
AMOUNT = r"-?(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d{1,3}(?: \d{3})+,\d{2}|\d{1,3}(?:['’]\d{3})+\.\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d+,\d{2}|\d+\.\d{2})"
DATE = r"\d{1,2}\s?[./-]\s?\d{1,2}\s?[./-]\s?(?:\d{4}|\d{2})|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?\p{L}{3,10}\.?,?\s+(?:de\s+)?\d{4}|\p{L}{3,10}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"
