"""Labels of business documents as they are written.

Fixed values: the words by which references, amounts and dates are labelled. Blanks, hyphens and dots don't count.
"""

from __future__ import annotations


def forms(stems: str, endings: str) -> tuple[str, ...]:
    """Every stem with every ending; words of one label are joined by ``_``."""
    return tuple(f"{a}{b}".replace("_", " ") for a in stems.split() for b in endings.split())


REFERENCES = {
    "processing_number": forms("bearbeitungs", "nummer nr zeichen") + forms("processing_", "no number"),
    "file_number": ("aktenzeichen", "geschäftszeichen", "az") + forms("akten geschäfts", "nummer nr") + forms("file_", "no number reference"),
    "case_number": forms("vorgangs fall ticket", "nummer nr") + ("ticket",) + forms("case_", "no number id"),
    "claim_number": forms("forderungs", "nummer nr referenz") + forms("claim_", "no number ref reference"),
    "customer_number": forms("kunden", "nummer nr konto kontonr id") + forms("kd", "nummer nr") + forms("customer_", "no number id account") + forms("client_", "no number id") + forms("account_", "no number"),
    "mandate_number": forms("mandats", "nummer nr referenz") + forms("mandate_", "no number reference"),
    "debtor_number": forms("debitoren", "nummer nr konto") + forms("schuldner", "nummer nr") + forms("debtor_", "no number"),
    "order_number": forms("bestell auftrags bestellung auftrag", "nummer nr") + ("bestellung", "auftrag", "purchase order") + forms("order_ purchase_order_ po_", "no number"),
    "contract_number": forms("vertrags", "nummer nr konto kontonr") + forms("vertrag miet mietvertrags mietvertrag pachtvertrag policen police versicherungs versicherungsschein abo abonnement schaden schadens", "nummer nr")
    + ("mietvertrag", "pachtvertrag") + forms("contract_", "no number id") + forms("agreement_", "no number"),
    "letter_number": forms("schreiben schreibens brief dokument dokumenten", "nummer nr") + ("unser zeichen", "unsere referenz") + forms("our_", "ref reference reference_no") + forms("letter_", "no number"),
    "payment_reference": ("zahlungsreferenz", "zahlungsreferenznummer", "payment reference"),
    "other": ("ihr zeichen", "ihre referenz", "referenz", "referenznummer", "reference") + forms("your_", "ref reference reference_no"),
}

INVOICE_NUMBER = forms("rechnungs rechnung re", "nummer nr") + ("rechnung no", "belegnummer", "gutschriftsnummer", "rechnung vom", "zu rechnung", "invoice", "rechnung") + forms("invoice_", "no number")
#: Labels of what is no reference end a value all the same.
ENDS = {"": INVOICE_NUMBER + ("rechnungsdatum", "belegdatum", "datum", "seite", "fällig", "fälligkeit", "zahlbar", "betrag", "summe")}
