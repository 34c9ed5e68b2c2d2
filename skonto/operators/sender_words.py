"""Words and patterns of business letters by which their senders are found.

Fixed values: legal forms, what streets and towns look like, words that never stand in a name, free mail providers, labels of
creditors, and what each kind of evidence weighs.
"""

from __future__ import annotations

LEGAL_FORM = (
    r"(?iU)(?<!\p{L})(?:gmbh|ag|kg|ohg|gbr|ug|mbh|e\. ?k\.?|e\. ?v\.?|ltd\.?|limited|inc\.?|llc|plc|se|kgaa|partg|mbb|sarl|sas|srl|s\.p\.a\.?|b\.v\.?|n\.v\.?|eg|gesellschaft|stiftung)(?!\p{L})"
)
#: Parts of words of what a firm does, without umlauts.
BUSINESS = (
    r"buerobedarf|werbetechnik|maschinenbau|logistik|steuerberat|rechtsanw|getraenke|baeckerei|metzgerei|gaertnerei|gartenbau|elektro|sanitaer|haustechnik|waescherei|"
    r"versicherung|makler|immobilien|hausverwaltung|stadtwerke|energie|telekom|verlag|druckerei|spedition|handel|service|dienstleistung|reinigung|hotelbedarf|inkasso|forderungsmanagement|kanzlei"
)
SLOGAN = r"(?iU)\b(?:partner|seit \d{4}|ihre?|qualität|zuverlässig|kompetent|willkommen|wir)\b"
STREET = (
    r"(?:\p{Lu}[\p{L}.\- ]{0,40}?(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|park|kante|kai|markt|hof|steig) ?\d{1,4}|\d{1,4} \p{Lu}[\p{L} ]{2,30}?(?:road|street|lane|avenue))"
)
TOWN = r"(?:\b(?:\p{Lu}{1,2}-)?\d{4,5} \p{Lu}\p{L}[\p{L}.\- /]*|\b\p{Lu}\d{2} ?[A-Z0-9]{4}\b)"
CONTACT = r"\b(?:tel(?:efon)?\b|fax\b|mobil\b|e-?mail\b|internet\b|web\b|www\.|phone\b)|@|https?://"
BANK = r"\b(?:iban|bic|swift|konto(?:nummer)?|blz|bankleitzahl|bankverbindung)\b"
REGISTER = r"\b(?:amtsgericht|handelsregister|hr[ab] \d|geschäftsführ\w*|vorstand|aufsichtsrat|inhaber|ust-?id\w*|umsatzsteuer\w*|steuer-?(?:nummer|nr)|finanzamt|sitz der|gerichtsstand|vat (?:no|id|number)|registered)"
OTHER = r"\b(?:seite|page|blatt) \d|\b\d{1,2}\. ?\d{1,2}\. ?\d{2,4}\b|\bpostfach\b"
#: How a line begins or ends that is a title, an address to somebody, or a label.
BEGINS = r"^(?:rechnung|\d\. ?mahnung|mahnung|letzte mahnung|zahlungserinnerung|gutschrift|inkassoschreiben|mahnbescheid|lieferschein|angebot|kontoauszug|invoice|reminder|credit note|statement|abrechnung|frau|herrn?|firma|sehr geehrte|zu händen|attn|dear|buchhaltung|pos\.)"
ENDS = r"\b(?:nummer|nr\.?|datum|betrag|summe|zeichen|referenz|kunde|vertrag|bearbeiter|aktenzeichen|forderung|fällig|zahlbar|bestellung|auftrag|preis)$"
CREDITOR = (
    r"(?<!\p{L})(?:auftraggeber|mandant(?:in)?|(?:ursprünglicher )?gläubiger(?:in)?|antragsteller(?:in)?|im auftrag (?:von|der|des)|forderungsinhaber(?:in)?|leistungserbringer|rechnungssteller|"
    r"wir vertreten(?: die interessen (?:von|der|des))?|namens und im auftrag (?:von|der|des)|empfänger|zahlung an|begünstigter|creditor|beneficiary|on behalf of|payee)(?!\p{L})"
)
CREDITOR_ENDS = r" [·|•] | {3,}|,|\.(?: |$)| (?:zur|zu|wegen|aus|bezüglich|für|und fordern|fordert) "

FREE_MAIL = (
    "gmail.com googlemail.com web.de gmx.de gmx.net gmx.at gmx.ch t-online.de outlook.com outlook.de hotmail.com hotmail.de live.de yahoo.com yahoo.de icloud.com me.com freenet.de "
    "aol.com online.de arcor.de 1und1.de protonmail.com mail.de posteo.de"
).split()

#: What makes a printed name plausible as the sender's.
PLAIN, WITH_FORM, SENDER_LINE, TOP, HEAD, FOOT, SLOGAN_LESS, REPEATED, MOST_REPEATED, DOMAIN, NEAR_BANK, AGAIN = 0.15, 0.3, 0.3, 0.2, 0.1, 0.1, 0.2, 0.15, 0.3, 0.25, 0.1, 0.05
#: What ties a letter to a party.
IBAN, VAT_ID, TAX_NUMBER, EMAIL, MAIL_DOMAIN, NAMED, NAMED_ELSEWHERE = 0.97, 0.97, 0.93, 0.9, 0.8, 0.5, 0.2
NAME_SHARE, PLAUSIBLE_SHARE = 0.55, 0.45
