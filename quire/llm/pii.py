"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Each kind is found in one pass over the text whatever the text looks like: an
e-mail address starts at its "@" and grows to the left, and a run of digits is
tried from its first digit only, so a long run of letters or digits cannot cost
the square of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quire.llm._batches import map_chunks, texts

#: The base kinds, in the order in which they are listed; then what the scan adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
#: Score of a span before its context is read: what its own form or checksum proves.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Words that raise the score of a kind, and words that lower it, when they stand within NEAR characters.
RAISE = {  # in English, German, French and Spanish
    "email": ("mail", "contact", "write", "address", "adresse", "schreiben", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "serveur", "servidor"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "handy", "appeler", "portable", "llamar", "móvil"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "virement", "cuenta", "banco"),
}
LOWER = ("version", "example", "sample", "test", "isbn", "serial", "order", "beispiel", "bestellung", "exemple", "commande", "ejemplo", "pedido")
NEAR, STEP = 40, 0.1

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OPENS = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: Lengths of account codes in the public registry, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether a run of ASCII digits has a right Luhn check digit."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account code, without spaces, has right ISO 7064 mod 97-10 check digits."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account codes, as long as their country's are; what follows one, set apart by a blank, is not part of it."""
    for m in _OPENS.finditer(text):
        n = IBAN_LENGTHS.get(m[1])
        if n is None:
            continue
        end, code = m.start(), []
        while len(code) < n and end < len(text):
            c = text[end]
            if c == " " and text[end + 1 : end + 2] != " ":
                pass
            elif "0" <= c <= "9" or "A" <= c <= "Z":
                code.append(c)
            else:
                break
            end += 1
        after = text[end : end + 1]
        if len(code) == n and not (after.isascii() and after.isalnum()) and mod97("".join(code)):
            yield m.start(), end


def find(text: str) -> list[tuple[str, int, int]]:
    """The confirmed spans of a text, by start, then by kind as listed."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    for start, end in _accounts(text):
        out.append((start, 4, end))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def score(text: str, kind: str, start: int, end: int) -> float:
    """0 to 1: the kind's prior, a step up or down for each telling word nearby."""
    near = set(_WORD.findall(text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()))
    up, down = sum(w in near for w in RAISE[kind]), sum(w in near for w in LOWER)
    return min(1.0, max(0.0, PRIOR[kind] + STEP * (up - down)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points, score) of each whole text; no shuffle.

    Spans are ordered by start, then by kind as listed; those of different kinds
    may overlap.  The score tells how sure a span is and removes none.  A null or
    empty text has none; rows that repeat are each reported; an empty table gives
    an empty result.
    """

    def make():
        def step(ids, blobs):
            out = []
            for b in blobs:
                text = b.decode("utf-8", "replace")
                out.append([dict(kind=k, start=s, end=e, score=score(text, k, s, e)) for k, s, e in find(text)])
            return {"doc_id": ids, "spans": out}

        return step

    return map_chunks(texts(docs, id_col, text_col), "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>", make)
