"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_text, fields, map_documents

#: The kinds in the order of ties, and the characters of an address's local part.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: What a kind scores by itself, and words that speak for it or against it.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
FOR = {
    "email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "server", "host", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax"), "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social", "security", "tax"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "serial", "part no")
NEAR, UP, DOWN, LEAST = 40, 0.2, 0.2, 0.5
WHOLE = {k: re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])") for k, words in (*FOR.items(), ("against", AGAINST))}
FIELDS = fields("spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses without overlap, in time linear in the text: from each @ outward."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = [(a, "email", b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, moved by whole words of its context that begin and end within NEAR."""
    low = max(0, start - NEAR - 1)
    before, after = text[low:start].lower(), text[end : end + NEAR + 1].lower()

    def near(name: str) -> bool:
        # the first character tells whether the next begins a word, the last whether the one before ends one
        return bool(WHOLE[name].search(before, min(1, low))) or any(m.end() <= NEAR for m in WHOLE[name].finditer(after))

    return round(min(1.0, max(0.0, SCORE[kind] + UP * near(kind) - DOWN * near("against"))), 3)


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans as (kind, start, end, score, base), by start, then kind as listed.

    Spans of the base kinds always stay; the added kinds (account numbers by mod-97, social
    security numbers) need a score of LEAST, which their context can give or take away.
    """
    found = [(a, kind, b, score(text, kind, a, b), True) for a, kind, b in base_spans(text)]
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")) and (s := score(text, "iban", *m.span())) >= LEAST:
            found.append((m.start(), "iban", m.end(), s, False))
    for m in SSN.finditer(text):
        a, b, c = m[0].split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" and (s := score(text, "ssn", *m.span())) >= LEAST:
            found.append((m.start(), "ssn", m.end(), s, False))
    found.sort(key=lambda f: (f[0], KINDS.index(f[1])))
    return [(kind, a, b, s, base) for a, kind, b, s, base in found]


def mask(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each stretch of personal data as the name of its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, *, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Adds spans: array of (kind, start, end, score, base), code points with the end left out.

    Null and empty texts have no spans (an empty array).  Texts are searched whole, in time linear
    in their length.  Spans that begin together come in the order of KINDS; spans of different kinds
    may overlap.  Repeated rows give repeated results; no rows give none.  Input columns other than
    those of ``keep`` are dropped, and one of those named spans gives way.
    """

    def make():
        def kernel(texts: pa.Array) -> dict:
            names = ("kind", "start", "end", "score", "base")
            return {"spans": [[dict(zip(names, s)) for s in find(t)] for t in as_text(texts)]}

        return kernel

    return map_documents(docs, make, FIELDS, text_col=text_col, keep=keep)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with personal data in ``text_col`` masked.

    Null stays null and empty empty; overlapping spans are masked as one, by the name of the first.
    Otherwise as ``scan``; no column gives way.
    """
    columns = docs.columns

    def make():
        def kernel(texts: pa.Array) -> dict:
            return {"__masked": [t if t is None else mask(t, find(t)) for t in texts.to_pylist()]}

        return kernel

    made = map_documents(docs, make, fields("__masked string"), text_col=text_col, keep=columns)
    return made.withColumn(text_col, made["__masked"]).select(*[f"`{c}`" for c in columns])
