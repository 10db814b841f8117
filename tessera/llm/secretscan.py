"""Secrets: strong patterns stand alone, weak parts count only beside the part that completes them.

A credential often comes in parts: an access identifier, a secret, an endpoint.  Strong patterns
(assignments of long values, access keys, long hex strings) are reported as they are.  Weak
candidates - identifiers, short assigned values, endpoints - are joined by interval: two parts link
if they lie in the same scope (a paragraph, that is a stretch without an empty line).  A weak part
is reported only if a part of another role links to it.  The join runs over starts and prefix
maxima of ends by scope and role with binary search, so its work grows with the number of
candidates and not of pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_text, fields, map_documents

#: Kinds in the order of ties; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts, each with the role it plays.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?<!secret_)(?:client_?id|access_?key(?:_?id)?|user(?:name)?|login|account)["']? *[:=] *["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp|ssh)://[^\s"'<>]{4,}""", re.IGNORECASE | re.ASCII)
SECRET_KEY = re.compile(r"""secret_?access_?key["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", re.IGNORECASE | re.ASCII)
#: Code points of a weak part at least, its name included: shorter ones say nothing.
LEAST = 8
SCOPE = re.compile(r"\n[ \t]*\n")
ROLE = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}
FIELDS = fields("spans array<struct<kind:string,start:bigint,end:bigint,link:bigint,base:boolean>>")


def candidates(text: str, least: int = LEAST) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Strong and weak candidates as (start, end, kind)."""
    strong, weak = [], []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            (strong if len(m[1]) >= 12 else weak).append((*m.span(), "assign" if len(m[1]) >= 12 else "secret"))
        weak += [(*m.span(), "identifier") for m in IDENTIFIER.finditer(text)]
        weak += [(*m.span(), "secret") for m in SECRET_KEY.finditer(text)]
        weak += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            (strong if m.end() - m.start() >= 18 else weak).append((*m.span(), "access" if m.end() - m.start() >= 18 else "identifier"))
    strong += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return strong, [w for w in weak if w[1] - w[0] >= least]


def find(text: str, least: int = LEAST) -> list[tuple[str, int, int, int | None, bool]]:
    """Spans as (kind, start, end, link, base) by start, then kind; link is the start of the nearest
    part of another role in the same scope (ties: the lower start), or None.

    Links hold both ways within a scope, so whatever a reported part links to is reported too.
    """
    strong, weak = candidates(text, least)
    if not strong and not weak:
        return []
    cuts = [m.end() for m in SCOPE.finditer(text)] if len(strong) + len(weak) > 1 else []
    # by scope and role: starts, and up to each the part that ends last
    parts: dict[int, dict[str, tuple[list[int], list[tuple[int, int]]]]] = {}
    for a, b, kind in sorted(strong + weak):
        starts, last = parts.setdefault(bisect_right(cuts, a), {}).setdefault(ROLE[kind], ([], []))
        starts.append(a)
        last.append(max(last[-1], (b, a), key=lambda x: x[0]) if last else (b, a))

    def link(a: int, b: int, role: str) -> int | None:
        best = None
        for other, (starts, last) in parts[bisect_right(cuts, a)].items():
            if other == role:
                continue
            i = bisect_left(starts, a)
            near = [(max(0, a - last[i - 1][0]), last[i - 1][1])] if i else []
            near += [(max(0, starts[i] - b), starts[i])] if i < len(starts) else []
            best = min(near if best is None else [best, *near])
        return best and best[1]

    found = [(a, kind, b, link(a, b, ROLE[kind]), True) for a, b, kind in strong]
    found += [(a, kind, b, to, False) for a, b, kind in weak if (to := link(a, b, ROLE[kind])) is not None]
    found.sort(key=lambda f: (f[0], KINDS.index(f[1])))
    return [(kind, a, b, to, base) for a, kind, b, to, base in found]


def scan(docs: DataFrame, *, text_col: str = "text", keep=("doc_id",), least: int = LEAST) -> DataFrame:
    """Adds spans: array of (kind, start, end, link, base), code points with the end left out.

    ``least`` is the shortest weak part in code points.  Null and empty texts have no spans (an empty
    array).  Texts of any length are searched whole.  Spans that begin together come in the order of
    KINDS.  Repeated rows give repeated results; no rows give none.  Input columns other than those of
    ``keep`` are dropped, and one of those named spans gives way.
    """

    def make():
        def kernel(texts: pa.Array) -> dict:
            names = ("kind", "start", "end", "link", "base")
            return {"spans": [[dict(zip(names, s)) for s in find(t, least)] for t in as_text(texts)]}

        return kernel

    return map_documents(docs, make, FIELDS, text_col=text_col, keep=keep)
