"""Derivatives of web archives: from each response a metadata record and a plain-text conversion record.

Both refer to their response by its identifier, repeat its source headers (target, date, HTTP
headers, digests of payload and block) and carry a digest of their own block.  A page is read by one
pass over its tags, in time linear in its length whatever is in it.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_type, fields

#: What begins with <: a tag with its name and attributes, a comment, or a declaration.
INSIDE = r"""[^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+"""
MARK = re.compile(rf"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({INSIDE})>|!--|[!?/]{INSIDE}>)""")
#: An attribute; values may be bare.
ATTRIBUTE = re.compile(r"""([^\s"'<>=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
#: Elements whose content isn't text, and those that begin a line.
HIDDEN = {"script", "style", "noscript", "template"}
BLOCK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer title blockquote pre hr main aside dl dt dd form figure".split())
CLOSES = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in HIDDEN}
BLANK = re.compile(r"[ \t\x0b\f\r\xa0]+")
#: The date of responses whose table has none.
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
RECORD = fields(
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_payload_digest string, source_block_digest string, source_http string, block_digest string, content_length bigint, block binary"
)
#: Header names of a serialised record, and the columns that they hold.
NAMES = (
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
    ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("X-Source-Payload-Digest", "source_payload_digest"), ("X-Source-Block-Digest", "source_block_digest"),
    ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
)
SOURCE = "X-Source-HTTP"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    h = hashlib.sha1("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def attribute(text: str, name: str) -> str | None:
    """The first attribute of that name."""
    for found, double, single, bare in ATTRIBUTE.findall(text):
        if found.lower() == name:
            return double or single or bare
    return None


def read(page: str) -> tuple[str, str, list[str], str]:
    """Title, language, distinct links in order, and the visible text: one line per block, entities
    resolved, white space collapsed, empty lines dropped.

    A comment ends the page if nothing closes it, and so does a hidden element.
    """
    parts, at, title, language, links = [], 0, None, None, {}
    began = None  # where the title's text begins
    search, add = MARK.search, parts.append
    while m := search(page, at):
        start, end = m.span()
        closing, name, attributes = m.groups()
        add(page[at:start])
        if began is not None:
            title, began = page[began:start], None
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", end)
                end = len(page) if end < 0 else end + 3
        else:
            name = name.lower()
            if name in BLOCK:
                add("\n")
                if name == "title" and not closing and title is None:
                    began = end
            elif name in HIDDEN:
                add(" ")
                if not closing:
                    close = CLOSES[name].search(page, end)
                    tail = page.find(">", close.end()) if close else -1
                    end = tail + 1 if tail >= 0 else len(page)
            elif attributes and not closing:
                if name == "a":
                    if (href := attribute(attributes, "href")) is not None:
                        links[html.unescape(href)] = None
                elif name == "html" and language is None:
                    language = attribute(attributes, "lang")
        at = end
    add(page[at:])
    if began is not None:
        title = page[began:]
    lines = (line.strip() for line in BLANK.sub(" ", html.unescape("".join(parts))).split("\n"))
    return BLANK.sub(" ", html.unescape(title or "")).strip(), language or "", list(links), "\n".join(filter(None, lines))


def about(title: str, language: str, links: list[str]) -> bytes:
    """A metadata block: title, language, number of links, then each distinct link in order."""
    lines = [("title", title), ("language", language), ("links", str(len(links))), *(("outlink", x) for x in links)]
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode("utf-8", "surrogatepass")


def derive(target: str | None, date: str | None, record_id: str, http: str | None, payload: bytes) -> list[tuple]:
    title, language, links, text = read(payload.decode("utf-8", "replace"))
    head = (http or "").encode("utf-8", "surrogatepass")
    digests = sha1(payload), sha1(head + b"\r\n\r\n" + payload)
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", about(title, language, links)), ("conversion", "text/plain; charset=UTF-8", text.encode("utf-8", "replace"))):
        out.append((kind, urn(record_id, kind), record_id, target, date, mime, *digests, http, sha1(block), len(block), block))
    return out


def serialise(record: dict) -> bytes:
    """One record in the WARC/1.1 form.  The response's target and date stand as refers-to headers as
    well, its digests and each line of its HTTP headers as extension headers."""
    head = [(name, record[column]) for name, column in NAMES if record[column] is not None]
    head += [(SOURCE, line) for line in (record["source_http"] or "").split("\r\n") if record["source_http"] is not None]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + record["block"] + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A serialised record's columns."""
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    got, http, columns = dict.fromkeys(f.name for f in RECORD), [], dict(NAMES)
    for line in lines:
        name, _, value = line.partition(": ")
        if name == SOURCE:
            http.append(value)
        else:
            got[columns[name]] = value
    got["source_http"] = "\r\n".join(http) if http else None
    got["content_length"] = int(got["content_length"])
    got["block"] = body[: got["content_length"]]
    if len(got["block"]) != got["content_length"] or body[got["content_length"] :] != b"\r\n\r\n" or sha1(got["block"]) != got["block_digest"]:
        raise ValueError("the block doesn't fit its length or digest")
    return got


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, date: str = DATE) -> DataFrame:
    """Pages as response records: id, record_id, target_uri, warc_date, http, payload.

    The date is that of ``date_col``, or ``date`` for all.  The identifier follows from id, address,
    date and payload, so two captures of an address have two; wholly repeated rows repeat theirs.  A
    null page has a null payload.
    """
    day, body = F.lit(date) if date_col is None else F.col(f"`{date_col}`").cast("string"), F.col(f"`{html_col}`").cast("binary")
    told = [F.coalesce(x.cast("string"), F.lit("")) for x in (F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), day, F.sha1(body))]
    name = F.sha1(F.concat_ws("\n", *told))
    part = lambda a, n: F.substring(name, a, n)
    record = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    return pages.select(F.col(f"`{id_col}`"), record.alias("record_id"), F.col(f"`{url_col}`").alias("target_uri"), day.alias("warc_date"), F.lit(HTTP).alias("http"), body.alias("payload"))


def derivatives(source: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Two records for each response, of types metadata and conversion, beside the response's id.

    A null payload counts as empty: its metadata has no title and no links, its text is empty.  Null
    targets, dates and headers stay null.  Damaged UTF-8 is replaced.  Pages of any length are read
    whole; of repeated titles, languages and attributes the first counts.  Repeated responses give
    repeated records; none give none.  Columns that aren't part of a response are dropped, whatever
    their names.
    """
    names = ("target_uri", "warc_date", "record_id", "http", "payload")
    frame = source.select(f"`{id_col}`", *names)
    schema = T.StructType([frame.schema.fields[0], *RECORD])
    kinds = [arrow_type(f.dataType) for f in RECORD]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                target, date, record, http, payload = (batch.column(i + 1).to_pylist() for i in range(5))
                made = [r for t, d, i, h, p in zip(target, date, record, http, payload) for r in derive(t, d, i or "", h, p or b"")]
                ids = batch.column(0).take(pa.array([i for i in range(batch.num_rows) for _ in (0, 1)], pa.int64()))
                columns = list(zip(*made)) if made else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return frame.mapInArrow(run, schema)
