"""WARC derivatives: metadata and plain-text conversion records from response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# Elements whose content is not text, and elements that start a new line.
HIDDEN = frozenset("script style noscript template title".split())
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table td th tr ul".split())

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE) for name in HIDDEN}
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id whenever the same record is derived again, so a repeated task adds none."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(page: str) -> tuple[str, str | None, list[str]]:
    """(text, title, hrefs) of an HTML page, in one scan from tag to tag."""
    parts: list[str] = []
    hrefs: list[str] = []
    title: str | None = None
    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, tag + 1)
        if not name and not page.startswith(("<!", "<?"), tag):
            parts.append("<")
            at = tag + 1
            continue
        end = page.find(">", tag)
        end = n if end < 0 else end
        at = end + 1
        if not name:
            continue
        element, closing = name[1].lower(), page[tag + 1] == "/"
        if element in BREAKS:
            parts.append("\n")
        if element == "a" and not closing and (href := _HREF.search(page, name.end(), end)):
            hrefs.append(html.unescape(next(g for g in href.groups() if g is not None)))
        if element in HIDDEN and not closing:
            found = _ENDS[element].search(page, at)
            stop = found.start() if found else n
            if element == "title" and title is None:
                title = " ".join(html.unescape(page[at:stop]).split())
            at = stop
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line), title, hrefs


def read_http(block: bytes | None) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """(status line, headers in order, payload) of an HTTP response; no status line if it isn't one.

    A header may stand several times; folded lines belong to the one before them.
    """
    head, found, payload = (block or b"").partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return None, [], block or b""
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            name, value = headers.pop()
            headers.append((name, f"{value} {line.strip()}".strip()))
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
    return status, headers, payload


def _unchunked(data: bytes) -> tuple[bytes, str | None]:
    """(body, fault) of a chunked transfer; a fault leaves the chunks before it."""
    parts: list[bytes] = []
    at = 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(parts), "broken chunk"
        n = int(size, 16)
        if n == 0:
            return b"".join(parts), None
        parts.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(parts[-1]) < n or data[at : at + 2] != b"\r\n":
            return b"".join(parts), "broken chunk"
        at += 2


def _inflated(data: bytes, window: int) -> tuple[bytes, str | None]:
    """(body, fault) of compressed members one after the other; what follows the last one is padding."""
    parts: list[bytes] = []
    while data:
        member = zlib.decompressobj(window)
        try:
            parts.append(member.decompress(data))
        except zlib.error:
            return b"".join(parts), "broken data" if not parts else None
        if not member.eof:
            return b"".join(parts), "data end early"
        data = member.unused_data
    return b"".join(parts), None


def _deflated(data: bytes) -> tuple[bytes, str | None]:
    """Servers send deflate with or without the zlib head."""
    with_head = _inflated(data, zlib.MAX_WBITS)
    return _inflated(data, -zlib.MAX_WBITS) if with_head[1] == "broken data" else with_head


# Names of the codings that can be undone.
_UNDO = {
    "chunked": _unchunked,
    "gzip": lambda data: _inflated(data, zlib.MAX_WBITS | 16),
    "x-gzip": lambda data: _inflated(data, zlib.MAX_WBITS | 16),
    "deflate": _deflated,
    "identity": lambda data: (data, None),
}


def body_of(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes | None, str | None]:
    """(body, fault) once transfer codings, then content codings are undone, the last one named first.

    A fault in the middle leaves the body before it; where nothing can be undone the body is null.
    Payloads that a crawler stored decoded under their old headers start with no chunk size or no
    magic number, and are the body as they stand.
    """
    body, fault = payload, None
    for header in ("transfer-encoding", "content-encoding"):
        names = [n.strip().lower() for k, v in headers if k == header for n in v.split(",")]
        for name in reversed([n for n in names if n]):
            if name not in _UNDO:
                return None, f"{header} {_safe(name)}"
            if not body or (name == "chunked" and not re.match(rb"[0-9A-Fa-f]{1,15}\s*(;[^\r\n]*)?\r\n", body)) or (name.endswith("gzip") and body[:2] != b"\x1f\x8b"):
                continue
            body, broken = _UNDO[name](body)
            if broken:
                fault = f"{header} {name}: {broken}"
                if not body:
                    return None, fault
    return body, fault


def _decoded(body: bytes, content_type: str, is_html: bool) -> str:
    """Text by byte order mark, charset of the header, charset of a meta element (which HTML wants
    within the first 1024 bytes), else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    charset = _CHARSET.search(content_type)
    meta = _META.search(body, 0, 1024) if is_html and not charset else None
    name = charset[1] if charset else meta[1].decode("ascii") if meta else "utf-8"
    if meta and name.lower().startswith("utf-16"):
        name = "utf-8"  # the element could be read, so this it is not
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def _safe(value: str) -> str:
    """One header line: no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def _record(kind: str, own: str, source: dict, content_type: str, block: bytes, more: list[tuple[str, str]]) -> dict:
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", source["date"]),
        ("WARC-Target-URI", source["uri"]),
        ("WARC-Refers-To", source["record_id"]),
        ("WARC-Refers-To-Target-URI", source["uri"]),
        ("WARC-Refers-To-Date", source["date"]),
        *more,
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    lines = ["WARC/1.1", *(f"{k}: {_safe(v)}" for k, v in head if v)]
    return {"warc_type": kind, "record_id": own, "refers_to": source["record_id"], "header": "\r\n".join(lines) + "\r\n\r\n", "block": block, "block_digest": digest(block), "source_block_digest": source["block_digest"], "source_payload_digest": source["payload_digest"]}


def derive(record: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    """The metadata record and, if the response is text or HTML, the conversion record."""
    status, headers, payload = read_http(block)
    source = {"record_id": record or record_id("response", uri or "", digest(block or b"")), "uri": uri or "", "date": date or "", "block_digest": digest(block or b""), "payload_digest": digest(payload)}
    content_type = next((v for k, v in headers if k == "content-type"), None)
    kind = ("text/html" if content_type is None else content_type).split(";")[0].strip().lower()
    own, text_id = record_id(source["record_id"], "metadata"), record_id(source["record_id"], "conversion")
    own_digests = [("source-block-digest", source["block_digest"]), ("source-payload-digest", source["payload_digest"])]
    fields = [("source-status", status or ""), *own_digests]
    out = []
    if kind in ("text/html", "application/xhtml+xml", "text/plain"):
        raw, fault = body_of(headers, payload)
        fields.append(("body-fault", fault or ""))
        if raw is not None:
            body = _decoded(raw, content_type or "", kind != "text/plain")
            text, title, hrefs = (body, None, []) if kind == "text/plain" else plain_text(body)
            out.append(_record("conversion", text_id, source, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), [("WARC-Concurrent-To", own), ("WARC-Source-Payload-Digest", source["payload_digest"])]))
            fields.append(("title", title or ""))
            for href in hrefs:
                try:
                    fields.append(("outlink", urljoin(source["uri"], href)))
                except ValueError:
                    fields.append(("outlink", href))
    # A header of the source stays even if it has no value.
    lines = [(k, v) for k, v in fields if v]
    at = 1 if status else 0
    lines[at:at] = [(f"source-{_safe(k)}", v) for k, v in headers]
    block = "".join(f"{k}: {_safe(v)}\r\n" for k, v in lines).encode("utf-8", "replace")
    concurrent = [("WARC-Concurrent-To", text_id)] if out else []
    return [_record("metadata", own, source, "application/warc-fields", block, [*concurrent, ("WARC-Source-Payload-Digest", source["payload_digest"])]), *out]


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (id, record_id, uri, date, block) for pages that were kept without their WARC envelope."""
    url, body = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), url))
    uuid_text = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    own: Column = F.concat(F.lit("<urn:uuid:"), uuid_text, F.lit(">"))
    return pages.select(id_col, own.alias("record_id"), url.alias("uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"))


OUT = "warc_type string, record_id string, refers_to string, header string, block binary, block_digest string, source_block_digest string, source_payload_digest string"


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Derived records of response records (id, record_id, uri, date, block): (id, warc_type, record_id,
    refers_to, header, block, block_digest, source_block_digest, source_payload_digest).

    ``header`` and ``block`` one after the other, and two line ends, are the record as it stands in
    a file. Each response gives a metadata record (the HTTP headers of the source, its digests,
    title and outgoing links) and, if it is HTML or plain text, a conversion record with its text;
    both refer to the response and to each other. Identifiers follow from the source's, so a task
    that runs again makes the same records. One pass without a shuffle.

    Chunked transfers, gzip and deflate are undone before the text is read; digests are those of the
    bytes as they stand in the source. A body whose coding is unknown (or broken from its start) has
    no conversion record, one that breaks off has the text before the break; both are named in the
    field ``body-fault`` of the metadata. Source headers keep their order, repeats and empty values.

    A response without an HTTP head is taken as the payload itself; a null block is an empty one; a
    null record id is replaced by one made from uri and digest. Repeated rows each get their
    records; other columns are not looked at; an empty table gives no rows.
    """
    schema = StructType([StructField(id_col, records.schema[id_col].dataType), *StructType.fromDDL(OUT)])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids, rows = [], []
                for k, values in enumerate(zip(*(part.column(c).to_pylist() for c in range(1, 5)))):
                    found = derive(*values)
                    rows += found
                    ids += [k] * len(found)
                cols = [part.column(0).take(pa.array(ids, pa.int64())).cast(arrow.field(0).type)]
                cols += [pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return records.select(F.col(id_col), F.col("record_id").cast("string"), F.col("uri").cast("string"), F.col("date").cast("string"), F.col("block").cast("binary")).mapInArrow(run, schema)
