"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

VERSION = b"WARC/1.1"
# Names record ids: the same response gives the same derivatives in any run.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:seriesloom:warc")

_OPENS = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|title|head|body|blockquote|pre|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""("[^"]*"|'[^']*'|[^\s>"']+)""")
_TITLE = re.compile(r"<title\b", re.I)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_CHARSET = re.compile(rb"""charset\s*=\s*["']?([\w.:-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, an empty line, the block, and two line ends.

    Control characters of a header's value, which could end its line, are percent-encoded.
    """
    values = ((k, _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", v)) for k, v in headers)
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in values), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines in order, folded ones joined; lines without a colon are left out."""
    out: list[tuple[str, str]] = []
    for line in head.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def _halves(data: bytes) -> tuple[bytes, bytes]:
    """Header part and body of a record or an HTTP message."""
    ends = [(i, w) for mark, w in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := data.find(mark)) >= 0]
    if not ends:
        return data, b""
    at, width = min(ends)
    return data[:at], data[at + width :]


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; the block is as long as Content-Length says, where it does."""
    head, rest = _halves(data)
    start, _, lines = head.partition(b"\n")
    if not start.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines)
    size = _get(headers, "Content-Length")
    return headers, rest[: int(size)] if size and size.isdigit() else rest


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _without_dropped(page: str) -> str:
    """A page with a space for each comment, script, style and the like.

    One pass forward: an end that was looked for in vain is not looked for again.
    """
    out, at, last, absent = [], 0, 0, set()
    while (found := _OPENS.search(page, at)) is not None:
        name = (found[1] or "").lower()
        at = found.end()
        if name in absent:
            continue
        if name:
            opened = page.find(">", at)
            close = _CLOSES[name].search(page, opened + 1) if opened >= 0 else None
            end = close.end() if close else -1
        else:
            end = page.find("-->", at)
            end = end + 3 if end >= 0 else -1
        if end < 0:
            absent.add(name)
            continue
        out += [page[last : found.start()], " "]
        at = last = end
    return "".join([*out, page[last:]])


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles, comments or tags; a line for each block; entities as characters."""
    page = _without_dropped(page)
    # No tag ends behind the last bracket.
    last = page.rfind(">") + 1
    page = _TAG.sub("", _BREAK.sub("\n", page[:last])) + page[last:]
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str) -> list[str]:
    """The targets of a page's anchors: of each tag the first href with a value, in quotes or not."""
    out, at = [], 0
    while (found := _ANCHOR.search(page, at)) is not None:
        close = page.find(">", found.end())
        at = close if close >= 0 else len(page)
        place = found.end()
        while (href := _HREF.search(page, place, at)) is not None:
            value = _VALUE.match(page, href.end())
            place = href.end()
            if value:
                out.append(html.unescape(value[0].strip("\"'")))
                at = value.end()
                break
    return out


def title_of(page: str) -> str | None:
    found = _TITLE.search(page)
    opened = page.find(">", found.end()) if found else -1
    close = _CLOSES["title"].search(page, opened + 1) if opened >= 0 else None
    return " ".join(html.unescape(page[opened + 1 : close.start()]).split()) if close else None


def response(url: str | None, page: str | None, date: str) -> bytes:
    """A response record for a page as it was fetched; a null page has an empty body."""
    body = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    name = uuid.uuid5(_SPACE, f"{url}\n{hashlib.sha256(body).hexdigest()}")
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Target-URI", url or ""),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(head + body)),
    ]
    return record(headers, head + body)


def derive(data: bytes) -> list[tuple]:
    """``record_type, record_id, refers_to, target_uri, date, payload_digest, block_digest, data`` of a response's derivatives.

    The conversion record holds the plain text, the metadata record a JSON object with the
    source's WARC and HTTP headers as they are, the title, the links and the id of the
    conversion. Both refer to the source, keep its target and date, and name the digest of
    the payload they come from: as the source says, or computed where it says nothing.
    What is no response record has no derivatives.
    """
    try:
        headers, block = parse(data)
    except ValueError:
        return []
    if (_get(headers, "WARC-Type") or "").lower() != "response":
        return []
    head, body = _halves(block)
    status, _, lines = head.partition(b"\n")
    http = _fields(lines)
    kind = (_get(http, "Content-Type") or "").encode()
    charset = (found := _CHARSET.search(kind) or _CHARSET.search(body[:2048])) and found[1].decode() or "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source = _get(headers, "WARC-Record-ID") or f"<urn:uuid:{uuid.uuid5(_SPACE, hashlib.sha256(data).hexdigest())}>"
    target, date = _get(headers, "WARC-Target-URI") or "", _get(headers, "WARC-Date") or ""
    payload = _get(headers, "WARC-Payload-Digest") or digest(body)
    names = {t: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{t} {source}')}>" for t in ("metadata", "conversion")}
    about = {
        "source": {"record": source, "payload_digest": payload, "block_digest": _get(headers, "WARC-Block-Digest") or digest(block)},
        "warc_headers": headers,
        "http_status": status.rstrip(b"\r").decode("utf-8", "replace"),
        "http_headers": http,
        "title": title_of(page),
        "links": links(page),
        "conversion": names["conversion"],
    }
    blocks = {
        "metadata": ("application/json", json.dumps(about, ensure_ascii=False).encode()),
        "conversion": ("text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    }
    out = []
    for kind_of, (media, content) in blocks.items():
        own = digest(content)
        fields = [
            ("WARC-Type", kind_of),
            ("WARC-Record-ID", names[kind_of]),
            ("WARC-Refers-To", source),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("Content-Type", media),
            ("WARC-Source-Payload-Digest", payload),
            ("WARC-Block-Digest", own),
        ]
        if kind_of == "metadata":
            fields.insert(3, ("WARC-Concurrent-To", names["conversion"]))
        out.append((kind_of, names[kind_of], source, target, date, payload, own, record(fields, content)))
    return out


_DERIVED = ["record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest"]


def responses(pages: DataFrame, date: str, url: str = "url", page: str = "html", key: str = "page_id") -> DataFrame:
    """``key, data``: a response record for every page. A null url is an empty target, a null page an empty body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "page"):
            made = [response(u, p, date) for u, p in zip(part.column("url").to_pylist(), part.column("page").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made, pa.binary())], names=["key", "data"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("data", T.BinaryType())])).withColumnRenamed("key", key)


def derivatives(records: DataFrame, key: str = "page_id", data: str = "data") -> DataFrame:
    """``key``, the columns of ``derive`` and ``data``, two rows for every response record of ``records``.

    Rows whose record is null, broken or of another type give none; repeated records give
    theirs each time, under the same ids. Each record is handled where it lies. An empty
    table gives an empty one. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            at, rows = [], []
            for i, own in enumerate(part.column("data").to_pylist()):
                made = derive(own) if own is not None else []
                rows += made
                at += [i] * len(made)
            if rows:
                *names, blobs = zip(*rows, strict=True)
                columns = [part.column("key").take(pa.array(at)), *(pa.array(c, pa.string()) for c in names), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *_DERIVED, "data"])

    rows = records.select(F.col(key).alias("key"), F.col(data).alias("data"))
    fields = [rows.schema["key"], *(T.StructField(c, T.StringType()) for c in _DERIVED), T.StructField("data", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def write_records(records: DataFrame, folder: str, data: str = "data") -> DataFrame:
    """Write records as compressed WARC files, one for each task, a gzip member for each record; ``file, records, bytes``.

    ``folder`` is a URI that all executors reach. A file gets its name when it is whole;
    a task that is run again replaces its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():08d}.warc.gz"
        draft, count, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for own in batch.column("data").to_pylist():
                    if own is None:
                        continue
                    held = io.BytesIO()
                    with gzip.GzipFile(fileobj=held, mode="wb", mtime=0) as member:
                        member.write(own)
                    out.write(held.getvalue())
                    count, size = count + 1, size + len(held.getvalue())
        if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            store.delete_file(f"{root}/{name}")
        if count:
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})
        else:
            store.delete_file(draft)

    return records.select(F.col(data).alias("data")).mapInArrow(run, "file string, records long, bytes long")
