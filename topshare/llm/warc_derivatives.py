"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is its header lines (``head``) and its ``block``.  For every response
one metadata record (``application/warc-fields``) holds the HTTP status and
headers, the digests of the source and whether they agree with its bytes, and
the links of the page; for text and HTML one conversion record holds the visible
text.  Both name their source in ``WARC-Refers-To`` and keep its URI and date;
the metadata names the conversion too.  Identifiers are derived from the
source's, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers
from topshare.llm.html_layout import Node, parse, render

VERSION = "WARC/1.1"
_SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BREAK = re.compile(rb"\r?\n\r?\n")
_ONE_LINE = re.compile(r"[\r\n]+\s*")
#: Text and links of a compressed body come from so many unpacked bytes at most, and the records of a longer one say so;
#: its digests are those of the whole body.
MOST_UNPACKED = 64 << 20
_UNPACKED = frozenset(["gzip", "x-gzip", "deflate"])
_READ, _WRITTEN = 1 << 14, 1 << 20  # bytes that go into and come out of a decompressor at once


class Response(NamedTuple):
    status: str
    headers: list[tuple[str, str]]
    body: bytes
    truncated: bool
    packed: bytes | None = None  # the body as it came, if only a part of it was unpacked
    unknown_coding: str = ""  # the body is packed in a way that is not known here

    def codings(self) -> list[str]:
        """Content codings in the order in which they were applied."""
        named = [c.strip() for n, v in self.headers if n.lower() == "content-encoding" for c in v.lower().split(",")]
        return [c for c in named if c not in ("", "identity")]

    def payload(self) -> Iterable[bytes]:
        """All of the body in parts, also of one that is too long to hold."""
        return [self.body] if self.packed is None else _unpacked(self.packed, self.codings(), [])

    def header(self, name: str) -> str:
        return next((v for n, v in self.headers if n.lower() == name), "")


def fields_of(lines: str) -> list[tuple[str, str]]:
    """Header fields in order; a line that begins with white space goes on with the one before."""
    fields: list[tuple[str, str]] = []
    for line in lines.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return fields


def parse_response(block: bytes) -> Response | None:
    """An HTTP response, its body without chunks and compression; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    end = _BREAK.search(block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    status, _, lines = head.decode("utf-8", "replace").partition("\n")
    response = Response(status.strip(), fields_of(lines), body, False)
    if "chunked" in response.header("transfer-encoding").lower():
        body = _unchunked(body)
    codings = response.codings()
    if not codings:
        return response._replace(body=body)
    if not _UNPACKED.issuperset(codings):
        return response._replace(body=body, unknown_coding=", ".join(codings))
    faults: list[str] = []
    plain = bytearray()
    for part in _unpacked(body, codings, faults):
        plain += part
        if len(plain) > MOST_UNPACKED:
            return response._replace(body=bytes(plain[:MOST_UNPACKED]), truncated=True, packed=body)
    return response._replace(body=bytes(plain), truncated=bool(faults))


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body if not parts else b"".join(parts)
        if size <= 0:
            break
        parts.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(parts)


def _unpacked(body: bytes, codings: list[str], faults: list[str]) -> Iterator[bytes]:
    """The unpacked body in parts, as far as it can be read; ``faults`` gets an entry if that is not to its end."""
    parts: Iterator[bytes] = (body[i : i + _READ] for i in range(0, len(body), _READ))
    for coding in reversed(codings):
        parts = _unpacked_once(parts, coding, faults)
    return parts


def _unpacked_once(parts: Iterator[bytes], coding: str, faults: list[str]) -> Iterator[bytes]:
    """One coding taken off: all members of gzip, or deflate with or without its header."""
    reader, members, held = None, 0, b""
    for part in parts:
        part, held = held + part, b""
        more = False  # the reader may hold more than it could put out
        while part or more:
            if reader is None:
                part = part.lstrip(b"\0") if members else part  # padding
                if len(part) < 2:
                    held = part
                    break
                if members and ("gzip" not in coding or part[:2] != b"\x1f\x8b"):
                    faults.append("more than the members")
                    return
                headed = part[0] & 15 == 8 and int.from_bytes(part[:2]) % 31 == 0
                reader = zlib.decompressobj(31 if "gzip" in coding else 15 if headed else -15)
            try:
                plain = reader.decompress(part, _WRITTEN)
            except zlib.error:
                faults.append("broken")
                return
            if plain:
                yield plain
            part, more = reader.unconsumed_tail, len(plain) == _WRITTEN
            if reader.eof:
                part, more, reader, members = reader.unused_data, False, None, members + 1
    if reader is not None or held:
        faults.append("ends early")


def _charset_text(response: Response) -> str:
    named = _CHARSET.search(response.header("content-type"))
    found = _META_CHARSET.search(response.body[:4096])
    for name in (named[1] if named else None, found[1].decode() if found else None, "utf-8"):
        try:
            if name:
                return response.body.decode(name, "replace")
        except LookupError:
            continue
    return ""


def digest_agrees(label: str, data: bytes | Iterable[bytes]) -> bool | None:
    """Whether ``algorithm:value`` (base 32 or hex) is the digest of the data or its parts; None if it can't be told."""
    name, _, value = label.partition(":")
    try:
        found = hashlib.new(name.lower())
    except ValueError:
        return None
    for part in [data] if isinstance(data, bytes) else data:
        found.update(part)
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == _base32(found.digest())


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def sha1_label(data: bytes | Iterable[bytes]) -> str:
    found = hashlib.sha1()
    for part in [data] if isinstance(data, bytes) else data:
        found.update(part)
    return "sha1:" + _base32(found.digest())


def links_of(tree: Node, base: str) -> list[str]:
    """The targets of links, in order and as often as they occur."""
    found, todo, joiner = [], [tree], _Joiner(base)
    while todo:
        node = todo.pop()
        if node.tag == "base" and node.attrs.get("href"):
            joiner = _Joiner(joiner.joined(node.attrs["href"]))
        if node.tag in ("a", "area") and node.attrs.get("href"):
            found.append(joiner.joined(node.attrs["href"]))
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


#: What ``urljoin`` gives back as it is, or only puts behind the start of the base: plain segments, none of dots.
_PLAIN = r"(?:[\w~%+-][\w.~%+-]*/)*(?:[\w~%+-][\w.~%+-]*)?(?:\?[\w=&%+.,/-]+)?(?:#[\w.-]+)?"
_ABSOLUTE = re.compile(rf"https?://[\w.-]+(?::\d+)?/{_PLAIN}", re.A)
_ROOTED = re.compile(rf"/{_PLAIN}", re.A)
_BESIDE = re.compile(rf"[\w~%+-]{_PLAIN}", re.A)


class _Joiner:
    """Joins the links of one page to its base; the base is taken apart once."""

    def __init__(self, base: str):
        self._base = base
        plain = _ABSOLUTE.fullmatch(base)
        # The base up to its path, and up to the last slash of its path.
        self._root = base[: base.index("/", 8)] if plain else None
        self._folder = re.split(r"[?#]", base, maxsplit=1)[0].rpartition("/")[0] + "/" if plain else None

    def joined(self, href: str) -> str:
        if _ABSOLUTE.fullmatch(href):
            return href
        if self._root is not None:
            if _ROOTED.fullmatch(href):
                return self._root + href
            if _BESIDE.fullmatch(href):
                return self._folder + href
        return _joined(self._base, href)


def _joined(base: str, href: str) -> str:
    try:
        return _ONE_LINE.sub("", urljoin(base, href.strip()))
    except ValueError:
        return _ONE_LINE.sub("", href.strip())


def _record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{kind} {source}')}>"


def _head(fields: list[tuple[str, str]]) -> str:
    return "".join(f"{n}: {_ONE_LINE.sub(' ', v)}\r\n" for n, v in fields if v != "")


def derive(head: str, block: bytes) -> list[tuple[str, str, str, str, bytes]]:
    """The derivatives of one record: type, id, source id, header lines and block of each.

    Records of other types than response, and those without an id, have none.
    """
    return [record[:5] for record in _derived(head, block)]


def _derived(head: str, block: bytes) -> list[tuple]:
    """As :func:`derive`, each with the values of ``_FIELDS`` behind, null where there is none."""
    fields = {n.lower(): v for n, v in reversed(fields_of(head))}
    source = fields.get("warc-record-id", "")
    if fields.get("warc-type", "").lower() != "response" or not source:
        return []
    uri = fields.get("warc-target-uri", "")
    response = parse_response(block)
    kind = response.header("content-type").partition(";")[0].strip().lower() if response else ""
    links: list[str] = []
    text: bytes | None = None
    if response and response.unknown_coding:
        pass  # no text to be read
    elif response and kind in ("text/html", "application/xhtml+xml"):
        tree = parse(_charset_text(response))
        links = links_of(tree, uri)
        text = "\n".join(render(tree)).encode("utf-8", "replace")
    elif response and kind.startswith("text/"):
        text = _charset_text(response).encode("utf-8", "replace")

    def shared(kind: str, body: bytes, content_type: str) -> list[tuple[str, str]]:
        return [
            ("WARC-Type", kind),
            ("WARC-Record-ID", _record_id(source, kind)),
            ("WARC-Date", fields.get("warc-date", "")),
            ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", fields.get("warc-date", "")),
            ("WARC-Block-Digest", sha1_label(body)),
            ("WARC-Truncated", "length" if response and response.truncated else ""),
            ("Content-Type", content_type),
            ("Content-Length", str(len(body))),
        ]

    told = [("source-content-length", str(len(block)))]
    of_payload: tuple = (None, None)
    for name, data in (("block", block), ("payload", response.payload() if response else b"")):
        if label := fields.get(f"warc-{name}-digest"):
            agrees = digest_agrees(label, data)
            if name == "payload" and response and response.unknown_coding:
                agrees = agrees or None  # it may be that of the unpacked body
            if name == "payload":
                of_payload = (_ONE_LINE.sub(" ", label), agrees)
            told += [(f"source-{name}-digest", label)]
            told += [(f"source-{name}-digest-agrees", "unknown" if agrees is None else str(agrees).lower())]
    if response:
        told += [("http-status", response.status)] + [(f"http-header-{n.lower()}", v) for n, v in response.headers]
        told += [("payload-digest", sha1_label(response.payload()))]
        if response.unknown_coding:
            told += [("payload-still-packed", response.unknown_coding)]
    else:
        told += [("parse-error", "no HTTP response")]
    if text is not None:
        told += [("conversion", _record_id(source, "conversion"))]
    told += [("outlink", link) for link in links]
    body = _head(told).encode("utf-8", "replace")
    records = [("metadata", body, "application/warc-fields")]
    if text is not None:
        records.append(("conversion", text, "text/plain; charset=utf-8"))
    found = []
    for name, data, content_type in records:
        lines = shared(name, data, content_type)
        values = {n: _ONE_LINE.sub(" ", v) or None for n, v in lines}
        told_of = [values["WARC-Target-URI"], values["WARC-Date"], content_type, len(data), values["WARC-Block-Digest"]]
        payload = of_payload if name == "metadata" else (None, None)
        found.append((name, values["WARC-Record-ID"], source, _head(lines), data, *told_of, *payload))
    return found


def to_warc(head: str, block: bytes, compressed: bool = True) -> bytes:
    """A whole record as it stands in a file, by itself one gzip member."""
    record = f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if compressed else record


def from_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Header lines and block of each record of a file; gzip members or plain."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        head = data[data.index(b"\r\n", start) + 2 : end + 2].decode()
        size = int(next(v for n, v in fields_of(head) if n.lower() == "content-length"))
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """``page_id, head, block``: a response record for each row of ``page_id, url, html``.

    Null HTML is an empty body, a null URL leaves its field out.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    block = F.concat(http, body)
    key = F.md5(F.to_json(F.struct("page_id", "url", F.md5(body)), {"ignoreNullFields": "false"}))
    record_id = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    uri = F.regexp_replace("url", r"[\r\n]+\s*", " ")
    head = F.concat(
        F.lit("WARC-Type: response\r\nWARC-Record-ID: "),
        record_id,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.when(uri.isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n"))),
        F.lit("WARC-Block-Digest: sha256:"),
        F.sha2(block, 256),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.length(block).cast("string"),
        F.lit("\r\n"),
    )
    return pages.select("page_id", head.alias("head"), block.alias("block"))


#: Columns behind ``block``.
_FIELDS = {
    "target_uri": pa.string(),
    "warc_date": pa.string(),
    "content_type": pa.string(),
    "content_length": pa.int64(),
    "block_digest": pa.string(),
    "source_payload_digest": pa.string(),
    "source_digest_agrees": pa.bool_(),
}
_RECORD = dict.fromkeys(["record_type", "record_id", "refers_to", "head"], pa.string()) | {"block": pa.binary()} | _FIELDS


def derivatives(records: DataFrame, id_column: str = "page_id") -> DataFrame:
    """The derivative records of ``head, block`` rows; ``id_column`` is kept.

    ``record_type, record_id, refers_to, head, block``, and as columns of their
    own what the header lines tell: ``target_uri, warc_date, content_type,
    content_length, block_digest`` and, of metadata, ``source_payload_digest,
    source_digest_agrees`` (null where unknown).  A null head or block is an
    empty one; a row that is no response, or has no id, gives no records; one
    whose block is no HTTP gives metadata that say so.  Repeated rows give
    repeated records.
    """
    prepare_workers(records.sparkSession, 256)
    kind = records.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], []
            for at, (head, block) in enumerate(zip(batch.column("head").to_pylist(), batch.column("block").to_pylist())):
                found = _derived(head or "", block or b"")
                source += [at] * len(found)
                rows += found
            ids = batch.column(0).take(pa.array(source, pa.int64()))
            columns = zip(*rows) if rows else [()] * len(_RECORD)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(columns, _RECORD.values())]], names=[id_column, *_RECORD]
            )

    text = "record_type string, record_id string, refers_to string, head string, block binary"
    fields = "target_uri string, warc_date string, content_type string, content_length long, block_digest string"
    agrees = "source_payload_digest string, source_digest_agrees boolean"
    return records.select(id_column, "head", "block").mapInArrow(run, f"{id_column} {kind}, {text}, {fields}, {agrees}")
