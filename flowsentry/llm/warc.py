"""Derivative records of web archives: for each response a metadata record and a plain-text conversion record.

A response record (WARC/1.1) holds the HTTP headers and body as received. Its derivatives name it in WARC-Refers-To,
repeat its target URI and date, carry their own block digests, and the metadata record keeps the source's headers and
payload digest. Record ids are derived from content (UUID version 5), so a task that runs again writes the same bytes.

The text of a conversion record holds the page's visible blocks, one a line, as the tag reader of ``html_extract`` finds
them; the title is a field of the metadata record.

Edge cases: null html counts as empty (still a response with an empty body); a null url gives records without
WARC-Target-URI; repeated rows give repeated records with equal ids; a table without rows gives none; further columns
are ignored. Damaged bytes give the records before the damage; ``damaged`` lists the rows and why. A null record gives
none and is not damaged.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.html_extract import blocks

CRLF = b"\r\n"
RECORD_SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_digest string, source_headers string, record binary"

def sha1_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


class Damage(ValueError):
    """Bytes that are no records; the message is the reason."""


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """The content of plain bytes or of gzip members one after the other, up to a damage, and the damage."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    parts = []
    while data:
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data))
        except zlib.error:
            return b"".join(parts), "gzip data"
        if not member.eof:
            return b"".join(parts), "truncated gzip member"
        data = member.unused_data
    return b"".join(parts), None


def decode_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of plain or gzip-member WARC bytes; header names in lower case. Raises Damage after the last sound record."""
    data, damage = inflate(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise Damage(damage or "no version line")
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            raise Damage(damage or "unfinished headers")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length, body = headers.get("content-length", ""), end + 4
        if not re.fullmatch(r"[0-9]{1,18}", length):
            raise Damage("no length")
        stop = body + int(length)
        if stop > len(data):
            raise Damage(damage or "truncated block")
        if data[stop : stop + 4] != CRLF + CRLF:
            raise Damage(damage or "no end of block")
        yield headers, data[body:stop]
        at = stop + 4
    if damage:
        raise Damage(damage)


def sound_records(data: bytes | None) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The records before the first damage, and the damage."""
    found = []
    try:
        for record in decode_records(bytes(data) if data is not None else b""):
            found.append(record)
    except Damage as e:
        return found, str(e)
    return found, None


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, body = block.partition(CRLF + CRLF)
    return head, body


def plain_text(html: str) -> str:
    """All visible text: the page's blocks, each on its own line."""
    return "\n".join(b.text for b in blocks(html))


def response_record(url: str | None, html: str, date: str) -> bytes:
    """A response as a crawler would store it."""
    body = html.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + CRLF + CRLF + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_urn("response", url or "", sha1_digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", sha1_digest(body)), ("WARC-Block-Digest", sha1_digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return encode_record(headers, block)


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and conversion records of one response: (type, id, refers_to, uri, content type, length, block digest, source digest, source headers, bytes)."""
    http, body = split_http(block)
    source, uri, date = headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date")
    payload = headers.get("warc-payload-digest") or sha1_digest(body)
    verified = payload.lower() == sha1_digest(body).lower()
    charset = re.search(rb"(?i)charset=([\w-]+)", http)
    try:
        text = body.decode(charset[1].decode() if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    converted = plain_text(text).encode("utf-8", "replace")
    kept = http.decode("latin-1")
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    links = re.findall(r"""(?i)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]+)""", text)
    fields = [("source-record-id", source or ""), ("source-payload-digest", payload), ("source-payload-verified", str(verified).lower()), *(("source-http-header", line) for line in kept.split("\r\n") if line), ("title", " ".join(html_lib.unescape(title[1]).split()) if title else ""), *(("outlink", html_lib.unescape(x)) for x in links)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, content, data in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", converted)):
        block_digest = sha1_digest(data)
        own = record_urn(kind, source or "", block_digest)
        record = encode_record([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Block-Digest", block_digest), ("Content-Type", content)], data)
        out.append((kind, own, source, uri, content, len(data), block_digest, payload, kept, record))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): each page as a response record."""

    def fill(batches):
        for batch in batches:
            urls = [None if pd.isna(u) else u for u in batch["url"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "record": [response_record(u, h if isinstance(h, str) else "", date) for u, h in zip(urls, batch["html"], strict=True)]})

    return pages.select("page_id", "url", "html").mapInPandas(fill, "page_id long, record binary")


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of every sound response among (page_id, record); other record types are passed over."""

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def build(batches):
        for batch in batches:
            rows = [(page, *row) for page, data in zip(batch["page_id"], batch["record"], strict=True) for headers, block in sound_records(data)[0] if headers.get("warc-type") == "response" for row in derivatives(headers, block)]
            yield pd.DataFrame(rows, columns=names)

    return records.select("page_id", "record").mapInPandas(build, RECORD_SCHEMA)


def damaged(records: DataFrame) -> DataFrame:
    """(page_id, sound, reason) of every row with damaged bytes; sound records come before the damage."""

    def test(batches):
        for batch in batches:
            found = [(page, len(sound), why) for page, (sound, why) in zip(batch["page_id"], map(sound_records, batch["record"]), strict=True) if why]
            yield pd.DataFrame(found, columns=["page_id", "sound", "reason"])

    return records.select("page_id", "record").mapInPandas(test, "page_id long, sound long, reason string")


def archive_bytes(records: DataFrame) -> DataFrame:
    """Each record as one gzip member, so members of a partition can be concatenated into one archive file."""
    member = F.pandas_udf(lambda r: r.map(lambda b: gzip.compress(bytes(b), mtime=0)), "binary")
    return records.withColumn("record", member("record"))
