"""Operator 5: WARC derivatives of response records.

For each response record the builder makes a metadata record (the fields of the source: HTTP status and headers,
title, numbers of links and characters, the source's digests) and a conversion record (the page's plain text).
Both carry the response's identifier in WARC-Refers-To, its target and date, and their own block digest;
the metadata record also names the conversion in WARC-Concurrent-To. Identifiers are version-5 style UUIDs of
the source's identifier, so a task that runs again makes the same records. Files have one gzip member a
record; a task writes its own file and moves it, and a manifest lists them. Chunked transfers and gzip or deflate contents are
undone in a stream, whatever they unpack to; text is extracted in one pass and, of long pages, in segments, so hostile pages take no longer than others of their size.

Defined results: a page without URL has the target ``urn:page:<id>``; null html is an empty payload, whose conversion is
empty; a record that isn't a response, is cut off (also by the end of its file, or by damage to it), or whose payload can't be unpacked, gives a metadata record with the field derivation-error and no
conversion; a payload of several gzip members is all of them; of a payload that ends too early, what is there is converted, and the metadata record says payload-truncated; bytes after a compressed
payload are left out and counted in payload-trailing-bytes; repeated pages give repeated records; an empty table gives no files and no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")
#: Elements whose content isn't text, and elements that end a line.
_HIDDEN = frozenset(("script", "style", "noscript", "template", "title"))
_BREAKS = frozenset(("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "body"))
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|title)(?![\w-])")
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)|[/!?])[^>]*>")
_HREF = re.compile(r"\shref\s*=", re.I)
#: Where a long page may be cut: between a tag and one that begins a line.
_CUT = re.compile(r">\s*<(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article)(?![\w-])[^<>]*>", re.I)
#: Characters of a segment of a long page, and bytes that are unpacked at a time.
SEGMENT, PIECE = 1 << 24, 1 << 20
_ROWS = "page_id long, response_id string, metadata_id string, conversion_id string, target_uri string, source_digest string, metadata_digest string, conversion_digest string, text_sha256 string, n_chars long, n_links long, error string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record; ValueError if it isn't a whole record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields.get("content-length", "-1")) if fields.get("content-length", "").isdigit() else -1
    if size < 0 or len(rest) < size:
        raise ValueError("block cut off")
    return fields, rest[:size]


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record of a fetched page."""
    payload = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = url or f"urn:page:{page_id}"
    fields = [("WARC-Record-ID", identifier("response", str(page_id), target)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("X-Page-ID", "" if page_id is None else str(page_id))]
    return record("response", fields, http + payload)


class Page:
    """A page's plain text, title and number of links, in linear time: no end that isn't there is looked for twice.

    No scripts, styles, comments or title; a line for each block; entities resolved. What is opened and never closed hides nothing.
    """

    def __init__(self, html: str) -> None:
        self.links, self._title, parts, at = 0, None, [], 0
        low = html.lower()
        if len(low) != len(html):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
        missing: set[str] = set()

        def end(mark: str, start: int) -> int:
            """Where the mark ends next; 0, found once and for all, if it is nowhere."""
            if mark in missing:
                return 0
            if (found := low.find(mark, start)) < 0:
                missing.add(mark)
                return 0
            return found + len(mark)

        for m in _OPEN.finditer(low):
            if m.start() < at:
                continue
            if m[1] is None:
                stop = end("-->", m.end())
            else:
                stop = (inner := end(">", m.end())) and (close := end(f"</{m[1]}", inner)) and end(">", close)
                if stop and m[1] == "title" and self._title is None:
                    self._title = html[inner : close - len("</title")]
            if stop:
                parts += [html[at : m.start()], " "]
                at = stop
        body = "".join([*parts, html[at:]])
        last = body.rfind(">") + 1  # no tag ends beyond, so none is looked for there
        text = _TAG.sub(self._tag, body[:last]) + body[last:]
        lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def _tag(self, m: re.Match) -> str:
        """What stands for a tag: the end of a line, or nothing. Counts links."""
        name = m[2]
        if not name:
            return ""
        name = name.lower()
        if name == "a":
            self.links += not m[1] and bool(_HREF.search(m[0]))
            return ""
        return "\n" if name in _BREAKS else ""

    @property
    def title(self) -> str:
        return " ".join(entities.unescape(self._title or "").split())

    @classmethod
    def of(cls, pieces: Iterator[str]) -> Page:
        """A page that comes in pieces. Of a long one, segments are extracted one after the other; only a page without a place to cut, or with an element that hides a long part, is held for longer."""
        done, held, size, least = [], [], 0, SEGMENT
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size >= least:
                whole = "".join(held)
                cut = cls._safe_cut(whole)
                if cut:
                    done.append(cls(whole[:cut]))
                held, size = [whole[cut:]], len(whole) - cut
                least = max(SEGMENT, 2 * size)  # without a place to cut, the next look is at twice the size
        page = cls("".join(held))
        for one in reversed(done):
            page.links += one.links
            page._title = page._title if one._title is None else one._title
        page.text = "\n".join(t for t in (*(one.text for one in done), page.text) if t)
        return page

    @staticmethod
    def _safe_cut(html: str) -> int:
        """The last place where the rest of a page can be read by itself: at a tag that begins a line, in no hidden element or comment that is still open; 0 if there is none."""
        low, at, limit = html.lower(), 0, len(html)
        if len(low) != len(html):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
        hidden = []
        for m in _OPEN.finditer(low):
            if m.start() < at:
                continue
            stop = low.find("-->" if m[1] is None else f"</{m[1]}", m.end())
            stop = low.find(">", stop) + 1 if stop >= 0 else 0
            if not stop:
                limit = m.start()
                break
            hidden.append((m.start(), stop))
            at = stop
        places = [(m.start(), m.start() + m[0].index("<")) for m in _CUT.finditer(html, 0, limit)]
        for before, place in reversed(places):
            while hidden and hidden[-1][0] >= place:
                hidden.pop()
            if not hidden or hidden[-1][1] <= before:  # the > before it is a tag's, not that of a hidden element
                return place
        return 0


def plain_text(html: str) -> str:
    return Page(html).text


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The payload of a chunked transfer, and whether it came to its end; what isn't chunked comes back as it is."""
    parts, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return body, True
        if not size:
            return b"".join(parts), True
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
    return (b"".join(parts), False) if parts else (body, True)


def _inflated(pieces: Iterator[bytes], coding: str, about: dict[str, str]) -> Iterator[bytes]:
    """What a gzip or deflate payload holds, all its members, a piece at a time. Notes in about if it ends too early or goes on after its end."""
    press, begun = None, False
    for piece in pieces:
        while piece:
            if press is None:
                if begun and (coding == "deflate" or not piece.lstrip(b"\0")[:2] == b"\x1f\x8b"[: len(piece.lstrip(b"\0"))]):
                    left = len(piece.lstrip(b"\0")) + sum(map(len, pieces))
                    if left:
                        about["payload-trailing-bytes"] = str(left)
                    return
                piece = piece.lstrip(b"\0") if begun else piece
                if not piece:
                    break
                press, begun = zlib.decompressobj(wbits=31 if coding != "deflate" else 15 if piece[:1] in (b"\x78", b"\x58") else -15), True
            try:
                yield press.decompress(piece, PIECE)
            except zlib.error as e:
                raise ValueError(f"damaged {coding}: {e}") from e
            piece = press.unused_data if press.eof else press.unconsumed_tail
            if press.eof:
                press = None
    if press is not None:
        yield press.flush()
    if not begun or press is not None and not press.eof:
        about["payload-truncated"] = coding


def unpacked(body: bytes, encoding: str, about: dict[str, str]) -> Iterator[bytes]:
    """The content of a payload by its content codings, a piece at a time; ValueError for a coding other than gzip and deflate, and for damage."""
    pieces = iter([body])
    for coding in reversed([c.strip() for c in encoding.lower().split(",") if c.strip() not in ("", "identity")]):
        if coding not in ("gzip", "x-gzip", "deflate"):
            raise ValueError(f"content coding {coding}")
        pieces = _inflated(pieces, coding, about)
    return pieces


def _decoded(pieces: Iterator[bytes], charset: str) -> Iterator[str]:
    """Text of bytes that come in pieces; what can't be read is replaced. An unknown character set is read as UTF-8."""
    try:
        reader = codecs.getincrementaldecoder(charset)("replace")
    except LookupError:
        reader = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield reader.decode(piece)
    yield reader.decode(b"", True)


def derive(raw: bytes) -> tuple[bytes, bytes | None]:
    """The metadata and the conversion record of one response record."""
    try:
        fields, block = parse(raw)
        error = "" if fields.get("warc-type") == "response" else f"not a response: {fields.get('warc-type', '')}"
    except ValueError as e:
        fields, block, error = {}, b"", str(e)
    source = fields.get("warc-record-id") or identifier("unknown", hashlib.sha256(raw).hexdigest())
    common_fields = [("WARC-Refers-To", source), ("WARC-Date", fields.get("warc-date", DATE)), ("WARC-Target-URI", fields.get("warc-target-uri", ""))]
    if number := fields.get("x-page-id"):
        common_fields.append(("X-Page-ID", number))
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not error and not (sep and head.startswith(b"HTTP/")):
        error = "no HTTP header"
    about = [("source-block-digest", fields.get("warc-block-digest", "")), ("source-payload-digest", fields.get("warc-payload-digest", ""))]
    if not error:
        status, *headers = head.decode("latin-1").split("\r\n")
        told_headers = [(k.strip().lower(), v.strip()) for k, _, v in (h.partition(":") for h in headers)]
        header = dict(told_headers)
        entity, ended = unchunked(payload) if "chunked" in header.get("transfer-encoding", "").lower() else (payload, True)
        charset = re.search(r"charset=[\"']?([\w-]+)", header.get("content-type", ""), re.I)
        noted: dict[str, str] = {} if ended else {"payload-truncated": "chunked"}
        try:
            page = Page.of(_decoded(unpacked(entity, header.get("content-encoding", ""), noted), charset[1] if charset else "utf-8"))
        except ValueError as e:
            error = str(e)
    if error:
        body = [*about, ("derivation-error", error)]
        return record("metadata", [("WARC-Record-ID", identifier("metadata", source)), *common_fields, ("Content-Type", "application/warc-fields")], _fields(body)), None
    if (told := fields.get("warc-payload-digest", "")).startswith("sha1:") and told not in (digest(entity), digest(payload)):
        about.append(("payload-digest-mismatch", digest(entity)))
    about += noted.items()
    text = page.text.encode("utf-8", "replace")
    converted = identifier("conversion", source)
    about += [("http-status", status), *((f"http-header-{k}", v) for k, v in told_headers)]
    about += [("title", page.title), ("links", str(page.links)), ("characters", str(len(text.decode())))]
    metadata = record("metadata", [("WARC-Record-ID", identifier("metadata", source)), *common_fields, ("WARC-Concurrent-To", converted), ("Content-Type", "application/warc-fields")], _fields(about))
    conversion = record("conversion", [("WARC-Record-ID", converted), *common_fields, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(text))], text)
    return metadata, conversion


def _fields(rows: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {_one_line(v)}\r\n" for k, v in rows).encode("utf-8", "replace")


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: response records of the table of fetched pages."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id")
            made = [response(*row) for row in zip(ids.to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], ["page_id", "record"])

    return common.in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), step, "page_id long, record binary")


def records_of(uri: str) -> Iterator[bytes]:
    """The records of a WARC file, of gzip members or plain."""
    system, path = common.open_fs(uri)
    with system.open_input_file(path) as f:
        packed = f.read(2) == b"\x1f\x8b"
    if packed:
        yield from members(uri)
        return
    with system.open_input_stream(path, compression=None) as f:
        rest = b""
        while True:
            while (cut := rest.find(b"\r\n\r\n")) < 0 and (more := f.read(1 << 20)):
                rest += more
            if cut < 0:
                if rest.strip():
                    yield rest
                return
            size = re.search(rb"(?im)^content-length:\s*(\d+)", rest[:cut])
            end = cut + 4 + (int(size[1]) if size else 0)
            while len(rest) < end + 4 and (more := f.read(1 << 20)):
                rest += more
            yield rest[:end]
            rest = rest[end:].lstrip(b"\r\n")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            for raw in records_of(uri):
                head, whole, _ = raw.partition(b"\r\n\r\n")
                if not whole or b"\r\nwarc-type: response\r\n" in head.lower() + b"\r\n":  # of one whose header is cut, nobody knows
                    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["record"])


def read_responses(spark, path: str) -> DataFrame:
    """record: the response records of WARC files (a path or a pattern), cut ones too; a file is read by one task, record by record."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return common.in_batches(files.repartition(common.partitions(spark)), _open, "record binary")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    name = f"derived-{TaskContext.get().partitionId():06d}.warc.gz"
    system, path = common.open_fs(f"{folder}/{name}")
    own, n = f"{path}.{TaskContext.get().taskAttemptId()}", 0
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        with system.open_output_stream(own) as out:
            for batch in batches:
                for raw in batch.column("record"):
                    for made in derive(raw.as_py() or b""):
                        if made is not None:
                            press = zlib.compressobj(6, wbits=31)
                            out.write(press.compress(made) + press.flush())
                            n += 1
    except BaseException:
        system.delete_file(own)
        raise
    if not n:
        system.delete_file(own)
        return
    system.move(own, path)
    yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the derivatives of response records; name, n_records of each file."""
    return common.written(common.in_batches(records.select("record"), partial(_write, folder=folder), "name string, n_records long"), "manifest")


_MEMBER = b"\x1f\x8b\x08"


def members(uri: str) -> Iterator[bytes]:
    """The records of a file of gzip members. Of one that is cut or damaged, what can be read; after damage, reading goes on at the next member's mark."""
    system, path = common.open_fs(uri)
    with system.open_input_stream(path, compression=None) as f:
        rest, press, parts = b"", None, []
        while True:
            data = rest or f.read(1 << 20)
            if not data:
                break
            press = press or zlib.decompressobj(wbits=31)
            try:
                parts.append(press.decompress(data))
                rest = press.unused_data
                ended = press.eof
            except zlib.error:
                ended = True
                rest = data[1:] + f.read(2)
                while (mark := rest.find(_MEMBER)) < 0 and (more := f.read(1 << 20)):
                    rest = rest[-2:] + more
                rest = rest[mark:] if mark >= 0 else b""
            if ended:
                yield b"".join(parts)
                press, parts = None, []
        if press is not None:
            yield b"".join([*parts, press.flush()])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    names = [f.strip().rsplit(" ", 1) for f in _ROWS.split(",")]
    types = {"long": pa.int64(), "string": pa.string()}
    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows, metadata = [], None
            for raw in members(f"{folder}/{name}"):
                fields, block = parse(raw)
                if fields["warc-type"] == "metadata":
                    if metadata:
                        rows.append(_row(metadata, None))
                    metadata = (fields, block)
                    if "warc-concurrent-to" not in fields:
                        rows.append(_row(metadata, None))
                        metadata = None
                else:
                    rows.append(_row(metadata, (fields, block)))
                    metadata = None
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])
                    rows = []
            if metadata:
                rows.append(_row(metadata, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])


def _row(metadata: tuple[dict, bytes], conversion: tuple[dict, bytes] | None) -> tuple:
    fields, block = metadata
    about = {k: v for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")) if k}
    page = fields.get("x-page-id")
    made, text = conversion or ({}, None)
    if conversion and (made["warc-refers-to"] != fields["warc-refers-to"] or made["warc-record-id"] != fields["warc-concurrent-to"]):
        raise ValueError(f"unlinked records: {fields['warc-record-id']}")
    return (
        int(page) if page else None, fields["warc-refers-to"], fields["warc-record-id"], made.get("warc-record-id"), fields["warc-target-uri"], about["source-payload-digest"],
        fields["warc-block-digest"], made.get("warc-block-digest"), hashlib.sha256(text).hexdigest() if conversion else None, len(text.decode()) if conversion else None, int(about["links"]) if "links" in about else None, about.get("derivation-error"),
    )


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each source record, from the files."""
    n = common.partitions(manifest.sparkSession)
    return common.in_batches(manifest.select("name").repartition(n), partial(_read, folder=folder), _ROWS)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "warc")
    return read(write(responses(common.table(spark, sf_dir, "pages")), folder), folder)
