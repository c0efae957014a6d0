"""WARC archives: writing with Spark's own writer, and reading back with segment reassembly.

An archive is gzipped text that Spark writes, so any store that Spark reaches will do; a file has the records of one task.
Payloads go out in chunked transfer framing; a chunk ends inside every version line in a payload. Blocks above SEGMENT become a
first record and continuation records; reading groups them by origin identifier, orders them by segment number, checks the total
length, and decodes the framing. Archives of other writers are read too, WARC/1.0 or 1.1, gzipped as a whole or by record: Spark
cuts a file at version marks, and Content-Length says how many of the pieces belong to a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm.arrow import small_batches

VERSION = b"WARC/1.1"
SEPARATOR = "WARC/1.1\r\n"
#: Where Spark's reader cuts files: before the minor version of any record, and wherever else a payload holds these bytes.
MARK = "WARC/1."
#: Equal payloads below this are each written in full.
REVISIT_BYTES = 1000
CHUNK, SEGMENT = 32 << 10, 256 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _ends(data: bytes, step: int) -> list[int]:
    """Places to cut data at about every `step` bytes: between characters, inside every version line, never right after one."""
    cuts, at = [], 0
    inside = [m.start() + 4 for m in re.finditer(re.escape(VERSION), data)]
    for limit in [*inside, len(data)]:
        while at < limit:
            end = min(at + step, limit)
            while end < len(data) and end > at + 1 and (data[end] & 0xC0) == 0x80:
                end -= 1
            if end < len(data) and data[max(0, end - len(VERSION)) : end] == VERSION:
                end -= 1
            cuts.append(end)
            at = end
    return cuts


def chunked(payload: bytes) -> bytes:
    out, at = [], 0
    for end in _ends(payload, CHUNK):
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Decode chunked framing: size lines in hexadecimal, extensions and trailers ignored. ValueError if it is damaged."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if n < 0 or line + 2 + n + 2 > len(body) or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("damaged chunk")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def record_id(page_id: int | None, sha256: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha256}/{copy}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    """A record from its version line on, without its last line end, which the writer adds."""
    said = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"{SEPARATOR}{said}\r\n" + block.decode() + "\r\n"


def _uri(url: str | None) -> str:
    return urllib.parse.quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._").replace("WARC/", "WARC%2F")


def records(page_id: int | None, url: str | None, html: bytes | None, sha1: str, sha256: str, copy: int, refers_to: int | None) -> list[str]:
    """The records of one page: a revisit, which needs no html, or a response with its continuations."""
    own = record_id(page_id, sha256, copy)
    head: list[tuple[str, object]] = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Page-ID", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha256, 1))], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html or b"")
    if len(block) <= SEGMENT:
        return [_record([("WARC-Type", "response"), *head], block)]
    out, at, ends = [], 0, _ends(block, SEGMENT)
    for i, end in enumerate(ends):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(ends) - 1 else []
        if i == 0:
            out.append(_record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)], block[:end]))
        else:
            out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, sha256, -i * (1 << 20) - copy)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i + 1), *total], block[at:end]))
        at = end
    return out


def write_warc(pages: DataFrame, path: str) -> None:
    """A record per row of (page_id, url, html) under path.

    Of rows with equal payloads of at least 1000 bytes the largest page_id is the response; the others revisit it.

    Edge cases: null html is the empty payload; a null url is empty; control characters in a url are percent-encoded. Null
    page_ids count as less than any. Rows that repeat both payload and the largest page_id are all responses. An empty table
    writes archives without records. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha2("html", 256))
    digests, _ = scratch.stored(own.select("page_id", "sha", (F.octet_length("html") >= REVISIT_BYTES).alias("large")), "payload-digests")
    twice, _ = scratch.stored(digests.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "top"), "repeated-payloads")
    # One bit for each of 2^24 digest prefixes, 64 to a row: whatever the corpus weighs, 2^18 rows at most are broadcast. Payloads whose bit is
    # clear occur once and are written where they are read; only the others are shuffled.
    slot = F.conv(F.substring("sha", 1, 6), 16, 10).cast("long")
    bits = twice.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_slot % 64))")).alias("_bits"))
    marked = own.withColumn("_slot", slot).join(F.broadcast(bits), F.floor(F.col("_slot") / 64) == F.col("_word"), "left")
    marked = marked.withColumn("_again", F.coalesce(F.expr("shiftright(_bits, int(_slot % 64)) & 1L = 1L"), F.lit(False))).select("page_id", "url", "html", "sha", "_again")
    visits = digests.where("large").join(twice.select(F.col("sha").alias("_sha"), "top"), (F.col("sha") == F.col("_sha")) & ((F.col("page_id") < F.col("top")) | (F.col("page_id").isNull() & F.col("top").isNotNull())))
    visits = visits.select(F.col("page_id").alias("_page"), "_sha", "top").distinct()
    again = marked.where("_again").join(visits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    # Rows of one page and payload get different record ids. Nothing refers to a record without page_id, of which there may be many: those need no order.
    named = again.where("page_id is not null").withColumn("copy", F.row_number().over(W.partitionBy("page_id", "sha").orderBy("url")).cast("long"))
    again = named.unionByName(again.where("page_id is null").withColumn("copy", F.monotonically_increasing_id() + 2))
    once = marked.where("not _again").withColumn("copy", F.lit(1).cast("long")).withColumn("top", F.lit(None).cast("long"))
    cols = ["page_id", "url", "html", "sha", "copy", "top"]
    rows = once.select(cols).unionByName(again.select(cols))
    rows = rows.select("page_id", "url", F.when(F.col("top").isNull(), F.col("html")).alias("html"), F.sha1("html").alias("sha1"), "sha", "copy", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [part.column(n) for n in ("page_id", "url", "html", "sha1", "sha", "copy", "top")]
                cols[2] = cols[2].cast(pa.binary())
                out = [line for row in zip(*(c.to_pylist() for c in cols), strict=True) for line in records(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _starts(piece: bytes) -> bool:
    """A piece that begins a record: the minor version, a line end, and headers that name a record's type or identifier."""
    head = piece[: piece.find(b"\r\n\r\n") + 1]
    return re.match(rb"\d\r\n", piece) is not None and re.search(rb"(?i)\nwarc-(record-id|type)[ \t]*:", head) is not None


class Records:
    """Puts the pieces of one file between marks together to records: (headers by lower-case name, block, whether it is whole).

    Content-Length tells where a record ends: what looks like a version line before that belongs to the block, and the mark is put back.
    Where lengths and pieces disagree, the record is damaged and ends before the next piece that begins one. It holds one record at a time.
    """

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.size, self.end = 0, None

    def _take(self, piece: bytes) -> None:
        self.size += len(piece) + (len(MARK) if self.pieces else 0)
        self.pieces.append(piece)
        if self.end is None and (said := self._headers(raw := MARK.encode().join(self.pieces))) is not None:
            self.end = raw.index(b"\r\n\r\n") + 4 + said[1]

    @staticmethod
    def _headers(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
        """Headers and the length of the block, once they are complete."""
        head, found, _ = raw.partition(b"\r\n\r\n")
        if not found:
            return None
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
        said = headers.get(b"content-length", b"")
        return headers, int(said) if said.isdigit() else 0

    def _close(self) -> Iterator[tuple[dict[bytes, bytes], bytes, bool]]:
        pieces, end = self.pieces, self.end
        self.pieces, self.size, self.end = [], 0, None
        raw = MARK.encode().join(pieces)
        agrees = end is not None and len(raw) >= end and not raw[end:].strip(b"\r\n")
        cut = len(pieces) if agrees else next((i for i in range(1, len(pieces)) if _starts(pieces[i])), len(pieces))
        if cut < len(pieces):
            raw = MARK.encode().join(pieces[:cut])
        if (said := self._headers(raw)) is not None:
            block = raw.partition(b"\r\n\r\n")[2]
            yield said[0], block[: said[1]], len(block) >= said[1]
        for piece in pieces[cut:]:
            yield from self.add(piece)

    def add(self, piece: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, bool]]:
        while self.pieces and (_starts(piece) if self.end is None else self.size >= self.end):
            yield from self._close()
        if self.pieces or _starts(piece) or re.match(rb"\d\r\n", piece) and b"\r\n\r\n" not in piece:  # headers may hold a mark too
            self._take(piece)

    def done(self) -> Iterator[tuple[dict[bytes, bytes], bytes, bool]]:
        """What is held at the end of a file."""
        while self.pieces:
            yield from self._close()


def _payload(block: bytes) -> bytes:
    """The entity of an HTTP message, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


_OUT = "record_id string, record_type string, page_id long, url string, said_digest string, refers_to_id string, segment int, origin string, total long, payload_bytes long, payload_digest string, whole boolean, block binary"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]


def _decoded(block: bytes, keep: bool) -> tuple[int | None, str | None, bool, bytes | None]:
    try:
        payload = _payload(block)
    except ValueError:
        return None, None, False, None
    return len(payload), hashlib.sha1(payload).hexdigest(), True, payload if keep else None


def _row(headers: dict[bytes, bytes], block: bytes, whole: bool, keep: bool) -> list:
    get = lambda k: headers[k].decode("utf-8", "replace") if headers.get(k) else None
    number = lambda k: int(v) if (v := get(k)) and v.lstrip("-").isdigit() else None
    kind, segment, digest = get(b"warc-type"), number(b"warc-segment-number"), get(b"warc-payload-digest")
    row = [get(b"warc-record-id"), kind, number(b"warc-page-id"), get(b"warc-target-uri"), _hex_sha1(digest), get(b"warc-refers-to"), segment]
    row += [get(b"warc-segment-origin-id") or (row[0] if segment else None), number(b"warc-segment-total-length")]
    if segment:
        return [*row, None, None, whole, block]
    if kind == "response":
        n, own, fine, payload = _decoded(block, keep)
        return [*row, n, own, whole and fine, payload]
    return [*row, None, None, whole, None]


def _hex_sha1(digest: str | None) -> str | None:
    """A digest header as hexadecimal SHA-1; other writers give it in base 32."""
    said = (digest or "").removeprefix("sha1:")
    if len(said) == 32:
        try:
            return base64.b32decode(said, casefold=True).hex()
        except ValueError:
            pass
    return said.lower() or None


def _read_records(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, rows, size = None, Records(), [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for piece, path in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = []
                    if path != file:  # files follow each other in a task
                        found, file = list(held.done()), path
                    for r in (*found, *held.add(piece)):
                        rows.append(_row(*r, keep))
                        size += len(r[1])
                    if len(rows) >= 256 or size >= 8 << 20:
                        yield made()
                        rows, size = [], 0
        rows += [_row(*r, keep) for r in held.done()]
        if rows:
            yield made()

    return run


def _assemble(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (parts,) = batch.slice(i, 1).column("parts").to_pylist()
                parts.sort(key=lambda p: p["segment"])
                first, last = parts[0], parts[-1]
                block = b"".join(p["block"] for p in parts)
                whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] == len(block) and all(p["whole"] for p in parts)
                n, digest, fine, payload = _decoded(block, keep)
                row = [first["record_id"], first["record_type"], first["page_id"], first["url"], first["said_digest"], None, None, None, None, n, digest, whole and fine, payload]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], _NAMES)

    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """(record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to, whole[, payload]) of the archives under path.

    A revisit has the size of the response that it refers to, read back, and the digest in its header. `whole` is false
    where a length, a segment, the framing or a digest does not agree; damaged records are kept and named, not dropped. Records of other
    kinds (warcinfo, request) are not answered. A response without a digest header is whole if its length is right.

    A gzipped archive is one task, as gzip cannot be entered midway. An archive that is not compressed is read in splits: a record
    whose payload holds a version mark right where a split begins is named as damaged.
    """
    small_batches(spark)
    pieces = spark.read.option("lineSep", MARK).text(path).select("value", "_metadata.file_path")
    got, _ = scratch.stored(pieces.mapInArrow(_read_records(keep_payload), _OUT), "warc-records")
    parts = got.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block", "whole", "record_id", "record_type", "page_id", "url", "said_digest")).alias("parts"))
    joined = got.where("segment is null").unionByName(parts.mapInArrow(_assemble(keep_payload), _OUT))
    answers = joined.where("record_type = 'response'")
    targets = answers.select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    visits = got.where("record_type = 'revisit'").join(targets, F.col("refers_to_id") == F.col("_id"), "left")
    visits = visits.withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", F.col("said_digest")).withColumn("whole", F.col("whole") & F.coalesce(F.col("_digest") == F.col("said_digest"), F.lit(False)))
    both = answers.withColumn("_page", F.lit(None).cast("long")).withColumn("whole", F.col("whole") & F.coalesce(F.col("payload_digest") == F.col("said_digest"), F.col("said_digest").isNull() & F.col("payload_digest").isNotNull())).unionByName(visits.drop("_id", "_bytes", "_digest"))
    out = ["record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", F.col("_page").alias("refers_to"), "whole"]
    return both.select(*out, *([F.col("block").alias("payload")] if keep_payload else []))
