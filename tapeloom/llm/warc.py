"""Web archives in Zstandard: one frame per record, a shared dictionary in a leading skippable frame."""

import hashlib
import uuid
from base64 import b32encode

import pandas as pd
import zstandard
from pyspark.sql import functions as F

from ..functions.storage import cut
from .common import shuffle_partitions
from .files import read_bytes, shared_folder, write_bytes

# Magic numbers of the formats.
DICTIONARY_FRAME = bytes.fromhex("5d2a4d18")
ZSTD_FRAME = bytes.fromhex("28b52ffd")

FILE_BYTES = 8 << 20
PIECE = 1 << 16  # fed to the decompressor at once; what follows a frame is read again with the next one
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16


def record_id(page_id):
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name):
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"unknown record id {name}")
    value = name[len("<urn:page:"):-1]
    return None if value == "none" else int(value)


def digest(payload):
    return b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url, payload, refers_to=None, revisit=False):
    """The bytes of one record: WARC headers, HTTP headers and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
               ("WARC-Target-URI", target or record_id(page_id)[1:-1]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
               ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def _headers(data, start, first):
    """({lower-case name: value}, end) of a header block that begins with the line ``first``."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0 or not data.startswith(first, start):
        raise ValueError("broken header block")
    lines = data[start:end].decode("utf-8").split("\r\n")[1:]
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in found:
            raise ValueError(f"bad header line {line!r}")
        found[name.lower()] = value.strip()
    return found, end + 4


def parse_record(data):
    """One validated record: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload).

    Errors: missing or repeated headers, a block that is not as long as ``Content-Length``, digests that do not match, a
    revisit without the record it refers to.
    """
    head, start = _headers(data, 0, b"WARC/1.1\r\n")
    kind, length = head["warc-type"], int(head["content-length"])
    block = data[start:start + length]
    if len(block) != length or data[start + length:] != b"\r\n\r\n":
        raise ValueError("record length does not match Content-Length")
    if head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest does not match")
    http, at = _headers(block, 0, b"HTTP/1.1 200 OK\r\n")
    size, value = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload, refers_to = block[at:], None
        if len(payload) != size or digest(payload) != value:
            raise ValueError("payload does not match its length or digest")
    elif kind == "revisit":
        payload, refers_to = None, page_of(head["warc-refers-to"])
        if at != len(block):
            raise ValueError("revisit with a payload")
    else:
        raise ValueError(f"unknown record type {kind}")
    return page_of(head["warc-record-id"]), size, value, kind, refers_to, head["warc-target-uri"], payload


def dictionary_frame(dictionary):
    return DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""


def read_archive(blob):
    """Records of one archive, in order: the leading dictionary if there is one, then exactly one frame per record."""
    at, loaded = 0, None
    if blob[:4] == DICTIONARY_FRAME:
        size = int.from_bytes(blob[4:8], "little")
        content, at = blob[8:8 + size], 8 + size
        if len(content) != size:
            raise ValueError("dictionary is cut")
        if content[:4] == ZSTD_FRAME:
            content = zstandard.ZstdDecompressor().decompress(content)
        loaded = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
    view = memoryview(blob)
    while at < len(blob):
        if view[at:at + 4] != ZSTD_FRAME:
            raise ValueError("expected a frame")
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at:at + PIECE]
            if not piece:
                raise ValueError("frame is cut")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def train_dictionary(pages, html="html"):
    """A dictionary from at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_BYTES`` bytes each, those of smallest hash."""
    some = pages.where((F.octet_length(html) > 0) & (F.octet_length(html) <= SAMPLE_BYTES)).select(F.xxhash64(html).alias("h"), F.col(html).alias("t"))
    texts = [r.t.encode("utf-8", "replace") for r in some.orderBy("h", "t").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) > 10 else b""
    except zstandard.ZstdError:  # too little to learn from: archives without a dictionary
        return b""


def write_archives(pages, folder=None, page_id="page_id", url="url", html="html"):
    """Write one record per page to archives of about ``FILE_BYTES``; returns the stored manifest (path, n_records, n_bytes).

    Of pages with equal payloads the one with the largest id is a response, the others are revisits that refer to it.
    Groups are counted by digest with map-side combine; only digests with several pages are joined back, spread over
    ``SALTS`` parts, so a payload that a third of all pages share does not meet in one task.

    NULL html is an empty payload. A NULL id is smaller than any other and is written as ``none``; repeated rows of the
    largest id, and groups of NULL ids alone, are all responses. Characters a header line cannot hold are percent-encoded
    in the URL; without a URL the record's own name stands there. No pages give no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    dictionary = train_dictionary(pages, html)
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"),
                        F.coalesce(html, F.lit("")).alias("t")).withColumn("d", F.sha1(F.col("t").cast("binary")))
    groups = rows.groupBy("d").agg(F.max("p").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    groups = groups.select(F.col("d").alias("_d"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = rows.withColumn("s", F.pmod(F.xxhash64("p", "u"), F.lit(SALTS)).cast("int"))
    marked = salted.join(groups, (F.col("d") == F.col("_d")) & (F.col("s") == F.col("_s")), "left").select(
        F.col("p").cast("string").alias("p"), "u", "t", F.col("top").cast("string").alias("top"))

    def write(batches):
        parts, records, held = [], 0, 0
        loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if loaded:
            loaded.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=loaded) if loaded else zstandard.ZstdCompressor(level=3)

        def flush():
            nonlocal parts, records, held
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            blob = dictionary_frame(dictionary) + b"".join(parts)
            write_bytes(path, blob)
            row = pd.DataFrame({"path": [path], "n_records": [records], "n_bytes": [len(blob)]})
            parts, records, held = [], 0, 0
            return row

        for batch in batches:
            for p, u, t, top in zip(batch["p"], batch["u"], batch["t"], batch["top"]):  # ids as strings: pandas has no NULL integer
                revisit = top is not None and p != top
                frame = packer.compress(build_record(p, u, t.encode("utf-8", "replace"), top, revisit))
                parts.append(frame)
                records, held = records + 1, held + len(frame)
                if held >= FILE_BYTES:
                    yield flush()
        if parts:
            yield flush()

    return cut(marked.mapInPandas(write, "path string, n_records long, n_bytes long"))


def read_archives(manifest, payload=False):
    """One row per record of the archives in ``manifest``; ``payload=True`` adds the URL and the payload of responses."""
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    keep = names if payload else names[:5]

    def read(batches):
        for batch in batches:
            for path, n in zip(batch["path"], batch["n_records"]):
                found = list(read_archive(read_bytes(path)))
                if len(found) != n:
                    raise ValueError(f"{path} holds {len(found)} records, its manifest says {n}")
                rows = pd.DataFrame(found, columns=names)[keep]
                for c in ("page_id", "refers_to"):
                    rows[c] = pd.array([None if pd.isna(v) else int(v) for v in [r[names.index(c)] for r in found]], "Int64")
                yield rows

    spread = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path")
    return spread.mapInPandas(read, columns + (", url string, payload binary" if payload else ""))
