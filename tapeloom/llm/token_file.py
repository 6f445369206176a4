"""Token ids in binary files: frequency-ranked, byte-aligned, with the control bytes apart from the data bytes.

A file holds documents in order::

    magic b"TIDR1\\n\\0\\0" | documents, ids, control bytes, data bytes: 4 x uint64
    document keys: int64 each, lowest value for NULL | ids per document: uint32 each
    control bytes | data bytes

An id is stored as its frequency rank. A control byte gives the lengths of four values, two bits each, lowest first: a
rank takes 1 to 4 bytes, little-endian. The table from rank to id is one row per id in the folder ``ranks``.
"""

from functools import lru_cache
import unicodedata
import uuid
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Window, functions as F

from ..functions.storage import cut
from . import textmath
from .common import shuffle_partitions, small_batches
from .files import read_bytes, shared_folder, write_bytes

MAGIC = b"TIDR1\n\0\0"
NO_KEY = -(1 << 63)
FILE_IDS = 2_000_000
CACHE_WORDS = 1_000_000

# Fixed value: how the tokenizer file splits a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

# What the tokenizer does not treat as Python does: separators that only Python splits at, and U+0000.
UNLIKE = ["\x1c", "\x1d", "\x1e", "\x1f", "\x00"]

LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ranks(values):
    """(control, data) bytes of an array of ranks."""
    values = np.ascontiguousarray(values, np.uint32)
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF) + np.uint8(1)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[:len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control, data, count):
    """The ranks; lengths come from a table with a row of four per control byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    start = np.cumsum(size, dtype=np.int64) - size
    if size.sum() != len(data):
        raise ValueError("control bytes do not match the data bytes")
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for byte in range(1, 4):
        at = np.flatnonzero(size > byte)
        out[at] |= raw[start[at] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def pack_file(keys, counts, ranks):
    control, data = encode_ranks(ranks)
    head = np.array([len(keys), len(ranks), len(control), len(data)], "<u8").tobytes()
    return b"".join((MAGIC, head, np.asarray(keys, "<i8").tobytes(), np.asarray(counts, "<u4").tobytes(), control, data))


def unpack_file(blob):
    """(keys, counts, ranks) of one file; a wrong magic or length is an error."""
    if blob[:8] != MAGIC or len(blob) < 40:
        raise ValueError("not a token file")
    docs, ids, n_control, n_data = (int(x) for x in np.frombuffer(blob, "<u8", 4, 8))
    if len(blob) != 40 + 12 * docs + n_control + n_data:
        raise ValueError("token file is cut or too long")
    at = 40 + 12 * docs
    counts = np.frombuffer(blob, "<u4", docs, 40 + 8 * docs).astype(np.int64)
    ranks = decode_ranks(blob[at:at + n_control], blob[at + n_control:], ids)
    if counts.sum() != ids:
        raise ValueError("document lengths do not add up")
    return np.frombuffer(blob, "<i8", docs, 40), counts, ranks


def gather(values, begins, sizes):
    """The runs ``values[begin:begin + size]``, one after the other."""
    upto = np.cumsum(sizes)
    return values[np.repeat(begins - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]


class KnownWords:
    """Ids of words by the hash of a word, in arrays: a few sorted parts that point into one array of ids."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.parts, self.ids, self.used = [], np.zeros(1 << 16, np.uint32), 0

    def __len__(self):
        return sum(len(keys) for keys, _, _ in self.parts)

    def add(self, keys, sizes, ids):
        """``keys`` sorted and new; a size of -1 stands for a word without ids of its own."""
        if self.used + len(ids) > len(self.ids):
            room = np.zeros(max(2 * len(self.ids), self.used + len(ids)), np.uint32)
            room[:self.used] = self.ids[:self.used]
            self.ids = room
        self.ids[self.used:self.used + len(ids)] = ids
        length = np.maximum(sizes, 0)
        part = keys, (self.used + np.cumsum(length) - length).astype(np.uint32), sizes.astype(np.int32)
        self.used += len(ids)
        if not len(keys):
            return
        while self.parts and len(self.parts[-1][0]) < 2 * len(part[0]):
            both = [np.concatenate(pair) for pair in zip(self.parts.pop(), part)]
            order = np.argsort(both[0], kind="stable")
            part = tuple(x[order] for x in both)
        self.parts.append(part)

    def find(self, keys):
        """(begin, size, found) of every key."""
        begins, sizes, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, begin, size in self.parts:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            begins[hit], sizes[hit] = begin[at[hit]], size[at[hit]]
            found |= hit
        return begins, sizes, found


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees every distinct word once.

    A batch of texts is cut at ASCII white space in numpy, pieces of ASCII characters also into words, and equal ones are
    found by 64-bit hashes. The tokenizer's own normalisation (NFC, white space, lower case) and word split run over the
    distinct other pieces, its byte-level BPE model over the distinct words. Texts go whole through the unchanged tokenizer
    if they hold the string of a special token, a character that Python treats in another way, or a code point without a
    character, which tables of different age class differently. Words seen before are kept by their hash, at most ``CACHE_WORDS``.
    """

    def __init__(self, path):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.path, self._whole = path, None
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(r"\n"), "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [str(t.content) for t in self.model.get_added_tokens_decoder().values()] + UNLIKE
        self.known = KnownWords()

    def whole(self, text):
        """Ids by the unchanged tokenizer, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _apart(self, piece):
        """Whether a text with this piece goes whole through the tokenizer."""
        low = piece.lower()
        return any(s in piece or s in low for s in self.special) or (
            not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece))

    def _some_apart(self, pieces):
        """Whether one of many pieces may go apart, found on all of them at once."""
        joined = "\n".join(pieces)
        low = joined.lower()
        return any(x in joined or x in low for x in self.special) or any(unicodedata.category(c) == "Cn" for c in set(joined))

    def _learn(self, tokens):
        """(sizes, ids) of new tokens; size -1 for pieces that send their text whole through the tokenizer."""
        check = self._some_apart([t for t in tokens if not t.isascii()])
        index, parts, counts = {}, [], []
        for token in tokens:
            if token.isascii():
                parts.append(index.setdefault(token, len(index)))
                counts.append(1)
            elif check and self._apart(token):
                counts.append(-1)
            else:
                lowered = unicodedata.normalize("NFC", token).replace("Σ", "σ").lower()
                words = [lowered] if lowered.isalpha() else [w for part in lowered.split() for w in WORDS.findall(part)]
                parts += [index.setdefault(w, len(index)) for w in words]
                counts.append(len(words))
        new, ids, sizes = list(index), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            encoded = self.model.encode("\n".join(part), add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.uint32))
            sizes.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(part)))
        size, parts = np.concatenate(sizes), np.array(parts, np.int64)
        n = size[parts]
        flat = gather(np.concatenate(ids), (np.cumsum(size) - size)[parts], n)
        counts = np.array(counts, np.int64)
        ends, total = np.cumsum(np.maximum(counts, 0)), np.concatenate(([0], np.cumsum(n)))
        return np.where(counts < 0, -1, total[ends] - total[ends - np.maximum(counts, 0)]), flat

    def encode(self, texts):
        """An id array per text."""
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        raw, starts, ends, doc = textmath.words(data, fold=False)
        place = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
        buffer, starts, ends, doc, strange = _tokens(raw, starts, ends, doc)
        apart = set(np.searchsorted(place, np.flatnonzero(strange), "right").tolist())
        joined = buffer.tobytes()
        for s in self.special[:-len(UNLIKE)]:
            at = joined.find(s.encode())
            while at >= 0:
                apart.add(int(np.searchsorted(place, at, "right")))
                at = joined.find(s.encode(), at + 1)
        keys, first, which = np.unique(textmath.word_hashes(buffer, starts, ends), return_index=True, return_inverse=True)
        begins, sizes, found = self.known.find(keys)
        new = np.flatnonzero(~found)
        if len(new):
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = np.arange(len(keys))
            tokens = [joined[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self.known.add(keys[new], *self._learn(tokens))
            begins, sizes, _ = self.known.find(keys)
        missing = sizes < 0
        n = np.maximum(sizes, 0)[which]
        all_ids = gather(self.known.ids, begins[which], n)
        per_text = np.bincount(doc, n, len(texts)).astype(np.int64)
        out = np.split(all_ids, np.cumsum(per_text)[:-1]) if len(texts) else []
        for i in apart | set(np.unique(doc[missing[which]]).tolist()):
            out[i] = self.whole(texts[i])
        return out


# Kinds of ASCII characters in the word split, and the endings that an apostrophe makes a word of their own.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _tokens(raw, starts, ends, doc):
    """Cut the ASCII pieces of a batch into lower-cased words; pieces with other characters stay whole, as they are.

    Returns ``(buffer, starts, ends, doc, strange)``; ``strange`` marks the characters that Python treats in another way.
    """
    strange = np.isin(raw, np.frombuffer("".join(UNLIKE).encode(), np.uint8))
    other = np.concatenate(([0], np.cumsum(raw >= 128)))
    odd = other[ends] > other[starts]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts[odd]], edge[ends[odd]] = 1, -1  # pieces do not touch
    in_odd = np.cumsum(edge[:-1], dtype=np.int8) > 0
    buffer = np.where(in_odd, raw, textmath.LOWER[raw])
    kind = KIND[buffer]
    begin = (kind != 0) & ~in_odd & ((kind == 2) | (kind != np.concatenate(([0], kind[:-1]))))
    padded = np.concatenate((buffer, np.zeros(4, np.uint8)))
    quote = np.flatnonzero(begin & (buffer == 39))
    quote = quote[KIND[padded[quote + 1]] == 1]
    for ending in ENDINGS:
        hit = quote
        for k, c in enumerate(ending, start=1):
            hit = hit[padded[hit + k] == c]
        begin[hit + 1] = False
        after = hit + 1 + len(ending)
        begin[after[KIND[padded[after]] == 1]] = True
    begin[starts[odd]] = True
    at = np.flatnonzero(begin)
    piece = np.searchsorted(starts, at, "right") - 1
    until = np.minimum(np.append(at[1:], len(raw)), ends[piece]) if len(at) else at
    return buffer, at, until, doc[piece], strange


@lru_cache(maxsize=1)
def _encoder(path, job):
    """The encoder that the tasks of one job share in a worker; the words of a job before are dropped with its encoder."""
    return WordEncoder(path)


def _batches(texts, size=1 << 20):
    """Index ranges of about ``size`` characters."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > first and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def _id_type(tokenizer, end_id):
    """Two bytes an id between tasks if the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return "<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4"


def write_token_files(docs, tokenizer, folder=None, text="text", doc_id="doc_id", end_id=2):
    """Write all documents, ordered by id, to token files; returns the stored manifest and the table of ranks.

    ``tokenizer``: path of a tokenizer file of the tokenizers library, the same on every machine. Every text is encoded
    once, whole, and ``end_id`` follows it. Ids are counted over the whole corpus, ranked by falling frequency and
    stored as ranks; the table of ranks is bounded by the vocabulary. A file takes about ``FILE_IDS`` ids. The manifest has
    (part, nth, path, n_docs, n_ids); ``part`` and ``nth`` give the order.

    NULL text is empty and gives the end id alone. A NULL id comes first; rows of one id stand next to each other, in
    the order of their ids. No documents give no file. Columns besides the two are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "tokens")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_KEY)).alias("k"), F.col(text).alias("t"))
    kind = _id_type(tokenizer, end_id)

    def encode(batches):
        for batch in batches:
            texts = batch["t"].tolist()
            for a, b in _batches(texts):
                ids = _encoder(tokenizer, folder).encode(texts[a:b])
                yield pd.DataFrame({"k": batch["k"].to_numpy()[a:b],
                                    "ids": [np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in ids]})

    plain = _with_codec(rows.mapInPandas(encode, "k long, ids binary"))

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch["ids"]), kind), minlength=len(total))
            part[:len(total)] += total
            total = part
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    order = Window.orderBy(F.desc("n"), "id")
    counts = plain.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = cut(counts.select("id", "n", (F.row_number().over(order) - 1).cast("long").alias("rank")))
    table = ranks.orderBy("id").toPandas()  # one row per vocabulary entry
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"].to_numpy()] = table["rank"].to_numpy()

    def write(batches):
        from pyspark import TaskContext

        width = np.dtype(kind).itemsize
        part, nth, keys, blobs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal nth, keys, blobs, held
            ids = np.frombuffer(b"".join(blobs), kind)
            path = f"{folder}/part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.ids"
            write_bytes(path, pack_file(keys, [len(b) // width for b in blobs], rank_of[ids]))
            row = pd.DataFrame({"part": [part], "nth": [nth], "path": [path], "n_docs": [len(keys)], "n_ids": [len(ids)]})
            nth, keys, blobs, held = nth + 1, [], [], 0
            return row

        for batch in batches:
            for key, blob in zip(batch["k"], batch["ids"]):
                keys.append(key)
                blobs.append(blob)
                held += len(blob) // width
                if held >= FILE_IDS:
                    yield flush()
        if keys:
            yield flush()

    placed = plain.repartitionByRange(shuffle_partitions(spark), "k", F.xxhash64("ids")).sortWithinPartitions("k", "ids")
    return cut(placed.mapInPandas(write, "part int, nth int, path string, n_docs long, n_ids long")), ranks


def _with_codec(df):
    """Store ids once, compressed; they are read twice."""
    spark = df.sparkSession
    path = shared_folder(spark, "ids")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_token_files(manifest, ranks, per_document):
    """Decode every file; ``per_document(key, start, ids)`` makes the output columns of one document.

    ``start`` counts the ids of all documents before it: the manifest's running total (one row per file) and the lengths
    in the file.
    """
    spark = manifest.sparkSession
    table = ranks.orderBy("rank").toPandas()
    id_of = table["id"].to_numpy().astype("<u4")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids")
    files = files.repartition(shuffle_partitions(spark), "path")

    def read(batches):
        for batch in batches:
            for path, start, n_docs, n_ids in batch[["path", "start", "n_docs", "n_ids"]].itertuples(index=False):
                keys, counts, held = unpack_file(read_bytes(path))
                if len(keys) != n_docs or len(held) != n_ids:
                    raise ValueError(f"{path} does not match its manifest")
                ids, ends = id_of[held], np.cumsum(counts)
                yield per_document(keys, start + ends - counts, ids, ends, counts)

    return files, read


def checksums(manifest, ranks):
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def digest(keys, starts, ids, ends, counts):
        doc_id = pd.array(keys, "Int64")
        doc_id[keys == NO_KEY] = pd.NA
        return pd.DataFrame({"doc_id": doc_id,
                             "start": starts, "n_tokens": counts,
                             "ids_crc32": [zlib.crc32(ids[e - c:e].tobytes()) for e, c in zip(ends, counts)]})

    files, read = read_token_files(manifest, ranks, digest)
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
