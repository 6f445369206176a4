import hashlib
import zlib
from base64 import b32encode

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from tapeloom.llm import token_file as tf, warc
from tapeloom.llm.files import read_bytes, shared_folder, write_bytes
from tapeloom.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2 ** 32 - 1)), max_size=300))
def test_codes_round_trip(values):
    control, data = tf.encode_ranks(np.array(values, np.uint32))
    assert tf.decode_ranks(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_broken_files_are_errors():
    blob = tf.pack_file([1, 2], [2, 1], np.array([5, 300, 70_000], np.uint32))
    keys, counts, ranks = tf.unpack_file(blob)
    assert keys.tolist() == [1, 2] and counts.tolist() == [2, 1] and ranks.tolist() == [5, 300, 70_000]
    for bad in (blob[:-1], blob + b"x", b"x" + blob[1:], blob[:20]):
        with pytest.raises(ValueError):
            tf.unpack_file(bad)


def test_encoder_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [t for _, t, _, _ in rows] + ["it's we'll 'tis ''s don'T", "x́é y　z w", "a<|startoftext|>b", "İIiı ΟΔΟΣ ΣΑΣ", "１２3½Ⅷ", "\x00\x1f \x85q"]
    got = tf.WordEncoder(tokenizer_path()).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]


def test_encoder_in_mixed_batches(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    odd = ["ab\0Cd", "foo x\0 bar", "ab\0Cd \0E x\0", "a\u0558b", "x\u088f\u088fy z", "<|EndOfText|> q", "q\u0378", "e\u0301 \u0301x", "a\u2003b\u3000c\x85d", "\u0390 \u1fd3"]
    odd += ["it's IT'S 'sure ''s .'s 're've'll'LL'd'm x'", "'", "a'", "'t", "a1b23-c--d_e", "don't-can't'", "9's", "é's é'S a'é", "J\u030c j\u030c I\u0307", "x'lL\nl'l l"]
    plain = ["ab Cd  E x ", "x y", "ab cd e x", "", None, "Foo FOO foo", "  "] * 30
    batch = [t for i, p in enumerate(plain) for t in (p, odd[i % len(odd)])]
    for text, ids in zip(batch, tf.WordEncoder(tokenizer_path()).encode(batch)):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert tf.WordEncoder(tokenizer_path()).encode([]) == []


def test_encoder_agrees_on_every_code_point():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(tokenizer_path()), tf.WordEncoder(tokenizer_path())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    for at in range(0, len(points), 4000):
        texts = [f"ab{c}cd {c}1 {c}" for c in points[at:at + 4000]]
        want = whole.encode_batch(texts, add_special_tokens=False)
        bad = [hex(ord(t[2])) for t, w, got in zip(texts, want, encoder.encode(texts)) if got.tolist() != w.ids]
        assert not bad, bad[:20]


def test_token_files_hold_all_documents_in_order(spark, docs, rows, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    manifest, ranks = tf.write_token_files(docs, tokenizer_path())
    out = tf.checksums(manifest, ranks).collect()
    at, got = 0, {}
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t, _, _ in rows:
        x = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    freq = ranks.orderBy("rank").collect()
    assert [r["rank"] for r in freq] == list(range(len(freq))) and all(a.n >= b.n for a, b in zip(freq, freq[1:]))


def test_no_documents_give_no_token_file(nothing):
    manifest, ranks = tf.write_token_files(nothing, tokenizer_path())
    assert manifest.count() == 0 and tf.checksums(manifest, ranks).count() == 0


PAGES = [(1, "http://a/1", "<html>one</html>"), (2, "http://a/2", "<html>one</html>"), (9, "http://a/ä b\r\nX: y", "<html>one</html>"),
         (3, None, None), (4, "u", ""), (5, "u", "é" * 3000), (None, "n", "<html>one</html>"), (None, "n", "alone"), (None, "m", "alone"),
         (6, "u", "same id"), (6, "u", "same id"), (7, "u", "a\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, d string")


def test_archives_give_every_page_back(spark):
    manifest = warc.write_archives(pages(spark))
    out = warc.read_archives(manifest, payload=True).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out)
    want = []
    for p, _, html in PAGES:
        body = (html or "").encode()
        top = max((q for q, _, h in PAGES if (h or "") == (html or "") and q is not None), default=None)
        kind = "response" if top is None or p == top else "revisit"
        want.append((str(p), len(body), b32encode(hashlib.sha1(body).digest()).decode(), kind, str(top) if kind == "revisit" else "None"))
    assert got == sorted(want)
    bodies = {r.page_id: bytes(r.payload) for r in out if r.record_type == "response" and r.page_id}
    assert bodies[5] == ("é" * 3000).encode() and bodies[7] == b"a\r\n\r\nWARC/1.1\r\n"
    assert all("\r" not in r.url and "\n" not in r.url for r in out)


def test_archive_format(spark):
    many = [(i, f"http://h/{i}", f"<html><body><h1>Page {i}</h1>" + f"<p>paragraph {i % 7} of the page</p>" * 20) for i in range(300)]
    manifest = warc.write_archives(pages(spark, many))
    blob = read_bytes(manifest.first().path)
    assert blob[:4] == warc.DICTIONARY_FRAME
    size = int.from_bytes(blob[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(blob[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(blob[8 + size:])
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and first.count(b"WARC/1.1") == 1
    assert manifest.count() > 0 and sum(r.n_records for r in manifest.collect()) == 300
    for bad in (blob[:-5], blob[:8 + size] + b"junk" + blob[8 + size:], blob[:6]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


def test_bad_records_are_errors():
    good = warc.build_record(1, "u", b"body")
    assert warc.parse_record(good)[:5] == (1, 4, warc.digest(b"body"), "response", None)
    for bad in (good[:-1], good.replace(b"body", b"bode"), good.replace(b"WARC-Type: response", b"WARC-Type: other"),
                good.replace(b"Content-Length: 4", b"Content-Length: 5"), b"x" + good):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_no_pages(spark):
    manifest = warc.write_archives(pages(spark, []))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_files_in_the_shared_folder(spark):
    path = f"{shared_folder(spark, 'test')}/a/b.bin"
    write_bytes(path, b"\x00\x01")
    assert read_bytes(path) == b"\x00\x01"
