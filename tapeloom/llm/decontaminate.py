"""Benchmark decontamination: a broadcast hash set of test n-grams, document windows scanned against it, hits verified."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from .common import broadcast_if_small, pack, unpack

# Fixed value: a word is a run of ASCII letters and digits (after lower-casing A-Z) and anything beyond ASCII.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"

BROADCAST_WINDOWS = 500_000
SET_ANCHORS = 50_000


def words_of(text):
    """Normalised words; NULL has none."""
    found = F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD))
    return F.coalesce(found, F.array().cast("array<string>"))


def anchor_shape(length):
    """Size and stride of the anchors for windows of ``length`` words.

    A window covers ``stride`` consecutive starts of anchors, so it holds one that starts at a multiple of ``stride``.
    """
    size = (length + 1) // 2
    return size, length - size + 1


def item_windows(items, item_id="item_id", text="text", window=10):
    """One row per window of each item: ``item``, ``length``, ``window``, ``hash``; a shorter item is one window."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("words"))
    rows = rows.withColumns({"length": F.least(F.size("words"), F.lit(window)), "n": F.size("words")}).where("n > 0")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("length") + 1), lambda i: F.slice("words", i, F.col("length")))
    out = rows.select("item", "length", F.explode(cuts).alias("window")).distinct()
    return out.withColumn("hash", F.xxhash64("window"))


def _anchors(windows, length):
    size, _ = anchor_shape(length)
    grams = F.transform(F.sequence(F.lit(1), F.lit(length - size + 1)), lambda i: F.xxhash64(F.slice("window", i, size)))
    return windows.where(F.col("length") == length).select(F.explode(grams).alias("h")).distinct()


def _candidates(length, anchors):
    """Array of (length, pos, window) of one row's windows that can be an item's: all, or those around a known anchor."""
    n, last = F.size("words"), F.size("words") - length
    if anchors is None:
        starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    else:
        size, stride = anchor_shape(length)
        known = ", ".join(f"{h}L" for h in anchors)
        seen = F.expr(f"filter(sequence(0, size(words) - {size}, {stride}), i -> xxhash64(slice(words, i + 1, {size})) in ({known}))")
        seen = F.when(n >= length, seen)
        back = stride - 1
        spans = F.transform(seen, lambda a: F.struct(F.greatest(a - back, F.lit(0)).alias("low"), F.least(a, last).alias("high")))
        spans = F.filter(spans, lambda s: s["low"] <= s["high"])
        starts = F.flatten(F.transform(spans, lambda s: F.sequence(s["low"], s["high"])))
    cut = F.transform(starts, lambda p: F.struct(F.lit(length).alias("length"), p.alias("pos"), F.slice("words", p + 1, length).alias("window")))
    return F.coalesce(cut, F.array().cast("array<struct<length:int,pos:int,window:array<string>>>"))


def contamination(docs, items, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=10):
    """One row per document: ``doc_id``, ``text_hash``, ``n_words``, ``spans``, ``n_hit``, ``items``.

    The item windows come in two forms: the hashes of their anchors are a set of literals shipped with the scan (up to
    ``SET_ANCHORS``, else every window is a candidate), and the windows themselves are a hash join that verifies the
    candidates word by word (broadcast up to ``BROADCAST_WINDOWS``, else shuffled). Texts are read once and never
    shuffled; only hashes, counts and candidate windows are.

    ``spans``: merged (start, end) word spans inside windows of an item; ``n_hit``: words in them; ``items``: sorted ids, as
    strings. NULL text and NULL items have no words; an item id NULL is called ``null``; rows of one item id are one item;
    items without words match nothing. Repeated documents are reported once per row; a NULL id is kept. No documents
    give no rows; without items nothing is hit. Other columns are not read.
    """
    windows = item_windows(items, item_id, item_text, window)
    found = {r.length: r.n for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("words"))
    parts = []
    for length, n in sorted(found.items()):
        known = _anchors(windows, length)
        known = [r.h for r in known.collect()] if known.count() <= SET_ANCHORS else None
        parts.append(_candidates(length, known))
    row_mark = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("pos"), F.array().cast("array<string>").alias("window")))
    rows = rows.select("doc_id", "text_hash", F.size("words").alias("n_words"),
                       F.posexplode(F.concat(row_mark, *parts)).alias("nth", "c"))
    rows = rows.select("doc_id", "text_hash", "n_words", "nth", "c.*", F.xxhash64("c.window").alias("hash"))
    known = windows.select(F.col("hash").alias("_hash"), F.col("window").alias("_window"), "item")
    if sum(found.values()) <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    hits = rows.join(known, (F.col("hash") == F.col("_hash")) & (F.col("window") == F.col("_window")), "left")
    hits = hits.where((F.col("nth") == 0) | F.col("item").isNotNull())
    span = F.when(F.col("item").isNotNull(), F.struct("pos", (F.col("pos") + F.col("length")).alias("end")))
    out = hits.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(F.col("nth") == 0, 1)).alias("rows"),
        F.array_sort(F.collect_set(span)).alias("hit"), F.array_sort(F.collect_set("item")).alias("items"))
    out = out.withColumn("spans", merged(F.col("hit")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["pos"])
    return out.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), "spans", covered.alias("n_hit"),
                      "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_row")).drop("_row")


def merged(spans):
    """Join overlapping or touching (pos, end) spans of a sorted array."""

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["pos"].alias("pos"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        return F.when(last["end"] >= span["pos"], grown).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _matched(docs, marks, doc_id, text, how):
    """Packed documents joined to the marked ones by id and text hash."""
    key, hashed = F.col("row")[doc_id], F.xxhash64(F.col("row")[text])
    return pack(docs).join(broadcast_if_small(marks), key.eqNullSafe(F.col("_id")) & (hashed == F.col("_text")), how)


def remove_documents(docs, report, doc_id="doc_id", text="text"):
    """Documents without a hit, all columns as they are."""
    return unpack(_matched(docs, _marks(report).select("_id", "_text"), doc_id, text, "left_anti"))


def remove_spans(docs, report, doc_id="doc_id", text="text"):
    """All documents; the words in hit spans go, with what stands between them and the next word, from texts with hits."""
    out = _matched(docs, _marks(report), doc_id, text, "left")
    value = F.col("row")[text]
    other = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(value, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + other + ")"))
    out = out.withColumn("pieces", F.when(F.col("_spans").isNotNull(), pieces))
    kept = F.filter("pieces", lambda w, i: ~F.exists("_spans", lambda s: (s["pos"] <= i) & (i < s["end"])))
    clean = F.when(F.col("_spans").isNull(), value).otherwise(F.array_join(kept, ""))
    return unpack(out, **{text: clean}).select(*[f"`{c}`" for c in docs.columns])


def _marks(report):
    return report.where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"),
                                            F.col("spans").alias("_spans")).dropDuplicates(["_id", "_text"])
