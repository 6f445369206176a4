"""Line dedup by a log-template tree: lines that differ only in variable fields are one template, kept in one document."""

from pyspark.sql import functions as F

from ..functions.skew import join_heavy
from ..functions.storage import cut
from .common import pack, unpack

DEPTH, CONSTANT = 3, 0.65
BROADCAST_LEAVES = 1_000_000
HOT_LINES = 20_000
ANY = "<*>"

# Fixed value: a token that holds an ASCII digit, taken whole and from its first character only.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
# Fixed value: white space inside a line.
GAP = r"[ \t\x0B\f\r]+"


def _lines(docs, text, doc_id, depth):
    """One row per line that is not blank: key of its document, place, masked line with single spaces, leaf of the tree, hash."""
    masked = F.regexp_replace(F.regexp_replace(F.col(text), VARIABLE, ANY), GAP, " ")
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(masked, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("words", F.trim("line")).where("words != ''")
    rows = rows.withColumn("n", F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)
    leaf = F.xxhash64("n", F.substring_index("words", " ", depth))
    return rows.select("doc", "text_hash", "pos", "words", "n", leaf.alias("leaf"), F.xxhash64("words").alias("line"))


def _templates(lines, depth, constant):
    """(line, template) of the distinct ``lines`` of one leaf or more that share a template with another line.

    Each round looks at groups of lines, first the leaves. The lines that hold the token of most lines of their group in
    ``constant`` of their places get one template; the others are dealt into smaller groups by the token in the place that
    has the fewest different ones, and the next round looks at those. A group's counts are aggregates, so it is never gathered.
    """
    hashes = F.transform(F.slice("tokens", depth + 1, F.col("n")), lambda t: F.xxhash64(t))
    active = lines.where(F.col("n") > depth).select("line", "n", F.col("leaf").alias("node"), hashes.alias("rest"))
    found = None
    while True:
        cells = active.select("node", F.posexplode("rest").alias("place", "h")).groupBy("node", "place", "h").agg(F.count("*").alias("c"))
        places = cells.groupBy("node", "place").agg(
            F.max(F.struct("c", "h")).alias("top"), F.count("*").alias("values"), F.sum("c").alias("lines"))
        most = F.when(2 * F.col("top.c") > F.col("lines"), F.col("top.h"))
        split = F.when(F.col("values") > 1, F.struct("values", -F.col("top.c"), "place"))
        nodes = cut(places.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", most.alias("h")))).alias("common"),
                                               F.min(split).alias("split"), F.max("lines").alias("lines")))
        rows = join_heavy(active, nodes, "node", "lines", hot_rows=HOT_LINES)
        same = F.size(F.filter(F.zip_with("rest", "common", lambda h, m: h.eqNullSafe(m["h"])), lambda equal: equal))
        deal = F.xxhash64("node", "split.place", F.get("rest", F.col("split.place")))
        rows = cut(rows.select("line", "n", "rest", "lines", "node", deal.alias("deal"),
                               (same + depth >= F.lit(constant) * F.col("n")).alias("member")))
        members = rows.where("member and lines > 1").select("line", F.xxhash64("node", F.lit("template")).alias("template"))
        found = members if found is None else found.union(members)
        active = rows.where("not member").select("line", "n", F.col("deal").alias("node"), "rest")
        if active.isEmpty():
            return found


def drop_recurring_lines(docs, text="text", doc_id="doc_id", depth=DEPTH, constant=CONSTANT):
    """All documents, with ``text`` less the lines whose template stands in a document of smaller id, ``n_lines``, ``n_dropped``.

    The tree has two levels: token count, then the first ``depth`` tokens; tokens with a digit are wildcards from the
    start. In a leaf, lines of which at least ``constant`` of the tokens are those of most lines in their group are one
    template, whatever stands in the other places; lines far from it are looked at in smaller groups until each has a
    template or is alone. Only leaves with several lines are looked into, by counts: no leaf is gathered in a task. Of a template
    found in several documents the one with the smallest id keeps its lines; all others drop theirs. Templates that only
    recur inside one document are left alone, blank lines are never dropped.

    NULL text stays NULL with 0 lines. A NULL id counts as the smallest. Documents of one id count as one document. Rows of
    equal id and text get equal results. No rows give no rows. Input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    lines = cut(_lines(docs, text, doc_id, depth))  # stored: the texts are masked once
    narrow = lines.drop("words")
    leaves = cut(narrow.groupBy("leaf", "line").count().groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1").select("leaf"))
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    shared = cut(lines.join(leaves, "leaf", "left_semi").select("leaf", "line", "n", "words").dropDuplicates(["leaf", "line"]))
    shared = shared.select("leaf", "line", "n", F.split("words", " ").alias("tokens"))
    varied = _templates(shared, depth, constant)
    placed = narrow.groupBy("line").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("rows"))
    placed = placed.join(varied, "line", "left").withColumn("template", F.coalesce("template", "line"))
    placed = cut(placed)
    firsts = placed.groupBy("template").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("lines"))
    recurring = cut(firsts.where("first < last"))
    spread = join_heavy(placed.select("line", "template", "rows"), recurring.select("template", "first", "lines"), "template", "lines")
    marked = cut(spread.where("first is not null").select("line", "first", "rows"))
    hits = join_heavy(narrow.select("doc", "text_hash", "pos", "line"), marked, "line", "rows").where("first < doc")
    dropped = hits.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("_dropped"))
    key, value = F.coalesce(F.col("row")[doc_id].cast("long"), F.lit(-(1 << 63))), F.col("row")[text]
    match = (key == F.col("doc")) & (F.xxhash64(value) == F.col("text_hash"))
    out = pack(docs).join(dropped, match, "left").withColumn("parts", F.split(value, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("_dropped"))
    clean = F.when(F.col("_dropped").isNull(), value).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    added = {text: clean, "n_lines": F.coalesce(F.when(value != "", F.size("parts")), F.lit(0)),
             "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0))}
    same = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return unpack(out, **added).select(*[f"`{c}`" for c in same], "n_lines", "n_dropped")
