"""Similarity join on word shingles with adaptive multi-match prefixes, and its classes of linked documents."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import textmath
from .common import broadcast_if_small, shuffle_partitions, small_batches

HOT, MAX_HOT, GROUP = 16, 500_000, 64
PAIRS = 200_000  # pairs a task holds at once
CELL, DRAWS = 16, 2  # rows of a token that meet at random in a round, and how often each node is dealt
NUM, DEN = 4, 5  # Jaccard threshold NUM / DEN


def prefix_size(n):
    """Tokens of a set of ``n`` of which a similar set must hold one."""
    return n - (n * NUM + DEN - 1) // DEN + 1


def needed(a, b):
    """Least overlap of two sets of these sizes at the threshold."""
    return (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)


def node_of(tokens):
    """64-bit content hash of a sorted shingle set: equal sets are one node."""
    return np.uint64(len(tokens)) ^ textmath.mix(tokens).sum(dtype=np.uint64)


def _is_hot(tokens, hot):
    if not len(hot):
        return np.zeros(len(tokens), bool)
    return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens


def lengthened(tokens, hot, rank):
    """The prefix of one set: its first ``prefix_size`` tokens with the hot ones put last, the rarest of those first.

    In hash order this is a prefix lengthened by its ``h`` hot tokens. Two similar sets share at least ``1 + min(h, h')``
    tokens of their lengthened prefixes, so at least one that is not hot; only that one has to be looked up.
    """
    p = prefix_size(len(tokens))
    is_hot = _is_hot(tokens, hot)
    cool = tokens[~is_hot]
    if len(cool) >= p:
        return cool[:p]
    warm = tokens[is_hot]
    order = np.argsort(rank[np.searchsorted(hot, warm)], kind="stable")
    return np.concatenate((cool, warm[order][:p - len(cool)]))


def _token_counts(docs, text, width, pick, least):
    """Frequencies above ``least`` of the tokens that ``pick`` takes from each set, the ``MAX_HOT`` largest."""

    def emit(batches):
        seen = set()
        for batch in batches:
            for _, data in textmath.chunks(batch["t"]):
                parts = [np.zeros(0, np.uint64)]
                for tokens in textmath.shingle_sets(data, width):
                    if len(tokens) and (node := node_of(tokens)) not in seen:  # copies in a task count once
                        seen.add(node)
                        parts.append(pick(tokens))
                yield pd.DataFrame({"token": np.concatenate(parts).view(np.int64)})

    counts = docs.select(F.col(text).alias("t")).mapInPandas(emit, "token long").groupBy("token").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") > least).orderBy(F.desc("n"), "token").limit(MAX_HOT).toPandas()
    return dict(zip(top["token"].to_numpy().view(np.uint64).tolist(), top["n"].tolist()))


def hot_tokens(docs, text, width, least=HOT):
    """Tokens too frequent to look up: sorted array and their frequencies, at most ``MAX_HOT`` of them.

    The candidate cost of a prefix is the frequency of its tokens over all documents. Prefixes with hot tokens are
    lengthened past them, the new tokens are counted in turn, until a round finds no hot one. Any set of hot tokens
    gives whole results; a better one gives fewer candidates.
    """
    found = _token_counts(docs, text, width, lambda x: x[:prefix_size(len(x))], least)
    new = dict(found)
    while new and len(found) < MAX_HOT:
        hot = np.sort(np.fromiter(found, np.uint64, len(found)))

        def extension(tokens, hot=hot):
            p, is_hot = prefix_size(len(tokens)), _is_hot(tokens, hot)
            if not is_hot[:p].any():
                return tokens[:0]
            cool = np.flatnonzero(~is_hot)
            end = cool[p - 1] + 1 if len(cool) >= p else len(tokens)
            extra = 2 * int(is_hot[:end].sum()) + 4
            rest = np.arange(p, min(end + extra, len(tokens)))
            return tokens[rest[~is_hot[rest]]]

        new = {k: v for k, v in _token_counts(docs, text, width, extension, least).items() if k not in found}
        found |= dict(sorted(new.items(), key=lambda kv: (-kv[1], kv[0]))[:MAX_HOT - len(found)])
    hot = np.sort(np.fromiter(found, np.uint64, len(found)))
    return hot, np.array([found[t] for t in hot.tolist()], np.int64)


def _scan(batches):
    """Groups of rows with one token, in token order: the pairs of small groups, and the rows of large ones as ``big``.

    ``near`` tells whether what follows the token in both sets can reach the threshold; of a similar pair the first shared
    token always does.
    """
    held = None
    blank = {"token": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64)}
    big_token = None

    def out(kind, a, b, na, nb, pos, near):
        return pd.DataFrame({"big": np.full(len(a), kind), "a": a, "b": b, "na": na, "nb": nb, "pos": pos, "near": near})

    def work(rows, last):
        nonlocal held, big_token
        token, node, n, pos = (rows[c] for c in blank)
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, pos = token[keep], node[keep], n[keep], pos[keep]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, int)
        sizes = np.diff(np.append(edge, len(token)))
        held = None
        if len(edge) and not last and sizes[-1] <= GROUP and token[edge[-1]] != big_token:
            at = edge[-1]
            held = {"token": token[at:], "node": node[at:], "n": n[at:], "pos": pos[at:]}
            edge, sizes = edge[:-1], sizes[:-1]
        large = (sizes > GROUP) | (token[edge] == big_token) if len(edge) else np.zeros(0, bool)
        for at, size in zip(edge[large], sizes[large]):
            part = slice(at, at + size)
            yield out(True, token[part], node[part], n[part], n[part], pos[part], True)
        if len(large) and large[-1] and held is None:
            big_token = token[edge[-1]]
        for size in np.unique(sizes[~large]):
            if size < 2:
                continue
            rows_at = edge[~large & (sizes == size)][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS // len(i))
            for block in range(0, len(rows_at), step):
                m = rows_at[block:block + step]
                left, right = m[:, i].ravel(), m[:, j].ravel()
                fit = NUM * np.maximum(n[left], n[right]) <= DEN * np.minimum(n[left], n[right])
                left, right = left[fit], right[fit]
                near = np.minimum(n[left] - pos[left], n[right] - pos[right]) >= needed(n[left], n[right])
                yield out(False, node[left], node[right], n[left], n[right], pos[left], near)

    for batch in batches:
        rows = {c: batch[c].to_numpy() for c in blank}
        if held is not None:
            rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
        yield from work(rows, False)
    if held is not None:
        yield from work(held, True)


def components(edges):
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable, by hooking and pointer doubling.

    Every round hooks each node to its smallest neighbour, halves the pointer chains until they end, and goes on with
    the edges between different roots; each round at least halves what is left of a component.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = cut(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")))
            parent = moved.select("node", "up")
            if moved.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            up = parent.select(F.col("node").alias("root"), "up")
            labels = cut(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = [parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}r")) for c in ("a", "b")]
        edges = cut(edges.join(ends[0], "a").join(ends[1], "b").where("ar != br")
                    .select(F.least("ar", "br").alias("a"), F.greatest("ar", "br").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _verified(pairs, sets, column, dtype):
    """Pairs whose overlap in ``column`` reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col(column).alias("y"))

    def check(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y, na, nb) in enumerate(zip(batch["x"], batch["y"], batch["na"], batch["nb"])):
                x, y = np.frombuffer(x, dtype), np.frombuffer(y, dtype)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                ok[i] = (y[at] == x).sum() >= needed(na, nb)
            yield batch.loc[ok, ["a", "b", "na", "nb"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "x", "y").mapInPandas(
        check, "a long, b long, na long, nb long")


SKETCH = [f"f{i}" for i in range(16)]


def sketch(tokens):
    """64 flags for each of ``SKETCH``, one of them set by every token."""
    flags = np.zeros(64 * len(SKETCH), bool)
    flags[tokens >> np.uint64(64 - (len(flags) - 1).bit_length())] = True
    return np.packbits(flags).view(np.int64)


def _sketches(sets):
    def run(batches):
        for batch in batches:
            flags = [sketch(np.frombuffer(x, np.uint64)) for x in batch["whole"]]
            yield pd.DataFrame(np.array(flags, np.int64).reshape(-1, len(SKETCH)), columns=SKETCH).assign(node=batch["node"].to_numpy())

    return sets.select("node", "whole").mapInPandas(run, ", ".join(f"{c} long" for c in SKETCH) + ", node long")


def _meetings(x, by, first):
    """Pairs (a, b, na, nb) of rows of different classes that agree in ``by`` and could reach the threshold.

    A flag that only one of two sketches has set stands for at least one token that only that set holds, so sizes less such
    flags bound the overlap.
    """
    sides = [x.select(*by, *[F.col(c).alias(f"{c}{end}") for c in ("node", "n", "pos", "root", *SKETCH)]) for end in ("a", "b")]
    alone = [" + ".join(f"bit_count({c}{p} & ~{c}{q})" for c in SKETCH) for p, q in ("ab", "ba")]
    enough = f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}"
    met = sides[0].join(sides[1], by).where("nodea < nodeb and roota != rootb").where(
        f"{NUM} * greatest(na, nb) <= {DEN} * least(na, nb)").where(
        f"least(na - ({alone[0]}), nb - ({alone[1]})) >= {enough}")
    if first:  # of a similar pair, what follows the first shared token is long enough
        met = met.where(f"least(na - posa, nb - posb) >= {enough}")
    return met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "na", "nb").distinct()


def _dealt(named, nth):
    """Rows of ``named`` dealt for a round: each node with the smallest of its tokens under a hash, so similar sets tend to
    agree in it, and the rows of a token in random cells of about ``CELL``."""
    fields = ["token", "node", "n", "pos", "root", *SKETCH]
    one = named.groupBy("node").agg(F.min_by(F.struct(*fields), F.struct(F.xxhash64("token", F.lit(nth)), "token")).alias("r")).select("r.*")
    cells = one.groupBy("token").agg(F.ceil(F.count("*") / CELL).alias("cells")).where("cells > 0")
    return one.join(cells, "token").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(nth)), F.col("cells")))


def _across(common, sets, links, tried, compare):
    """The links between nodes that share a common token and are in different classes by the ``links`` so far.

    ``common`` has the rows (token, node, n, pos). As most nodes of a large group end in one class, random cells of a group are
    compared first, in rounds, for as long as a round joins a tenth of the classes; the cost of a round is in proportion to
    the nodes. What is then still apart is compared with every node of another class whose sketch allows a link.
    """
    marked = cut(common.select("token", "node", "n", "pos").join(_sketches(sets), "node"))
    before = None
    for nth in range(64):
        labels = components(links)
        named = marked.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        named = cut(named.join(mixed.select("token"), "token", "left_semi"))
        left = named.select("root").distinct().count()
        if before is not None and left > 0.9 * before or left <= CELL:
            break
        before = left
        met = [_meetings(_dealt(named, nth * DRAWS + k), ["token", "cell"], False) for k in range(DRAWS)]
        some = met[0]
        for more in met[1:]:
            some = some.union(more)
        some = cut(some.distinct().join(tried, ["a", "b"], "left_anti"))
        tried = tried.select("a", "b").union(some.select("a", "b"))
        links = cut(links.union(compare(some)))
    rest = cut(_meetings(named, ["token"], True).join(tried, ["a", "b"], "left_anti"))
    return cut(links.union(compare(rest)))


def jaccard_join(docs, text="text", doc_id="doc_id", width=5):
    """Documents with their shingle count and class: rows (doc_id, text_hash, node, n_shingles, root), one per document.

    Two documents link when the Jaccard similarity of their sets of ``width``-word shingles is at least 4/5; a class is
    everything reachable by links, ``root`` its name. Words are runs of non-space bytes with A-Z lower-cased; fewer words
    than ``width`` are one shingle; NULL and texts without words have ``node`` and ``root`` NULL and link with nothing.

    Equal sets are one node, so copies meet in an aggregate and are never paired. Nodes look each other up by the tokens
    of their lengthened prefixes (``hot_tokens``, ``lengthened``). A pair must then share enough prefix tokens, and what
    follows its first shared token must be long enough, for the threshold to be in reach before whole sets are compared:
    first 32-bit, then 64-bit hashes. Tokens that stay common (sets made of hot tokens only) link to one leader per size
    class first, then in random cells (``_across``); afterwards only pairs of different classes that still share such a token are
    compared. No pair above the threshold is lost, whatever the group sizes.

    A NULL id is kept. Rows of one id are told apart by ``text_hash``; repeated rows all come out. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    hot, frequency = hot_tokens(docs, text, width)
    rank = np.argsort(np.argsort(frequency, kind="stable"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def emit(batches):
        seen = set()
        for batch in batches:
            for first, data in textmath.chunks(batch["t"]):
                sets = textmath.shingle_sets(data, width)
                nodes, parts = [None] * len(sets), [None] * len(sets)
                for i, tokens in enumerate(sets):
                    if len(tokens):
                        node = node_of(tokens)
                        nodes[i] = int(node.view(np.int64))
                        if node not in seen:
                            seen.add(node)
                            parts[i] = lengthened(tokens, hot, rank).view(np.int64)
                some = batch[["doc_id", "text_hash"]].iloc[first:first + len(sets)]
                yield some.assign(node=pd.array(nodes, "Int64"), n=[len(x) for x in sets], prefix=parts)

    named = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn ids with NULLs into floats
    base = named.mapInPandas(emit, "doc_id string, text_hash long, node long, n long, prefix array<bigint>")
    base = cut(base.withColumn("doc_id", F.col("doc_id").cast(id_type)))
    tokens = base.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "node", "n")
    dealt = tokens.repartition(shuffle_partitions(docs.sparkSession), "token").sortWithinPartitions("token", "node")
    met = cut(dealt.mapInPandas(_scan, "big boolean, a long, b long, na long, nb long, pos long, near boolean"))
    common = met.where("big").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("na").alias("n"), "pos")
    in_common = common.groupBy("node").agg(F.count("*").alias("c"))
    pairs = met.where("not big").groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("near").alias("near")).where("near")
    for end in ("a", "b"):
        pairs = pairs.join(in_common.select(F.col("node").alias(end), F.col("c").alias(f"c{end}")), end, "left")
    rest = F.greatest(*[F.expr(f"{n} - ({n} - ({n} * {NUM} + {DEN - 1}) div {DEN} + 1)") for n in ("na", "nb")])
    seen = F.col("c") + F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    pairs = pairs.where(seen + rest >= F.expr(f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}"))
    pairs = pairs.select("a", "b", "na", "nb")
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM))).cast("int")
    common = common.withColumn("step", step)
    leaders = common.groupBy("token", "step").agg(F.min(F.struct("n", "node")).alias("l"))
    to_leader = common.join(leaders, ["token", "step"]).where("node != l.node").select(
        F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"),
        F.when(F.col("node") < F.col("l.node"), F.col("n")).otherwise(F.col("l.n")).alias("na"),
        F.when(F.col("node") < F.col("l.node"), F.col("l.n")).otherwise(F.col("n")).alias("nb")).distinct()
    fit = f"{NUM} * greatest(na, nb) <= {DEN} * least(na, nb)"
    pairs = cut(pairs.union(to_leader.where(fit)).distinct())
    open_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(common.select("node")).distinct()
    texts = base.join(open_nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    texts = texts.select("node", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    texts = broadcast_if_small(texts)
    found = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))

    def whole(batches):
        for batch in batches:
            nodes = batch["node"].to_numpy()
            for first, data in textmath.chunks(batch["t"]):
                parts = textmath.shingle_sets(data, width)
                short = [textmath.distinct((p >> np.uint64(32)).astype(np.uint32)) for p in parts]
                yield pd.DataFrame({"node": nodes[first:first + len(data)], "whole": [p.tobytes() for p in parts],
                                    "small": [p.tobytes() for p in short], "extra": [len(p) - len(q) for p, q in zip(parts, short)]})

    sets = cut(found.select("node", "t").mapInPandas(whole, "node long, whole binary, small binary, extra int")
               .dropDuplicates(["node"]))

    def compare(some):
        likely = cut(_verified(some, sets.where("extra = 0"), "small", np.uint32).select("a", "b", "na", "nb"))
        odd = sets.where("extra > 0").select("node")
        unsure = some.join(odd.withColumnRenamed("node", "a"), "a", "left_semi").union(
            some.join(odd.withColumnRenamed("node", "b"), "b", "left_semi")).distinct()
        return _verified(likely.union(unsure), sets, "whole", np.uint64)

    links = cut(compare(pairs))
    if not common.isEmpty():
        links = _across(common, sets, links, pairs, compare)
    labels = components(links)
    out = base.join(labels, "node", "left")
    return out.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def classes(joined):
    """(doc_id, n_shingles, component_id) per document: the smallest id of its class; documents without shingles are alone."""
    least = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
