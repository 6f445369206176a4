"""Registered queries of the operators and their DuckDB statements."""

from pyspark.sql import functions as F

from ..functions.storage import cut
from . import (decontaminate, filter_audit, hilbert, jaccard, line_templates, mixing, nn_descent, quality, repetition, sharded_kmeans,
               token_file, toxicity, warc)
from .common import table, utf8_size, word_count

QUERIES, ORACLES = {}, {}


_FOLD = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_words(c, pattern):
    return f"regexp_extract_all({_FOLD.format(c=c)}, '{pattern}')"


def tokenizer_path():
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_hilbert_shards")
def op3_hilbert_shards(spark, sf_dir):
    """All documents in 8 shards along a Hilbert curve over source, language and size."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (utf8_size("text") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = hilbert.hilbert_shards(docs, ["source", "lang", "size"], ["doc_id", "text_crc32"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op7_decontaminate", f"""
    with d as (select doc_id, {_sql_words('text', _BENCH_WORD)} as w from documents),
    b as (select item_id, w, least(len(w), 10) as n from (select item_id, {_sql_words('text', _BENCH_WORD)} as w from benchmark)
          where len(w) > 0),
    g as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win
          from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
    p as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
          from (select d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) as i from d, (select distinct n from g) l)),
    h as (select p.doc_id, p.n, p.i, g.item_id from p join g on p.n = g.n and p.win = g.win),
    c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from h) group by doc_id),
    t as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids
          from (select distinct doc_id, cast(item_id as varchar) as k from h) group by doc_id)
    select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
           sha256(coalesce(t.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
    from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id""")
def op7_decontaminate(spark, sf_dir):
    """Benchmark words inside every document."""
    report = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_curriculum_mix")
def op8_curriculum_mix(spark, sf_dir):
    """Words the mix takes of every document, and the time and position of its first copy in the training order."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count("text").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    mixed = cut(mixing.mix(docs, "size", tie=("doc_id", "text_md5")))
    first = mixing.training_order(mixed, tie=("doc_id", "text_md5")).groupBy(
        F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.min("position").alias("first_position"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5"))
    return mixed.join(first, same, "left").select(
        "doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("copies"),
        F.round(F.get("copies", F.lit(0))["time"], 9).alias("first_time"), "first_position")


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document by non-negative positive-unlabelled learning."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_jaccard_join", f"""
    with recursive w as (select doc_id, {_sql_words('text', r'[^\x20\x09-\x0D]+')} as w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
          from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    met as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
             group by a.doc_id, b.doc_id),
    l as (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
    reach(x, y) as (select doc_id, doc_id from w union select reach.x, l.y from reach join l on reach.y = l.x)
    select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.y) as component_id
    from w join reach on reach.x = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id""")
def op5_jaccard_join(spark, sf_dir):
    """Every document with its number of 5-word shingles and its class of similar documents."""
    return jaccard.classes(jaccard.jaccard_join(table(spark, sf_dir, "documents")))


@query("op2_token_files")
def op2_token_files(spark, sf_dir):
    """Write every document's token ids to binary files, read them back and give place, length and checksum."""
    return token_file.checksums(*token_file.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op4_warc", """
    with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
    d as (select page_id, octet_length(payload) as n, sha1(payload) as h from p),
    g as (select *, max(page_id) over (partition by h) as top from d),
    b as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (('0x' || substr(h || '00', 1 + ((i * 5) // 4), 3))::int >> (7 - ((i * 5) % 4))) % 32, 1)) as c from g)
    select page_id, n as payload_bytes, array_to_string(c, '') as payload_digest,
           case when page_id = top then 'response' else 'revisit' end as record_type,
           case when page_id = top then null else top end as refers_to from b""")
def op4_warc(spark, sf_dir):
    """Archive every page, read the archives back and list the records."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


@query("op6_line_templates")
def op6_line_templates(spark, sf_dir):
    """Every document less the lines whose template recurs from a document of smaller id."""
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    """Quality of every document by nearest-neighbour voting."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         quality.quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op1_nn_descent")
def op1_nn_descent(spark, sf_dir):
    """The 5 nearest embeddings found for every 50th one."""
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_filter_audit", r"""
    with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from t),
    m as (select doc_id, part, (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
            + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
            + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when least < doc_id then 16 else 0 end) as mask from w),
    c as (select m.part, m.mask, count(*) as n, count(*) filter (l.quality = 1) as good, count(*) filter (l.toxic = 1) as toxic
          from m left join labels l on l.doc_id = m.doc_id group by m.part, m.mask),
    f(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    o as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
          where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select filter_order, cast(step as int) as step, 1 << (ascii(filter_order[step]) - 65) as bit,
                 coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int as earlier
          from o, range(1, 6) r(step)),
    r as (select c.*, s.*, (mask & bit) > 0 as here, (mask & earlier) > 0 as gone from c, s),
    a as (select part, filter_order, step, bit, sum(n) filter (not here and not gone) as kept, sum(n) filter (here and not gone) as removed,
                 sum(n) filter (here and gone) as redundant, sum(n) filter (mask = bit) as unique_fails,
                 sum(good) filter (here and not gone) as good_lost, sum(toxic) filter (here and not gone) as toxic_lost
          from r group by part, filter_order, step, bit)
    select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
           coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
           coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
           coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley from a""")
def op11_filter_audit(spark, sf_dir):
    """Five filters over all documents, in all 120 orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SHARES = " or ".join(f"chars_{n} > {share} * word_chars" for n, share in repetition.NGRAM_SHARE.items())


@query("op12_repetition", rf"""
    with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(t, '[^ 	-
]+') as w from documents),
    l as (select doc_id, x, regexp_extract_all(x, '[^ 	-
]+') as v, row_number() over (partition by doc_id, x) as k
          from (select doc_id, unnest(string_split(t, chr(10))) as x from d)),
    ls as (select doc_id, count(*) as n_lines, count(*) filter (k > 1) as n_dup_lines,
                  coalesce(sum(length(array_to_string(v, ''))) filter (k > 1), 0) as dup_line_chars from l where len(v) > 0 group by doc_id),
    g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
          from (select *, unnest(range(1, len(w) - n + 2)) as i from d, (values (3), (5), (6), (7), (8), (9), (10)) v(n))),
    k as (select doc_id, n, i, count(*) over (partition by doc_id, n, g) as c, min(i) over (partition by doc_id, n, g) as least from g),
    r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 3)) as p from k where n = 3 and c > 1) group by doc_id),
    p as (select distinct doc_id, n, unnest(range(i, i + n)) as p from k where i > least and n > 3),
    h as (select p.doc_id, {', '.join(f'sum(length(w[p])) filter (n = {n}) as chars_{n}' for n in repetition.NGRAM_SHARE)}
          from p join d on d.doc_id = p.doc_id group by p.doc_id),
    a as (select d.doc_id, len(w) as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
                 coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(dup_line_chars, 0)::bigint as dup_line_chars,
                 coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                 {', '.join(f'coalesce(chars_{n}, 0)::bigint as chars_{n}' for n in repetition.NGRAM_SHARE)}
          from d left join ls on ls.doc_id = d.doc_id left join r on r.doc_id = d.doc_id left join h on h.doc_id = d.doc_id),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
    select *, not (base_failed or n_dup_lines > 0.3 * n_lines or dup_line_chars > 0.2 * word_chars or {_SHARES}) as kept from b""")
def op12_repetition(spark, sf_dir):
    """Repetition counts of every document, and whether it passes the bounds."""
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def _lloyd_sql(dims=64, k=16, rounds=3):
    """Lloyd's rounds as one statement; the centroids of round r are c{r}."""
    parts = [f"""v as (select vec_id, list_transform(embedding, lambda e: floor(e::double * 64)::bigint) as x from embeddings
        where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
    c0 as (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as c, x from v qualify c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as (select vec_id, c, d, x from (select v.vec_id, v.x, c.c,
            list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{r} c)
            qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} as (select c, j, sum(x[j])::bigint as s, count(*) as n from a{r}, range(1, {dims + 1}) t(j) group by c, j),
            m{r} as (select c, list((s - ((s % n) + n) % n) // n order by j) as x from s{r} group by c),
            c{r + 1} as (select o.c, coalesce(m.x, o.x) as x from c{r} o left join m{r} m on m.c = o.c)""")
    return f"""with {', '.join(parts)}
        select vec_id, a.c as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia,
               (sum(d) over ())::bigint as inertia, sha256(array_to_string(f.x, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} f on f.c = a.c"""


@query("op13_sharded_kmeans", _lloyd_sql())
def op13_sharded_kmeans(spark, sf_dir):
    """Three rounds of clustering over all embeddings."""
    return sharded_kmeans.cluster(table(spark, sf_dir, "embeddings"))
