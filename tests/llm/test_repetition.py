import random
import re

from tapeloom.llm import repetition

WORD = re.compile(r"[^ \t-\r]+")


def brute(text):
    """Counts by plain loops over words and lines."""
    text = text or ""
    w = WORD.findall(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]] if len(lines) < 2000 else []
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(v) for x in again for v in WORD.findall(x))}
    for n in (3, *repetition.NGRAM_SHARE):
        places = {}
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i:i + n]), []).append(i)
        inside = {p for at in places.values() if len(at) > 1 for i in (at if n == 3 else at[1:]) for p in range(i, i + n)}
        if n == 3:
            out["n_repeat_words"] = len(inside)
        else:
            out[f"chars_{n}"] = sum(len(w[p]) for p in inside)
    base = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    bad = out["n_dup_lines"] > 0.3 * out["n_lines"] or out["dup_line_chars"] > 0.2 * out["word_chars"] or any(
        out[f"chars_{n}"] > share * out["word_chars"] for n, share in repetition.NGRAM_SHARE.items())
    return out | {"base_failed": base, "kept": not base and not bad}


def check(df, texts):
    got = sorted([{c: v for c, v in r.asDict().items() if c != "doc_id"} for r in df.collect()], key=repr)
    assert got == sorted([{c: brute(t)[c] for c in [*repetition.COLUMNS, "base_failed", "kept"]} for t in texts], key=repr)


def test_report_equals_brute_force(docs, rows):
    check(repetition.repetition_report(docs), [r[1] for r in rows])


def test_repeats_of_all_kinds(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n", "a", "a a", "a a a", "a a a a", "a b a b a b a b", "x\n x\nx\n\nx ", "é é é\x0bb\x0cb", "# $ <b> |", "\x00 \x00 \x00 \x00"]
    for size in (3, 5, 40):
        for _ in range(60):
            made = [rng.choice("abcdefghijklmnopqrstuvwxyzäß数"[:size]) * rng.randint(1, 3) for _ in range(rng.randint(0, 150))]
            texts.append("".join(x + rng.choice(" \n\t") for x in made))
    prose = [f"w{i}" for i in range(400)]
    for n in (4, 5, 9, 10, 11, 30, 80):  # one passage again, and as a line
        texts += [" ".join(prose[:100] + prose[:n] + prose[200:300]), " ".join(prose[:100]) + "\n" + " ".join(prose[200:200 + n]) + "\n" + " ".join(prose[200:200 + n])]
    texts += [" ".join(prose)] * 3 + ["Ab " * 60, " ".join(["long"] * 3000 + prose * 30)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int").repartition(3)
    check(repetition.repetition_report(df), texts)
    kept = {r.doc_id: r.kept for r in repetition.repetition_report(df).collect()}
    assert True in kept.values() and kept[len(texts) - 5] and not kept[len(texts) - 1]


def test_texts_over_several_chunks_do_not_meet(spark, monkeypatch):
    texts = [f"alpha beta gamma delta epsilon zeta {i % 3}" for i in range(200)] + [None]
    parts = [repetition.measure(held) for _, held in repetition.chunks(texts, 500)]
    assert len(parts) > 5 and not any(p["n_repeat_words"].any() or p["n_dup_lines"].any() for p in parts)


def test_no_documents(nothing):
    assert repetition.repetition_report(nothing).count() == 0
