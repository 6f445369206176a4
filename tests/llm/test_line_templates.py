import random
import re
from collections import Counter, defaultdict

from tapeloom.llm import line_templates

from .conftest import frame

SPACE = r"[ \t\n\x0b\f\r]"
TEXTS = ["Visit page 12 of our site now\nunique line of the first document here\n\nfooter text",
         "Visit page 9987 of our site now\nanother unique line stands in this one\n\nfooter text",
         "login accepted for alice at the gate at noon today\nsomething else entirely different",
         "login accepted for bob at the gate at noon today\nyet more words that nobody repeats",
         "short a b\nx", "short a c\nx", None, "", "dup line in one document\ndup line in one document", "  footer   text \nkept tail"]


def tokens(line):
    masked = re.sub(rf"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r0-9]*[0-9][^ \t\n\x0b\f\r]*", "<*>", line)
    return tuple(re.sub(SPACE + "+", " ", masked).strip(" ").split(" "))


def leaf_templates(lines, depth=3, constant=0.65):
    """{line: template} of the distinct lines of one leaf that share a template, group by group as the operator does."""
    out, groups = {}, [((), sorted(lines))]
    while groups:
        path, group = groups.pop()
        columns = [Counter(x[p] for x in group) for p in range(depth, len(group[0]))]
        if not columns:
            continue
        common = [next((t for t, c in column.items() if 2 * c > len(group)), None) for column in columns]
        rest = []
        for x in group:
            if depth + sum(t == m for t, m in zip(x[depth:], common)) >= constant * len(x):
                if len(group) > 1:
                    out[x] = (path, "T")
            else:
                rest.append(x)
        if rest:
            _, _, place = min((len(c), -max(c.values()), p) for p, c in enumerate(columns) if len(c) > 1)
            parts = defaultdict(list)
            for x in rest:
                parts[x[depth + place]].append(x)
            groups += [(path + ((place, token),), part) for token, part in parts.items()]
    return out


def brute(rows):
    lines = [(-1 << 63 if i is None else i, n, k, tokens(x)) for n, (i, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3] != ("",)]
    leaves = defaultdict(set)
    for *_, x in lines:
        leaves[len(x), x[:3]].add(x)
    template = {}
    for key, leaf in leaves.items():
        template |= {x: (key, t) for x, t in leaf_templates(leaf).items()}
    first = {}
    for i, _, _, x in lines:
        name = template.get(x, x)
        first[name] = min(i, first.get(name, i))
    gone = {(n, k) for i, n, k, x in lines if first[template.get(x, x)] < i}
    return sorted((str(i), str(t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone)),
                   sum(m == n for m, _ in gone)) for n, (i, t) in enumerate(rows))


def check(spark, rows):
    out = line_templates.drop_recurring_lines(frame(spark, [(i, t, None, None) for i, t in rows]))
    assert sorted((str(r.doc_id), str(r.text), r.n_dropped) for r in out.collect()) == brute(rows)
    assert "row" in out.columns and dict(out.dtypes)["n_lines"] == "int"
    return out


def test_templates_equal_brute_force(spark, rows):
    out = check(spark, list(enumerate(TEXTS))).collect()
    text = {r.doc_id: r.text for r in out}
    assert text[1] == "another unique line stands in this one\n" and text[3] == "yet more words that nobody repeats"
    assert text[5] == "short a c" and text[8] == TEXTS[8] and text[9] == "kept tail" and text[6] is None
    check(spark, [(i, t) for i, t, _, _ in rows])


def test_families_that_need_several_rounds_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(240):  # few values in every place: groups overlap, split and split again
        size = rng.choice([4, 5, 7, 9, 12])
        line = ["the", "same", "start"] + [rng.choice(words[:rng.choice([2, 3, 16])]) for _ in range(size - 3)]
        rows.append((rng.choice([i, i // 2]), rng.choice(["\t\n", "  ", ""]) + rng.choice([" ", " \t "]).join(line)))
    check(spark, rows)


def test_lines_of_white_space_only_are_blank(spark):
    assert kept(spark, "\t\nfirst text of all", "\t\n \r\nsecond") == ["\t\nfirst text of all", "\t\n \r\nsecond"]


def test_without_rows_and_without_broadcast(spark, nothing, monkeypatch):
    assert line_templates.drop_recurring_lines(nothing).count() == 0
    monkeypatch.setattr(line_templates, "BROADCAST_LEAVES", 0)
    check(spark, list(enumerate(TEXTS)) + [(None, "footer text"), (3, TEXTS[3])])


def kept(spark, *texts, **options):
    """Texts of the documents 0, 1, ... after the drop."""
    out = line_templates.drop_recurring_lines(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), **options)
    return [r.text for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_lines_of_one_template_get_one_mask(spark):
    line = "user went out of the house this morning {} {}".format
    other = "user went out for a long walk through town again"
    texts = [line("alice", "paris"), line("bob", "paris"), line("bob", "rome")]
    assert kept(spark, *texts) == [texts[0], "", ""]
    assert kept(spark, *texts[:2]) == [texts[0], ""]
    assert kept(spark, "user went out by sea", *texts, line("carol", "oslo"), other) == ["user went out by sea", texts[0], "", "", "", other]


def test_groups_of_one_leaf_are_told_apart(spark):
    names = ["ann", "ben", "cy", "dora"]
    first = [f"the job named {a} has ended well after a short while" for a in names]
    second = [f"the job named {a} was stopped by hand and left there" for a in names]
    out = kept(spark, *first, *second)
    assert out == [first[0], "", "", "", second[0], "", "", ""]


def test_several_word_fields(spark):
    names, towns, days = ["ann", "ben", "cy", "dora"], ["paris", "rome", "oslo", "bonn"], ["monday", "friday", "sunday", "tuesday"]
    two = [f"login accepted for {a} at gate {b} today" for a, b in zip(names, towns)]
    three = [f"the backup of {a} went to {b} on {c} without errors" for a, b, c in zip(names, towns, days)]
    assert kept(spark, *two) == [two[0], "", "", ""]
    assert kept(spark, *three) == [three[0], "", "", ""]
    assert kept(spark, *two, *three) == [two[0], "", "", "", three[0], "", "", ""]


def test_short_lines_may_have_a_word_field(spark):
    assert kept(spark, "session closed for ann", "session closed for ben", "session closed by ben") == [
        "session closed for ann", "", "session closed by ben"]
    two = ["session closed for ann yesterday", "session closed for ben today"]
    assert kept(spark, *two) == two
