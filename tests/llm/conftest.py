import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, curve string, `size` string, copies string,"
          " shard string, taken string, n_lines string, node string, _id string")
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "per", "sti") for b in ("da", "fo", "ga", "hi", "jo", "xu")]
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions near ancient mossy stones"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, near copies, repeated rows, shared passages, NULL in every column, long and empty texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(40)]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", "big", None][i % 5]) for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "big") for i in range(25)]
    out += [(200 + i, base[1] + f" tail{i}", "en", "big") for i in range(20)]
    out += [(300 + i, prose(rng, 15) + " " + PASSAGE + " " + prose(rng, 15), "de", "s1") for i in range(10)]
    out += [(400, None, "en", "s1"), (401, "", "de", "s2"), (402, " \n\t ", None, None), (403, "one", "en", "s3"), (404, "One", "en", "s3"),
            (405, "one two", "en", "s3"), (406, PASSAGE.upper(), "en", "s1"), (None, None, None, None), (None, base[2], "en", None),
            (407, prose(rng, 20_000), "fr", "s2"), (5, base[5], "de", "s1"), (5, base[5], "de", "s1"), (6, base[7], None, "s2"),
            (408, "ÄÖ été 数据 \U0001f600 İstanbul ΣΑΣ", "xx", "s9"), (409, "a\x1cb c\xa0d <|endoftext|> x", "en", "s9")]
    return out


def frame(spark, rows):
    clash = ["clash"] * (len(SCHEMA.split(",")) - 5)
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *clash) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
