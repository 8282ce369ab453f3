import random

import pytest

#: Extra columns are named like things that operators make up inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, mark string, copies int, part int, fingerprint int, label string, row string, h int"



@pytest.fixture(scope="session")
def rows():
    """Documents with nulls everywhere, empty and long texts, ties, repeats, odd white space and non-Latin letters."""
    rng = random.Random(4)
    lexicon = {"en": "the of and to in that with for was are this from".split(), "fr": "le la les des une dans pour avec était cette où qui".split()}

    def prose(lang, n):
        return " ".join(rng.choice(lexicon[lang]) + rng.choice(["", "", "ing" if lang == "en" else "ée", "x" * rng.randint(0, 2), ".", ","]) for _ in range(n))

    out = [(i, prose(("en", "fr")[i % 2], rng.choice([1, 3, 4, 5, 60, 90, 200])), ("en", "fr")[i % 2], f"s{i % 3}" if i % 7 else None) for i in range(60)]
    long = prose("en", 12000)
    out += [
        (100, None, None, None),
        (101, "", "en", "s1"),
        (102, " \t\n\x0b\x0c\r ", "en", "s0"),
        (103, "123 456 !!", "fr", "s0"),
        (104, "Ünï　code\x85 中文 \U0001f600 ĸ́", "fr", "s2"),
        (105, long, "en", "s0"),
        (106, long + " end", "en", "s0"),
        (107, "line one here\nline one here\nline one here\n\n\nother # $ |", "en", "s1"),
        (108, "same words " * 80, "en", "s1"),
        (109, out[5][1], "fr", "s0"),
        (110, "x" * 30000, None, "s2"),
        (110, "a tie on the id", "en", "s2"),
        (None, "no name at all but some words", "en", "s1"),
        (None, None, None, None),
    ]
    out += [out[4], out[4], (111, out[4][1].upper(), "en", None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "m", 2, 3, 4, "l", "r", 5) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
