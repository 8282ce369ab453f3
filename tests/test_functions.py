"""Column expressions against worked examples and plain Python versions."""

import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxmend.functions import edits as E
from voxmend.functions.distance import cer, edit_distance, units_distance
from voxmend.functions.model_text import read_replies
from voxmend.functions.phonetic import Characters, Syllables, sound_alike
from voxmend.operators.evidence import computed
from voxmend.functions.text import EXACT, normal_form, normalize, normalize_composed, strip


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_normal_form(spark):
    texts = ["ｆｕｌｌ　Ｗidth，好。", "é a b\x1c!", "$a+b=|<c>", "", None, "😀 a", " x　"]
    got = [r[0] for r in rows(spark, [(t,) for t in texts], "t string", normalize(F.col("t")))]
    assert got == ["fullWidth好", "éab", "$a+b=|<c>", "", "", "😀a", "x"]
    composed = [(unicodedata.normalize("NFKC", t),) for t in texts if t]
    assert [r[0] for r in rows(spark, composed, "t string", normalize_composed(F.col("t")))] == [normal_form(t) for (t,) in composed]
    assert rows(spark, [("　 a b\x1d\n",)], "t string", strip(F.col("t"))) == [("a b",)]


def test_distances(spark):
    rng = random.Random(1)
    pairs = [("abc", "adc"), ("abc", "ab"), ("中界", "中介"), ("", ""), ("a", ""), ("😀a", "b")]
    pairs += [("".join(rng.choices("ab中é", k=rng.randint(0, 7))), "".join(rng.choices("ab中é", k=rng.randint(0, 7)))) for _ in range(60)]
    got = rows(spark, pairs, "a string, b string", edit_distance(F.col("a"), F.col("b")), units_distance(Characters().units(F.col("a")), Characters().units(F.col("b"))))
    assert got == [(lev(a, b), lev(a, b)) for a, b in pairs]
    units = [(["zhong", "jie"], ["zhong", "jie"]), (["a"], ["b", "a"]), ([], ["x"])]
    assert rows(spark, units, "a array<string>, b array<string>", units_distance(F.col("a"), F.col("b"))) == [(0,), (1,), (1,)]
    rates = [("中界", "中介", 0.5), ("中介", "中介", 0.0), ("", "", 0.0), ("a", "", 1.0), ("abcd", "a", 3.0)]
    assert [r[0] for r in rows(spark, rates, "p string, r string, x double", cer(F.col("p"), F.col("r")))] == [x for *_, x in rates]


def minimal(a, b):
    if a == b:
        return []
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    left, more = i, 0
    if len(a) - j == i:
        left, more = (i - 1, 0) if i else (0, 1)
    f, t = a[left : len(a) - j + more], b[left : len(b) - j + more]
    return [(f, t)] if f else []


def test_minimal_edits(spark):
    fixed = [("bc", "abc", [("b", "ab")]), ("abc", "abxc", [("b", "bx")]), ("", "abc", []), ("甲乙甲丙", "甲乙丁丙", [("甲", "丁")]), ("a", "a", [])]
    rng = random.Random(2)
    data = [(a, b) for a, b, _ in fixed] + [("".join(rng.choices("ab", k=rng.randint(0, 6))), "".join(rng.choices("abc", k=rng.randint(0, 6)))) for _ in range(120)]
    got = [[(e["from"], e["to"]) for e in r[0]] for r in rows(spark, data, "a string, b string", E.minimal_edits(F.col("a"), F.col("b")))]
    assert got == [minimal(a, b) for a, b in data]
    assert got[: len(fixed)] == [x for *_, x in fixed]


def correct(spark, top1, nbest, edits, hotwords=(), max_changed=12, provider=None):
    df = spark.createDataFrame([(top1, list(nbest), list(hotwords), [{"from": f, "to": t, "reason": ""} for f, t in edits])], f"t string, n array<string>, h array<string>, e {E.EDITS}")
    e = E.clean_edits(F.col("e"))
    support = E.support_texts(F.col("t"), F.col("n"), (), F.col("h"))
    df = computed(df, t_n=normalize(F.col("t")), n_n=EXACT.many(F.col("n")), s_n=EXACT.many(support))
    reasons = E.check_edits(e, F.col("t_n"), F.col("n_n"), F.col("s_n"), max_changed, norm=EXACT, provider=provider)
    r = df.select(E.safe_apply(F.col("t"), e, reasons, E.apply_edits(F.col("t"), e)).alias("r")).first()["r"]
    return r["accepted"], r["text"], list(r["reasons"]), len(r["applied_edits"])


def test_verifier(spark):
    top1 = "广州市房地产中界协会分析"
    assert correct(spark, top1, [top1, "广州市房地产中介协会分析"], [("中界", "中介")]) == (True, "广州市房地产中介协会分析", [], 1)
    assert correct(spark, top1, [top1], [("广州", "上海")]) == (False, top1, ["to_not_supported:上海"], 0)
    assert correct(spark, "而对面楼市成交", [], [("面", "")])[:2] == (True, "而对楼市成交")
    assert correct(spark, "甲乙甲丙", ["甲乙丁丙"], [("甲", "丁")])[1] == "丁乙甲丙"
    assert correct(spark, "中，界", ["中介"], [("中界", "中介")]) == (False, "中，界", ["missing_from:中界"], 0)
    assert correct(spark, "abcdefghijklm", ["abcdefghijklm"], [("abcdef", "fedcba"[:0]), ("ghijklm", "")])[2] == ["too_many_changed_chars"]
    assert correct(spark, "abc", [], [("abc", "abc"), ("，", "b"), ("zz", "a")])[2] == ["identity_edit:abc", "empty_span", "from_not_supported:zz"]
    assert correct(spark, "abc", [], [("abc", "热词")], ["热词"])[0]
    assert correct(spark, "中界", [], [("界", "介")])[2] == ["to_not_supported:介"]
    table = Syllables({"界": "jie", "介": "jie"})
    assert correct(spark, "中界", [], [("界", "介")], provider=table)[:2] == (True, "中介")
    assert correct(spark, "abcdef", ["ab"], [("abcdef", "ab")], max_changed=6)[0]


def test_sound_alike(spark):
    data = [(["a"], ["a"]), ([], []), (["a"], ["b"])]
    assert rows(spark, data, "a array<string>, b array<string>", sound_alike(F.col("a"), F.col("b"))) == [(True,), (False,), (False,)]


@pytest.mark.parametrize(
    ("text", "n", "warnings"),
    [
        ('ok ```json\n{"edits":[{"from":"a","to":"b"}]}\n``` end', 1, []),
        ("不需要修改", 0, ["no_valid_json_edits"]),
        ('{"from":"a","to":"b"}', 1, []),
        ('[{"from":"a","to":"b"}]', 1, []),
        ('x [{"from":"a","to":"b"},{"from":"c","to":"d"}] y', 2, []),
        ("null", 0, []),
        ("123", 0, ["edits must be a list or an object with an edits list", "no_valid_json_edits"]),
        ('{"other":1}', 0, []),
        ("[1]", 0, ["each edit must be a JSON object", "no_valid_json_edits"]),
        (None, 0, ["no_valid_json_edits"]),
        ('{"a":1} x', 0, []),
        ('```json\n[{"from":"a","to":"b"}]', 1, []),
        ('``` JSON ``` ```JSON [{"from":"a","to":"b"}, {"from":"c","to":"d"}]```', 2, []),
        ('```json 3``` then ```[{"from":"a","to":"b"}]```', 1, ["edits must be a list or an object with an edits list"]),
        ('```3``` and ``` 3 ``` and }{', 0, ["edits must be a list or an object with an edits list", "no_valid_json_edits"]),
        ('{"edits":null}', 0, []),
        ("[" * 100000, 0, ["no_valid_json_edits"]),
    ],
)
def test_replies(text, n, warnings):
    got = read_replies(pd.Series([text])).iloc[0]
    assert (len(got["edits"]), got["parse_warnings"]) == (n, warnings)
    assert all(set(e) == {"from", "to", "reason"} for e in got["edits"])


def test_spelled_units(spark):
    """Texts of one code point a unit are as far apart as the units, whatever the table maps to what."""
    rng = random.Random(3)
    for table in ({"界": "jie", "介": "jie", "中": "zhong"}, {"a": "e", "e": "x", "é": "e"}, {"a": "b", "b": "a"}, {"a": "", "b": "", "ab": "c"}, {"a": "😀", "😀": "a b"}, {}):
        read = Syllables(table)
        pairs = [("".join(rng.choices("abexé界介中😀", k=rng.randint(0, 7))), "".join(rng.choices("abexé界介中😀", k=rng.randint(0, 7)))) for _ in range(40)]
        a, b = F.col("a"), F.col("b")
        got = rows(spark, pairs, "a string, b string", edit_distance(read.spelled(a), read.spelled(b)), units_distance(read.units(a), read.units(b)))
        assert got == [(lev([table.get(c, c) for c in x], [table.get(c, c) for c in y]),) * 2 for x, y in pairs]
