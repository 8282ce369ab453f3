"""Queries over the sentences of whole texts, against plain versions."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from voxmend import catalog
from voxmend.functions.distance import edit_distance, within
from voxmend.functions.text import common_start, normal_form

ENDS = re.compile(r"[.!?\n]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def hypotheses(turn, r):
    p = 2 + turn % 7
    sb, dl, ins = r[: p - 1] + "x" + r[p:], r[: p - 1] + r[p:], r[:p] + "e" + r[p:]
    kinds = [(r, sb, dl), (sb, r, r, dl), (dl, sb, ins, r), (ins, dl, dl), (r[::-1], r, r), ("", "  ", sb, r)]
    return [h for h in kinds[turn % 6] if h.strip()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("texts")
    rows = [(i, "".join(f"Wört{i * k % 17}, né{k}中" + [" ", ". ", "!\n", ""][k * i % 4] for k in range(6 + 9 * i)), "de", f"s{i % 2}") for i in range(13)]
    rows += [(13, "", "de", "s0"), (14, None, "fr", "s1"), (15, "one sentence only", "fr", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(where / "documents.parquet"))
    norm = {f"{i}-{k}": (i + k, normal_form(s)) for i, t, _, _ in rows for k, s in enumerate(ENDS.split(t or ""))}
    return str(where), norm


def test_every_character_is_in_a_record(spark):
    where = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{where}/documents.parquet").select("text").collect()]
    got = catalog.QUERIES["sft_records"](spark, where).agg(F.sum(F.length("reference")).alias("chars"), F.count("*").alias("n")).first()
    assert (got["chars"], got["n"]) == (sum(len(normal_form(t)) for t in texts), sum(len(ENDS.split(t)) for t in texts))
    replies = catalog.QUERIES["parse_model_output"](spark, where)
    halves = {r["doc_id"]: r["edits"] for r in replies.where("doc_id % 6 = 1").collect()}
    by_id = {r["doc_id"]: normal_form(r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    assert all(e.removesuffix(":r").replace(">", "", 1) == by_id[i] for i, e in halves.items() if by_id[i])


def test_records_are_sentences(spark, folder):
    where, norm = folder
    got = {r["id"]: (r["reference"], r["nbest"]) for r in catalog.QUERIES["sft_records"](spark, where).collect()}
    assert got == {i: (t, "|".join(hypotheses(turn, t))) for i, (turn, t) in norm.items()}
    assert max(len(t) for _, t in norm.values()) > 300


def test_distances(spark, folder):
    where, norm = folder
    wanted = {(i, k): distance(h, t) for i, (turn, t) in norm.items() for k, h in enumerate(hypotheses(turn, t))}
    assert {(r["id"], r["idx"]): r["distance"] for r in catalog.QUERIES["edit_distance_pairs"](spark, where).collect()} == wanted
    report = catalog.QUERIES["baseline_report"](spark, where).first()
    said = {i: t for i, (_, t) in norm.items() if t}
    best = sum(min(wanted[i, k] for k in range(len(hypotheses(norm[i][0], t)))) for i, t in said.items())
    assert (report["samples"], report["reference_chars"], report["top1_edits"], report["oracle_edits"]) == (len(said), sum(map(len, said.values())), sum(wanted[i, 0] for i in said), best)


def test_minimal_edits(spark, folder):
    where, norm = folder
    for r in catalog.QUERIES["minimal_edit"](spark, where).collect():
        turn, t = norm[r["id"]]
        top1 = (hypotheses(turn, t) or [""])[0]
        start = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(top1, t)))
        end = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(top1[start:][::-1], t[start:][::-1])))
        bare = len(top1) - end == start
        left, more = start - (bare and start > 0), int(bare and start == 0)
        old, new = top1[left : len(top1) - end + more], t[left : len(t) - end + more]
        assert r["edits"] == ("" if top1 == t or not old else f"{old}>{new}:middle_span_replace")


def test_bounded_distances(spark):
    base = "".join("abcdefgé中"[i * i % 9] for i in range(400))
    pairs = [(base, base), (base, base[:200] + base[203:]), (base, "x" + base[:-1]), (base, base[::-1]), (base, base[:100] + "xyzxy" + base[100:]), ("ab" * 150, "ba" * 150), (base, ""), ("abc", "abd"), (base[:10] + "q" + base[10:390], base)]
    df = spark.createDataFrame(pairs, "l string, r string")
    for most in (1, 4):
        got = df.select("l", "r", within(F.col("l"), F.col("r"), most).alias("w"), edit_distance(F.col("l"), F.col("r")).alias("d"), common_start(F.col("l"), F.col("r")).alias("s")).collect()
        for r in got:
            d = distance(r["l"], r["r"])
            assert (r["d"], r["w"]) == (d, d if d <= most else -1)
            assert r["s"] == sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(r["l"], r["r"])))


def test_training_texts_are_cut_where_training_cuts(spark, tmp_path):
    rows = [(1, 0, "user", "u" * 600), (1, 1, "assistant", "a" * 700), (2, 0, "user", "v" * 20000)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(r["text"] for r in catalog.QUERIES["training_texts"](spark, str(tmp_path)).collect())
    assert got == ["<user>\n" + "u" * 600 + "\n<assistant>\n" + "a" * 700, ("<user>\n" + "v" * 20000)[:16384]]


def test_candidates_that_sound_alike(spark, folder):
    where, norm = folder
    heard = {c: u for c, u in catalog.SOUNDS.table.items()}
    wanted = {}
    for i, (turn, t) in norm.items():
        nbest = hypotheses(turn, t)
        near = [(distance(nbest[0], h), k) for k, h in enumerate(nbest) if k and h and abs(len(h) - len(nbest[0])) < 3 and [heard.get(c, c) for c in h] == [heard.get(c, c) for c in nbest[0]]]
        near = [(d, k) for d, k in near if 1 <= d <= 2]
        wanted[i] = nbest[min(near)[1]] if near else "".join(nbest[:1])
    found = catalog.QUERIES["sound_rule_candidate"](spark, where)
    assert {r["id"]: r["candidate"] for r in found.collect()} == wanted
    # No unit is looked up in a list of the pair's units: that made a pair cost the square of its length.
    assert "array_position" not in found._jdf.queryExecution().optimizedPlan().toString()
