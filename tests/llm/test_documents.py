"""Operators over documents against plain versions, on texts of every awkward kind."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from llm_fixtures import LOWER, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxmend.llm import codes, common, gru, langid, lm, mixing, packing, quality, simhash, tokens, winnow
from voxmend.llm.components import components

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def key(x):
    return (x is not None, x or 0)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def signed_hash(text):
    """Spark's xxhash64 of a text, 42 for null."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes(docs, rows, nothing, library):
    got = [tuple(r) for r in codes.encode_documents(docs, VOCABULARY, 2).collect()]
    assert len(got) == len(rows)
    start, expected = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (key(r[0]), signed_hash(r[1]))):
        ids = [*library(text), 2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    assert codes.encode_documents(nothing, VOCABULARY, 2).count() == 0


def test_codes_at_a_path(spark, docs, tmp_path, library):
    few, path = docs.where("doc_id < 20"), str(tmp_path / "codes")
    made = codes.write_codes(few, VOCABULARY, 2, path, segment_ids=300)
    whole = [i for r in codes.read_codes(codes.open_codes(spark, path)).orderBy("start").collect() for i in r["ids"]]
    assert made.count() > 3 and [codes.token_at(spark, path, k) for k in range(0, len(whole), 211)] == whole[::211]
    assert whole[-1] == 2
    with pytest.raises(IndexError):
        codes.token_at(spark, path, len(whole))
    # Segments lie in the files as they are, each in a page of its own.
    for file in Path(path, "segments").glob("*.parquet"):
        raw, meta = file.read_bytes(), pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            data = meta.row_group(k).column(meta.schema.names.index("data"))
            assert data.compression == "UNCOMPRESSED" and not any("DICT" in e for e in data.encodings)
        assert all(x in raw for x in pq.read_table(file)["data"].to_pylist())


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    pieces = ["İ", "I", "i̇", "ß", "é", "e\u0301", "Σ", "ς", "ǅ", "ﬁ", "中", "か", "한", " ", "\n", "\t", "\x85", "\xa0", "\u3000", ".", ",", "'s", "'", "!!", "--"]
    pieces += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "1", "23", "½", "²", "٣", "a", "The", "word", "\U0001f600", "\u0301", "\u0338", "=", "<", ">", "_", "@", "\x00", "\x1c", "ᲀ", "אב", "don't", "I'll."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    for made in (tokens.WordEncoder(tokens.definition(VOCABULARY), words=3000, parts=2000), tokens.WordEncoder(tokens.definition(VOCABULARY))):
        for a in range(0, len(texts), 5000):
            (_, _, ids, ends), = made.runs(pa.array(texts[a : a + 5000]).slice(1), 2)
            got = [x.tolist() for x in np.split(ids, ends)[:-1]]
            assert got == [[*library(t), 2] for t in texts[a + 1 : a + 5000]]


def test_plain_words_skip_the_split_and_marks_part_no_run(library):
    words = ["über", "straße", "ñandú", "слово", "λόγος", "かな", "漢字", "한글", "the", "word", "ŉa", "ſo", "x9", "don't", "e\u0301a", "İx", "\u0301", "\xa0"]
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words[:12]) + rng.choice(["", "", ".", "!!"]) for _ in range(30)) for _ in range(50)]
    made = tokens.WordEncoder(tokens.definition(VOCABULARY))
    made.encode(pa.array(["", ". !!"], pa.large_string()))
    whole, made.tokenizer = made.tokenizer, None  # these need it no more
    ids, ends = made.encode(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [library(t) for t in texts]
    made.tokenizer, calls, run = whole, [], made.words_encoded
    made.words_encoded = lambda part: calls.append(len(part)) or run(part)
    mixed = [" ".join(rng.choice(words) for _ in range(9)) + " <|endoftext|>" * (k % 2) for k in range(40)]
    ids, ends = made.encode(pa.array(mixed, pa.large_string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [library(t) for t in mixed] and calls == [20]


def test_letting_go_gives_memory_back():
    pages = lambda: int(Path("/proc/self/statm").read_text().split()[1])
    common.worker_memory()["encoder"] = [np.ones(8000) for _ in range(3000)]  # 192 MB in pieces that the C library keeps
    pin, before = np.ones(8000), pages()
    common.let_go()
    assert before - pages() > 100_000_000 // 4096 and pin[0]


def test_classes_are_bytes():
    symbols = np.arange(gru.SYMBOLS)
    plain = np.where(symbols < gru.HEAD, symbols // gru.CLASS_WORDS, symbols - gru.HEAD + gru.HEAD_CLASSES)
    found = gru.class_of(symbols)
    assert found.dtype == np.uint8 and found.tolist() == plain.tolist()  # bytes are put in order without comparisons


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, own = tokens.WordEncoder(tokens.definition(path)), Tokenizer.from_file(path)
    texts = ["The Words, and  spaces.", "", "x" * 50, " a<|endoftext|>b "]
    assert not made.by_words
    (_, _, ids, ends), = made.runs(pa.array(texts), 7)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [[*own.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_sequences(docs):
    pieces = packing.packed(docs, VOCABULARY, 1, capacity=256, with_ids=True)
    found = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 1024 for r in found)
    assert sum(r["length"] for r in found) == pieces.agg({"length": "sum"}).first()[0]


def test_a_segment_gives_any_id():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    seg = codes.Segment(codes.pack([1, None, 3], np.array([10, 10, len(ids)]), ids))
    assert seg.doc_ids == [1, None, 3] and len(seg.document(1)) == 0
    assert [seg[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (511, 513), (3000, 3001), (5, 5), (512, 2048)):
        assert (seg.slice(a, b) == ids[a:b]).all()
    assert len(codes.Segment(codes.pack([], np.zeros(0), np.zeros(0, np.uint32))).doc_ids) == 0
    with pytest.raises(IndexError):
        seg[len(ids)]


def measured(text):
    w, seen, repeated = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)

    def cover(n):
        c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    chars = sum(map(len, w))
    shares = {n: sum(len(w[j]) for j in cover(n)) / max(chars, 1) for n in quality.NGRAM_LIMITS}
    r = len(cover(3))
    failed = len(w) < 50 or 100 * r > 50 * len(w)
    lines = sum(len("".join(words(x))) for k, x in enumerate((text or "").split("\n")) if words(x) and x in (text or "").split("\n")[:k]) / max(chars, 1)
    kept = not failed and lines <= quality.LINE_LIMIT and all(shares[n] <= limit for n, limit in quality.NGRAM_LIMITS.items())
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), repeated, r, failed, kept, round(lines, 9), *(round(shares[n], 9) for n in shares)


def test_quality(docs, rows, nothing):
    got = collections.Counter((r[0], *(round(x, 9) if isinstance(x, float) else x for x in r[1:])) for r in quality.quality_rules(docs).collect())
    assert got == collections.Counter((r[0], *measured(r[1])) for r in rows)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and kept.count() == sum(measured(r[1])[6] for r in rows)
    assert quality.quality_rules(nothing).count() == quality.keep_good(nothing).count() == 0


def test_packing(docs, rows, nothing, library):
    got = [tuple(r) for r in packing.packed(docs, VOCABULARY, 1, capacity=512).collect()]
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*library(text), 1]
        expected.update((doc_id, k, s, len(ids[s : s + 512]), crc(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512)))
    assert collections.Counter(r[:5] for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 512
    assert len(bins) <= math.ceil(sum(r[3] for r in got) / 512) + 1
    assert packing.packed(nothing, VOCABULARY, 1).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cap = int(rng.integers(1, 50))
        counts = {int(k): int(rng.integers(1, 30)) for k in rng.choice(np.arange(1, cap + 1), min(cap, 8), replace=False)}
        p = packing.plan(counts, cap)
        load = collections.Counter()
        for length, n, first, offset in zip(p["length"].tolist(), p["n"].tolist(), p["sequence"].tolist(), p["offset"].tolist()):
            for s in range(first, first + n):
                load[s] += length
                assert offset + length <= cap
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fitting = [r for r in rooms if r >= length]
                room = min(fitting) if fitting else cap
                if fitting:
                    rooms.remove(room)
                rooms.append(room - length)
        assert sorted(cap - x for x in load.values()) == sorted(rooms)
    with pytest.raises(ValueError, match="fit"):
        packing.plan({9: 1}, 8)


def test_languages(docs, rows, nothing):
    net = langid.fit(docs, docs_per_lang=30)
    assert net.langs == ["en", "fr"]
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert {k for k in by_id if by_id[k]["lang_pred"] == "und"} - {None} == {100, 101, 102, 103}
    assert all(0 <= r["score"] <= 1 for r in got)
    sure = [(by_id[r[0]]["lang_pred"], r[2]) for r in rows if r[0] is not None and r[0] < 60 and len(words(r[1])) > 50]
    assert np.mean([a == b for a, b in sure]) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema and 100 not in {r["doc_id"] for r in kept.collect()}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98


def test_the_language_sample_keeps_its_bound(spark, monkeypatch):
    """One id over thousands of texts, and one text over thousands of ids."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, langs: seen.append(len(windows)))
    rows = [(7, f"a text of its own number {i}", "en") for i in range(3000)] + [(i, "ever the same", "de") for i in range(3000)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), docs_per_lang=50, windows_per_doc=2)
    assert seen and 40 <= seen[0] <= 2 * 50 + 2


def test_languages_without_labels(spark, docs):
    unlabelled = docs.drop("lang").withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == docs.count()
    assert langid.keep_identified(docs.where("false")).count() == 0


def winnowed(text, k=5, w=8):
    """(hash, place) of the selected grams: rolled word by word, the rightmost minimum taken window by window."""
    full = (1 << 64) - 1

    def turn(x, n):
        return (x << n | x >> (64 - n)) & full if n % 64 else x

    hs = [xxhash.xxh64_intdigest(t.encode(), 42) for t in words((text or "").lower())]
    if not hs:
        return []
    k = min(k, len(hs))
    now, rolls = 0, []
    for i, h in enumerate(hs):
        now = turn(now, 1) ^ h ^ (turn(hs[i - k], k) if i >= k else 0)
        if i >= k - 1:
            rolls.append(now >> 32)
    out = []
    for i in range(max(1, len(rolls) - w + 1)):
        here = rolls[i : i + w]
        best = min(here)
        place = i + max(j for j, x in enumerate(here) if x == best)
        if not out or out[-1][1] != place:
            out.append((best, place))
    return out


def alike(a, b):
    a, b = ({h for h, _ in x} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_winnowing(docs, rows, nothing):
    got = winnow.edited_likeness(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63)), reverse=True)
    expected = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b = winnowed(text), winnowed(edited)
        shown = [" ".join(f"{h:x}:{p}" for h, p in x) for x in (a, b)]
        expected.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, round(alike(a, b), 12), round(alike(a, winnowed(after)), 12)))
    assert collections.Counter((*tuple(r)[:5], round(r[5], 12), round(r[6], 12)) for r in got) == collections.Counter(expected)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[101]["fingerprint"] == "" and by_id[101]["near_edited"] == 1.0
    assert collections.Counter(r["fingerprint"] for r in winnow.fingerprints(docs).collect()) == collections.Counter(r["fingerprint"] for r in got)
    assert winnow.edited_likeness(nothing).count() == 0
    only = docs.where("doc_id = 105")
    assert winnow.edited_likeness(only).first()["near_next"] == 1.0


def test_next_documents_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(winnow, "STRETCH_DOCS", 7)
    rng = random.Random(9)
    rows = [(i * i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(100)]
    got = {r["doc_id"]: r["edited_sha256"] for r in winnow.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for (_, after), (doc_id, text) in zip(rows[-1:] + rows[:-1], rows):
        half = len(text) // 2
        assert got[doc_id] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_winnowing_keeps_its_guarantee(spark):
    rng = np.random.default_rng(3)
    text = [str(x) for x in rng.integers(0, 6, 300)]
    got = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    picked = [x.split(":") for x in winnow.fingerprints(got).first()["fingerprint"].split(" ")]
    places, hashes = [int(p) for _, p in picked], {}
    k, w = winnow.GRAM_WORDS, winnow.WINDOW_GRAMS
    assert places == sorted(places) and all(b - a <= w for a, b in zip(places, places[1:])) and places[0] < w
    for h, p in picked:  # one hash for one gram
        assert hashes.setdefault(tuple(text[int(p) : int(p) + k]), h) == h


def test_scores(docs, rows, nothing):
    got = lm.scores(docs, known=40).collect()
    tokens = [[*words((r[1] or "").translate(LOWER)), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = collections.Counter(t for ts, out in zip(tokens, held) if not out for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter(
        (r[0], out, len(ts), sum(t in counts for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts, out in zip(rows, tokens, held)
    )
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    assert lm.scores(nothing).count() == 0


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


def test_the_network_beats_counts_whatever_the_layout(table, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1 << 17)
    made = [{r["doc_id"]: r for r in lm.scores(table.repartition(n)).collect()} for n in (1, 4, 16)]
    for other in made[1:]:
        for k, r in made[0].items():
            assert abs(other[k]["score"] - r["score"]) <= 1e-6 * abs(r["score"]) and abs(other[k]["base_score"] - r["base_score"]) <= 1e-9 * abs(r["base_score"])
    held = [r for r in made[0].values() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    score, base = (sum(r[c] for r in held) / tokens for c in ("score", "base_score"))
    monkeypatch.setattr(lm, "trained", lambda *a: gru.fresh())
    untrained = sum(r["score"] for r in lm.scores(table).collect() if r["held_out"]) / tokens
    assert score > base + 0.15 and score > untrained + 0.15


def test_every_symbol_is_learned_from():
    for n in (0, 1, 63, 64, 700, 33000):
        teacher = gru.Trainer(gru.fresh(), 0.01)
        rest = teacher.feed(np.arange(n) % gru.SYMBOLS, False)
        assert teacher.seen + len(rest) == n and len(teacher.feed(rest)) == 0 and teacher.seen == n


def test_network_carries_state_and_has_right_gradients():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in gru.fresh().items()}
    x, y = (rng.integers(0, gru.SYMBOLS, (5, 3)) for _ in range(2))
    x[2, 1] = gru.END
    h = rng.normal(size=(3, gru.HIDDEN))
    _, g, _ = gru.window_gradients(p, x, y, h)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        sides = []
        for step in (1e-5, -1e-5):
            p[k][at] += step
            sides.append(gru.window_gradients(p, x, y, h)[0])
            p[k][at] -= step
        assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-6
    q = gru.fresh()
    symbols = np.append(rng.integers(1, gru.SYMBOLS, 100), gru.END)
    state, before, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([gru.END]), 0.0
    for s in symbols:
        state = gru.step(q, before, state)[0]
        before = np.array([s])
        total += gru.log_probabilities(q, state, before)[0]
    assert abs(gru.document_scores(q, np.concatenate([symbols, [gru.END]]), np.array([0, 101, 102]))[0] - total) < 1e-2
    assert {k: v.shape for k, v in gru.unpack(gru.pack(q)).items()} == {k: v.shape for k, v in q.items()}


def fingerprint(text, n=4):
    w = words((text or "").translate(LOWER))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((p[0] for p, x in zip(prints, group) if x == g and p[0] is not None), default=None) for g in group}
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((d, f"{f:016x}", least[g]) for (d, f), g in zip(prints, group))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("most", [1 << 14, 20])  # the second cuts the dense group into chunks
def test_links_lose_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(simhash.meetings, "__defaults__", (most,))
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**64, 40, dtype=np.uint64)
    chain = [values[0]]
    for _ in range(300):  # a dense group: every value a few bits from an earlier one
        v = int(chain[int(rng.integers(len(chain)))])
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            v ^= 1 << int(b)
        chain.append(np.uint64(v))
    values = np.unique(np.concatenate([values, np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fingerprint long")
    found = components(simhash.links(df)).collect()
    label = {int(x): int(x) for x in values.view(np.int64)} | {r["node"]: r["label"] for r in found}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    seen, want = {}, values.view(np.int64).tolist()
    for i in range(len(values)):
        if i in seen:
            continue
        queue, seen[i] = [i], i
        while queue:
            for j in np.flatnonzero(near[queue.pop()]):
                if j not in seen:
                    seen[j] = i
                    queue.append(j)
    pairs = {(seen[i], label[want[i]]) for i in range(len(values))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 9), (None, 1), (20, 21), (21, 20)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_taken_words_are_those_of_the_schedule(spark):
    """The closed form against slots joined to blocks, word by word."""
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 100, 700]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = docs.select("source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = mixing.source_targets(sizes)
    times = collections.Counter((r["sid"], r["block"]) for r in mixing.schedule(sources, sum(r["source_size"] for r in sizes.collect())).collect())
    for r in got:
        assert r["taken"] == sum(times[r["sid"], k // mixing.BLOCK_WORDS] for k in range(r["start"], r["start"] + r["size"]))
    order = sorted((r for r in got if r["sid"] == 0), key=lambda r: (hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()))
    assert [r["start"] for r in order] == [sum(x["size"] for x in order[:k]) for k in range(len(order))]


def test_documents_come_as_often_as_the_mix_takes_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words_of = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    taken = mixing.repeated_as_mixed(docs).groupBy("source").agg(F.sum(words_of).alias("n"))
    want = {r["source"]: r["t"] for r in mixing.mix(docs).groupBy("source").agg(F.max("target").alias("t")).collect()}
    got = {r["source"]: r["n"] for r in taken.collect()}
    assert set(got) == set(want) and all(abs(got[s] - t) <= 0.02 * t + 2000 for s, t in want.items())


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: cap * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mix(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(words(r[1]))) for r in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 5 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(2)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert mixing.mix(nothing).count() == 0
    assert {(r["target"], r["taken"]) for r in mixing.mix(docs.where("doc_id in (100, 101, 102)")).collect()} == {(0.0, 0)}
    assert mixing.repeated_as_mixed(nothing).count() == 0
    mixed = mixing.repeated_as_mixed(docs)
    assert mixed.schema.names == docs.schema.names
    assert set(r["doc_id"] for r in mixed.collect()) <= {r["doc_id"] for r in got if r["taken"]}
