"""The pipeline's near-duplicates against brute force over all pairs of 5-word shingle sets."""

import random

import corpus_pipeline
import numpy as np
from llm_fixtures import LOWER, words

from voxmend.llm import similar
from voxmend.llm.simhash import apart, distances, squared


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if group[i] != group[j] and (not both or 5 * len(sets[i] & sets[j]) >= 4 * both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_stage_finds_pairs_of_similarity_four_fifths(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 30))):
                w[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    # One id over two texts, two rows alike, null ids, texts without a word.
    rows += [(5, "a text of its own under an id that is taken"), rows[7], rows[7], (None, rows[9][1]), (None, "only here, without an id at all"), (900, ""), (901, None), (902, " \n")]
    group = survivors(rows)
    wanted = []
    for g in set(group):
        wanted.append(min((r[0] is None, r[0] or 0) for r, x in zip(rows, group) if x == g))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(wanted)
    left = survivors([tuple(r) for r in kept])
    assert len(set(left)) == len(left)


def test_pivots_discard_what_is_unlike_and_lose_no_pair():
    rng = np.random.default_rng(4)
    pivots = similar.orthogonal_pivots(similar.PIVOTS)
    assert {int(x) for i, p in enumerate(pivots) for x in apart(pivots[:i], p)} == {similar.PRINT_BITS // 2}

    def flipped(one, n):
        bits = np.unpackbits(one.astype(">u8").view(np.uint8))
        bits[rng.choice(similar.PRINT_BITS, n, replace=False)] ^= 1
        return np.packbits(bits).view(">u8").astype(np.uint64)

    sizes = np.array([2, 5, 31, 32, 33, 2, 150])
    values = rng.integers(0, 2**64, (sizes.sum(), 2), dtype=np.uint64)
    for i in range(1, len(values), 2):  # every second print is near an earlier one, up to the bound and just over it
        values[i] = flipped(values[rng.integers(max(0, i - 4), i)], [3, 20, 35, 36, 36, 37, 38][i % 7])
    values[-1] = ~values[-2]
    i, j = np.triu_indices(len(values), 1)
    table = distances(values, pivots)
    assert (table == [[int(apart(v, p)) for p in pivots] for v in values]).all()
    left = squared(table, i, j) <= similar.PRINT_BITS * similar.MOST_BITS
    near = apart(values[i], values[j]) <= similar.MOST_BITS
    assert near.sum() > 60 and left[near].all()
    assert left[~near].mean() < 0.02
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = near & (group[i] == group[j])
    names = np.arange(len(values))
    wanted = similar.least_linked(names, i[inside], j[inside])
    assert (similar.least_linked(names, *similar.pairs_within(values, sizes)) == wanted).all()


def test_stage_sends_meeting_prints_through_the_pivot_table(spark, monkeypatch):
    """With a pivot table that says that all prints are far apart, nothing is found."""
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text.replace("w7 ", "n7 "))], "doc_id long, text string")
    assert similar.one_of_similar(docs).count() == 1
    monkeypatch.setattr(similar, "squared", lambda table, left, right: np.full(len(left), 1 << 20))
    assert similar.one_of_similar(docs).count() == 2
