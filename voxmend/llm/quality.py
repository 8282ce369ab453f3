"""Quality rules by repetition coverage: how much of a text lies in its own repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxmend.llm.common import let_go, only
from voxmend.llm.wordkernel import Layout, chunks, covered, found_again, ngrams

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Largest share of a text's word characters that may lie in its repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.45, 7: 0.40, 10: 0.35}
#: Largest share of a text's word characters that may lie in lines that occurred before.
LINE_LIMIT = 0.30
MIN_WORDS = 50
REPEAT_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_LIMITS)
)


def measures(data: np.ndarray, off: np.ndarray, ngram_limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id for texts laid end to end."""
    at = Layout(data, off)
    prefix = at.prefix()
    word = at.span(prefix, at.start, at.end)
    letters = at.solid & ((data & 0xC0) != 0x80)  # first bytes of code points
    upto = np.concatenate([[0], np.cumsum(letters)])
    chars = upto[at.end] - upto[at.start]
    word_chars = upto[off[1:]] - upto[off[:-1]]
    out = {"n_words": at.n_words, "word_chars": word_chars, "n_symbols": at.per_text(SYMBOLS[data])}

    # Lines: each text's last line ends where the text does.
    breaks = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    last = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    # A line may start where its text ends and the next text starts, so lines are dealt to texts by count.
    n_lines = 1 + np.diff(np.searchsorted(breaks, off))
    doc = np.repeat(np.arange(len(off) - 1), n_lines)
    some = upto[last] > upto[first]
    first, last, doc = first[some], last[some], doc[some]
    key = at.span(prefix, first, last) ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.lexsort((first, key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=len(off) - 1).astype(np.int64)
    in_lines = np.bincount(doc[again], (upto[last] - upto[first])[again], minlength=len(off) - 1)

    def in_repeats(n: int) -> np.ndarray:
        where, keys = ngrams(word, at.doc, n)
        return covered(where[found_again(keys)], n, len(word))

    whole = np.maximum(word_chars, 1)
    out["n_repeat_words"] = at.per_text_words(in_repeats(3))
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["dup_line_share"] = in_lines / whole
    good = out["dup_line_share"] <= line_limit
    for n, limit in ngram_limits.items():
        share = at.per_text_words(np.where(in_repeats(n), chars, 0)) / whole
        out[f"dup_{n}gram_share"] = share
        good &= share <= limit
    out["kept"] = ~out["base_failed"] & good
    return out


def quality_rules(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per row of docs (doc_id, text) with its measures and verdict; one scan, no shuffle.

    Words are runs of anything but ASCII white space. base_failed: fewer than 50 words, or more than half of the words
    in 3-word windows that occur twice or more in the text. kept: not base_failed, and for each n of ngram_limits at
    most that share of the word characters lies in repeated n-word windows (every occurrence counts), and at most
    line_limit of them in lines equal to an earlier line.

    Null or empty text: no words, so base_failed and not kept. Repeated rows are measured alike. A null doc_id stays
    null. Extra columns of docs are ignored. An empty table gives no rows. Windows are compared by 64-bit rolling
    hashes, within one text only; memory is bounded by one megabyte of texts at a time, or one text.
    """
    limits = dict(ngram_limits or NGRAM_LIMITS)
    schema = SCHEMA.split(", dup_5gram")[0] + "".join(f", dup_{n}gram_share double" for n in limits)
    names = [x.split()[0] for x in schema.split(", ")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, off in chunks(batch.column("text")):
                found = measures(data, off, limits, line_limit)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), *(pa.array(found[x]) for x in names[1:])], names)

    return only(docs, doc_id="long", text="string").mapInArrow(measured, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text and more) that quality_rules keeps, with docs' own columns; verdict and text travel together, so
    nothing is joined. Null, empty and short texts go, as their verdict is; repeated rows stay or go together, whatever
    their ids; a null doc_id is no reason to go; an empty table stays empty."""
    names = docs.columns

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for first, last, data, off in chunks(batch.column("text")):
                found = measures(data, off, NGRAM_LIMITS, LINE_LIMIT)
                yield batch.slice(first, last - first).filter(pa.array(found["kept"]))

    return docs.select(*(f"`{x}`" for x in names)).mapInArrow(good, docs.schema)
