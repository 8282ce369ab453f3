"""Language identification by a byte convolutional network, trained in numpy on labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmend.llm.common import let_go, only, shipped
from voxmend.llm.wordkernel import LOWER, chunks

WINDOW_BYTES = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBEDDING = 8
#: The bounded sample that the network is fitted on: so many labelled documents of each language, so many windows of each.
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4
EPOCHS = 10
#: How many times the sample a hash bound aims at, and how many languages are learned at most.
SPARE = 1.5
MAX_LANGS = 256
UNKNOWN = "und"
#: A document is kept by keep_identified if its language's mean probability over windows is at least this.
MIN_SCORE = 0.5
_PAD = max(WIDTHS) - 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class ByteNet:
    """Embedding of bytes, filters of several widths, the maximum of each over a window, and a softmax over langs."""

    langs: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    tables: dict[int, list[np.ndarray]] = field(default_factory=dict, repr=False)

    def lookup(self) -> dict[int, list[np.ndarray]]:
        """For each width, a table by byte pair for every two bytes of a filter: applying it is a sum of looked-up rows."""
        if not self.tables:
            for width, w in self.filters.items():
                one = np.einsum("bd,kdf->kbf", self.embedding, w.reshape(width, -1, w.shape[-1]))  # by place and byte
                self.tables[width] = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, width, 2)]
        return self.tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Rows of WINDOW_BYTES + _PAD bytes (0: nothing there) to probabilities of langs."""
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        n, length = len(windows), WINDOW_BYTES
        pooled = []
        for width, tables in self.lookup().items():
            total = tables[0].take(pairs[:, :length].reshape(-1), axis=0)
            for k, t in enumerate(tables[1:], 1):
                total += t.take(pairs[:, 2 * k : 2 * k + length].reshape(-1), axis=0)
            pooled.append(total.reshape(n, length, -1).max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def __getstate__(self):
        return {**self.__dict__, "tables": {}}


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
    """Adam on the cross entropy; windows are shortened at random so that short texts are learned too."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_features = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "b": np.zeros(n_features), "d": rng.normal(0, 0.2, (n_features, len(langs))), "o": np.zeros(len(langs))}
    p |= {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p["e"][0] = 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, batch = 0, 64
    weight = 1.0 / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    weight = weight[labels] / weight[labels].mean()
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            here = order[a : a + batch]
            x = windows[here].copy()
            size = np.where(rng.random(len(here)) < 0.5, WINDOW_BYTES + _PAD, rng.integers(6, WINDOW_BYTES, len(here)))
            x[np.arange(x.shape[1])[None, :] >= size[:, None]] = 0
            length = int(min(WINDOW_BYTES, max(size.max(), 1)))
            emb = p["e"][x]
            pooled, places = [], []
            for w in WIDTHS:
                z = sum(emb[:, k : k + length] @ p[w][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w))
                places.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, places[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + p["b"]
            h = np.maximum(raw, 0)
            z = h @ p["d"] + p["o"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(here)), labels[here]] -= 1
            q *= weight[here][:, None] / len(here)
            g = {"d": h.T @ q, "o": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = (q @ p["d"].T) * (raw > 0)
            g["b"] = dh.sum(axis=0)
            rows = np.arange(len(here))[:, None]
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g[w] = np.zeros_like(p[w])
                for k in range(w):
                    part = slice(k * EMBEDDING, (k + 1) * EMBEDDING)
                    at = places[i] + k
                    g[w][part] = np.einsum("bfe,bf->ef", emb[rows, at], d)
                    np.add.at(g["e"], x[rows, at].reshape(-1), (d[:, :, None] * p[w][part].T[None]).reshape(-1, EMBEDDING))
            g["e"][0] = 0
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    f = {k: x.astype(np.float32) for k, x in p.items()}
    return ByteNet(langs, f["e"], {w: f[w] for w in WIDTHS}, f["b"], f["d"], f["o"])


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text number) of the fixed-length windows of texts laid end to end; every byte is in a window of its text."""
    n = -(-np.diff(off) // WINDOW_BYTES)
    doc = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return off[doc] + nth * WINDOW_BYTES, doc


def laid_out(data: np.ndarray, off: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW_BYTES + _PAD)[None, :]
    there = at < off[doc + 1][:, None]
    return np.where(there, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; such documents are never learned from. Null doc_id: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, max_langs: int = MAX_LANGS) -> ByteNet | None:
    """A network from docs (doc_id, text, lang), or None without a labelled text.

    The fit is on a bounded sample: of each lang (the max_langs most frequent) the docs_per_lang distinct texts lowest in a
    hash, among rows not held out with doc_id, text and lang, and windows_per_doc windows spread over each. A hash bound
    by each lang's rows leaves about SPARE times as many in the scan, so no lang is ranked or gathered anywhere; equal
    texts count once, however many rows or ids they have. Nothing but these windows comes to the driver.
    """
    rows = only(docs, doc_id="long", text="string", lang="string").where("doc_id is not null and lang is not null and text is not null and text <> ''").where(~held_out())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, SPARE * docs_per_lang / r["n"]))))
    marked = rows.select("text", "lang", F.xxhash64("text", F.lit(5)).alias("mark"))
    low = F.shiftrightunsigned("mark", 11).cast("double") / float(1 << 53)
    near = marked.where(low < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, off in chunks(batch.column("text")):
                data = LOWER[data]
                start, doc = windows_of(data, off)
                n = np.bincount(doc, minlength=last - first)
                head = np.cumsum(n) - n
                found = []
                for d in range(last - first):
                    pick = np.unique(head[d] + n[d] * np.arange(windows_per_doc) // windows_per_doc)
                    found.append(laid_out(data, off, start[pick], doc[pick]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, last - first), batch.column("mark").slice(first, last - first), pa.array(found, pa.binary())], ["lang", "mark", "windows"])

    sample = near.mapInArrow(spread, "lang string, mark long, windows binary").dropDuplicates(["lang", "mark"]).toPandas()
    sample["rank"] = sample["mark"].astype("uint64")
    sample = sample.sort_values(["lang", "rank"], kind="stable").groupby("lang").head(docs_per_lang)
    if not len(sample):
        return None
    langs = sorted(sample["lang"].unique())
    each = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW_BYTES + _PAD) for x in sample["windows"]]
    labels = np.repeat(sample["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), [len(x) for x in each])
    return train(np.concatenate(each), labels, langs)


def languages(net: ByteNet | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Predicted language and its mean probability (weighted by bytes) over the windows of each text of an Arrow column."""
    names: list[str] = []
    scores: list[float] = []
    for first, last, data, off in chunks(column):
        n = last - first
        upto = np.concatenate([[0], np.cumsum(_LETTER[data])])
        spoken = upto[off[1:]] > upto[off[:-1]]
        for k in np.flatnonzero(~spoken & (np.diff(off) > 0)):
            spoken[k] = any(map(str.isalpha, data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")))
        if net is None or not spoken.any():
            names += [UNKNOWN] * n
            scores += [0.0] * n
            continue
        low = LOWER[data]
        start, doc = windows_of(low, off)
        use = spoken[doc]
        start, doc = start[use], doc[use]
        total = np.zeros((n, len(net.langs)))
        for a in range(0, len(start), 256):
            s, d = start[a : a + 256], doc[a : a + 256]
            size = np.minimum(off[d + 1] - s, WINDOW_BYTES)
            np.add.at(total, d, net.probabilities(laid_out(low, off, s, d)) * size[:, None])
        best = total.argmax(axis=1)
        share = total[np.arange(n), best] / np.maximum(total.sum(axis=1), 1e-30)
        names += [net.langs[b] if ok else UNKNOWN for b, ok in zip(best, spoken)]
        scores += np.where(spoken, np.clip(share, 0.0, 1.0), 0.0).tolist()
    return names, np.array(scores)


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text); one scan, no shuffle.

    lang_pred is a lang that the network learned, or und (score 0) for a text that is null or has no letter, and for every
    text if nothing was learned. score is that lang's mean probability over the windows of the whole text. Ties go to the lang first in
    code point order. Repeated rows are predicted alike. An empty table gives no rows; extra columns are ignored.
    """
    shared = shipped(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = shared()
        for batch in batches:
            names, scores = languages(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = only(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs (doc_id, text, lang and more), with their columns, whose language is known and has at least min_score;
    fitted on docs themselves.

    Rows with a null or empty text, or without a letter, go. If nothing can be learned, as no row has a lang, the network
    tells nothing about any row, and all rows stay. Repeated rows are treated alike; a null doc_id or lang is no reason to
    go; an empty table stays empty.
    """
    net = fit(docs)
    if net is None:
        return docs
    shared = shipped(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = shared()
        for batch in batches:
            names, scores = languages(model, batch.column("text"))
            yield batch.filter(pa.array((np.array(names, object) != UNKNOWN) & (scores >= min_score)))

    return docs.mapInArrow(run, docs.schema)
