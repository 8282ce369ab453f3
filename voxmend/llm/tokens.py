"""Token ids of whole texts with the tokenizers library, word by word with a bounded memory of words."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxmend.llm.common import one_thread, plain_strings, worker_memory
from voxmend.llm.wordkernel import chunks

#: Distinct words, and parts of them, that a Python worker remembers; then it forgets all but those of the texts at hand.
REMEMBERED_WORDS = 3 << 17
REMEMBERED_PARTS = 3 << 17
#: ASCII punctuation (no apostrophe) that may close a word.
_CLOSING = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~-"
#: Bytes of texts whose words are told apart at once.
CHUNK_BYTES = 4 << 20
#: Words that go through the library in one text.
_TOGETHER = 512
#: What word by word encoding relies on: normalizers that look at no more than a word, and a split between a letter and punctuation.
_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that every Unicode version of the last twenty years has: Latin, Greek, Cyrillic, kana, Han, Hangul.
_OLD_LETTERS = ((0x80, 0x52F), (0x3041, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Letters that are lower case, composed and one letter under any Unicode version: Latin, Greek, Cyrillic, kana, Han, Hangul.
_PLAIN_LETTERS = ((0x61, 0x7A), (0xDF, 0x17F), (0x3AC, 0x3CE), (0x430, 0x45F), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_LETTERS_ONLY = f"^[{''.join(c for a, b in _PLAIN_LETTERS for c in map(chr, range(a, b + 1)) if c.isalpha() and c.lower() == c and unicodedata.is_normalized('NFC', c))}]+$"


def steps(kind: dict | None, key: str) -> list[dict]:
    """The members of a sequence in a tokenizer's definition, or the one that it is."""
    return [] if kind is None else kind[key] if kind.get("type") == "Sequence" else [kind]


def by_words(made: dict) -> bool:
    """Whether a tokenizer gives a text the ids of its words (cut at ASCII white space) one after the other, and a word's
    letters or digits and closing punctuation ids of their own: by its normalizers, its one split, and no later additions."""
    normal, cuts = steps(made.get("normalizer"), "normalizers"), steps(made.get("pre_tokenizer"), "pretokenizers")
    if {x["type"] for x in normal} - _NORMALIZERS or not any(x["type"] == "Lowercase" for x in normal) or made.get("truncation"):
        return False
    if any(x["type"] == "Replace" and (x["pattern"].get("Regex"), x["content"]) != ("\\s+", " ") for x in normal):
        return False
    split = [x for x in cuts if x["type"] != "ByteLevel"]
    own = [x for x in cuts if x["type"] == "ByteLevel"]
    return len(split) == 1 and split[0].get("pattern", {}).get("Regex") == _SPLIT and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True) and all(not x["add_prefix_space"] and not x["use_regex"] for x in own)


class WordEncoder:
    """The ids that a tokenizer gives whole texts (add_special_tokens=False).

    If the tokenizer works by words (see by_words), each distinct word, less its closing punctuation, goes through the
    library once and is remembered: the ids of word w are flat[first[w] : first[w] + count[w]]. Words and parts are Arrow
    arrays, looked up by Arrow: only new parts reach Python. Texts that hold the string of a special token, and all
    texts under any other tokenizer, go through the library whole.
    """

    def __init__(self, definition: str, words: int = REMEMBERED_WORDS, parts: int = REMEMBERED_PARTS):
        one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = by_words(made)
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.most_words, self.most_parts = words, parts
        # The same model for runs of plain letters, which normalizers and split leave as they are.
        self.of_letters = Tokenizer(self.tokenizer.model)
        own = any(x["type"] == "ByteLevel" for x in steps(made.get("pre_tokenizer"), "pretokenizers"))
        bytewise = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)] * own
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *bytewise])
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.parts = pa.array([""], pa.large_string())
        self.flat = np.zeros(1 << 12, np.uint32)
        self.first, self.count, self.part_first, self.part_count = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.n_flat = 0

    def forget_but(self, words: pa.Array) -> None:
        """Forgets all words but those of these that are known: common words come in every run of texts."""
        at = self.places(words, self.words)
        words, at = words.take(pa.array(np.flatnonzero(at >= 0))), at[at >= 0]
        sizes, first = self.count[at].astype(np.int64), self.first[at]
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(first - (upto - sizes), sizes) + np.arange(sizes.sum())]
        self.forget()
        self.first, self.count = self.grown(self.first, len(words)), self.grown(self.count, len(words))
        self.first[: len(words)], self.count[: len(words)] = self.add(ids) + upto - sizes, sizes
        self.words = words

    @staticmethod
    def places(what: pa.Array, known: pa.Array) -> np.ndarray:
        """Where each of what stands in known, or -1."""
        return pc.fill_null(pc.index_in(what, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    @staticmethod
    def grown(x: np.ndarray, n: int) -> np.ndarray:
        """x with room for n, doubled as often as that takes."""
        if n <= len(x):
            return x
        out = np.zeros(1 << n.bit_length(), x.dtype)
        out[: len(x)] = x
        return out

    def add(self, ids: np.ndarray) -> int:
        """Where ids now start in flat."""
        at = self.n_flat
        self.n_flat += len(ids)
        self.flat = self.grown(self.flat, self.n_flat)
        self.flat[at : self.n_flat] = ids
        return at

    @staticmethod
    def cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The words (large_string) without their closing punctuation, and that, where a letter that lower-casing keeps one
        letter, or a digit, stands before it."""
        before = pc.ascii_rtrim(words, characters=_CLOSING.decode())
        size, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, before))
        some = np.flatnonzero((kept > 0) & (kept < size))
        off, data = (np.frombuffer(x, kind) if x else np.zeros(0, kind) for x, kind in zip(before.buffers()[1:], (np.int64, np.uint8)))
        last = data[off[before.offset + some + 1] - 1]
        plain = (last >= 48) & (last <= 57) | (last >= 97) & (last <= 122)
        odd = np.flatnonzero(last >= 128)
        letters = (x[-1] for x in before.take(pa.array(some[odd])).to_pylist())
        plain[odd] = [any(a <= ord(x) <= b for a, b in _OLD_LETTERS) and x.isalpha() and len(x.lower()) == 1 for x in letters]
        ends = np.zeros(len(words), bool)
        ends[some[plain]] = True
        # What was cut off: the last bytes of those words.
        off, data = (np.frombuffer(x, kind) if x else np.zeros(0, kind) for x, kind in zip(words.buffers()[1:], (np.int64, np.uint8)))
        n = np.where(ends, size - kept, 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        stop = off[words.offset + 1 : words.offset + 1 + len(words)]
        tails = data[np.repeat(stop - n - upto[:-1], n) + np.arange(upto[-1])]
        tail = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(upto), pa.py_buffer(tails)])
        return pc.if_else(pa.array(ends), before, words), tail

    def ask(self, parts: pa.Array) -> None:
        """Remembers the ids of parts, put to the library with spaces between."""
        letters = pc.match_substring_regex(parts, _LETTERS_ONLY)
        n = len(self.parts)
        self.part_first, self.part_count = self.grown(self.part_first, n + len(parts)), self.grown(self.part_count, n + len(parts))
        plain, others = parts.filter(letters), parts.filter(pc.invert(letters))
        self.parts = pa.concat_arrays([self.parts, plain, others])
        for tokenizer, asked in ((self.of_letters, plain.to_pylist()), (self.tokenizer, others.to_pylist())):
            for a in range(0, len(asked), _TOGETHER):
                texts = asked[a : a + _TOGETHER]
                found = tokenizer.encode(" ".join(texts), add_special_tokens=False)
                ids = np.array(found.ids, np.uint32)
                if tokenizer is self.of_letters:
                    edge = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(1, len(texts) + 1))
                else:  # a part may be several words to the library: offsets say whose an id is
                    edge = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(ids)), np.cumsum([len(t) + 1 for t in texts]))
                start = np.concatenate([[0], edge[:-1]])
                self.part_first[n : n + len(texts)], self.part_count[n : n + len(texts)] = self.add(ids) + start, edge - start
                n += len(texts)

    def learn(self, words: pa.Array) -> None:
        coded = pa.concat_arrays(self.cut(words)).dictionary_encode()
        at = self.places(coded.dictionary, self.parts)
        new = np.flatnonzero(at < 0)
        if len(new):
            asked = coded.dictionary.take(pa.array(new))
            known = len(self.parts)
            self.ask(asked)
            at[new] = known + self.places(asked, self.parts.slice(known))
        core, tail = np.split(at[coded.indices.to_numpy()], 2)
        n = len(self.words)
        self.first, self.count = self.grown(self.first, n + len(words)), self.grown(self.count, n + len(words))
        first, count = self.part_first[core], self.part_count[core]
        both = np.flatnonzero(tail)
        if len(both):
            ends = np.stack([core[both], tail[both]], axis=1).reshape(-1)
            sizes = self.part_count[ends].astype(np.int64)
            upto = np.cumsum(sizes)
            place = self.add(self.flat[np.repeat(self.part_first[ends] - (upto - sizes), sizes) + np.arange(upto[-1])])
            count[both] = sizes[0::2] + sizes[1::2]
            first[both] = place + (upto - sizes)[0::2]
        self.first[n : n + len(words)], self.count[n : n + len(words)] = first, count
        self.words = pa.concat_arrays([self.words, words])

    def words_encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of an Arrow array of texts one after the other, and where each text's end. Arrow's ASCII
        functions lower A-Z and split at space and 0x09-0x0D and touch nothing else."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.parts) > self.most_parts or len(self.words) > self.most_words:
            self.forget_but(distinct)
        row = self.places(distinct, self.words)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.words) + np.arange(len(new))
            self.learn(distinct.take(pa.array(new)))
        at = row.astype(np.int32)[coded.indices.to_numpy()]
        count = self.count[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        kind = np.int32 if max(upto[-1], self.n_flat) < 2**31 else np.int64
        place = np.repeat(self.first[at] - upto[:-1].astype(kind), count)
        place += np.arange(upto[-1], dtype=kind)
        where = lists.offsets.to_numpy().astype(np.int64)
        return self.flat[place], upto[where[1:] - where[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of an Arrow array of texts one after the other, and where each text's end."""
        whole = np.full(len(texts), not self.by_words)
        if self.by_words:
            for mark in self.special:
                whole |= pc.match_substring(texts, mark, ignore_case=True).to_numpy(zero_copy_only=False)
            if not whole.any():
                return self.words_encoded(texts)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k in np.flatnonzero(whole):
            parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        by_words = np.flatnonzero(~whole)
        if len(by_words):  # all at once: every look at what is remembered costs as much as for many texts
            ids, ends = self.words_encoded(texts.take(pa.array(by_words)))
            for k, x in zip(by_words, np.split(ids, ends[:-1])):
                parts[k] = x
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum([len(x) for x in parts])

    def runs(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, ends) of runs of texts of an Arrow column (null: empty), some megabytes of texts at a time:
        their ids one after the other, end_id behind each, and where each text's end."""
        column = plain_strings(column)
        for first, last, _, _ in chunks(column, CHUNK_BYTES):
            ids, ends = self.encode(column.slice(first, last - first))
            yield first, last, np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, last - first + 1)


def encoder(definition: str) -> WordEncoder:
    """The worker's one encoder for this definition (the text of the tokenizer's JSON file), kept from task to task."""
    kept = worker_memory()
    if kept.get("definition") != definition:
        kept["definition"], kept["encoder"] = definition, WordEncoder(definition)
    return kept["encoder"]


def definition(path: str) -> str:
    """The tokenizer file's text, read on the driver and broadcast: executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
