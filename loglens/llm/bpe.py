"""BPE encoding and decoding by a prefix-sharing trie.

Texts are cut into words as the vocabulary file asks (NFC, lower case, the
split pattern).  The distinct words of a slice of texts are inserted into a
trie and walked depth first.  The state of a trie node is the last token of
the encoding of its prefix: among the vocabulary entries that end there it
is the only one that may follow the last token of the shorter prefix it
leaves.  A word's tokens are read by going back from its end.  Each shared
prefix is worked out once.

Edge cases: a null or empty text has no tokens and decodes to ''; the
special tokens' own strings in a text become their ids, as the library does;
repeated rows are encoded each for itself; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, slices, text_or_empty

# Words with their punctuation that a task remembers between slices; afterwards it starts anew (memory only, never the result).
REMEMBERED_CHUNKS = 150_000
# Bytes of text whose distinct words go into one trie.
LEARN_BYTES = 8 << 20
# Of these, chunks whose words and tokens are lists at a time; each costs about 1 kB, which a worker hardly ever gives back.
LEARN_CHUNKS = 1 << 14
# Pairs of tokens whose order is remembered (some 30 MB).
REMEMBERED_PAIRS = 1 << 18
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = (b for b in range(256) if b not in set(shown))
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and split pattern of a tokenizers file with word-end suffixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", WHITE_SPACE)
        self.words = regex.compile(pattern, flags=regex.V0)
        self.other_spaces = regex.compile(f"[{WHITE_SPACE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.rank: dict[tuple[int, int], int] = {}
        #: token -> (rank of the merge that makes it, left part, right part); first merge of a string counts
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = rank
            self.made.setdefault(whole, (rank, left, right))
        #: tokens by their symbols from last to first, inside words and at their end; "" holds the token
        self.endings: tuple[dict, dict] = ({}, {})
        for string, token in self.ids.items():
            own = string.removesuffix(self.end) or string
            node = self.endings[own != string]
            for symbol in reversed(own):
                node = node.setdefault(symbol, {})
            node[""] = token
        self.pairs: dict[tuple[int, int], bool] = {}

    def normalized(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # by single characters, so no final sigma

    def chunks(self, text: str) -> list[str]:
        """What stands between white space (no word goes over it), and special tokens after a space."""
        if "<|" not in text:
            return self._split(self.normalized(text))
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [f" {part}"] if i % 2 else self._split(self.normalized(part))
        return out

    def _split(self, text: str) -> list[str]:
        # str.split() takes these four for white space; the pattern doesn't
        return [c for c in self.other_spaces.split(text) if c] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def symbols(self, word: str) -> str:
        """The word in byte characters."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.alphabet)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave token b beside token a.

        Going back in time, the parts beside the border are the right spine of
        a and the left spine of b.  They would have merged over the border if
        their merge came before the merges that took them up (on the right
        also at the same rank, as the leftmost pair goes first).
        """
        x, y, until_x, until_y, fine = a, b, len(self.rank), len(self.rank), True
        while True:
            rank = self.rank.get((x, y))
            if rank is not None and rank < until_x and rank <= until_y:
                fine = False
                break
            of_x, of_y = self.made.get(x), self.made.get(y)
            if of_x is None and of_y is None:
                break
            if of_y is None or (of_x is not None and of_x[0] > of_y[0]):
                until_x, x = of_x[0], of_x[2]
            else:
                until_y, y = of_y[0], of_y[1]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = fine
        return fine


class WordTrie:
    """Encodings of distinct words; see the module text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.whole: dict[int, bool] = {}

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its tokens.

        The sorted words are the trie in depth-first order: what a word shares
        with the one before is the path from the root to their branching, whose
        states are still on the stack.
        """
        last: list[int] = []  # by depth - 1: the last token of the prefix
        back: list[int] = []  # by depth - 1: the depth that token leaves
        before = ""
        for word in sorted(words):
            most = min(len(last), len(word) - 1)  # a word's last symbol carries the word end
            if word[:most] != before[:most]:
                most = next(i for i in range(most) if word[i] != before[i])
            del last[most:], back[most:]
            for depth in range(most + 1, len(word)):
                token, start = self._state(word, depth, False, last)
                last.append(token)
                back.append(start)
            token, depth = self._state(word, len(word), True, last)
            tokens = [token]
            while depth:
                tokens.append(last[depth - 1])
                depth = back[depth - 1]
            tokens.reverse()
            before = word
            yield word, tokens

    def _state(self, word: str, depth: int, end: bool, last: list[int]) -> tuple[int, int]:
        node, found, start = self.v.endings[end], [], depth
        while start and (node := node.get(word[start - 1])) is not None:
            start -= 1
            if "" in node:
                found.append((node[""], start))
        pairs = self.v.pairs
        for token, start in reversed(found):
            if not start:
                fine = self._whole(token)
            else:
                pair = last[start - 1], token
                fine = pairs.get(pair)
                if fine is None:
                    fine = self.v.may_follow(*pair)
            if fine:
                return token, start
        raise ValueError(f"no token ends {word[:depth]!r}")

    def _whole(self, token: int) -> bool:
        """Whether the merges of the token's own symbols end in it alone: each split stays reachable."""
        known = self.whole.get(token)
        if known is None:
            made = self.v.made.get(token)
            known = self.whole[token] = made is None or not self.v.may_follow(made[1], made[2])
        return known


class Encoder:
    """Encodes slices of texts; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.trie = WordTrie(self.v)
        self.number: dict[str, int] = {f" {s}": i for i, s in enumerate(self.v.special)}
        self.shown: list[str] = list(self.v.special)
        self.flat = np.array(list(self.v.special.values()), np.int32)  # the tokens of chunk 0, 1, ...
        self.size = np.ones(len(self.flat), np.int64)
        self.used = np.zeros(len(self.flat), np.int64)

    def _forget(self) -> None:
        """Keep what was met again and again."""
        keep = np.flatnonzero(self.used >= 4).tolist()
        keep = [*range(len(self.v.special)), *keep[: REMEMBERED_CHUNKS // 2]]
        names = list(self.number)
        first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([self.flat[first[i] : first[i] + self.size[i]] for i in keep])
        self.size, self.shown = self.size[keep], [self.shown[i] for i in keep]
        self.number = {names[i]: k for k, i in enumerate(keep)}
        self.used = np.zeros(len(keep), np.int64)

    def _learn(self, chunks: set[str]) -> None:
        flats, sizes = [self.flat], [self.size]
        ordered = sorted(chunks)  # neighbours share prefixes
        for i in range(0, len(ordered), LEARN_CHUNKS):
            flat, size = self._tokens(ordered[i : i + LEARN_CHUNKS])
            flats.append(flat)
            sizes.append(size)
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)

    def _tokens(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number the chunks; their tokens one after another, and how many each has."""
        split, symbols = self.v.words.findall, self.v.symbols
        words = {c: [c] if c.isascii() and c.isalpha() else [symbols(w) for w in split(c)] for c in chunks}
        known = dict(self.trie.encode(list({w for ws in words.values() for w in ws})))
        flat, size = [], []
        for chunk, ws in words.items():
            tokens = known[ws[0]] if len(ws) == 1 else [t for w in ws for t in known[w]]
            self.number[chunk] = len(self.shown)
            self.shown.append(" ".join([self.v.strings[t] for t in tokens]))
            flat += tokens
            size.append(len(tokens))
        return np.array(flat, np.int32), np.array(size, np.int64)

    def learn(self, texts: pa.Array) -> None:
        """Encode the distinct chunks of the texts that aren't known yet."""
        if len(self.shown) > REMEMBERED_CHUNKS:
            self._forget()
        new: set[str] = set()
        for text in texts:
            new.update(set(self.v.chunks(text.as_py())).difference(self.number))
        self._learn(new)
        self.used = np.concatenate([self.used, np.zeros(len(self.size) - len(self.used), np.int64)])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Offsets by text, the ids of all texts one after another, decoded texts; learn() has had them."""
        number, shown = self.number.__getitem__, self.shown.__getitem__
        first = np.cumsum(self.size) - self.size
        offsets, ids, decoded, met = [0], [], [], [np.zeros(0, np.int64)]
        for text in texts:
            at = list(map(number, self.v.chunks(text)))
            decoded.append(" ".join(map(shown, at)))
            at = np.array(at, np.int64)
            n = self.size[at]
            total = int(n.sum())
            ids.append(self.flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(total)])
            offsets.append(offsets[-1] + total)
            met.append(at)
        self.used += np.bincount(np.concatenate(met), minlength=len(self.used))
        return np.array(offsets, np.int32), np.concatenate([np.zeros(0, np.int32), *ids]), decoded


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    """One vocabulary a Python worker; what a task remembers of its texts goes with the task."""
    return Vocabulary(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded string for every row; vocabulary: path of a tokenizers file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(vocabulary)
        encoder = Encoder(words)
        collects = gc.isenabled()
        gc.disable()  # the encoder's many small lists hold no cycles; walking through them takes a quarter of the time
        try:
            for some in slices(batches, size=LEARN_BYTES):
                encoder.learn(some.column(1))
                for part in slices(iter([some])):
                    offsets, ids, decoded = encoder.texts(part.column(1).to_pylist())
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["_k", "ids", "decoded"])
        finally:
            # the worker stays for tasks of other stages; a few small objects among many would hold all their memory
            words.pairs.clear()
            pa.default_memory_pool().release_unused()
            if collects:
                gc.enable()

    rows = docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("text"))
    kind = rows.schema["_k"].dataType.simpleString()
    return map_arrow(rows, run, f"_k {kind}, ids array<int>, decoded string").withColumnRenamed("_k", key)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a list of ids; a file without a decoder joins tokens by spaces."""
    return " ".join([vocabulary.strings[i] for i in ids])
