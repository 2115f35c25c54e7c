"""BPE encoding and decoding by a prefix-sharing traversal of a trie of distinct words.

The words of a block of texts are made distinct and visited in sorted order, which is the depth-first order of their trie. Each trie node
holds one state: the last token of the BPE encoding of its prefix. That token is a suffix of the prefix, and the node before it holds the
state of what precedes, so a word's tokens are read off by stepping back from its last node, and a shared prefix is worked out once. Of
the tokens that end at a node exactly one can follow the last token of the node where it begins: the one for which undoing both
tokens' merges, newest first, meets no merge across their border that BPE would have made earlier. Words keep their tokens for later
blocks of the same task, in a table of bounded size.

For vocabularies with an end-of-word suffix and byte-level symbols, as in word_bpe_49k.json: NFC, lower case, white space dropped.

Defined results: null and empty texts have no tokens and decode to the empty text; the strings of special tokens in a text become these
tokens; equal rows give equal results; long texts are read in slices that end in white space, with the result of the whole text; tables
may have any other columns: those kept by name are returned, and give way where the names of results clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._support import read_texts, unpacked

BLOCK = 2 << 20
#: Words whose tokens a task keeps between blocks.
KEPT_WORDS = 400_000

#: The vocabulary's words in texts of characters below U+0250: letters, a contraction's end, one digit, or other signs.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_BLANK = "\\t-\\r \u0085 "
PLAIN = f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fill = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(fill)) for b in range(256)]


class Vocabulary:
    """A vocabulary file, its tokens as bytes: those within words apart from those that end words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in reversed(merges)}
        self.rank = {vocab[a + b]: k for k, (a, b) in reversed([*enumerate(merges)])}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        #: inner and last: the token, or -1, of each string of bytes that is a token's suffix; last: of tokens that end words
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for name, i in vocab.items():
            ends = name.endswith(self.end)
            if i in self.rank and not self._stands(i):
                continue
            raw = bytes(of_symbol[c] for c in (name[: -len(self.end)] if ends else name))
            at = self.last if ends else self.inner
            for k in range(1, len(raw)):
                at.setdefault(raw[k:], -1)
            at[raw] = i
        self.follows = cache(self._follows)

    def _stands(self, token: int) -> bool:
        """Whether BPE makes this token of its own symbols."""
        symbols, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                todo += reversed(self.parts[t])
            else:
                symbols.append(t)
        while len(symbols) > 1:
            ranked = [(self.rank[m], k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := self.joined.get(pair)) is not None]
            if not ranked:
                return False
            k = min(ranked)[1]
            symbols[k : k + 2] = [self.joined[symbols[k], symbols[k + 1]]]
        return symbols == [token]

    def _follows(self, left: int, right: int) -> bool:
        """Whether BPE of left's and right's symbols in a row ends in these two tokens.

        bound: merges across the border of a lower rank came first. Of equal ranks, BPE merges the leftmost pair first.
        """
        rank, bound = self.rank.get, float("inf")
        while True:
            across = self.joined.get((left, right))
            if across is not None and self.rank[across] < bound:
                return False
            a, b = rank(left, -1), rank(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, bound = self.parts[left][1], a
            else:
                right, bound = self.parts[right][0], b + 1

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The tokens of each word; words are sorted, distinct and not empty."""
        inner, last, follows = self.inner, self.last, self.follows
        # of the path from the root to the present node: the last token, and the length before it
        token, begin = [-1] * 64, [0] * 64
        before, depth = b"", 0
        for word in words:
            n = len(word) - 1
            if n >= len(token):
                token += [-1] * n
                begin += [0] * n
            shared, most = 0, min(depth, n)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            for end in range(shared + 1, n + 1):
                # the longest token that ends here is the one for nearly all
                longest = -1
                for at in range(end - 1, -1, -1):
                    t = inner.get(word[at:end])
                    if t is None:
                        break
                    if t >= 0:
                        longest, start = t, at
                if longest >= 0 and (not start or follows(token[start], longest)):
                    token[end], begin[end] = longest, start
                else:
                    token[end], begin[end] = self._state(word, end, inner, token, follows)
            depth, before = n, word
            t, at = self._state(word, n + 1, last, token, follows)
            ids = [t]
            while at:
                ids.append(token[at])
                at = begin[at]
            ids.reverse()
            yield ids

    @staticmethod
    def _state(word: bytes, end: int, table: dict[bytes, int], token: list[int], follows) -> tuple[int, int]:
        found = []
        for at in range(end - 1, -1, -1):
            t = table.get(word[at:end])
            if t is None:
                break
            if t >= 0:
                found.append((t, at))
        for t, at in reversed(found):
            if not at or follows(token[at], t):
                return t, at
        raise ValueError(f"no token ends {word[:end]!r}")


class Encoder:
    """Encodes and decodes texts; one lives as long as its task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        # the file's own character rules decide for rare characters, whose classes change with Unicode's versions
        rules = Tokenizer.from_file(path)
        self.normalize, self.words = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.plain = re.compile(PLAIN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.beyond = re.compile("[^\0-ɏ]").search
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        for name, i in self.vocabulary.special.items():
            self._add(f"\0{name}", [i])

    def _add(self, word: str, ids: list[int]) -> None:
        self.ids[word] = np.array(ids, "<u4").tobytes()
        self.text[word] = self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        names = self.vocabulary.names
        return " ".join([names[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is its string after a NUL."""
        if "<|" in text and (parts := self.special.split(text))[1:]:
            return [w for k, part in enumerate(parts) for w in ([f"\0{part}"] if k % 2 else self.split(part))]
        lower = text.lower()
        if self.beyond(text) or self.beyond(lower):
            text = self.normalize(text)
            return [text[a:b] for _, (a, b) in self.words(text)]
        return self.plain(lower)

    def learn(self, words: set[str]) -> None:
        """Encode those of the words that are not known yet, by their trie."""
        if len(self.ids) > KEPT_WORDS:  # this block's words stay: the frequent ones are among them
            stay = words | {f"\0{name}" for name in self.vocabulary.special}
            self.ids = {w: x for w, x in self.ids.items() if w in stay}
            self.text = {w: x for w, x in self.text.items() if w in stay}
        new = sorted((w.encode(), w) for w in words if w not in self.ids)
        for (_, word), ids in zip(new, self.vocabulary.encode_sorted([raw for raw, _ in new]), strict=True):
            self._add(word, ids)


def slices(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in parts of at least size characters, each but the last ending in a space or line feed."""
    at = 0
    while len(text) - at > size:
        ends = [k for c in " \n" if (k := text.find(c, at + size)) >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:] if at else text


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)

    def flush(rest: list[pa.Array], texts: list[str]) -> pa.RecordBatch:
        words = [encoder.split(x) for x in texts]
        encoder.learn(set().union(*words))
        ids, text = encoder.ids.__getitem__, encoder.text.__getitem__
        all_ids = [b"".join(map(ids, w)) for w in words]
        decoded = [" ".join(map(text, w)) for w in words]
        return pa.RecordBatch.from_arrays([*rest, pa.array([len(x) // 4 for x in all_ids], pa.int64()), pa.array(all_ids, pa.binary()), pa.array(decoded, pa.string())], names=names)

    for batch in batches:
        names = [*batch.schema.names[:-1], "n_tokens", "ids", "decoded"]
        texts, keep = batch.column(batch.num_columns - 1), batch.columns[:-1]
        lo, held, size = 0, [], 0
        for row in range(len(texts)):
            text = texts[row].as_py() or ""
            if held and size + len(text) > BLOCK:
                yield flush([c.slice(lo, row - lo) for c in keep], held)
                lo, held, size = row, [], 0
            if len(text) > 2 * BLOCK:
                yield _long(encoder, text, [c.slice(row, 1) for c in keep], names)
                lo = row + 1
            else:
                held.append(text)
                size += len(text)
        if held:
            yield flush([c.slice(lo, len(held)) for c in keep], held)


def _long(encoder: Encoder, text: str, keep: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    ids, decoded = [], []
    for part in slices(text):
        words = encoder.split(part)
        encoder.learn(set(words))
        ids.append(b"".join(map(encoder.ids.__getitem__, words)))
        decoded += [" ".join(map(encoder.text.__getitem__, words))] * bool(words)
    joined = b"".join(ids)
    return pa.RecordBatch.from_arrays([*keep, pa.array([len(joined) // 4], pa.int64()), pa.array([joined], pa.binary()), pa.array([" ".join(decoded)], pa.string())], names=names)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (what the ids decode to) of each row."""
    found = read_texts(docs, keep, text, lambda batches: _encode(batches, path), "n_tokens bigint, ids binary, decoded string")
    made = ("n_tokens", "ids", "decoded")
    return found.select(*unpacked(keep, made), *made)
