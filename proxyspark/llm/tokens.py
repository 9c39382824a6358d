"""Whole texts to token ids with a public tokenizer file, words cached.

A text is cut where the tokenizer's own pre-tokenizer must cut, and the ids of
each piece are remembered, so that the library encodes a piece once and not at
every occurrence. The ids are those of encoding the text in one go.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import regex

from proxyspark.llm.common import kept

# Characters for which a piece's ids never depend on its neighbours: Latin
# letters, digits, ASCII punctuation, plain white space. U+0130 is left out, as
# its lower case ends in a combining mark.
_PLAIN = re.compile("[\\t\\n\\r\x20-\x7e\xa0-įı-ɏ]*")

# How the two kinds of tokenizer split text before their merges.
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PIECES = (r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]"
                r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_LETTERS = "[a-zA-ZÀ-ÖØ-öø-ÿ]"
_LONE_SPACE = re.compile("(?<! ) (?! )")
# A line break between printable ASCII characters is a piece of its own.
_LONE_BREAK = re.compile("\n(?<=[!-~]\n)(?=[!-~])")
_MARK = "\x01"


class CachedEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned integers of
    ``width`` bytes: 2 where the vocabulary allows it, else 4.

    ``limit`` bounds the cache. A full one loses the half that came last, as
    frequent words come early; that changes the time taken, never the ids.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        # Word-end vocabularies drop white space; byte-level ones keep it.
        self.by_words = any(t.endswith("</w>") for t in list(vocabulary)[:1000])
        self.pieces = regex.compile(_WORD_PIECES if self.by_words else _BYTE_PIECES)
        # Where a word ends (or starts) in the ids of many words.
        self.borders = {i for t, i in vocabulary.items() if (t.endswith("</w>") if self.by_words else t.startswith("Ġ"))}
        self.simple = re.compile(f"{'' if self.by_words else ' '}{_LETTERS}+")
        self.ids, self.limit = {}, limit
        self.tails = {c: self.library(c) for c in ",."}

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def batch(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text, without the offsets it otherwise keeps."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def library(self, text: str) -> bytes:
        return self._packed(self.batch([text])[0])

    def together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of simple words, encoded in one call and parted at the borders."""
        ids = self.batch([(" " if self.by_words else "").join(words)])[0]
        data, width, borders = self._packed(ids), self.width, self.borders
        ends = [k + 1 for k, i in enumerate(ids) if i in borders] if self.by_words else \
            [k for k, i in enumerate(ids) if i in borders][1:] + [len(ids)]
        return {w: data[width * lo:width * hi] for w, lo, hi in zip(words, [0, *ends], ends)}

    def chunks(self, text: str) -> list[str]:
        if self.by_words:
            return text.replace("\n", " ").split(" ")
        if _MARK in text:
            return [text]
        marked = _LONE_SPACE.sub(f"{_MARK} ", text) if "  " in text else text.replace(" ", f"{_MARK} ")
        return _LONE_BREAK.sub(f"{_MARK}\n{_MARK}", marked).split(_MARK)

    def chunked(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not simple words; their new pieces, and chunks that
        can't be cut, go to the library in one call."""
        cut = {c: [c] if "<|" in c or not _PLAIN.fullmatch(c) else self.pieces.findall(c) for c in chunks}
        whole = {c for c, pieces in cut.items() if pieces == [c]}
        known, ids = {}, self.ids.get
        for pieces in cut.values():
            known.update((p, ids(p)) for p in pieces)
        new = [p for p, found in known.items() if found is None]
        if new:
            known.update((p, self._packed(found)) for p, found in zip(new, self.batch(new)))
            self.ids.update((p, known[p]) for p in new if p not in whole)
        return {c: b"".join([known[p] for p in pieces]) for c, pieces in cut.items()}

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks; it keeps those that are short."""
        found, words, later, others = {}, {}, [], []
        known, simple, tails = self.ids.get, self.simple.fullmatch, self.tails
        for c in chunks:
            tail = tails.get(c[-1:])
            word = c if tail is None else c[:-1]
            if not simple(word):
                others.append(c)
                continue
            ids = known(word)
            if ids is None:
                words[word] = None
                later.append((c, word, tail or b""))
            else:
                found[c] = self.ids[c] = ids + (tail or b"")
        if others:
            others = self.chunked(others)
            found.update(others)
            self.ids.update((c, ids) for c, ids in others.items() if len(c) <= 64)
        if words:
            words = self.together(list(words))
            self.ids.update((w, ids) for w, ids in words.items() if len(w) <= 64)
            found.update((c, words[w] + tail) for c, w, tail in later)
        return found

    def encode(self, text: str) -> bytes:
        chunks = self.chunks(text)
        ids = list(map(self.ids.get, chunks))
        missing = {c for c, i in zip(chunks, ids) if i is None}
        if missing:
            fresh = self.learn(missing)
            ids = [fresh[c] if i is None else i for c, i in zip(chunks, ids)]
            if len(self.ids) > self.limit:
                self.ids = dict(islice(self.ids.items(), self.limit // 2))
        return b"".join(ids)


def encoder(path: str) -> CachedEncoder:
    """One encoder per Python worker and file; a full cache takes some 200 MB."""
    return kept(("encoder", path), lambda: CachedEncoder(path), large=True)
