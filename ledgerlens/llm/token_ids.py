"""Ids of whole texts by the tokenizers library, asked once for each word that a worker meets.

A byte-level BPE tokenizer cuts a text at every space that stands between two characters other than white
space, whatever else its pattern says: such a space can only begin a piece.  So the ids of a text are the
ids of its words, each with its space in front, one after the other.  Words stay known to the worker (at
most ``KEPT_WORDS``, then it starts anew).  Two more places always part pieces, so that fewer different words
are met: between letters and the punctuation that ends a word, apostrophes aside, and on both sides of a
line end between other characters.  Texts with other white space next to a space are cut at clean
spaces only; a tokenizer of any other make gets the whole text.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

KEPT_WORDS = 600_000
LONG_WORD = 64
#: U+180E was white space in older Unicode tables.
WHITE = r"[\s᠎]"
UNCLEAN = re.compile(rf"{WHITE} | {WHITE}|^ | $")
NEAR_SPACE = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
#: ASCII punctuation without the apostrophe, which can begin a piece of its own with the letters behind it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CLEAN_SPACE = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte: itself if it prints, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def latin(word: str) -> bool:
    return word.isalpha() and max(word) < "ɐ"


def visible(character: str) -> bool:
    return character.isalnum() or "!" <= character <= "~"


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, with a space in front of the word."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        own = [t["content"] for t in made.get("added_tokens") or []]
        flags = [t[k] for t in made.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word")]
        self.by_word = (not made.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                        and not split.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
                        and not any(flags) and not any(c.isspace() for t in own for c in t))
        self.pieces = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.no_space: dict[str, bytes] = {}
        self.line_end = self.asked("\n")
        self.special = re.compile("|".join(map(re.escape, own)) or r"(?!)").search
        self.small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16

    def asked(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        return self.keep(self, word, self.parted(word))

    def parted(self, word: str) -> bytes:
        if self.special(word):
            return self.asked(" " + word)
        if "\n" in word:
            head, _, rest = word.partition("\n")
            if head and rest and visible(head[-1]) and visible(rest[0]):
                return self[head] + self.line_end + self.at_line_start(rest)
        letters = word.rstrip(MARKS)
        if len(letters) < len(word) and latin(letters):
            return self[letters] + self.bare(word[len(letters):])
        return self.model_ids(" " + word) if latin(word) else self.asked(" " + word)

    def keep(self, held: dict[str, bytes], word: str, ids: bytes) -> bytes:
        if len(word) <= LONG_WORD:
            if len(held) >= KEPT_WORDS:
                held.clear()
            held[word] = ids
        return ids

    def model_ids(self, piece: str) -> bytes:
        """Latin letters with or without a space in front are one piece: straight to the library's model."""
        seen = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.pieces(seen)]).tobytes()

    def bare(self, word: str) -> bytes:
        """Ids of a word without special strings and with no space in front."""
        ids = self.no_space.get(word)
        return self.keep(self.no_space, word, self.model_ids(word) if latin(word) else self.asked(word)) if ids is None else ids

    def at_line_start(self, rest: str) -> bytes:
        """Ids of what follows a line end up to the next space."""
        letters = rest.rstrip(MARKS)
        if len(letters) < len(rest) and latin(letters):
            return self.bare(letters) + self.bare(rest[len(letters):])
        return self.bare(rest)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text, little-endian unsigned 32-bit."""
        if not text:
            return b""
        if not self.by_word:
            return self.asked(text)
        if text.isascii() and text[0] != " " and text[-1] != " " and not any(x in text for x in NEAR_SPACE + ODD) \
                or not UNCLEAN.search(text):
            first, *rest = text.split(" ")
            return self.asked(first) + b"".join(map(self.__getitem__, rest))
        return b"".join(map(self.asked, CLEAN_SPACE.split(text)))


#: The other ASCII white space (as Python counts it) in texts sends them to the slower, general test.
ODD = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


@functools.cache
def words(path: str) -> WordIds:
    """One per worker process and tokenizer."""
    return WordIds(path)


def encode(path: str, text: str | None, end_id: int) -> np.ndarray:
    """Ids of a text with the end id behind them."""
    return np.frombuffer(words(path).ids(text) + end_id.to_bytes(4, "little"), "<u4")
