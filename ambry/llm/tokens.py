"""Token ids of whole texts, by the files of public tokenizers.

A text is cut at spaces and line feeds, where this kind of tokenizer never
joins anything, and the ids of each different word are computed once.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
KEPT_WORDS = 400_000
KEPT_LENGTH = 64


def vocabulary(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``path`` must name a byte-level BPE that lower-cases, drops white space and
    never merges across it. At most ``kept`` words are remembered; longer words
    than ``KEPT_LENGTH`` never are, so memory does not grow with the input.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.missed = 0
        # how the tokenizer writes each byte, read off its own byte-level step
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled: dict[int, str] = {}
        for code in range(0x41, 0x100):
            letter = chr(code)
            self.spelled.update(zip(letter.encode(), spell.pre_tokenize_str(letter)[0][0], strict=True))
        self.marks = {".": self._encode(["."])[0], ",": self._encode([","])[0]}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _word(self, word: str) -> bytes:
        """Ids of one word. Western letters alone are one piece for the merges."""
        if not word:
            return b""
        mark = self.marks.get(word[-1])
        if mark is not None and word[:-1].isalpha():
            known = self.known.get(word[:-1])
            return (self._word(word[:-1]) if known is None else known) + mark
        if word.isalpha() and max(word) <= "\xff":
            lower = word.lower()
            if lower != word:
                return self[lower]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.spelled)
            ids = [x.id for x in self.tokenizer.model.tokenize(word)]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._encode([word])[0]

    def __getitem__(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) <= KEPT_LENGTH:
                if len(self.known) < self.kept:
                    self.known[word] = ids
                else:
                    self.missed += 1
                    if self.missed > self.kept:  # what is known has gone out of use
                        self.known.clear()
                        self.missed = 0
        return ids

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; no ids where the text is null or empty."""
        out: list[bytes] = []
        for text in texts:
            words = (text or "").replace("\n", " ").split(" ")
            found = list(map(self.known.get, words))
            if None in found:
                found = [self[w] if x is None else x for w, x in zip(words, found, strict=True)]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process; tasks that follow each other in it share what it knows."""
    return WordEncoder(path)
