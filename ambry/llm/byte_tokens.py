"""Token ids of whole texts by a byte-level BPE that keeps white space.

A text is cut before each run of white space, where this kind of tokenizer
never joins anything, and the ids of each different piece are computed once.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable
from functools import lru_cache

BYTE_BPE = "byte_bpe_50k.json"
KEPT_PIECES = 400_000
KEPT_LENGTH = 64
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: what the tokenizer takes for white space: the property of that name, nothing else
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: letters up to U+00FF, and ASCII marks behind them
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class _Pieces(dict):
    """Ids of pieces behind a fixed lead, found when first asked for; bounded.

    Western letters alone, with the lead, are one word to the merges, and marks behind them are another.
    """

    def __init__(self, tokenizer, lead: str, spelled: dict[int, str]):
        self.encode, self.merged = tokenizer.encode, tokenizer.model.tokenize
        self.lead, self.before, self.spelled = lead, lead.translate(spelled), spelled

    def _word(self, spelled: str) -> bytes:
        ids = [x.id for x in self.merged(self.before + spelled)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, piece: str) -> bytes:
        if piece.isascii():
            if piece.isalpha():  # such letters are spelled as they are
                return self._word(piece)
            if piece[-1:] in ".," and piece[:-1].isalpha():
                return (self.get(piece[:-1]) or self._word(piece[:-1])) + self.behind[piece[-1]]
        if parts := _WORD.match(piece):
            word, marks = parts.groups()
            ids = self.get(word) or self._word(word.encode().decode("latin-1").translate(self.spelled))
            return ids + self.behind[marks] if marks else ids
        ids = self.encode(self.lead + piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()  # what is used often comes back at once
            self[piece] = ids
        return ids


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``path`` must name a byte-level BPE without a normalizer whose special
    tokens hold no white space and take none beside them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # how the tokenizer writes each byte, read off its own byte-level step
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled: dict[int, str] = {}
        for code in range(0x20, 0x100):
            letter = chr(code)
            spelled.update(zip(letter.encode(), spell.pre_tokenize_str(letter)[0][0], strict=True))
        self.spaced, self.plain = (_Pieces(self.tokenizer, lead, spelled) for lead in (" ", ""))
        self.spaced.behind = self.plain.behind = self.plain

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; no ids where the text is null or empty."""
        out: list[bytes] = []
        for text in texts:
            text = text or ""
            # one space or line feed between all words, and no other white space: cut by a plain split
            lines = text.split("\n")
            rows = [line.split(" ") for line in lines]
            if len(text.split()) == sum(map(len, rows)):
                found = []
                for k, row in enumerate(rows):
                    found.append(self.plain["\n" + row[0] if k else row[0]])
                    found.extend(map(self.spaced.__getitem__, row[1:]))
                out.append(b"".join(found))
            else:
                out.append(b"".join(map(self.plain.__getitem__, _PIECES.findall(text))))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> ByteEncoder:
    """The encoder of this process; tasks that follow each other in it share what it knows."""
    return ByteEncoder(path)
