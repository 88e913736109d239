"""Token ids of whole texts, by pre-token, through worker caches.

A byte-level BPE never merges across pre-tokens, and a single blank between two
characters that are certainly not white space is always a pre-token border (the
blank goes to the right).  Texts are cut at such blanks only; every cut
pre-token is encoded once per worker by the tokenizers library itself and then
looked up.  Whatever is not certain (white space runs, characters whose class differs
between Unicode versions) stays inside one piece, which the library splits.
"""

from __future__ import annotations

import json
import os
import re

from .caches import only

#: Characters that no Unicode version counts as white space.
GRAPHIC = "!-~¡-ɏͰ-ӿ԰-׿ؠ-ي‐-‧一-鿿가-힣"
_CLEAN = re.compile(f"[{GRAPHIC}](?:.*[{GRAPHIC}])?", re.S).fullmatch
#: Letters in every Unicode version, then perhaps signs: one or two pre-tokens.
_WORD_SIGNS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.:;?|]*)").fullmatch
_CUT = re.compile(f"(?<=[{GRAPHIC}]) (?=[{GRAPHIC}])")


def _byte_units() -> dict[int, int]:
    """How byte-level vocabularies write a byte: itself if it prints in Latin-1, else the
    next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_UNITS = _byte_units()
_BLANK = chr(BYTE_UNITS[32])

#: Longest pre-token that is kept in a cache, and how many a worker keeps in each of two generations (about
#: 260 bytes each with their place in the table).
CACHED_CHARS, CACHED_PIECES = 64, 350_000
#: Texts read at a time.
TEXTS = 512


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a file, else a file of the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(text: str) -> tuple[str, list[str]]:
    """First piece, and the later ones without the blank that they begin with."""
    parts = _CUT.split(text)
    return parts[0], parts[1:]


class Coder(dict):
    """Value of ``" " + piece`` by piece; computed by ``value(ids)`` on a miss.

    Values add up (``value(a + b) == value(a) + value(b)``), so a word and the signs
    behind it are looked up apart; both together are kept from the word's second time on, as most words of a
    corpus come once.  A plain ``dict`` lookup serves known pieces.
    ``fixed`` entries (the broadcast tier) are never evicted; of the others two
    generations are kept, and what is used moves to the younger one.
    """

    def __init__(self, name: str, value, fixed: dict | None = None):
        super().__init__(fixed or {})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.value, self.fixed, self.signs = value, dict(fixed or {}), {}
        self.old: dict = {}
        kind = json.loads(self.tok.to_str())
        before = kind["pre_tokenizer"] or {}
        plain = (before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
                 and kind["model"]["type"] == "BPE" and not kind["normalizer"])
        #: The library's own model, for words that are one pre-token in any case.
        self.model = self.tok.model if plain else None

    def of(self, text: str):
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)

    def word(self, word: str):
        """Value of a blank and a word of letters."""
        if self.model is None:
            return self.of(" " + word)
        units = _BLANK + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(BYTE_UNITS)
        return self.value([t.id for t in self.model.tokenize(units)])

    def _keep(self, piece: str, v):
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES + len(self.fixed):
                self.old = dict(self)
                self.clear()
                self.update(self.fixed)
            self[piece] = v
        return v

    def __missing__(self, piece: str):
        v = self.old.get(piece)
        if v is None:
            if self.model is not None and piece.isascii() and piece.isalpha():
                v = self.word(piece)
            elif self.model is not None and (two := _WORD_SIGNS(piece)):
                word, signs = two.groups()
                v = self.get(word)
                if v is None:
                    v = self.old.get(word)
                    new = v is None
                    v = self._keep(word, self.word(word) if new else v)
                else:
                    new = False
                if signs:
                    more = self.signs.get(signs)
                    if more is None:
                        if len(self.signs) >= CACHED_PIECES:
                            self.signs.clear()
                        more = self.signs[signs] = self.of(signs)
                    v = v + more
                if new or not signs:
                    return v
            elif _CLEAN(piece):
                v = self.of(" " + piece)
            else:
                return None          # the blank before it may not be a border
        return self._keep(piece, v)

    def total(self, text: str, add):
        """``add`` of the values of a whole text's pieces."""
        parts = text.split(" ")
        first = parts.pop(0)
        if not parts or _CLEAN(first):
            try:
                return add([self.of(first), add(map(self.__getitem__, parts))] if text else ())
            except TypeError:            # a piece without a value of its own
                pass
        return add(self.values_of(text))

    def values_of(self, text: str) -> list:
        """Values of the pieces of a whole text, in order."""
        if not text:
            return []
        first, *rest = text.split(" ")
        if not rest:
            return [self.of(first)]
        if _CLEAN(first):
            out = list(map(self.__getitem__, rest))
            if None not in out:
                return [self.of(first), *out]
        first, rest = pieces(text)       # the last piece may end in white space
        return [self.of(first), *map(self.__getitem__, rest[:-1]), *(self.of(" " + x) for x in rest[-1:])]


def coder(name: str, kind: str, value, key=None, fixed=None) -> Coder:
    """The coder of this worker process for (tokenizer, kind, broadcast)."""
    return only((name, kind, key), lambda: Coder(name, value, fixed() if fixed else None))


def totals(c: Coder, column, add):
    """``add`` of the values of each text of an Arrow column (null: none), a few texts in memory at a time."""
    for a in range(0, len(column), TEXTS):
        for t in column.slice(a, TEXTS).to_pylist():
            yield c.total(t or "", add)
