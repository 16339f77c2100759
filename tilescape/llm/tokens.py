"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Words whose ids a worker keeps in each of two generations; when the younger is full it
#: becomes the older one, so memory stays bounded and words still in use are kept.
CACHE_WORDS = 600_000
_RUN = re.compile(r"\s\s")
#: Fixed values of byte-level BPE: its pieces, and the bytes that stand for themselves (the others follow from U+0100 on).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = (",", ".")
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_encoders: dict[str, Callable[[str], bytes]] = {}


def encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit integers, without special tokens; one encoder per worker.

    Ids are those of the tokenizers library for the whole text. For a byte-level BPE with
    its standard pre-tokenizer a single space or line end between two words always starts a
    new piece, so such texts are encoded word by word with the library's model, and the
    ids of known words are reused. All other texts and tokenizers are encoded
    in one call.
    """
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = _build(tokenizer_path)
    return _encoders[tokenizer_path]


class _Words(dict):
    """word -> packed ids; `before` is put before each word, `encode` gives unknown ones."""

    def __init__(self, before: str, encode: Callable[[str], bytes]):
        super().__init__()
        self.before, self.encode, self.older = before, encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            if word[-1:] in MARKS and word[:-1].isalpha():  # letters and a mark are two pieces
                ids = self[word[:-1]] + self.encode(word[-1])
            else:
                ids = self.encode(self.before + word)
        self[word] = ids
        return ids


def _build(tokenizer_path: str) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    whole = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pre, special = str(library.pre_tokenizer), [t.content for t in library.get_added_tokens_decoder().values()]
    if library.normalizer is not None or not pre.startswith("ByteLevel(add_prefix_space=False") or "use_regex=True" not in pre:
        return whole
    import regex

    pieces, model = regex.compile(PIECES).findall, library.model.tokenize
    moved = [b for b in range(256) if b not in PLAIN_BYTES]
    letters = {b: chr(256 + i) for i, b in enumerate(moved)}
    marks = {m: whole(m) for m in MARKS}

    def spelled(piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", letters[32])
        return piece.encode().decode("latin-1").translate(letters)

    def one(word: str) -> bytes:
        if word in marks:
            return marks[word]
        parts = [word] if word.isalpha() or word[:1] == " " and word[1:].isalpha() else pieces(word)
        ids = array("I", [t.id for part in parts for t in model(spelled(part))])
        if ids.itemsize != 4 or sys.byteorder != "little":
            return np.array(ids, "<u4").tobytes()
        return ids.tobytes()

    starts, others = _Words("", one), _Words(" ", one)
    line_end = whole("\n")

    def by_word(text: str) -> bytes:
        if _RUN.search(text) or any(s in text for s in special):
            return whole(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(starts[first])
            out += map(others.__getitem__, rest)
            out.append(line_end)
        out.pop()
        return b"".join(out)

    return by_word
