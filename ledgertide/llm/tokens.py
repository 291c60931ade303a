"""Token ids of whole texts, as the tokenizers library gives them."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

#: The split of texts that a byte-level vocabulary without a prefix space has (a fixed value), for letters up to U+00FF.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Texts with any other character go to the library whole.
_OTHER = re.compile(rf"[^\t-\r -~{_LETTER}]")
#: A worker remembers the ids of twice so many pieces, and of none longer than this.
_MOST_PIECES, _LONGEST_PIECE = 300_000, 64


def _byte_letters() -> dict[int, int]:
    """The letter for which each byte stands in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = chr(_LETTERS[32])


def _splits_into_pieces(tokenizer) -> bool:
    """Whether a tokenizer encodes each piece of the split above by itself and unchanged."""
    from tokenizers import models

    split = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer is not None else {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    odd = any(getattr(tokenizer.model, k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")) if isinstance(tokenizer.model, models.BPE) else True
    return plain and tokenizer.normalizer is None and not odd


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of what stands between spaces, made when first asked for and remembered in two generations of bounded size."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk) or self.make(chunk)
        if len(chunk) <= _LONGEST_PIECE:
            if len(self) >= _MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts as the library's encode(text, add_special_tokens=False) does.

    The string of a special token in a text becomes that token, as it does there, unless special_as_text. A byte-level
    vocabulary encodes each piece of its split by itself, so each distinct piece is given to the library's
    model once and remembered. Texts that hold the string of an added token, or
    characters beyond the split's letters, are given whole to the library, and so are all texts of other vocabularies.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.by_piece = _splits_into_pieces(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known = _Known(self._after_space)

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        """Ids of the text by its pieces."""
        return b"".join(map(self._piece, _PIECE.findall(text)))

    def _after_space(self, chunk: str) -> bytes:
        """Ids of a space and the chunk, which has none."""
        if chunk.isalpha():
            return array("I", [t.id for t in self.model.tokenize(_SPACE + chunk)]).tobytes() if chunk.isascii() else self._piece(f" {chunk}")
        if (word := chunk[:-1]).isalpha() and chunk[-1] in ".,!?":
            return self.known[word] + self._piece(chunk[-1])
        return self._pieces(f" {chunk}")

    def __call__(self, text: str, end_id: int) -> np.ndarray:
        """The text's ids as little-endian 32-bit numbers, followed by end_id."""
        end = np.array([end_id], dtype="<u4").tobytes()
        if not self.by_piece or _OTHER.search(text) or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array([*ids, end_id], dtype="<u4")
        if "  " in text:  # longer runs of spaces join into pieces of their own
            return np.frombuffer(self._pieces(text) + end, dtype="<u4")
        # A piece always starts at a single space, so what lies between spaces can be encoded, and remembered, by itself.
        first, *rest = text.split(" ")
        return np.frombuffer(b"".join([self._pieces(first), *map(self.known.__getitem__, rest), end]), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


assert sys.byteorder == "little" and array("I").itemsize == 4


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
