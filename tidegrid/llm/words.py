"""Exact encoding with a tokenizers vocabulary that drops white space, by remembered words."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Words kept by a worker, about 200 bytes each. At half of them those met before the last half are let go, so memory
#: stays bounded and frequent words stay.
REMEMBERED = 400_000
#: Longer words (in characters) are encoded each time.
LONGEST = 40
END_ID = 1
#: Texts of these characters only are lower-cased at once: up to U+017F every letter is composed and, but for U+0130, has
#: one lower-case letter, so normalising again changes nothing.
PLAIN = re.compile("[\x00-\u012f\u0131-\u017f]*")
#: A run of these after letters is a token group of its own in the vocabulary's pattern.
MARKS = ".,;:!?%&$#*|"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shown() -> dict[int, str]:
    """For every byte the character that stands for it in a byte-level vocabulary: printable ones for themselves, the
    others in order from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


class WordEncoder(dict):
    """Ids of whole texts, as Tokenizer.encode(text, add_special_tokens=False) gives them, for a tokenizer that splits at
    white space and keeps none of it, and that parts letters from other characters: a text's ids are its words' ids in
    order. The dict holds words' ids as bytes.

    special: a text that holds the string of an added token ("<|endoftext|>") goes to the library whole, in its default
    state, which gives such a string the token's id; else these strings count as ordinary text. Ids are kept as
    little-endian 16-bit integers where the vocabulary allows, else 32-bit.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.library = Tokenizer.from_file(path) if special else None
        added = self.model.get_added_tokens_decoder().values() if special else ()
        self.added = re.compile("|".join(re.escape(t.content) for t in added), re.I) if added else None
        self.merges = self.model.model
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.bytes = shown()
        self.before: dict[str, bytes] = {}
        super().__init__()

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if word in self.before:
            ids = self.before[word]
            self._keep(word, ids)
            return ids
        if word.isalpha() and word.islower() and PLAIN.fullmatch(word):
            own = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            ids = array(self.code, [t.id for t in self.merges.tokenize(own)]).tobytes()
        elif (stem := word.rstrip(MARKS)) != word and stem.isalpha() and PLAIN.fullmatch(stem):
            ids = self[stem] + self[word[len(stem) :]]
        else:
            ids = array(self.code, self.model.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()
        if len(word) <= LONGEST:
            self._keep(word, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self) >= REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        self[word] = ids

    def raw(self, text: str | None) -> bytes:
        text = text or ""
        if self.added and self.added.search(text):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if PLAIN.fullmatch(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.dtype)


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special: bool = False) -> WordEncoder:
    """The encoder of this worker process; kept over tasks."""
    if (path, special) not in _encoders:
        _encoders[path, special] = WordEncoder(path, special)
    return _encoders[path, special]


def texts(column: pa.Array):
    """The values of a string column one by one, without a list of all."""
    return (x.as_py() for x in column)
