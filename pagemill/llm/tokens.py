"""Token ids of texts, by the tokenizers library, with a memory of parts.

Byte-pair encoding works inside pre-tokens, and no pre-token of the two vocabularies used here crosses the cut
before a blank that follows another character. Texts are therefore cut there; a part of plain characters
(ASCII and Latin letters and punctuation) is cut into its pre-tokens by the vocabulary's own pattern, and each distinct
pre-token goes through the library's byte-pair model and is remembered, up to a bound. Parts with any other
character, texts with runs of white space, where a cut could fall inside a pre-token, and texts that hold an added
token such as ``<|endoftext|>`` are encoded by the whole library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import common

END = 2
REMEMBERED = 400_000
#: Longer parts are not remembered.
LONGEST = 64
#: Longer texts are not cut in a table of their code points, which takes some 30 bytes for each.
LONG = 4_000_000
#: Separators that only one of Python and the library takes for white space.
ODD = "\x1c\x1d\x1e\x1f"
#: Letters that every version of Unicode knows and whose lower case is one character.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
PLAIN = re.compile(f"[!-~«»„“”‘’‚–—…¡¿§×÷{_LETTERS}]+")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokens of plain text: with a blank in front (byte vocabulary), or lower-cased without blanks (word vocabulary).
SPACED = re.compile(f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+")
BARE = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


#: Byte-level vocabularies write a byte as this character: printable ones as themselves, the others from U+0100 on in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
WRITTEN = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the code points below 2**16; the last place stands for all beyond."""
    kinds, lower = np.full(1 << 16, OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range((1 << 16) - 1):
        c = chr(i)
        if c.isspace():
            kinds[i] = SPACE
        elif PLAIN.fullmatch(c):
            kinds[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
            lower[i] = ord(c.lower())
    return kinds, lower


def _cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the text without white space, and where in them, and in the text, pre-tokens begin.

    Plain words are lower-cased and cut as ``BARE`` does; a word with any other character stays one, as it is.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    table, lower = _kinds()
    at = np.minimum(points, (1 << 16) - 1)
    kind = table[at]
    small = np.where(points < (1 << 16), lower[at], points)
    black = kind != SPACE
    begins = black.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # a contraction is cut off where its apostrophe begins a pre-token
    after = lambda i, k: small[np.minimum(i + k, len(small) - 1)] * (i + k < len(small))
    marks = np.flatnonzero((small == ord("'")) & begins)
    one, two = after(marks, 1), after(marks, 2)
    long = np.zeros(len(marks), np.int64)
    for c in _CONTRACTIONS.split("|"):
        long[(one == ord(c[1])) & (two == ord(c[2]) if len(c) > 2 else True)] = len(c)
    marks, long = marks[long > 0], long[long > 0]
    begins[marks + 1] = False
    past = marks + long
    past = past[past < len(kind)]
    begins[past[kind[past] == LETTER]] = True
    if (kind == OTHER).any():
        first = black.copy()
        first[1:] &= ~black[:-1]
        word = np.cumsum(first)
        odd = np.zeros(word[-1] + 1, bool)
        odd[word[kind == OTHER]] = True
        odd = odd[word] & black
        begins, small = np.where(odd, first, begins), np.where(odd, points, small)
    return small[black], np.flatnonzero(begins[black]), np.flatnonzero(begins)


class Runs(ValueError):
    """A run of white space, inside which no text may be cut."""


class _Parts(dict):
    """Part -> bytes of its ids. A missing part is encoded and remembered; when full, the parts not used since the last time go."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(part)
            if len(part) > LONGEST:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    """``batch(texts)``: for every text its little-endian ids, of type ``kind``, as the library gives them for the whole text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        #: Added tokens of the vocabulary, which the library finds in the raw text before anything else.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.vocabulary = self.tokenizer.get_vocab_size()
        #: Whether ids fit in 16 bits.
        self.small = self.vocabulary <= 1 << 16
        self.kind, self.code = ("<u2", "H") if self.small else ("<u4", "I")
        #: Whether the library itself drops white space (and lower-cases).
        self.drops = not self._whole(" ")
        self.bare = _Parts(self._bare)
        self.spaced = _Parts(self._spaced)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _model(self, token: str) -> bytes:
        """The ids of one pre-token, by the library's byte-pair model."""
        return array(self.code, [t.id for t in self.tokenize(token)]).tobytes()

    def _bare(self, part: str) -> bytes:
        """The ids of a part that no blank precedes, or whose blank counts for nothing."""
        if self.drops and (low := part.lower()) != part and PLAIN.fullmatch(part):
            return self.bare[low]
        if part.isascii() and part.isalpha():
            return self._model(part)
        if not part:
            return b""
        if not PLAIN.fullmatch(part):
            return b"".join(map(self.bare.__getitem__, self._lines(part))) if "\n" in part and part != "\n" else self._whole(part)
        found = (BARE if self.drops else SPACED).findall(part)
        if len(found) > 1:
            return b"".join(map(self.bare.__getitem__, found))
        return self._model(part if part.isascii() else part.encode().decode("latin-1").translate(WRITTEN))

    def _spaced(self, part: str) -> bytes:
        """The ids of a blank and the part."""
        if part.isascii() and part.isalpha():
            return self._model("Ġ" + part)
        if not PLAIN.fullmatch(part):
            if not part or part[0].isspace():
                raise Runs
            if "\n" in part:
                first, *lines = self._lines(part)
                return self.spaced[first] + b"".join(map(self.bare.__getitem__, lines))
            return self._whole(" " + part)
        first, *rest = SPACED.findall(" " + part)
        if rest:
            return b"".join([self.spaced[first[1:]], *map(self.bare.__getitem__, rest)])
        return self._model("Ġ" + (part if part.isascii() else part.encode().decode("latin-1").translate(WRITTEN)))

    @staticmethod
    def _lines(part: str) -> list[str]:
        """The lines of a part and the breaks between them. A break at the end, or with white space behind it, is part of a run."""
        lines = part.split("\n")
        if any(not x or x[0].isspace() for x in lines[1:]):
            raise Runs
        return [x for line in lines for x in ("\n", line) if x][1:] if lines[0] else [x for line in lines[1:] for x in ("\n", line)]

    def ids(self, text: str) -> bytes:
        if self.added.search(text):
            return self._whole(text)
        if self.drops:
            return self._whole(text) if any(c in text for c in ODD) else b"".join(map(self.bare.__getitem__, text.split()))
        words = text.split(" ")
        try:
            first = self.bare[words[0]]
            return first + b"".join(map(self.spaced.__getitem__, words[1:]))
        except Runs:
            return self._whole(text)

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.drops:
            return [self.ids(t) for t in texts]
        alone = [len(t) > LONG or bool(self.added.search(t)) or any(c in t for c in ODD) for t in texts]
        rest = iter(self._together([t for t, single in zip(texts, alone, strict=True) if not single]))
        return [self.ids(t) if single else next(rest) for t, single in zip(texts, alone, strict=True)]

    def _together(self, texts: list[str]) -> list[bytes]:
        """As ``ids`` of each text, for a vocabulary that drops white space and texts without added tokens."""
        points, begins, places = _cut("\n".join(texts))
        if not len(begins):
            return [b""] * len(texts)
        # without white space, a pre-token ends where the next one begins
        wide = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64))
        offsets = np.append(wide[begins], wide[-1]).astype(np.int32)
        data = points.tobytes().decode("utf-32-le").encode()
        found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        parts = list(map(self.bare.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join(parts), self.kind)
        sizes = np.array([len(x) for x in parts]) // ids.itemsize
        which = found.indices.to_numpy()
        size = sizes[which]
        last = np.append(0, np.cumsum(size))
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - last[:-1], size) + np.arange(last[-1])]
        ends = last[np.searchsorted(places, np.cumsum([len(t) + 1 for t in texts]))].tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *ends], ends)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this process; other operators free it (:func:`pagemill.llm.common.working`)."""
    return Encoder(path)


common.CACHES.append(encoder.cache_clear)


def in_runs(texts: Iterable[str], most: int = 1_000_000):
    """Runs of neighbouring texts of about ``most`` characters in all, so that memory does not grow with a batch."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
