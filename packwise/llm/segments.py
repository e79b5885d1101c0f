"""Byte-pair ids of many texts at once, each distinct stretch encoded by the library only once.

A text is cut before every run of white space that follows something else. No pattern of the
two vocabularies' pre-tokenizers reaches across such a cut (a token takes at most the one blank
before it, and what a run of blanks becomes depends on the run and on what follows it), nor across
one between an ASCII letter and an ASCII mark other than the apostrophe. So the ids of a text are
the ids of its stretches in order. Stretches repeat, as words do; a batch is dictionary-encoded,
and the library sees only stretches that the worker hasn't met yet.
"""

from __future__ import annotations

import array
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: White space beyond ASCII, as UTF-8.
WIDE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
#: Special tokens of the vocabularies have this form.
SPECIAL = re.compile(rb"<\|")
#: Letters of ASCII, Latin-1 and Latin Extended-A (but the dotted capital I, which lower-cases to two).
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+"
PLAIN = re.compile(rb"(\s?)(" + LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Marks that never share a piece with the letter before them.
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = True
LETTER = np.zeros(256, bool)
LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
#: Beyond Latin Extended-A, where lower-casing may meet combining marks.
FAR = re.compile(rb"[\xc6-\xff]")
#: Stretches that a worker remembers, twice: those met since as many new ones, and those before.
#: About 200 bytes each.
REMEMBERED = 200_000


def byte_letters() -> dict[int, int]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Segments:
    """Ids of texts by one vocabulary file; ``blanks`` says whether a word keeps its blank."""

    def __init__(self, path: str, blanks: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blanks = blanks
        self.letters = byte_letters()
        self.blank = chr(self.letters[32])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, list[int]] = {}

    def forget(self) -> None:
        """Gives the stretches' memory back, for whatever the worker does next."""
        self.known, self.older = {}, {}

    def _word(self, word: bytes) -> list[int]:
        """Ids of what the pre-tokenizer leaves as one piece."""
        return [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))]

    def _mark(self, mark: bytes) -> list[int]:
        if mark not in self.words:
            if len(self.words) >= 10_000:
                self.words.clear()
            self.words[mark] = self._word(mark)
        return self.words[mark]

    def _stretch(self, stretch: bytes) -> bytes:
        if stretch[:1] == b" " and stretch[1:].isalpha():  # a word of ASCII letters stands for itself
            word = self.blank + stretch[1:].decode() if self.blanks else stretch[1:].lower().decode()
            return array.array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        m = PLAIN.fullmatch(stretch)
        if m is None or (self.blanks and m[1] not in (b"", b" ")):
            ids = self.tokenizer.encode(stretch.decode(), add_special_tokens=False).ids
        else:
            ids = self._word(m[1] + m[2] if self.blanks else m[2].decode().lower().encode())
            if m[3]:
                ids = ids + self._mark(m[3])
        return array.array("I", ids).tobytes()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as 32-bit integers, and the number of ids of each text."""
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data = b"".join(texts)
        if not self.blanks and not FAR.search(data):
            data = data.lower()  # as the normalizer does, with nothing there to compose
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        space = ASCII_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        if WIDE_SPACE.search(data):  # a run may begin with such a blank: cut after ASCII only
            cut[1:-1] &= raw[:-1] < 128
        if not SPECIAL.search(data):  # the library looks for special tokens before anything else
            cut[1:-1] |= MARK[raw[1:]] & LETTER[raw[:-1]]
        starts = np.concatenate(([0], ends[:-1]))
        cut[starts[starts < ends]] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        stretches = pa.Array.from_buffers(
            pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, got = self.known, self.older, []
        for stretch in stretches.dictionary.to_pylist():
            ids = known.get(stretch)
            if ids is None:
                ids = older.get(stretch) or self._stretch(stretch)
                if len(stretch) < 64:
                    known[stretch] = ids
            got.append(ids)
        size = np.fromiter((len(g) // 4 for g in got), np.int32, len(got))
        flat = np.frombuffer(b"".join(got), np.uint32)
        first = np.cumsum(size, dtype=np.int64) - size
        use = stretches.indices.to_numpy(zero_copy_only=False)
        taken = size[use]
        upto = np.concatenate(([0], np.cumsum(taken, dtype=np.int64)))
        place = np.repeat((first[use] - upto[:-1]).astype(np.int32), taken)  # a block has far fewer than 2^31 ids
        place += np.arange(upto[-1], dtype=np.int32)
        ids = flat[place]
        bounds = np.searchsorted(at, np.concatenate(([0], ends)))
        return ids, np.diff(upto[bounds])


_LOADED: dict[tuple[str, bool], Segments] = {}


def segments(path: str, blanks: bool) -> Segments:
    """The worker's encoder, kept from task to task; a task forgets its stretches when it ends."""
    if (path, blanks) not in _LOADED:
        _LOADED[path, blanks] = Segments(path, blanks)
    return _LOADED[path, blanks]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the counts with it."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
