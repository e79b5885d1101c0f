"""Licence notices in texts, by a generalised suffix automaton over the notices' words.

The automaton holds every run of words of all notices and phrases. A text is streamed through it in
pieces; after each word it tells the longest run that ends there and occurs in some notice (matching
statistics). Where a run of ``MIN_MATCH`` words or more can't be extended, it is a match with its
places in the notices. Matches of one notice whose places increase in text and notice, with at most
``GAP`` other words of the text between two, are chained so that they cover as many words of the
notice as possible; a chain that covers ``COVER`` of a notice is a span of it. Of spans inside a longer
one, and of equal ones, the one that covers most stays. Phrases give their label wherever they stand.

A text is one row's work, in memory bounded by a piece of it and the matches found; nothing moves
between tasks. The automaton is built from the notices in each worker (its size is that of the notices,
a parameter, not of the corpus).

Defined results: null text is empty and has no words; texts without a match have score zero, null
places and no label; rows that repeat are scanned each; an empty table stays empty; other columns are
kept, and new ones take longer names where they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from packwise.llm.common import col, fresh
from packwise.llm.licence_texts import NOTICES, PHRASES

#: Words of a match, words of the text between two matches of a chain, covered share of a notice.
MIN_MATCH, GAP, COVER = 3, 8, 0.8
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
SPAN = "label string, first_word long, last_word long, covered long, share double"
FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
TYPES = ("long", "long", "long", "long", "array<string>", "array<string>", "double", f"array<struct<{SPAN}>>")


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, ASCII letters lower-cased."""
    return WORD.findall((text or "").encode().lower())


def pieces_of(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words in order, those of about ``size`` bytes of text at a time; a word is never cut."""
    data, start = (text or "").encode().lower(), 0
    while start < len(data):
        gap = BREAK.search(data, start + size)
        end = gap.start() if gap else len(data)
        yield WORD.findall(data, start, end)
        start = end


class Automaton:
    """Generalised suffix automaton over the words of notices and phrases.

    ``following[s]`` maps a word's number to the next state, ``link`` and ``length`` are as usual;
    ``places[s]`` are the (notice, last word) pairs of the state's runs, ``told[s]`` the phrases that
    end wherever the state's runs do.
    """

    def __init__(self, notices: Mapping[str, Sequence[str]], phrases: Mapping[str, str]):
        self.notices = [(label, words_of(t)) for label in sorted(notices) for t in notices[label]]
        self.notices = [(label, words) for label, words in self.notices if words]
        self.phrases = [(label, words) for label, text in sorted(phrases.items()) if (words := words_of(text))]
        self.number: dict[bytes, int] = {}
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [[]]
        texts = [words for _, words in self.notices + self.phrases]
        for words in texts:
            for word in words:
                self.number.setdefault(word, len(self.number))
        for t, words in enumerate(texts):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, self.number[word])
                if t < len(self.notices):
                    self.places[last].append((t, i))
        by_length = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in by_length:  # what ends in a state ends in the state of its shorter runs, too
            self.places[self.link[s]].extend(self.places[s])
        self.told: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for label, words in self.phrases:
            self.told[self._state(words)] += ((len(words), label),)
        for s in reversed(by_length):
            self.told[s] += self.told[self.link[s]]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.following.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.link) - 1

    def _split(self, before: int, word: int, target: int) -> int:
        """The part of ``target`` that ``before`` and the word reach, as a state of its own."""
        copy = self._new(self.length[before] + 1, dict(self.following[target]), self.link[target])
        while before >= 0 and self.following[before].get(word) == target:
            self.following[before][word] = copy
            before = self.link[before]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.following[last]:  # another notice has this run
            target = self.following[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        state, before = self._new(self.length[last] + 1, {}, 0), last
        while before >= 0 and word not in self.following[before]:
            self.following[before][word] = state
            before = self.link[before]
        if before >= 0:
            target = self.following[before][word]
            fits = self.length[target] == self.length[before] + 1
            self.link[state] = target if fits else self._split(before, word, target)
        return state

    def _state(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.following[state][self.number[word]]
        return state

    def statistics(self, pieces: Iterable[list[bytes]]) -> Iterator[tuple[int, int, int, bool]]:
        """For every place where a notice's run ends: the place, its state and length, and whether the
        run is over there. At the end the number of words, with state -1."""
        number, following, link, length = self.number, self.following, self.link, self.length
        base = state = size = 0
        for words in pieces:
            if not words:
                continue
            ids = np.fromiter(map(number.get, words, [-1] * len(words)), np.int32, len(words))
            known = np.flatnonzero(ids >= 0)
            if size and (not len(known) or known[0]):
                yield base - 1, state, size, True
                state = size = 0
            upto = 0  # the place after the last known word
            for i, word in zip(known.tolist(), ids[known].tolist()):
                if size and i != upto:
                    yield base + upto - 1, state, size, True
                    state = size = 0
                upto, grown = i + 1, following[state].get(word)
                if size:
                    yield base + i - 1, state, size, grown is None
                while grown is None:  # every known word follows the root
                    state = link[state]
                    size, grown = length[state], following[state].get(word)
                state, size = grown, size + 1
            if size and upto < len(words):
                yield base + upto - 1, state, size, True
                state = size = 0
            base += len(words)
        if size:
            yield base - 1, state, size, True
        yield base, -1, 0, True


class Chains:
    """The best chains of one text's matches, fed in the order of their ends."""

    def __init__(self, automaton: Automaton, gap: int, cover: float):
        self.sizes = [len(words) for _, words in automaton.notices]
        self.labels = [label for label, _ in automaton.notices]
        self.gap, self.cover, self.best = gap, cover, 0.0
        #: By notice: last word in the text, last word in the notice, words covered, first word in the text.
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}
        #: By notice and first word: words covered, last word.
        self.spans: dict[tuple[int, int], tuple[int, int]] = {}

    def add(self, end: int, size: int, places: list[tuple[int, int]]) -> None:
        first = end - size + 1
        for notice, last in places:
            live = [c for c in self.open.get(notice, ()) if c[0] >= first - 1 - self.gap]
            covered, start = size, first
            for text_end, notice_end, so_far, began in live:
                if text_end < end and notice_end < last:
                    shared = max(0, text_end - first + 1, notice_end - (last - size))
                    if shared < size and (so_far + size - shared, -began) > (covered, -start):
                        covered, start = so_far + size - shared, began
            live.append((end, last, covered, start))
            self.open[notice] = live
            share = covered / self.sizes[notice]
            self.best = max(self.best, share)
            if share >= self.cover and covered > self.spans.get((notice, start), (0, 0))[0]:
                self.spans[notice, start] = (covered, end)

    def kept(self) -> list[tuple[str, int, int, int, float]]:
        """label, first and last word, words covered and share of each span that no other one holds."""
        rows = [(start, -end, -covered / self.sizes[n], self.labels[n], covered, n)
                for (n, start), (covered, end) in self.spans.items()]
        out, reach = [], -1
        for start, end, share, label, covered, _ in sorted(rows):
            if -end > reach:
                out.append((label, start, -end, covered, -share))
                reach = -end
        return out


def scan(automaton: Automaton, pieces: Iterable[list[bytes]], min_match: int = MIN_MATCH, gap: int = GAP,
         cover: float = COVER) -> tuple:
    """The values of ``FIELDS`` for one text."""
    chains = Chains(automaton, gap, cover)
    n_words = n_base = 0
    first = last = None
    base: set[str] = set()
    for at, state, size, over in automaton.statistics(pieces):
        if state < 0:
            n_words = at
            break
        for width, label in automaton.told[state]:
            if width <= size:
                n_base += 1
                base.add(label)
                start = at - width + 1
                first, last = min(start, start if first is None else first), max(start, start if last is None else last)
        if over and size >= min_match:
            chains.add(at, size, automaton.places[state])
    spans = chains.kept()
    score = 1.0 if base else chains.best
    return (n_words, n_base, first, last, sorted(base), sorted(base | {s[0] for s in spans}), score, spans)


_BUILT: dict[str, Automaton] = {}


def automaton(notices: Mapping[str, Sequence[str]], phrases: Mapping[str, str]) -> Automaton:
    """The worker's automaton for these notices, kept from batch to batch."""
    key = repr((notices, phrases))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(notices, phrases)
    return _BUILT[key]


def scan_licences(docs: DataFrame, notices: Mapping[str, Sequence[str]] = NOTICES,
                  phrases: Mapping[str, str] = PHRASES, min_match: int = MIN_MATCH, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """docs with n_words, n_base (places of phrases), first_word and last_word (smallest and largest of those
    places), base_labels, labels, score (largest covered share of a notice, 1 where a phrase stands) and
    spans; longer names on a clash."""

    @pandas_udf(", ".join(f"{name} {kind}" for name, kind in zip(FIELDS, TYPES)))
    def scanned(texts: pd.Series) -> pd.DataFrame:
        built = automaton(notices, phrases)
        names = [field.split()[0] for field in SPAN.split(", ")]
        rows = [scan(built, pieces_of(text), min_match, gap, cover) for text in texts]
        out = pd.DataFrame(rows, columns=FIELDS).astype({"first_word": "Int64", "last_word": "Int64"})
        out["spans"] = [[dict(zip(names, span)) for span in row[-1]] for row in rows]
        return out

    names = fresh(docs, "_scan", *FIELDS)
    out = docs.withColumn(names[0], scanned.asNondeterministic()(col("text")))
    return out.select(*map(col, docs.columns), *[
        F.col(names[0])[field].alias(name) for field, name in zip(FIELDS, names[1:])])
