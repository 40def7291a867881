"""License notices with bounded errors.

A notice of n characters may differ by k edits. Cut into k + 1 pieces, at least one piece
of any such occurrence is exact, so one pass of an automaton over all pieces finds every
place worth looking at; the regex library then matches the notice with at most k errors in
the small window around it.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of

# fixed values: the phrases that are counted exactly, and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# notices that are found with errors, and their labels
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "all rights reserved": "reserved",
    "spdx license identifier": "spdx",
}
CHARS_PER_ERROR = 10
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """Words of letters, digits and everything beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).decode("utf-8", "surrogatepass").split(" ")


@dataclass(frozen=True)
class Found:
    label: str
    start: int  # first word
    end: int  # word after the last
    errors: int
    length: int

    @property
    def score(self) -> float:
        return max(0.0, 1 - self.errors / self.length)


class Matcher:
    def __init__(self, notices: dict[str, str] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> None:
        self.notices = [(phrase, label, max(1, len(phrase) // chars_per_error)) for phrase, label in notices.items()]
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(p)}){{e<={k}}}(?![^ ])") for p, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, _, k) in enumerate(self.notices):
            edges = [len(phrase) * j // (k + 1) for j in range(k + 2)]
            for s, e in zip(edges, edges[1:]):
                seeds.setdefault(phrase[s:e], []).append((i, s))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def starts(self, line: str) -> dict[int, list[int]]:
        """For each notice, where it would start if the pieces found were in their places; with errors, at most k beside it."""
        out: dict[int, set[int]] = {}
        for last, (length, places) in self.seeds.iter(line):
            for i, offset in places:
                out.setdefault(i, set()).add(last + 1 - length - offset)
        return {i: sorted(s) for i, s in out.items()}

    def find(self, words: list[str]) -> list[Found]:
        """All occurrences, by word places. Of a notice's overlapping occurrences the best one counts, of equals the first.

        Each window is as long as one occurrence may be, with the starts that lie 2 k apart at
        most, so the work grows with the number of windows.
        """
        line = " ".join(words)
        out = []
        for i, starts in sorted(self.starts(line).items()):
            phrase, label, k = self.notices[i]
            found: set[tuple[int, int, int]] = set()
            at = 0
            while at < len(starts):
                first = at
                while at < len(starts) and starts[at] - starts[first] <= 2 * k:
                    at += 1
                found |= self.best(i, line, max(starts[first] - k - 1, 0), min(starts[at - 1] + len(phrase) + k + 1, len(line)))
            seen, done = 0, 0  # words before ``done``
            for s, e, errors in _apart(found):
                seen, done = seen + line.count(" ", done, s), s
                out.append(Found(label, seen, seen + line.count(" ", s, e) + 1, errors, len(phrase)))
        return out

    def best(self, i: int, line: str, begin: int, end: int) -> set[tuple[int, int, int]]:
        """(start, end, errors) of the best match in a window, and of those before and behind it."""
        phrase, _, k = self.notices[i]
        out: set[tuple[int, int, int]] = set()
        todo = [(begin, end)]
        while todo:
            begin, end = todo.pop()
            if end - begin < len(phrase) - k:
                continue
            exact = line.find(phrase, begin, end)
            if exact >= 0 and line[exact - 1 : exact] in ("", " ") and line[exact + len(phrase) : exact + len(phrase) + 1] in ("", " "):
                s, e, errors = exact, exact + len(phrase), 0
            else:
                m = self.patterns[i].search(line, begin, end)
                if not m or m.start() == m.end():
                    continue
                s, e, errors = m.start(), m.end(), sum(m.fuzzy_counts)
                if line[e : e + 1] not in ("", " "):  # the window ends inside a word, which is not the end of one
                    todo.append((begin, e - 1))
                    continue
            out.add((s, e, errors))
            todo += [(begin, s - 1), (e, end)]
        return out


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches that do not overlap, the better one first served, from left to right."""
    starts: list[int] = []
    taken: dict[int, tuple[int, int, int]] = {}
    for s, e, errors in sorted(found, key=lambda x: (x[2], x[0], x[1])):
        at = bisect(starts, s)
        if (at == 0 or taken[starts[at - 1]][1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            taken[s] = (s, e, errors)
    return [taken[s] for s in starts]


def exact_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a base phrase stand in a row."""
    out = []
    line = f" {' '.join(words)} "
    for phrase, label in BASE.items():
        at, seen, done = line.find(f" {phrase} "), 0, 0  # words before ``done``
        while at >= 0:
            seen, done = seen + line.count(" ", done, at), at
            out.append((seen, label))
            at = line.find(f" {phrase} ", at + 1)
    return sorted(out)


def _scan(notices: dict[str, str], chars_per_error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(notices, chars_per_error)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = [w for w in words_of(text) if w]
                base, found = exact_places(words), matcher.find(words)
                base_labels = sorted({label for _, label in base})
                labels = sorted({*base_labels, *(f.label for f in found)})
                score = 1.0 if base else max((f.score for f in found), default=0.0)
                spans = sorted({(f.start, f.end, f.label, f.errors) for f in found})
                rows.append((doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score,
                             ",".join(f"{label}:{s}:{e}:{errors}" for s, e, label, errors in spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    spans lists label:first word:word after the last:errors of every notice found; score is 1
    where a base phrase stands, else one less the share of wrong characters of the best notice,
    else 0. A null or empty text has no words. Repeated rows and null ids give a row each;
    other columns are ignored; an empty table gives none.
    """
    return texts_of(docs, id_col, text_col).mapInArrow(
        _scan(dict(notices or NOTICES), chars_per_error),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
