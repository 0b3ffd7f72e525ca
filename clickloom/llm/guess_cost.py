"""How many guesses a password takes: the cheapest cut into words, dates, repeats, keyboard walks and single characters.

All costs are base-10 logarithms of guesses; those of the segments of a cut add
up. A segment of one of the four patterns also costs ``KIND``, for saying which
pattern it is; the characters between patterns cost the size of their class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

#: Patterns, and characters one by one.
KIND = math.log10(5)
#: Dictionary words have so many characters; so have the parts of walks that are looked at besides whole ones.
SHORTEST, LONGEST = 3, 24
#: Units of repeats have at most so many characters.
UNIT = 8

# Rows of a US keyboard, and characters written for letters.
KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
WRITTEN_FOR = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "il", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}

_PLACE = {key: (x, y) for y, row in enumerate(KEYS) for x, key in enumerate(row) if key != " "}
_UPPER = {chr(i): chr(i + 32) for i in range(65, 91)}
_FOLD = str.maketrans(_UPPER)
#: Two readings of a value: the one figure that may stand for two letters taken either way.
READINGS = tuple(str.maketrans({c: letters[k % len(letters)] for c, letters in WRITTEN_FOR.items()} | _UPPER) for k in range(2))
_YEARS = range(1900, 2100)
_DAYS = math.log10(366 * len(_YEARS))
_DATE = re.compile(
    r"(?P<y1>\d{4})(?P<s1>[-/._]?)(?P<m1>\d{2})(?P=s1)(?P<d1>\d{2})|(?P<d2>\d{1,2})(?P<s2>[-/._]?)(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4}|\d{2})|(?P<y3>(?:19|20)\d{2})",
    re.A,
)


def fold(text: str) -> str:
    return text.translate(_FOLD)


def is_letter(c: str) -> bool:
    return "a" <= c <= "z" or c > "\x7f"


def character(c: str) -> float:
    size = 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c <= "\x7f" else 100
    return math.log10(size)


def readings(value: str) -> Iterator[tuple[int, int, str]]:
    """Substrings that could be dictionary words, folded and with figures read as letters: start, end, word.

    At most every third character is a figure for a letter.
    """
    plain = fold(value)
    reads = [value.translate(table) for table in (_FOLD, *READINGS)]
    for start in range(len(value)):
        found = set()
        for read in reads:
            figures = 0
            for end in range(start + 1, min(start + LONGEST, len(read)) + 1):
                if not is_letter(read[end - 1]):
                    break
                figures += read[end - 1] != plain[end - 1]
                if end - start >= SHORTEST and 3 * figures <= end - start:
                    found.add((start, end, read[start:end]))
        yield from sorted(found)


def letter_runs(value: str) -> list[str]:
    """The whole words of a value, as the corpus's words are cut."""
    out, run = [], ""
    for c in fold(value) + " ":
        if is_letter(c):
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def _variants(n: int, k: int) -> float:
    """Ways of changing at most k of n characters."""
    return math.log10(sum(math.comb(n, i) for i in range(1, k + 1)))


def word(written: str, read: str, share: float) -> float:
    """A dictionary word that makes up ``share`` of the corpus, with its capitals and figures."""
    cost = max(0.0, -math.log10(share))
    capitals = sum("A" <= c <= "Z" for c in written)
    figures = sum(a != b for a, b in zip(fold(written), read))
    if capitals:
        simple = capitals == len(written) or (capitals == 1 and "A" <= written[0] <= "Z")
        cost += math.log10(2) if simple else _variants(len(written), min(capitals, len(written) - capitals))
    if figures:
        cost += _variants(len(written), figures)
    return cost


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Neighbouring keys one after the other: parts of up to ``LONGEST`` characters, and whole walks."""
    keys = [_PLACE.get(c) for c in fold(value).translate(SHIFTED)]
    ends, steps = [len(value)] * len(value), [None] * len(value)
    for i in range(len(value) - 2, -1, -1):
        a, b = keys[i], keys[i + 1]
        steps[i + 1] = a and b and (b[0] - a[0], b[1] - a[1])
        near = a and b and a != b and max(map(abs, steps[i + 1])) <= 1
        ends[i] = ends[i + 1] if near else i + 1
    turned = [0]
    for i in range(len(value)):
        turned.append(turned[-1] + (i < 2 or steps[i] is None or steps[i] != steps[i - 1]))
    for start, end in enumerate(ends):
        whole = start == 0 or ends[start - 1] == start
        stops = [*range(start + SHORTEST, min(end, start + LONGEST) + 1), *([end] if whole and end - start > LONGEST else [])]
        for stop in stops:
            turns = 1 + turned[stop] - turned[start + 2]
            yield start, stop, math.log10(len(_PLACE)) + turns * math.log10(8) + math.log10(stop - start)


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for start in range(len(value)):
        if not "0" <= value[start] <= "9":
            continue
        found = _DATE.match(value, start)
        if not found:
            continue
        part = found.groupdict()
        for k in "12":
            if part["d" + k] and 1 <= int(part["m" + k]) <= 12 and 1 <= int(part["d" + k]) <= 31 and (len(part["y" + k]) == 2 or int(part["y" + k]) in _YEARS):
                yield start, found.end(), _DAYS + (math.log10(5) if part["s" + k] else 0.0)
        year = value[start : start + 4]
        if len(year) == 4 and year.isascii() and year.isdigit() and int(year) in _YEARS:
            yield start, start + 4, math.log10(len(_YEARS))


def _repeats(value: str, others: list[tuple[int, int, float]]) -> Iterator[tuple[int, int, float]]:
    """Longest repeats of units of up to ``UNIT`` characters: whole periods, and to the last character alike."""
    starting: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in others:
        if end - start <= UNIT:
            starting.setdefault(start, []).append((end, cost))
    for unit in range(1, UNIT + 1):
        start = 0
        while start + unit < len(value):
            same = start
            while same + unit < len(value) and value[same] == value[same + unit]:
                same += 1
            end = same + unit
            times = (end - start) // unit
            if times >= 2 and end - start >= SHORTEST:
                inner = [(i, b - start, c) for i in range(unit) for b, c in starting.get(start + i, ()) if b <= start + unit]
                cost = cheapest(value[start : start + unit], inner)
                for stop in {start + times * unit, end}:
                    yield start, stop, cost + math.log10(times + 1)
            start = same + 1


def segments(value: str, words: list[tuple[int, int, str, float]]) -> list[tuple[int, int, float]]:
    """Start, end and cost of all pattern segments; ``words``: start, end, the word as read and its share of the corpus."""
    found = [(a, b, KIND + word(value[a:b], read, share)) for a, b, read, share in words]
    found += [(a, b, KIND + c) for a, b, c in [*_walks(value), *_dates(value)]]
    return found + [(a, b, KIND + c) for a, b, c in _repeats(value, found)]


def cheapest(value: str, found: list[tuple[int, int, float]]) -> float:
    """The least cost of a cut of the whole value into the segments given and single characters."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in found:
        ending.setdefault(end, []).append((start, cost))
    least = [0.0]
    for end, c in enumerate(value, 1):
        least.append(min([least[-1] + character(c), *(least[start] + cost for start, cost in ending.get(end, ()))]))
    return least[-1]


def guesses(value: str, words: list[tuple[int, int, str, float]]) -> float:
    """The base-10 logarithm of the guesses that the whole value takes."""
    return cheapest(value, segments(value, words))
