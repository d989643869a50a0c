"""Scoring of survey answers and their projection onto two axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: items in the order the projection takes them (fixed values)
ITEMS = ["a008", "a165", "e018", "e025", "f063", "f118", "f120", "g006", "y002", "y003"]
#: means, spreads and weights of the published projection (fixed values)
CENTER = [1.8943346824, 1.7249291681, 1.5375948814, 2.1269639031, 7.1949652909, 3.9094104719, 3.8423957313, 1.5694507646, 1.7972968314, 0.19721005786]
SCALE = [0.71428942794, 0.44655054645, 0.72791694544, 0.82373260626, 3.2116353258, 3.3945220392, 3.0616139885, 0.73247264575, 0.61878304245, 1.1374858635]
WEIGHTS = [
    [-0.23807309806, 0.49269801609],
    [-0.2251712732, 0.1488361647],
    [-0.014293231158, 0.32860123575],
    [-0.27281863433, 0.12800336475],
    [-0.18470853804, -0.21524790046],
    [0.31012187775, -0.010659178321],
    [0.2628449143, 0.090593025901],
    [-0.082774181417, 0.49177541639],
    [0.1796722504, -0.080708482322],
    [0.15181160734, 0.18147842385],
]
LINES = [(1.81, 0.38), (1.61, -0.01)]
#: allowed range of each item (fixed values)
RANGES = {"a008": (1, 4), "a165": (1, 2), "e018": (1, 3), "e025": (1, 3), "f063": (1, 10), "f118": (1, 10), "f120": (1, 10), "g006": (1, 4), "y002": (1, 3), "y003": (-2, 2)}


#: how answers are read (fixed values): numbers up to a highest one; phrases that stand for a score, beside the lettered options A, B, C for the scores 1, 2, 3
HIGHEST = {"g006": 4, "a008": 4, "f063": 10, "f120": 10, "e018": 10, "f118": 10}
PHRASES = {
    "e025": [["have signed"], ["might do"], ["would never", "never under any"]],
    "a165": [["can be trusted"], ["be very careful"]],
}
#: qualities of a child that add to the score of y003 if they are not named, and that take from it
QUALITIES = (["Religious faith", "Obedience"], ["Independence", "Determination"])
#: score of y002 for the two goals chosen; any other two give 2
GOALS = {(1, 3): 1, (2, 4): 3}
OPTION = r"(?i)^\s*\(?\**(?:option\s*)?([ABC])\b"


def first_int(c: Column, lo: int, hi: int) -> Column:
    """First whole number of the text that lies in the range."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.get(F.filter(found, lambda v: (v >= lo) & (v <= hi)), F.lit(0))


def autonomy(c: Column) -> Column:
    """Qualities of the first kind less those of the second, each 1 if named and 2 if not."""
    t, total = F.coalesce(c, F.lit("")), F.lit(0)
    for sign, names in zip((1, -1), QUALITIES, strict=True):
        for name in names:
            total = total + sign * (2 - F.contains(t, F.lit(name)).cast("int"))
    return total


def two_choices(c: Column) -> Column:
    """Score of the first two numbers as goals, in either order; null with fewer than two numbers."""
    found = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    pair = F.array_distinct(F.sort_array(F.transform(F.slice(found, 1, 2), lambda x: x.try_cast("int"))))
    scores = [F.when(pair == F.array(*map(F.lit, goals)), value) for goals, value in GOALS.items()]
    return F.when(F.size(found) >= 2, F.coalesce(*scores, F.lit(2)))


def lead_letter(c: Column) -> Column:
    v = F.upper(F.regexp_extract(c, OPTION, 1))
    return F.when(v != "", v)


def by_phrase(item: str, c: Column) -> Column:
    """First score whose letter leads the text or one of whose phrases stands in it."""
    low, letter = F.lower(c), lead_letter(c)
    scores = []
    for k, phrases in enumerate(PHRASES[item]):
        hit = F.coalesce(letter == "ABC"[k], F.lit(False))
        for phrase in phrases:
            hit = hit | F.contains(low, F.lit(phrase))
        scores.append(F.when(hit, k + 1))
    return F.coalesce(*scores)


def score(item: Column, text: Column) -> Column:
    """Score of an answer text for an item; null where it cannot be read."""
    readers = {"y003": autonomy(text), "y002": two_choices(text)} | {i: first_int(text, 1, hi) for i, hi in HIGHEST.items()} | {i: by_phrase(i, text) for i in PHRASES}
    return F.coalesce(*[F.when(item == i, read) for i, read in readers.items()])


def in_range(item: str, c: Column) -> Column:
    lo, hi = RANGES[item]
    return F.when(c.between(lo, hi), c)


def projected(values: list[Column], axis: int) -> Column:
    """Coordinate on one axis; null if any item is missing."""
    total = F.lit(0.0)
    for v, m, s, w in zip(values, CENTER, SCALE, WEIGHTS, strict=True):
        total = total + (v.cast("double") - m) / s * w[axis]
    slope, base = LINES[axis]
    return total * slope + base
