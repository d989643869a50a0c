"""Running prose of a text, and its sentences.

Left out: headings, list entries, tables, code, logs, notices, addresses and tags.
A stop inside an abbreviation or a number ends no sentence. A line end within a
paragraph ends a sentence only where the text as a whole sets one sentence per line
without stops.
"""

from __future__ import annotations

import re
import unicodedata


TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
FENCE = re.compile(r"^\s*(```|~~~)")
#: lines that are no prose whatever stands around them
NOT_PROSE = re.compile(
    r"""^\s*(?:
      [-*+•‣◦–—]\s                                  # list entry
    | (?:\d{1,3}|[A-Za-z])[.)]\s                     # numbered entry
    | \#{1,6}\s | ={2,}(?:\s|$) | [-=_*~]{3,}\s*$    # heading, rule
    | \|                                             # table
    | [{}\[\]]                                       # data, code
    | \d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}               # log
    | \[?\d{2}:\d{2}:\d{2}
    | (?:https?|ftp)://\S+\s*$ | www\.\S+\s*$        # address
    | \S+@\S+\.\S+\s*$
    | [^\W\d_][\w -]{0,24}:\s*\S+(?:\s\S+){0,2}\s*$  # notice: one name, a short value
    | (?:©|\(c\)\s|copyright\b)                      # notice
    | [\w.]+\s*=\s*\S | (?:def|class|import|from|return|for|if|while)\s.*[:()]\s*$   # code
    )""",
    re.X | re.I,
)
INDENTED = re.compile(r"^(?: {4}|\t)\s*\S*[=(){}\[\];]")
PIPED = re.compile(r"\s\|\s.*\S|\t\S+\t")
BULLET = re.compile(r"^\s*[-*+•‣◦]\s")
INLINE_BULLET = re.compile(r"(?:^|\s{2,}|\n)[-*+•‣◦] ")
LINE = re.compile(r"\r\n|[\n\r\x0b\f\x85\u2028\u2029]")

#: abbreviations of the corpus languages after which a stop ends no sentence (fixed values)
ABBREVIATIONS = """
e.g i.e cf vs etc no nos vol pp p ch sec fig art approx ca mr mrs ms dr prof st al ed eds
bl.a t.ex dvs m.m jfr nr kap s.k f.d o.s.v
p.ej núm pág págs aprox sr sra dra ud uds ej
p.ex n env av chap éd ex
z.b bzw vgl abs u.a d.h usw evtl ggf bd hr fr str
tr tp th
""".split()
_ABBREVIATED = {a.rpartition(".")[2] for a in ABBREVIATIONS}
STOP = re.compile(r"[.!?؟…。]+[\"'”’»)\]]*(?=\s|$)")
WORD = re.compile(r"[^\W_]+")


def _ends(text: str, m: re.Match) -> bool:
    """Whether the stop found ends a sentence of ``text``."""
    after = text[m.end() : m.end() + 2].lstrip()
    if m.group()[0] != "." or m.group()[:2] == "..":
        return not (after[:1].islower() and m.group()[0] in "….")
    if after[:1].islower():
        return False
    before = text[max(0, m.start() - 16) : m.start()].split()
    tail = before[-1].lstrip("([\"'«“‘").rpartition(".")[2].lower() if before else ""
    if (len(tail) == 1 and tail.isascii() and tail.isalpha()) or tail in _ABBREVIATED:
        # at the end of a paragraph it ends the sentence as well
        return not text[m.end() :].strip()
    return True


def blocks(text: str) -> list[list[str]]:
    """Paragraphs as lists of prose lines."""
    out: list[list[str]] = []
    now: list[str] = []
    fenced = False

    def close() -> None:
        nonlocal now
        if now:
            out.append(now)
            now = []

    for raw in LINE.split(text):
        if FENCE.match(raw):
            fenced = not fenced
            close()
            continue
        if fenced:
            continue
        line = TAG.sub(" ", raw) if "<" in raw else raw
        bare = line.strip()
        if not bare:
            close()
            continue
        if INDENTED.match(line) or PIPED.search(line) or (NOT_PROSE.match(line) and not (BULLET.match(line) and "  " in bare)):
            close()
            continue
        now.append(line)
    close()
    return out


def _without_entries(block: list[str]) -> list[str]:
    """A wrapped paragraph may carry list entries set off by wide blanks; they go, their wrapped rest included."""
    joined = "\n".join(block)
    if not INLINE_BULLET.search(joined):
        return block
    kept = [part for part in re.split(r" {2,}|(?<=\n) ", joined) if not BULLET.match(part)]
    return [x for part in kept for x in part.split("\n") if x.strip()]


def measure(text: str | None) -> tuple[int, int, int, list[str]]:
    """(sentences, words, letters, words) of the running prose."""
    if not text:
        return 0, 0, 0, []
    paragraphs = []
    for block in blocks(unicodedata.normalize("NFC", text)):
        block = _without_entries(block)
        if len(block) == 1 and not STOP.search(block[0]) and len(WORD.findall(block[0])) <= 6:
            # a short line alone without a stop is a heading, unless the text goes by lines (seen below)
            paragraphs.append((block, True))
        elif block:
            paragraphs.append((block, False))
    lines = [x.strip() for block, heading in paragraphs if not heading for x in block]
    by_line = one_sentence_per_line(lines)
    sentences, found = 0, []
    for block, heading in paragraphs:
        if heading:
            continue
        for part in [x.strip() for x in block] if by_line else [" ".join(x.strip() for x in block)]:
            count = 0
            at = 0
            for m in STOP.finditer(part):
                if _ends(part, m):
                    if WORD.search(part, at, m.end()):
                        count += 1
                    at = m.end()
            if WORD.search(part, at):
                count += 1
            sentences += count
            found += WORD.findall(part)
    return sentences, len(found), sum(map(len, found)), found


def one_sentence_per_line(lines: list[str]) -> bool:
    """Whether the lines of a text are its sentences: hardly any full stop, and no line that goes on in lower case."""
    if len(lines) < 2:
        return False
    stopped = sum(1 for x in lines if x.endswith("."))
    small = sum(1 for x in lines if x[:1].islower())
    if stopped > 0.2 * len(lines) or small > 0.2 * len(lines):
        return False
    inside = sum(1 for x in lines for m in STOP.finditer(x, 0, max(0, len(x) - 1)) if m.end() < len(x) and _ends(x, m))
    return inside <= 0.1 * len(lines)
