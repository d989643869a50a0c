"""Column builders over text: normalising, tokens, n-grams, parsing and rendering.

All of them are expressions of built-in functions, but ``composed``, which goes through Arrow batches.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = [chr(65 + i) for i in range(14)]


def present(c: Column) -> Column:
    """Null for the three spellings of nothing: null, blank, ``None``."""
    t = F.trim(c)
    return F.when((t == "") | (t == "None"), None).otherwise(t)


def first_present(*cols: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[present(c) for c in cols])


def normalize(c: Column) -> Column:
    """Lower case, everything but letters, digits and underscore to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def tokens_sql(name: str) -> str:
    """``tokens`` of a column as text of an expression, for those that are built as text."""
    return rf"filter(split(trim(regexp_replace(regexp_replace(lower(`{name}`), r'[^\p{{L}}\p{{N}}_\s]', ' '), r'\s+', ' ')), ' '), x -> x <> '')"


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by blanks; fewer than ``n`` words give none."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(none))


def ngram_hashes(words: Column, n: int) -> Column:
    """64-bit hash of each run of ``n`` words: a light key to find candidates by."""
    none = F.array().cast("array<bigint>")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return bound(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(none))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, also where ``use`` names it inside a lambda of its own."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(c: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words_of(c))


def truncate_words(c: Column, n: int) -> Column:
    """First ``n`` words joined by blanks; a text that is short enough stays as it is."""
    return bound(words_of(c), lambda w: F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, 1, n), " ")))


def canonical_license(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))


#: licences a corpus may carry (fixed values)
OPEN_LICENSES = [
    "public-domain",
    "cc0-1.0",
    "cc-by-4.0",
    "cc-by-3.0",
    "cc-by-2.0",
    "cc-by-sa-4.0",
    "cc-by-sa-3.0",
    "odc-by-1.0",
    "ogl-3.0",
    "apache-2.0",
    "mit",
]


def seeded_order(*parts: Column | str) -> Column:
    """Hash that orders rows the same on every run: sha256 of ``seed:...:key``."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def stable_seed(seed: Column, name: Column) -> Column:
    """First 64 bits of sha256 of ``seed:name``."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), name), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def md5_bucket(key: Column, n: int) -> Column:
    """Worker 0 .. n - 1 of a key, from the first 32 bits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n))


def record_id(category: Column, source: Column, i: Column) -> Column:
    short = F.substring(F.replace(F.replace(category, F.lit("_shaped"), F.lit("")), F.lit("_"), F.lit("")), 1, 8)
    tail = F.substring(F.regexp_replace(source, "[^A-Za-z0-9]", ""), 1, 10)
    return F.format_string("rhsl_%s_%s_%06d", short, tail, i)


def slug(c: Column) -> Column:
    return F.translate(F.replace(F.lower(c), F.lit(" "), F.lit("_")), "()", "")


def quoted_title(c: Column) -> Column:
    return F.url_encode(F.replace(c, F.lit(" "), F.lit("_")))


THINK = r"(?s)<THINK>(.*?)</THINK>"
ANSWER = r"(?s)<ANSWER>(.*?)</ANSWER>"


def wrap_assistant(reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit("<THINK>\n"), F.trim(reasoning), F.lit("\n</THINK>\n<ANSWER>\n"), F.trim(answer), F.lit("\n</ANSWER>"))


def tagged(c: Column, pattern: str) -> Column:
    """Content of the first tag; null where it is missing, '' where it is empty."""
    return F.when(c.rlike(pattern), F.regexp_replace(F.regexp_extract(c, pattern, 1), r"^\s+|\s+$", ""))


def format_mc(question: Column, options: Column) -> Column:
    """Question, a blank line, then ``A) option`` lines (at most 14)."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(F.slice(options, 1, len(LETTERS)), lambda o, i: F.concat(F.get(letters, i), F.lit(") "), F.trim(o)))
    return F.concat_ws("\n", F.trim(question), F.lit(""), F.array_join(lines, "\n"))


# the patterns below are fixed by the answer formats they read


def final_number(c: Column) -> Column:
    """What follows the first ``####``: digits, without thousands commas and a leading dollar sign."""
    v = F.ltrim(F.replace(F.regexp_extract(c, r"####\s*([-$0-9.,]+)", 1), F.lit(","), F.lit("")), F.lit("$"))
    return F.when(v != "", v)


BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"


def boxed(c: Column) -> Column:
    """Last boxed expression, one level of braces inside it."""
    found = F.regexp_extract_all(c, F.lit(BOXED), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.get(found, F.size(found) - 1)))


def said_answer(c: Column) -> Column:
    v = F.regexp_extract(c, r"(?i)answer is[:\s]+\$?([-0-9.,]+)", 1)
    return F.when(v != "", F.rtrim(F.replace(v, F.lit(","), F.lit("")), F.lit(".")))


def first_user_turn(c: Column) -> Column:
    v = F.trim(F.regexp_extract(c, r"(?s)USER:\s*(.*?)(?=\n\s*(?:ASSISTANT|FUNCTION RESPONSE)|\z)", 1))
    return F.when(v != "", v)


def plain_number(c: Column) -> Column:
    """A number as text without trailing zeros of its fraction."""
    s = c.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def question_lines(c: Column) -> Column:
    """Lines of a model's list: without numbering, bullets and quotes; blanks dropped."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\(?\d+[.):]\s*", ""), r"^[-*•]\s*", ""), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.filter(F.transform(F.split(c, "\n"), bare), lambda x: x != "")


def passages(titles: Column, sentences: Column) -> Column:
    """``### title`` blocks with their sentences joined, separated by blank lines."""
    return F.array_join(F.transform(F.arrays_zip(titles.alias("t"), sentences.alias("s")), lambda x: F.concat(F.lit("### "), x["t"], F.lit("\n"), F.array_join(x["s"], " "))), "\n\n")


def with_context(context: Column, question: Column) -> Column:
    return F.when(present(context).isNull(), F.trim(question)).otherwise(F.concat(F.trim(context), F.lit("\n\n"), F.trim(question)))


def sentence_chunks(c: Column, max_words: int) -> Column:
    """Sentences packed greedily into chunks of at most ``max_words``; a longer sentence stays whole."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?؟।])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        n = F.size(F.split(s, r"\s+"))
        full = (acc["n"] > 0) & (acc["n"] + n > max_words)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"),
            F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]))


def head_tail(c: Column, cutoff: int, mark: str = "\n[...]\n") -> Column:
    """Head and tail of ``4 * cutoff`` characters of a text longer than twice that."""
    cap = 4 * cutoff
    return F.when(F.length(c) > 2 * cap, F.concat(F.substring(c, 1, cap), F.lit(mark), F.right(c, F.lit(cap)))).otherwise(c)


def token_window(words: Column, keep: Column) -> Column:
    """Head and tail of a token list, ``keep`` in all, the head being half of it rounded down."""
    head = F.floor(keep / 2).cast("int")
    tail = (keep - head).cast("int")
    return F.when(F.size(words) <= keep, words).otherwise(F.concat(F.slice(words, F.lit(1), head), F.slice(words, F.size(words) - tail + 1, tail)))


def answer_letter(c: Column) -> Column:
    """Letter A to D from the last answer tag, else from the last ``answer is``; null otherwise."""
    parts = F.split(c, "<ANSWER>")
    inside = F.get(F.split(F.get(parts, F.size(parts) - 1), "</ANSWER>"), F.lit(0))
    tag = F.when(F.contains(c, F.lit("<ANSWER>")), F.regexp_extract(inside, "([ABCD])", 1))
    said = F.regexp_extract_all(c, F.lit(r"(?i)(?:the\s+)?(?:best|correct|final)?\s*answer\s+is\s*:?\s*\(?\*{0,2}([ABCD])\b"), F.lit(1))
    return F.coalesce(F.when(tag != "", tag), F.when(F.size(said) > 0, F.upper(F.get(said, F.size(said) - 1))))


def answer_rule(c: Column) -> Column:
    parts = F.split(c, "<ANSWER>")
    inside = F.get(F.split(F.get(parts, F.size(parts) - 1), "</ANSWER>"), F.lit(0))
    by_tag = F.contains(c, F.lit("<ANSWER>")) & inside.rlike("[ABCD]")
    return F.when(by_tag, "answer-tag").when(answer_letter(c).isNotNull(), "answer-is").otherwise("no-answer-spiral")


def coerce_index(c: Column, n: int) -> Column:
    """Option index from a number or a letter, null outside 0 .. n - 1."""
    t = F.trim(c)
    i = F.when(t.rlike(r"^-?\d+$"), t.try_cast("int")).when(t.rlike("^[A-Za-z]$"), F.ascii(F.upper(t)) - 65)
    return F.when((i >= 0) & (i < n), i)


def part_label(key: Column) -> Column:
    return F.concat(F.lit("part_"), F.get(F.split(key, "_"), F.lit(1)))


def byte_tokens(c: Column) -> Column:
    """UTF-8 bytes as numbers."""
    pairs = F.filter(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def pad_right(xs: Column, width: Column) -> Column:
    return F.concat(xs, F.array_repeat(F.lit(0), F.greatest(width - F.size(xs), F.lit(0))))


def windows(xs: Column, width: int) -> Column:
    """Consecutive windows of ``width``; one shorter than 2 is dropped."""
    none = F.array().cast("array<int>")

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(width))).otherwise(none)
        return F.filter(F.transform(starts, lambda i: F.slice(w, i, width)), lambda x: F.size(x) >= 2)

    return bound(xs, cut)


def messages(user: Column, reasoning: Column, answer: Column, system: Column) -> Column:
    """Chat messages: optional system, user, assistant with its reasoning wrapped."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.filter(F.array(m("system", present(system)), m("user", user), m("assistant", wrap_assistant(reasoning, answer))), lambda x: x["content"].isNotNull())


def chat_text(msgs: Column, head: str = "<|start_header_id|>", tail: str = "<|end_header_id|>\n\n", end: str = "<|eot_id|>") -> Column:
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), F.trim(m["content"]), F.lit(end))), "")


def cue_score(c: Column, markers: list[str], marks: str) -> Column:
    """Two points a marker word, one a marked character (Unicode aware).

    A combining mark is no part of a word here, unlike for ``\\b``, so it ends one.
    """
    edge = r"[\p{L}\p{N}_]"
    return 2 * F.regexp_count(c, F.lit(rf"(?iU)(?<!{edge})({'|'.join(markers)})(?!{edge})")) + F.regexp_count(c, F.lit(rf"(?iU)[{marks}]"))


def redact(c: Column) -> Column:
    """Mail addresses, network addresses, long hexadecimal secrets and phone numbers replaced by their kind."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>")
    c = F.regexp_replace(c, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<IP>")
    c = F.regexp_replace(c, r"\b[0-9a-f]{40}\b", "<SECRET>")
    return F.regexp_replace(c, r"\+[0-9][0-9 ()-]{7,}[0-9]", "<PHONE>")


def alpha_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n).otherwise(0.0)


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


#: elements whose content is no text (fixed values)
SILENT = "script|style|nav|footer|noscript|template|svg"


def html_text(c: Column) -> Column:
    """Text of a page: silent elements and comments go, block ends become line breaks, entities are resolved."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, rf"(?is)<({SILENT})\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)\s*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{00A0}]+", " "), r" ?\n ?", "\n"), r"\n{2,}", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_url(c: Column) -> Column:
    """Address without fragment and tracking parameters."""
    c = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), r"(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&{2,}", "&"), r"\?&", "?"), r"[?&]+$", "")


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """A template with named fields in braces; doubled braces stand for themselves, an unknown name raises."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def known_name(c: Column, names: dict[str, str]) -> Column:
    """Name of a key: from the map, else the key in title case."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.initcap(c)) if pairs else F.initcap(c)


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def route(c: Column, routes: dict[str, list[str]], other: str) -> Column:
    """The route whose list holds the value."""
    out = None
    for name, values in routes.items():
        out = F.when(c.isin(values), name) if out is None else out.when(c.isin(values), name)
    return F.lit(other) if out is None else out.otherwise(other)


def first_tag(c: Column, words: dict[str, list[str]], other: str) -> Column:
    """First tag one of whose words stands in the text, in lower case."""
    low, out = F.lower(c), None
    for tag, held in words.items():
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in held])
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return F.lit(other) if out is None else out.otherwise(other)


def loss_spans(messages: Column) -> Column:
    """[first, last) characters of the assistant turns in ``chat_text``: their content and the end mark, not their header."""
    one = lambda m: F.length(chat_text(F.array(m)))
    trained = lambda m: F.length(F.trim(m["content"])) + F.lit(len("<|eot_id|>"))
    kind = "struct<at: int, spans: array<struct<first: int, last: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, last: int>>").alias("spans")).cast(kind)

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + one(m)
        span = F.array(F.struct((end - trained(m)).alias("first"), end.alias("last")))
        return F.struct(end.alias("at"), F.when(m["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(kind)

    return F.aggregate(messages, start, step, lambda acc: acc["spans"])
