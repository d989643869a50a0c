import re

from pyspark.sql import functions as F

from millrace.functions import survey
from millrace.functions import text as X


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items()))
    return row.select(expr.alias("v")).first().v


def text(spark, f, value):
    return one(spark, f(F.col("t")), t=(value, "string"))


def test_normalize_variants_agree(spark):
    assert {text(spark, X.normalize, t) for t in ("Hello, World!", "hello   world", "HELLO-WORLD")} == {"hello world"}
    assert text(spark, X.normalize, None) is None and text(spark, X.normalize, "") == ""


def test_normalize_like_plain_code(spark):
    for t in ("Ångström's naïve café—ok", "السلام عليكم؟", "Trần  Hưng\tĐạo_1", "a.b,c;d"):
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).strip()
        assert text(spark, X.normalize, t) == want


def test_ngrams_counts(spark):
    grams = lambda n: len(one(spark, X.ngrams(X.tokens(F.col("t")), 13), t=(" ".join(f"w{i}" for i in range(n)), "string")))
    assert [grams(n) for n in (0, 12, 13, 14)] == [0, 0, 1, 2]


def test_wrap_and_unwrap(spark):
    m = one(spark, X.wrap_assistant(F.col("a"), F.col("b")), a=("why\nso", "string"), b=("42", "string"))
    assert text(spark, lambda c: X.tagged(c, X.THINK), m) == "why\nso" and text(spark, lambda c: X.tagged(c, X.ANSWER), m) == "42"
    assert text(spark, lambda c: X.tagged(c, X.THINK), "<THINK></THINK>") == "" and text(spark, lambda c: X.tagged(c, X.THINK), "none") is None


def test_gold_answers(spark):
    assert text(spark, X.final_number, "so #### $1,234.5") == "1234.5" and text(spark, X.final_number, "none") is None
    assert text(spark, X.boxed, r"\boxed{1} then \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and text(spark, X.boxed, "x") is None
    assert text(spark, X.said_answer, "The Answer is: $12.") == "12"
    assert text(spark, X.first_user_turn, "SYSTEM: s\nUSER: hi there\n\nASSISTANT: yo") == "hi there"


def test_answer_letters(spark):
    assert text(spark, X.answer_letter, "<ANSWER> (C) </ANSWER>") == "C" and text(spark, X.answer_rule, "<ANSWER> (C) </ANSWER>") == "answer-tag"
    assert text(spark, X.answer_letter, "the correct answer is (b)") == "B" and text(spark, X.answer_rule, "hm") == "no-answer-spiral"


def test_coerce_index(spark):
    assert [text(spark, lambda c: X.coerce_index(c, 4), v) for v in ("2", "B", "3", "Z", "9", "True", None)] == [2, 1, 3, None, None, None, None]


def test_sentence_chunks(spark):
    got = text(spark, lambda c: X.sentence_chunks(c, 5), "First sentence here. Second one follows. Third and last sentence ends it.")
    assert got == ["First sentence here.", "Second one follows.", "Third and last sentence ends it."]
    assert text(spark, lambda c: X.sentence_chunks(c, 5), "") == []


def test_windows_and_padding(spark):
    xs = list(range(7))
    assert one(spark, X.windows(F.col("x"), 3), x=(xs, "array<int>")) == [[0, 1, 2], [3, 4, 5]]
    assert one(spark, X.pad_right(F.col("x"), F.lit(9)), x=(xs, "array<int>")) == xs + [0, 0]
    assert one(spark, X.byte_tokens(F.col("t")), t=("é!", "string")) == [195, 169, 33]
    assert one(spark, X.token_window(F.col("x"), F.lit(5)), x=(xs, "array<int>")) == [0, 1, 4, 5, 6]


def test_question_lines(spark):
    assert text(spark, X.question_lines, '1. "What?"\n\n- Why?\n2) How?') == ["What?", "Why?", "How?"]


def test_messages(spark):
    row = one(spark, X.messages(F.lit("u"), F.lit("r"), F.lit("a"), F.col("s")), s=("None", "string"))
    assert [m.role for m in row] == ["user", "assistant"]


def test_survey_scores(spark):
    score = lambda item, t: one(spark, survey.score(F.lit(item), F.col("t")), t=(t, "string"))
    assert score("f063", "I'd say 12, no: 8") == 8 and score("g006", "7 or 3") == 3 and score("a008", "none") is None
    assert score("y003", "Obedience and Religious faith") == -2 and score("y002", "1 and 3") == 1 and score("y002", "4, 2") == 3 and score("y002", "2") is None
    assert score("e025", "(B) maybe") == 2 and score("a165", "must be very careful") == 2


def test_projection_golden_values(spark):
    values = [2, 2, 2, 1, 8, 8, 8, 3, 2, 1]
    cols = [F.lit(v) for v in values]
    row = spark.range(1).select(survey.projected(cols, 0).alias("x"), survey.projected(cols, 1).alias("y")).first()
    assert abs(row.x - 1.9708776837) < 1e-6 and abs(row.y - 2.109577549) < 1e-6


def test_redact(spark):
    assert text(spark, X.redact, "mail a.b@c.example from 10.0.0.1 key " + "0f" * 20) == "mail <EMAIL> from <IP> key <SECRET>"


def test_html_text(spark):
    page = "<html><head><style>p{}</style><script>var a = '</p>';</script></head><body><nav>menu</nav><p>One &amp; two<br>three<p>four<b>five</div><!-- no --><footer>x</footer></body>"
    assert text(spark, X.html_text, page) == "One & two\nthree four five"
    assert text(spark, X.clean_url, "https://a.example/b?utm_source=x&id=3&gclid=1#top") == "https://a.example/b?id=3"
