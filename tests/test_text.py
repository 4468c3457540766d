import time

import pytest
from pyspark.sql import functions as F

from evalweave.functions import scoring, text

BOXES = [
    (r"\boxed{42}", "42"),
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
    (r"\boxed{(3, \frac{\pi}{2})}", r"(3, \frac{\pi}{2})"),
    (r"\boxed{5} and then \boxed{\frac{1}{2", "5"),
    ("FirstĠanswerĊĊ\\boxed{42}", "42"),
    (r"\boxed{a \boxed{b} c}", "b"),
    (r"\boxed{a \boxed b} c} {d}", "b} c} {d}"),
    (r"\boxed{a \fbox b} {c}", r"a \fbox b"),
    (r"so \boxed 42$ is it", "42"),
    (r"\boxed $ x", None),
    (r"\boxedx{1}", None),
    (r"final answer is: 7. I hope it is correct. \fbox x{1}", None),
    (r"\boxed{}", ""),
    (r"\boxed{ } final answer is: 3", ""),
    (r"Therefore, the final answer is: $\frac{3}{4}$. I hope it is correct.", r"\frac{3}{4}"),
    ("The Final Answer is: 12.\n", "12"),
    ("final answer is: $$", None),
    (r"final answer is: 9. I hope it is correct \boxed{", "9"),
    (r"\boxed{{{{{{{{7}}}}}}}}", "{{{{{{{7}}}}}}}"),
    (r"} \boxed} {x}", None),
    (r"\fbox{3} \boxed{4}", "4"),
    (r"\boxed{4} \fbox{3}", "3"),
    ("\\boxed{\u00a0 8 \u2003}", "8"),
    ("nothing here", None),
    ("", None),
    (None, None),
]


def test_boxed_answers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOXES)], "i int, t string")
    out = text.with_boxed(df, {"a": text.repair_markers(F.col("t"))}).orderBy("i").collect()
    assert [r.a for r in out] == [want for _, want in BOXES]


def test_python_and_column_paths_agree():
    for source, want in BOXES:
        if source is not None:
            assert text.boxed_or_final_line(source.replace("Ġ", " ").replace("Ċ", "\n")) == want, source


def test_long_and_unclosed_texts_are_fast(spark):
    texts = [r"\boxed{" * 3000 + "x" * 50_000, r"\boxed{1} " + r"\boxed{ {" * 3000, "a{" * 40_000 + r"\boxed{2}", "y " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.time()
    out = [r.a for r in text.with_boxed(df, {"a": F.col("t")}).orderBy("i").collect()]
    assert out == [None, "1", "2", None]
    assert time.time() - start < 20


@pytest.mark.parametrize("a, b", [("(3, pi/2)", "(3,pi/2)"), ("$ X\\,Y $", "xy"), (None, ""), ("ĠAĊb", "ab")])
def test_normalisation(spark, a, b):
    row = spark.range(1).select(text.normalize_answer(F.lit(a).cast("string")).alias("x")).first()
    assert row.x == b


@pytest.mark.parametrize("source, want", [
    ("Answer: C", "C"), ("answer: $b$", "B"), ("I think a dog", "A"), ("Answer: Because", "B"), ("so D. No", "D"),
    ("nothing", None), ("x" * 300 + " c", "C"), ("B " + "x" * 300, None), ("Answer:\n D", "D"), ("É a", "A"), ("éaé", None),
])
def test_choice_letter(spark, source, want):
    assert spark.range(1).select(text.choice_letter(F.lit(source)).alias("x")).first().x == want


@pytest.mark.parametrize("source, want", [
    ("it is 12,345.5 dollars", "12,345.5"), ("3.14.15", "15"), ("1,23", "23"), ("a-5", "-5"), ("5-", "5"), ("none", None),
    ("7, and ., -", "7"), ("12,345,6", "6"), ("x 1.", "1"),
])
def test_last_number(spark, source, want):
    import regex
    plain = regex.findall(text.NUMBER, source)
    assert (plain[-1] if plain else None) == want
    assert spark.range(1).select(text.last_number(F.lit(source)).alias("x")).first().x == want


def test_numeric_gold(spark):
    rows = [("work #### 1,000 ", "1,000"), ("a #### 1 #### 2", "2"), ("we get 5 or 6", "6")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r.x for r in df.select("i", text.numeric_gold(F.col("t")).alias("x")).orderBy("i").collect()] == [w for _, w in rows]


@pytest.mark.parametrize("source, want", [("", 0), (None, 0), ("one", 1), ("a\n\nb", 2), ("a\n\n\n", 2), ("a\n \nb\r\nc", 3), ("\n\n", 2), ("  ", 0), ("a\u2028b", 2)])
def test_reasoning_steps(spark, source, want):
    assert spark.range(1).select(text.reasoning_steps(F.lit(source).cast("string")).alias("x")).first().x == want


def test_score_by_task(spark):
    rows = [
        ("1", "math500", r"so \boxed{ 1/2 }", r"\boxed{1/2}", None),
        ("2", "gsm8k", "we get 1000", "x #### 1,000", None),
        ("3", "GPQA_diamond", "Answer: b", None, " B "),
        ("4", None, "no box", r"\boxed{3}", None),
        ("5", "gsm8k", None, "1", None),
        ("6", "gpqa_x", "Answer: A", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, task string, completion string, gold_solution string, gold_letter string")
    out = {r.id: r for r in scoring.score_responses(df).collect()}
    assert [out[str(i)].correct for i in range(1, 7)] == [True, True, True, False, False, False]
    assert out["1"].boxed_answer_present is True and out["2"].boxed_answer_present is None
    assert out["3"].gold_answer == "B" and out["6"].gold_answer is None
    assert out["4"].answer_parse_success is False and out["5"].reasoning_steps == 0


def test_confidence_rules(spark):
    rows = [(0.9, "explicit"), (0.2, None), (0.3, ""), (0.4, "mystery"), (0.5, "answer_parse_success"), (None, "explicit")]
    df = spark.createDataFrame([(i, c, s, True) for i, (c, s) in enumerate(rows)],
                               "i int, confidence double, confidence_source string, answer_parse_success boolean")
    got = lambda proxy: [
        (r.confidence_value, r.confidence_source, r.confidence_valid_for_calibration)
        for r in scoring.resolve_confidence(df, allow_parse_proxy=proxy).orderBy("i").collect()
    ]
    assert got(False) == [(0.9, "explicit", True), (0.2, "explicit", True), (0.3, "explicit", True), (0.4, "mystery", False),
                          (0.5, "answer_parse_success", False), (None, None, False)]
    assert got(True)[5] == (1.0, "answer_parse_success", False)


def test_numbers_of_any_decimal_digits(spark):
    texts = ["उत्तर ४२", "a 1,234.5 b", "-3", "none", "x ١٢٣ y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.last_number(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == ["४२", "1,234.5", "-3", None, "١٢٣"]
