"""Answer extraction from response text, as Column -> Column functions.

Everything runs in the JVM except one residue: a box whose braces nest deeper than
``NESTING`` levels, whose last box is unclosed, or whose token is not followed by a
brace.  Only those texts travel to an Arrow UDF; every other row sends it a NULL.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOXED = "\\boxed"
FBOX = "\\fbox"
NESTING = 5

# Fixed value: the characters that count as Unicode whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{WHITESPACE}]"
NON_SPACE = f"[^{WHITESPACE}]"
# Characters besides the line feed that end a line, and one more that only counts as space.
RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
RARE_ENDS = RARE_LINE_ENDS + "\x1f"
# What counts as a number (any decimal digits) and as a final-answer line.
NUMBER = r"-?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"
FINAL_LINE = r"(?isd)final answer is:\s*(.+?)(?:\.\s*I hope it is correct|\.\s*$|\s*$)"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends; a plain ``trim`` only removes spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def repair_markers(text: Column) -> Column:
    """Turn leaked tokenizer markers back into a space and a line break."""
    return F.replace(F.replace(text, F.lit("Ġ"), F.lit(" ")), F.lit("Ċ"), F.lit("\n"))


def _nested_braces(depth: int) -> str:
    body = r"[^{}]*+"
    for _ in range(depth):
        body = r"[^{}]*+(?:\{" + body + r"\}[^{}]*+)*+"
    return body


# Possessive and of fixed depth: linear, and no recursion on long texts.
_CLOSED_BOX = r"(?s)\A\{" + _nested_braces(NESTING) + r"\}"
_TOKENS = re.compile(r"[{}]|\\boxed|\\fbox")
_FINAL_LINE_PY = re.compile(FINAL_LINE.replace("(?isd)", "(?is)"))


def last_box(text: str) -> tuple[bool, str | None]:
    """(a box span exists, its content) for the last usable box, in one pass over the braces.

    A stack pairs the braces.  A candidate is usable when the first brace after it opens and
    is closed, or when a space follows it; later candidates win.
    """
    boxes, closes, brackets, open_at = [], {}, [], []
    for m in _TOKENS.finditer(text):
        token, at = m.group(), m.start()
        if token == "{":
            open_at.append(at)
            brackets.append((at, True))
        elif token == "}":
            if open_at:
                closes[open_at.pop()] = at
            brackets.append((at, False))
        else:
            boxes.append((at, m.end(), token, len(brackets)))
    for at, end, token, next_bracket in reversed(boxes):
        if token == BOXED and text.startswith(" ", end):
            inner = text[end:].split("$", 1)[0].strip()
            return True, inner or None
        if next_bracket == len(brackets):
            continue
        brace, opens = brackets[next_bracket]
        if not opens or brace not in closes:
            continue
        # A brace that does not follow the token directly ends the search without a value.
        return True, text[end + 1 : closes[brace]].strip() if brace == end else None
    return False, None


def boxed_or_final_line(text: str) -> str | None:
    found, value = last_box(text)
    if found:
        return value
    line = _FINAL_LINE_PY.search(text)
    if line is None:
        return None
    tail = line.group(1).strip()
    found, value = last_box(tail)
    if found:
        return value
    return tail.strip("$").strip() or None


@F.pandas_udf(T.StringType())
def _boxed_residue(texts: pd.Series) -> pd.Series:
    return texts.map(boxed_or_final_line, na_action="ignore")


def final_answer_line(text: Column) -> Column:
    """The value of a "final answer is: X" line, or NULL."""
    tail = strip(F.regexp_extract(text, FINAL_LINE, 1))
    bare = strip(F.regexp_replace(tail, r"^\$++|\$++$", ""))
    return F.nullif(bare, F.lit(""))


def with_boxed(df: DataFrame, texts: dict[str, Column], *, consume: bool = False) -> DataFrame:
    """Add, per output name, the last boxed answer of a text, else its final-answer line.

    The texts are already repaired.  The decision is made on the text after the last box token,
    which is short, so the whole text is read by plain substring search only.  ``consume`` drops
    the source columns before rows meet the UDF.  The stages are
    separate projections; as one expression the shared parts would be generated many times.
    """
    stages: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for name, source in texts.items():
        text, tail, spaced, hit, box = (F.col(f"_{name}_{p}") for p in ("text", "tail", "spaced", "hit", "box"))
        after_boxed = F.substring_index(text, BOXED, -1)
        after_fbox = F.substring_index(text, FBOX, -1)
        boxed_last = F.length(after_boxed) < F.length(after_fbox)
        stages[0][f"_{name}_text"] = source
        # Without a token substring_index returns the whole text, the longest possible tail.
        stages[1][f"_{name}_box"] = text.contains(BOXED) | text.contains(FBOX)
        stages[1][f"_{name}_tail"] = F.when(boxed_last, after_boxed).otherwise(after_fbox)
        stages[1][f"_{name}_spaced"] = boxed_last & after_boxed.startswith(" ")
        stages[2][f"_{name}_hit"] = F.when(box & tail.startswith("{"), F.regexp_extract(tail, _CLOSED_BOX, 0))
        found = F.coalesce(hit, F.lit("")) != ""
        # NULL for rows settled here: the UDF sees nothing of them.
        stages[3][f"_{name}_residue"] = F.when(box & ~spaced & ~found, text)
        stages[3][f"_{name}_settled"] = (
            F.when(~box, final_answer_line(text))
            .when(spaced, F.nullif(strip(F.substring_index(tail, "$", 1)), F.lit("")))
            .when(found, strip(F.substring(hit, F.lit(2), F.length(hit) - 2)))
        )
        stages[4][name] = F.coalesce(F.col(f"_{name}_settled"), _boxed_residue(F.col(f"_{name}_residue")))
    for stage in stages[:4]:
        df = df.withColumns(stage)
    parts = ("text", "tail", "spaced", "hit", "box", "settled", "residue")
    # The working copies of the texts end before the Arrow boundary.
    if consume:
        df = df.drop(*texts.values())
    df = df.drop(*[f"_{n}_{p}" for n in texts for p in parts[:5]]).withColumns(stages[4])
    return df.drop(*[f"_{n}_{p}" for n in texts for p in parts[5:]])


def normalize_answer(answer: Column) -> Column:
    """Comparable form of a math answer; NULL becomes '' (P5)."""
    text = repair_markers(F.coalesce(answer, F.lit("")))
    text = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit("\\,"), F.lit(""))
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def choice_letter(text: Column) -> Column:
    """Letter of an "Answer: X" line, else the last standalone A-D of the last 200 characters."""
    line = F.regexp_extract(text, r"(?iU)Answer:\s*\$?([A-D])\$?", 1)
    lone = F.regexp_extract(F.right(text, F.lit(200)), r"(?sU)^.*\b([A-Da-d])\b", 1)
    return F.upper(F.coalesce(F.nullif(line, F.lit("")), F.nullif(lone, F.lit(""))))


def normalize_letter(letter: Column) -> Column:
    return F.upper(strip(F.coalesce(letter, F.lit(""))))


def last_number(text: Column) -> Column:
    """Last number in the text.

    Numbers use only decimal digits and ``, . -``; so the last one lies in the last run of
    those characters that holds a digit, and only that short run is searched for numbers.
    """
    run = F.regexp_extract(text, r"(?s)^(?:.*[^\p{Nd},.\-])?([\p{Nd},.\-]*\p{Nd})", 1)
    return F.try_element_at(F.regexp_extract_all(run, F.lit(f"({NUMBER})"), 1), F.lit(-1))


def numeric_gold(text: Column) -> Column:
    """Gold number: what follows the last '####', else the last number."""
    return F.when(text.contains("####"), strip(F.substring_index(text, "####", -1))).otherwise(
        last_number(text)
    )


def numeric_answer(text: Column, boxed: Column) -> Column:
    """Predicted number: the boxed answer, else the last number."""
    return F.coalesce(F.nullif(boxed, F.lit("")), last_number(text))


def reasoning_steps(text: Column) -> Column:
    """Paragraph count when there is more than one, else the number of non-blank lines.

    Texts without rare line ends, found by substring search, take a pattern with small character
    classes, several times faster than the general one.
    """
    squeezed = F.octet_length(F.replace(text, F.lit("\n\n"), F.lit("")))
    breaks = ((F.octet_length(text) - squeezed) / 2).cast("int")
    rare = F.lit(False)
    for end in RARE_ENDS:
        rare = rare | text.contains(end)
    lines = F.when(rare, F.regexp_count(text, F.lit(f"{NON_SPACE}[^\n{RARE_LINE_ENDS}]*"))).otherwise(
        F.regexp_count(text, F.lit(r"(?U)\S[^\n]*"))
    )
    steps = F.when(breaks > 0, breaks + 1).otherwise(lines)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(steps).cast("int")


# Tasks receive these functions by value; workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
