"""Text functions with the meaning that they have in Python, as native column expressions.

Python's regular expressions know Unicode; Java's need (?U).  str.strip() also takes \\x1c-\\x1f.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The characters of SPACE, which are those that str.strip() takes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Lower case, stripped, white space collapsed."""
    return F.regexp_replace(strip(F.lower(text)), rf"(?U){SPACE}+", " ")


def tokens(text: Column) -> Column:
    """The number of words that str.split() finds."""
    return F.size(F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda x: x != ""))


def has(text: Column, part: str | Column) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(text), F.lower(part if isinstance(part, Column) else F.lit(part)))


def preview(text: Column, size: int, one_line: bool = False) -> Column:
    """The first characters, with an ellipsis if there are more."""
    cut = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
    return F.translate(cut, "\n", " ") if one_line else cut


def sub_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression rules, one after the other."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


Test = Callable[..., Column]


def any_of(*parts: str) -> Test:
    """A test that a text has one of these parts (lower case, without s), in any case.  The text in lower case is its second
    argument, so that it is made once for many tests.

    It stands before a costly pattern.  The letters that only fold to i and s pass it, as (?iU) takes them for these.
    """

    def test(text: Column, low: Column | None = None) -> Column:
        low = F.lower(text) if low is None else low
        out = folds(text)
        for part in parts:
            out = out | F.contains(low, F.lit(part))
        return out

    test.parts = parts
    return test


def folds(text: Column) -> Column:
    return F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u017f"))


def like(pattern: str) -> Test:
    return lambda text, low=None: F.regexp_like(text, F.lit(pattern))


def any_test(tests: list[Test]) -> Test:
    """A test that a text passes one of ``tests``, each tried once."""
    parts = sorted({part for test in tests for part in getattr(test, "parts", ())})
    others = list(dict.fromkeys(test for test in tests if not hasattr(test, "parts")))

    def test(text: Column, low: Column | None = None) -> Column:
        out = any_of(*parts)(text, low) if parts else F.lit(False)
        for other in others:
            out = out | other(text, low)
        return out

    return test


def sub_if(text: Column, rules: list[tuple[Test, str, str]], together: int = 8) -> Column:
    """As sub_all(), but the patterns of ``together`` rules in a row are tried only on texts that pass the test of one.

    A text that passes none of them is not changed by the first rule, hence not by the second, and so on.
    """

    def step(group: list[tuple[Test, str, str]]) -> Callable[[Column], Column]:
        test, plain = any_test([t for t, _, _ in group]), [(pattern, new) for _, pattern, new in group]
        return lambda t: bind(F.lower(t), lambda low: F.when(test(t, low), sub_all(t, plain)).otherwise(t))

    for at in range(0, len(rules), together):
        text = bind(text, step(rules[at : at + together]))
    return text
