"""Cleaning of label Markdown as native column expressions.

Patterns are Python's, with (?U) for its Unicode classes and (?d) so that only \\n ends a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import any_of, any_test, bind, like, normalize, strip, sub_all, sub_if

_STREET = "(Road|Street|Avenue|Drive|Way|Rd|St|Ave)"
_DIGIT = like(r"(?dUm)^\s*\d")
# The noise rules, in this order.  m: each line; i: any case.  Before each, a test that its matches pass.
NOISE_RULES = [
    (any_of("/"), r"(?dUm)^\d{1,2}/\d{1,2}/\d{2,4}\s*$", ""),
    (any_of("page"), r"(?dUmi)^Page\s+\d+\s*(of\s+\d+)?\s*$", ""),
    (any_of("page"), r"(?dUi)\d{1,2}/\d{1,2}/\d{2,4}\s*\n\s*Page\s+\d+\s*(of\s+\d+)?", ""),
    (any_of("filename"), r"(?dUmi)^Filename:\s*\S+\.(doc|docx|pdf)\s*$", ""),
    (any_of("draft"), r"(?dUmi)^Draft\s+(pack\s+)?label\s*(leaflet|booklet)?\s*$", ""),
    (any_of("<br>"), r"(?dUi)<br>\s*\*?", " "),
    (any_of("<"), r"(?dUi)</?[a-z]+[^>]*>", ""),
    (any_of("product"), r"(?dUmi)^Product\s+No\.?:\s*$", ""),
    (any_of("batch"), r"(?dUmi)^Batch\s+No\.?:\s*$", ""),
    (any_of("date"), r"(?dUmi)^Date\s+of\s+Manufacture:\s*$", ""),
    (any_of("nra"), r"(?dUmi)^NRA\s+Approval\s+No\.?:\s*\d*/?\d*\s*$", ""),
    (any_of("apvma"), r"(?dUmi)^APVMA\s+Approval\s+No\.?:\s*\d*/?\d*\s*$", ""),
    (any_of("trademark"), r"(?dUmi)^\s*[-*]\s*Registered\s+trademark\s+of\s+[^.\n]+\.?\s*$", ""),
    (any_of("®", "™"), r"(?dUm)^\s*[®™]\s*[^\n]*$", ""),
    (any_of("copyright"), r"(?dUi)\(c\)\s*Copyright[,.]?\s*[^,\n]+,?\s*\d{4}\s*", ""),
    (any_of("copyright"), r"(?dUi)©\s*Copyright[,.]?\s*[^,\n]+,?\s*\d{4}\s*", ""),
    (_DIGIT, rf"(?dUmi)^\d+\s+[\w\s]+\s+{_STREET},?\s+[\w\s]+\s+(NSW|VIC|QLD|SA|WA|TAS|NT|ACT)\s+\d{{4}}\s*$", ""),
    (_DIGIT, rf"(?dUmi)^\d+\s+\d+\s+\w+\s+{_STREET}[^\n]*$", ""),
    (_DIGIT, r"(?dUm)^(\d+)\s*L\s*$", ""),
    (any_of("dangerou"), r"(?dUi)THIS PRODUCT IS NOT CONSIDERED TO BE A DANGEROUS GOOD[S]? UNDER THE AUSTRALIAN\s*\n?CODE FOR THE TRANSPORT OF DANGEROUS GOODS BY ROAD AND RAIL\.?", ""),
    (any_of("emergency only"), r"(?dUi)\*\*FOR SPECIALIST ADVICE IN AN EMERGENCY ONLY\*\*", ""),
    (any_of("toll free"), r"(?dUi)\*\*TOLL FREE - ALL HOURS - AUSTRALIA WIDE\*\*", ""),
    (any_of("cyanamid"), r"(?dUm)^\*\*CYANAMID\*\*\s*$", ""),
    (any_of("cyanamid"), r"(?dUmi)^\d+\s+CYANAMID AGRICULTURE PTY\.?\s*LIMITED\s*$", ""),
    (_DIGIT, r"(?dUm)^\d+\s*$", ""),
    (_DIGIT, r"(?dUm)^\s*\d{1,3}\s+\d{1,3}\s*$", ""),
    (any_of("\n\n\n\n"), r"\n{4,}", "\n\n\n"),
    (like(r"[*_-]{3}"), r"(?dUm)^\s*[\*\-_]{3,}\s*$", ""),
    (any_of("|col"), r"(?dUi)\|Col\d+\|", "|"),
    (any_of("file attachment"), r"(?dUmi)^This section contains file attachment\.\s*$", ""),
]
NOISE = [(pattern, new) for _, pattern, new in NOISE_RULES]
# Headings of sections that go, up to the next bold line (a letter of any case) or the end.
SECTIONS = [
    (any_of("afety direction"), "SAFETY DIRECTIONS:?"), (any_of("t aid"), "FIRST AID:?"), (any_of("torage and"), "STORAGE AND DISPOSAL:?"), (any_of("sds"), "M?SDS:?"), (any_of("warranty"), "WARRANTY:?"),
    (any_of("wildlife"), r"PROTECTION OF WILDLIFE,?\s*FISH,?\s*CRUSTACEA?\s*(AND\s*(THE\s*)?ENVIRONMENT)?:?"),
]
SECTION_IF = [(test, rf"(?dUis)\*?\*?{head}\*?\*?\s*\n.*?(?=\n\*\*[A-Z]|\z)", "") for test, head in SECTIONS]
SECTION_RULES = [(pattern, new) for _, pattern, new in SECTION_IF]
PHONES_IF = [
    (any_of("phone"), r"(?dUi)\*?\*?PHONE\s*[-–]\s*1\s*800\s*\d{3}\s*\d{3}\*?\*?", ""),
    (any_of("contact a doctor"), r"(?dUi)If poisoning occurs,?\s*contact a doctor or Poisons Information Centre[^\n]*", ""),
    (any_of("phone au"), r"(?dUi)Phone Australia 13 11 26[^\n]*", ""),
    (any_of("telephone"), r"(?dUi)Telephone 131126 Australia-wide\.?", ""),
]
PHONES = [(pattern, new) for _, pattern, new in PHONES_IF]
# Boilerplate of which the first occurrence stays.
ONCE_IF = [
    (any_of("keep out of reach"), r"(?dUmi)\*\*KEEP OUT OF REACH OF CHILDREN\*\*\s*\n\s*\*\*READ SAFETY DIRECTIONS BEFORE OPENING OR USING\*\*"),
    (any_of("herbicide"), r"(?dUmi)#\s*\*\*[A-Z][A-Z\s\*]+\*\*\s*\n+\s*\*\*Herbicide\*\*"),
    (any_of("herbicide"), r"(?dUmi)#\s*\*\*GROUP\s+[A-Z]\s+HERBICIDE\*\*"),
    (any_of("active con"), r"(?dUmi)Active Constituent:\s*\d+\s*g/L\s*\*?\*?[A-Z]+\*?\*?"),
    (any_of("read the attached"), r"(?dUmi)\*\*DIRECTIONS FOR USE:\*\*\s*\n\s*\*\*READ THE ATTACHED (LEAFLET|BOOKLET) BEFORE USING THIS PRODUCT\.\*\*"),
]
ONCE = [pattern for _, pattern in ONCE_IF]
PRODUCT_HEADER = r"(?dUi)#\s*\*\*[^*]+\*\*\s*\n\s*\*\*Herbicide\*\*\s*\n\s*Active Constituent:[^\n]+\n[^\n]*\n#?\s*\*\*GROUP\s+[A-Z]\s+HERBICIDE\*\*"
SHORT = 50


def remove_noise(body: Column) -> Column:
    return sub_if(body, NOISE_RULES + SECTION_IF + PHONES_IF)


def frontmatter(content: Column) -> tuple[Column, Column]:
    """The leading block between two ``---`` (with a line end), and the rest."""
    parts = F.split(content, "---", 3)
    has_one = F.startswith(content, F.lit("---")) & (F.size(parts) >= 3)
    return F.when(has_one, F.concat(F.lit("---"), parts[1], F.lit("---\n"))).otherwise(""), F.when(has_one, parts[2]).otherwise(content)


def _behind_first(text: Column, pattern: str, test: Callable[[Column], Column] | None, make: Callable[[Column, Column], Column]) -> Column:
    """``text`` with what ``make`` makes of the first match and the rest behind it; as it is without a match."""

    def cut(t: Column) -> Column:
        def found(first: Column) -> Column:
            end = F.regexp_instr(t, F.lit(pattern)) + F.length(first)
            rebuilt = bind(end, lambda e: F.concat(F.substring(t, F.lit(1), e - 1), make(first, F.substring(t, e, F.length(t)))))
            return F.when(F.coalesce(F.length(first), F.lit(0)) > 0, rebuilt).otherwise(t)

        whole = bind(F.regexp_extract(t, pattern, 0), found)
        return F.when(test(t), whole).otherwise(t) if test else whole

    return bind(text, cut)


def keep_first(text: Column, pattern: str, test: Callable[[Column], Column] | None = None) -> Column:
    """Remove all matches but the first."""
    return _behind_first(text, pattern, test, lambda first, rest: F.regexp_replace(rest, pattern, ""))


def keep_first_equal(text: Column, pattern: str, test: Callable[[Column], Column] | None = None) -> Column:
    """Remove the later matches that equal the first one, but for case and white space at their ends."""

    def make(first: Column, rest: Column) -> Column:
        key = lambda m: strip(F.lower(m))
        pieces = lambda matches: F.transform(F.split(rest, pattern, -1), lambda part, i: F.concat(part, F.coalesce(F.when(key(F.get(matches, i)) != key(first), F.get(matches, i)), F.lit(""))))
        return F.array_join(bind(F.regexp_extract_all(rest, F.lit(pattern), 0), pieces), "")

    return _behind_first(text, pattern, test, make)


def keep_first_blocks(text: Column) -> Column:
    """Of equal paragraphs of 50 characters or more the first stays; paragraphs are put behind blank lines.

    Paragraphs are put in order of (normal form, place), so that equal ones are neighbours; short ones have no normal form.
    """

    def kept(blocks: Column) -> Column:
        keyed = F.array_sort(F.transform(blocks, lambda b, i: F.struct(F.when(F.length(strip(b)) >= SHORT, normalize(b)).alias("k"), i.alias("i"))))
        first = lambda entries: F.filter(entries, lambda e, n: e["k"].isNull() | (n == 0) | ~e["k"].eqNullSafe(F.get(entries, n - 1)["k"]))
        places = F.array_sort(F.transform(bind(keyed, first), lambda e: e["i"]))
        return F.array_join(F.transform(places, lambda i: F.get(blocks, i)), "\n\n")

    return bind(F.split(text, r"\n{2,}", -1), kept)


def keep_first_all(body: Column) -> Column:
    """Boilerplate and product headers once each.  Most texts have none: one look tells."""
    test = any_test([any_of("herbicide"), *(t for t, _ in ONCE_IF)])

    def every(t: Column) -> Column:
        for own, pattern in ONCE_IF:
            t = keep_first(t, pattern, own)
        return keep_first_equal(t, PRODUCT_HEADER, any_of("herbicide"))

    return bind(body, lambda t: F.when(test(t), every(t)).otherwise(t))


def tidy(body: Column) -> Column:
    return strip(sub_all(body, [(r"(?dm)^[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"(?dm)[ \t]+$", "")]))


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with cleaned.  The text goes from step to step as a column, so that no step's expression holds another's
    twice.  Files of few row groups are dealt out first, as patterns take far longer than a shuffle of the texts."""
    front, body = frontmatter(F.col(text))
    out = spread(docs).withColumn("_front", front).withColumn("_body", body)
    for step in (remove_noise, keep_first_all, keep_first_blocks, tidy):
        out = out.withColumn("_body", step(F.col("_body")))
    return out.withColumn("cleaned", F.concat("_front", F.lit("\n"), "_body", F.lit("\n"))).drop("_front", "_body")


SPLIT = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores.  A table of more than a row group's usual size for each core is so by itself, and stays."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT else rows


def reduction(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Characters before and after, and the percentage saved."""
    a, b = F.length(before), F.length(after)
    return a, b, F.when(a > 0, (a - b) / a * 100).otherwise(0.0)


def corpus_reduction(rows: DataFrame, before: str = "text", after: str = "cleaned") -> DataFrame:
    """One row: files, characters before and after, and the percentage saved.  A file without a cleaned text failed."""
    done = F.col(after).isNotNull()
    sums = rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(done).alias("succeeded"), F.sum(F.when(done, F.length(before))).alias("a"), F.sum(F.when(done, F.length(after))).alias("b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return sums.select("files", "succeeded", (F.col("files") - F.col("succeeded")).alias("failed"), a.alias("before"), b.alias("after"), F.when(a > 0, F.round((a - b) / a * 100, 1)).otherwise(0.0).alias("saved"))


def clean_page_text(text: Column) -> Column:
    """At most one blank line; words that a line end hyphenates are joined."""
    return strip(sub_all(text, [(r"\n{3,}", "\n\n"), (r"(?U)(\w)-\n(\w)", "$1$2")]))


def strip_html(html: Column) -> Column:
    """Text of a page, without scripts, styles, comments and tags."""
    rules = [(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), ("&amp;", "&"), (r"[ \t\r\n]+", " ")]
    return F.trim(sub_all(html, rules))
