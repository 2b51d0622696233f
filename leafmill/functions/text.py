"""Text rules of report parsing and chunking, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the reports' rules, where \s, \S and \d are those of Unicode.
NUMERAL = "一二三四五六七八九十"
LEVELS = [
    r"^第[一二三四五六七八九十百\d]+节\s*\S+",
    r"^[一二三四五六七八九十]+[、.．]\s*\S+",
    r"^[（(][一二三四五六七八九十]+[）)]\s*\S+",
    r"^\d+[、.．]\s*\S+",
    r"^[（(]\d+[）)]\s*\S+",
]
PAGE_NUMBER = r"^\s*(?:第\s*)?\d+\s*(?:页)?(?:\s*/\s*\d+)?\s*$"
YEAR = r"20\d{2}"
STOCK_CODE = r"(?:股票|证券|A股)\s*(?:代码|简称)?\s*[:：]?\s*([03668]\d{5})"
UNIT_NOTE = [r"单位[:：]", r"币种[:：]", r"金额单位", r"货币单位", r"人民币", r"元\s*$", r"万元\s*$", r"千元\s*$"]
END_MARKS = r"[。；;，,]$"
TOC_SECTION = r"第[一二三四五六七八九十百\d]+节"
TOC_DOTTED = r"\.{2,}|…{2,}|·{2,}|\s{3,}\d+\s*$"
YEAR_RANGE = r"(20\d{2})\s*年?\s*(?:到|至|~|～|-|—|－)\s*(20\d{2})\s*年?"
#: White space, other characters and line ends of Unicode as classes of the engine's patterns.
WS, NO_WS, LINE_END = r"[\s\x1c-\x1f\x{85}\p{Z}]", r"[^\s\x1c-\x1f\x{85}\p{Z}]", r"[\n\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def unicode_pattern(pattern: str) -> str:
    """A pattern whose ``\\s``, ``\\S`` and ``\\d`` mean Unicode, for an engine where they mean ASCII."""
    return pattern.replace(r"\s", WS).replace(r"\S", NO_WS).replace(r"\d", r"\p{Nd}")


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def normalize_text(c: Column) -> Column:
    """Runs of blanks to one space, three or more line breaks to two, then stripped; null gives an empty text."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def compact_text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), WS, "")


def safe_filename(c: Column) -> Column:
    """A part of a file name; nothing left gives ``unknown``."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]+', "_")
    return F.coalesce(F.nullif(F.regexp_replace(c, "^[_ ]+|[_ ]+$", ""), F.lit("")), F.lit("unknown"))


def company_from_filename(c: Column) -> Column:
    """The company part of a report's file name."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    before = unicode_pattern(r"^(.+?)(?:20\d{2}|年报|年度报告)")
    return (
        F.when(stem.contains("："), strip(F.substring_index(stem, "：", 1)))
        .when(stem.contains(":"), strip(F.substring_index(stem, ":", 1)))
        .when(stem.rlike(before), F.regexp_replace(F.regexp_extract(stem, before, 1), "^[_ -]+|[_ -]+$", ""))
        .otherwise(stem)
    )


def title_level(c: Column) -> Column:
    """Level 1 to 5 of a heading by its numbering, otherwise 6."""
    out = F.lit(6)
    for level in range(5, 0, -1):
        out = F.when(c.rlike(unicode_pattern(LEVELS[level - 1])), level).otherwise(out)
    return out.cast("long")


def is_page_number(c: Column) -> Column:
    return compact_text(c).rlike(unicode_pattern(PAGE_NUMBER))


def is_unit_note(c: Column) -> Column:
    t = normalize_text(c)
    return (F.length(t) <= 120) & t.rlike(unicode_pattern("|".join(UNIT_NOTE)))


def is_short_title(c: Column) -> Column:
    t = normalize_text(c)
    return (t != "") & (F.length(t) <= 60) & ~t.contains("适用") & ~t.rlike(END_MARKS) & ~(t.contains("\n") & (F.length(t) > 35))


def lines_of(c: Column) -> Column:
    """The lines of a normalised text, stripped, without blank ones."""
    return F.filter(F.transform(F.split(normalize_text(c), LINE_END, -1), strip), lambda x: x != "")


def markdown_columns(c: Column) -> Column:
    """Cells of the first table row; an escaped bar counts as a separator; 0 without a table."""
    row = F.try_element_at(F.filter(lines_of(c), lambda x: x.startswith("|")), F.lit(1))
    return F.coalesce(F.size(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|", -1)), F.lit(0)).cast("long")


def toc_marks(c: Column) -> tuple[Column, Column, Column]:
    """(lines that name a section, dotted lines, whether the text looks like a table of contents)."""
    lines = lines_of(c)
    sections = F.size(F.filter(lines, lambda x: x.rlike(unicode_pattern(TOC_SECTION))))
    dotted = F.size(F.filter(lines, lambda x: x.rlike(unicode_pattern(TOC_DOTTED))))
    named = F.substring(normalize_text(c), 1, 200).contains("目录")
    return sections, dotted, (named & ((sections >= 2) | (dotted >= 3))) | ((sections >= 4) & (dotted >= 2))


def page_label(a: Column, b: Column) -> Column:
    """``-`` without pages, ``a`` or ``a-b``."""
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return F.when((a == 0) & (b == 0), "-").when((a == b) | (b == 0), a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))


def bigrams(c: Column) -> Column:
    """Tokens: overlapping pairs of ideographs, Latin words and numbers, in lower case, with repeats."""
    t = F.lower(F.coalesce(c, F.lit("")))
    shifted = F.regexp_replace(t, r"(^|[^一-鿿])[一-鿿]", "$1 ")
    return F.concat(F.regexp_extract_all(t, F.lit(r"[一-鿿]{2}|[a-z]+|[0-9]+"), 0), F.regexp_extract_all(shifted, F.lit(r"[一-鿿]{2}"), 0))


def years_in(question: Column) -> Column:
    """Years of a question: a range of at most ten years is filled, otherwise the distinct years in order."""
    ends = unicode_pattern(YEAR_RANGE)
    a, b = (F.regexp_extract(question, ends, k) for k in (1, 2))
    lo, hi = F.least(a, b).try_cast("int"), F.greatest(a, b).try_cast("int")
    span = F.transform(F.sequence(lo, hi), lambda y: y.cast("string"))
    every = F.array_sort(F.array_distinct(F.regexp_extract_all(question, F.lit(r"20\d{2}"), 0)))
    return F.when((a != "") & (hi - lo <= 10), span).otherwise(every)
