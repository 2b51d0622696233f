"""Character forms: one base form for width, composition, invisible characters, spaces and dashes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without a visible shape of their own.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"
# White space within a line, and dashes.
SPACES = "\u0009\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\ufe58\ufe63\uff0d"
# Radical code points without a compatibility mapping, and the ideographs they look like.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺈": "刀", "⺉": "刂", "⺋": "巳", "⺌": "小", "⺍": "小",
    "⺒": "巳", "⺓": "幺", "⺗": "心", "⺘": "手", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺟": "母", "⺠": "民",
    "⺡": "氵", "⺢": "水", "⺣": "灬", "⺤": "爪", "⺦": "丬", "⺨": "犬", "⺩": "王", "⺪": "疋", "⺫": "目",
    "⺭": "示", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罒", "⺵": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊",
    "⺹": "老", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⻁": "虎", "⻂": "衣", "⻃": "西", "⻄": "西", "⻅": "见",
    "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "邑",
    "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页",
    "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼",
    "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "齐", "⻬": "齐", "⻭": "歯", "⻮": "齿",
    "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
# Cyrillic and Greek letters that have the shape of a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ı": "i", "ɡ": "g",
}

_FOLD = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {ord(c): "-" for c in DASHES}
_FOLD |= {ord(a): b for a, b in RADICALS.items()} | {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_LOOK = {ord(a): b for a, b in LOOKALIKES.items()}
_LOOK_ODD = re.compile("[" + "".join(LOOKALIKES) + "]")


def base_form_text(text: str | None) -> str | None:
    """Compatibility-composed text without invisible characters, with one kind of space, dash and line break."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _ODD.search(text):
        text = text.translate(_FOLD)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def shape_text(text: str | None) -> str | None:
    """The base form with every look-alike letter folded to Latin, for parsing only."""
    text = base_form_text(text)
    return text.translate(_LOOK) if text and not text.isascii() and _LOOK_ODD.search(text) else text


def base_form(col: Column) -> Column:
    """Column form of :func:`base_form_text`; null stays null, an empty text stays empty."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return pd.Series([base_form_text(t) for t in s], dtype=object)

    return fold(col)
