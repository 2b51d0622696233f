"""Problem 4: quantities recorded in different units.

Every value that a text states for a metric comes out in the metric's common unit. The unit is sought at
the value, in the row, in the unit column, in the clause or in the caption. Where it is missing, a mixture
on the log scale, whose components are offset by the known conversion factors, assigns it by posterior and
flags what stays uncertain.
"""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import shape_text
from ..session import written

# Units of each dimension and how many common units they are.
UNITS = {
    "money": {
        "元": 1, "千元": 10**3, "万元": 10**4, "十万元": 10**5, "百万元": 10**6, "千万元": 10**7, "亿元": 10**8, "万亿元": 10**12,
        "人民币元": 1, "RMB": 1, "CNY": 1, "yuan": 1, "thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "mn": 10**6, "billion": 10**9, "bn": 10**9,
        "亿": 10**8, "万": 10**4, "百万": 10**6, "千": 10**3,
    },
    "mass": {
        "千克": 1, "公斤": 1, "kg": 1, "kilograms": 1, "斤": Decimal("0.5"), "克": Decimal("0.001"), "g": Decimal("0.001"), "吨": 10**3, "t": 10**3, "tonnes": 10**3, "tonne": 10**3, "tons": 10**3,
        "千吨": 10**6, "kt": 10**6, "万吨": 10**7, "百万吨": 10**9, "million tonnes": 10**9, "thousand tonnes": 10**6, "亿吨": 10**11, "Mt": 10**9, "million kg": 10**6,
    },
    "power": {
        "千瓦时": 1, "度": 1, "kWh": 1, "MWh": 10**3, "兆瓦时": 10**3, "GWh": 10**6, "吉瓦时": 10**6, "TWh": 10**9, "万千瓦时": 10**4, "万度": 10**4,
        "亿千瓦时": 10**8, "亿度": 10**8, "million kWh": 10**6, "thousand kWh": 10**3, "billion kWh": 10**9,
    },
    "area": {
        "平方米": 1, "m2": 1, "square metres": 1, "square meters": 1, "sq m": 1, "sqm": 1, "公顷": 10**4, "hectares": 10**4, "hectare": 10**4, "ha": 10**4,
        "平方公里": 10**6, "平方千米": 10**6, "km2": 10**6, "square kilometres": 10**6, "万平方米": 10**4, "million m2": 10**6, "thousand m2": 10**3, "亩": Decimal(2000) / 3, "万亩": Decimal(20000000) / 3,
    },
    "volume": {
        "立方米": 1, "m3": 1, "cubic metres": 1, "cubic meters": 1, "方": 1, "千立方米": 10**3, "万立方米": 10**4, "亿立方米": 10**8, "百万立方米": 10**6,
        "million m3": 10**6, "million cubic metres": 10**6, "thousand m3": 10**3, "thousand cubic metres": 10**3, "升": Decimal("0.001"), "billion m3": 10**9, "ML": 10**3,
    },
    "people": {
        "人": 1, "名": 1, "位": 1, "people": 1, "persons": 1, "employees": 1, "staff": 1, "千人": 10**3, "万人": 10**4, "万名": 10**4, "百人": 100, "thousand": 10**3,
        "thousand people": 10**3, "thousand employees": 10**3, "thousand persons": 10**3,
    },
}
# Chinese numerals.
DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
TENS = {"十": 10, "百": 100, "千": 1000}

_NUM = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_HAN = r"[零〇一二两三四五六七八九十百千]+"
_CURRENCY = r"(?:人民币|RMB|CNY|¥|￥|Rmb)\s*"


def han_number(text: str) -> int:
    """Value of a Chinese numeral below 10,000."""
    total, digit = 0, 0
    for c in text:
        if c in TENS:
            total, digit = total + (digit or 1) * TENS[c], 0
        else:
            digit = DIGITS[c]
    return total + digit


def _unit_pattern(dimension: str) -> str:
    names = sorted((u for u in UNITS[dimension] if u not in ("RMB", "CNY")), key=len, reverse=True)
    return "|".join(re.escape(u) + (r"(?![A-Za-z0-9])" if u[-1].isascii() and u[-1].isalnum() else "") for u in names)


class Grammar:
    """Patterns of one dimension."""

    def __init__(self, dimension: str):
        self.dimension = dimension
        self.units = {u.lower(): Decimal(f) for u, f in UNITS[dimension].items()}
        unit = _unit_pattern(dimension)
        composite = rf"(?P<yi>{_NUM}|{_HAN})\s*亿\s*(?:零)?(?P<wan>{_NUM}|{_HAN})\s*万(?=[元千度平立吨人名]|$)" if dimension == "money" else r"(?P<yi>(?!))(?P<wan>(?!))"
        self.value = re.compile(
            rf"(?P<cur>{_CURRENCY})?(?P<open>\()?(?P<minus>-\s?|负)?(?:{_CURRENCY})?(?:{composite}(?:元)?|(?P<han>{_HAN})\s*(?P<hanunit>亿元|万元|百万元|千元|元|万人|人|名|吨|亿|万)|(?P<num>{_NUM}))(?P<close>\))?\s?(?P<unit>{unit})?(?P<after>\s*(?:%|个百分点|pct|percent))?",
            re.I,
        )
        self.label = re.compile(rf"^\s*[（(,/、:\[]?\s*(?:单位[:：]?\s*)?(?:人民币|RMB\s*|CNY\s*)?(?P<unit>{unit})\s*[)）\]]?\s*$", re.I)

        self.caption = re.compile(rf"(?:计量单位为?|单位|\bunits?)\s*[:：为]?\s*(?P<unit>{unit})(?=\s*(?:[)）\]】、,，;；/。]|$))", re.I)

    def amount(self, m: re.Match, unit: str | None = None) -> tuple[Decimal, str | None]:
        """(number in the stated unit, that unit's name or None)."""
        g = m.groupdict()
        if g["yi"]:
            a, b = (Decimal(x.replace(",", "")) if x[0].isdigit() else Decimal(han_number(x)) for x in (g["yi"], g["wan"]))
            value, unit = a * 10**8 + b * 10**4, "元"
        elif g["han"]:
            value, unit = Decimal(han_number(g["han"])), g["hanunit"]
        else:
            value = Decimal(g["num"].replace(",", ""))
            unit = g["unit"] or unit or ("元" if g["cur"] and self.dimension == "money" else None)
        negative = bool(g["minus"]) or bool(g["open"] and g["close"])
        return (-value if negative else value), unit


_GRAMMARS = {d: Grammar(d) for d in UNITS}
_HAN_LONG = re.compile(rf"({_HAN})亿(?:零)?({_HAN})万元")
_FILL = re.compile(
    r"(?:\s*\([^()\d]{0,20}\))?\s*(?:的|为|是|约为|约|合计为|合计|共计|共|计|达到|达|总计|由|实现|录得|:|=|of|was|were|is|reached|amounted to|totalled|totaled|stood at|came to|at|about|approximately|from)*\s*",
    re.I,
)
_NEXT = re.compile(r"\s*(?:变动至|变动到|增至|增加至|降至|减少至|上升至|下降至|调整至|变为|\((?:上年同期|上年|上期|去年同期|期初|本期|同期)(?:为)?[:：]?|,?\s*(?:compared with|compared to|against|versus|up from|down from|from|to)|[,，]\s*上年(?:同期)?(?:为)?)\s*", re.I)
_CLAUSE_UNIT = re.compile(r"(?:按|以|均以|单位[:：为]?|in)\s*(?:人民币)?\s*(?P<unit>百万元|千万元|万元|千元|亿元|元|thousands? of (?:RMB|CNY)|millions? of (?:RMB|CNY)|billions? of (?:RMB|CNY)|(?:RMB|CNY) (?:thousand|million|billion))\s*(?:列示|计|填报|表示|为单位|口径)?", re.I)
_MONEY_CAPTION = re.compile(
    r"(?:单位[:：为]?\s*(?:人民币)?\s*|计量单位为\s*(?:人民币)?|按\s*(?:人民币)?|以\s*人民币|以\s*|^\s*\(\s*(?:人民币)?|金额单位[:：]?\s*(?:人民币)?)(?P<zh>百万元|千万元|万元|千元|亿元|元)"
    r"|(?P<en>(?:RMB|CNY)\s+(?:thousand|million|billion)s?|(?:thousand|million|billion)s?\s+of\s+(?:RMB|CNY)|Unit:\s*(?:RMB|CNY)(?:\s+(?:thousand|million|billion))?|RMB'000|\(RMB\)|in RMB)",
    re.I,
)
# Headings of columns that hold no amounts, and of the unit column.
_SKIP_COLUMN = re.compile(r"附注|注释|note|增减|变动|同比|change|%|比例|growth|占比", re.I)
_UNIT_COLUMN = re.compile(r"^(?:计量)?单位$|^units?$", re.I)
_SENTENCE = re.compile(r"[。!?\n]|(?<=[A-Za-z0-9%)])\.(?=\s|$)")


def _caption_unit(text: str) -> str | None:
    found = None
    for m in _MONEY_CAPTION.finditer(text):
        if m["zh"]:
            found = m["zh"]
        else:
            low = m["en"].lower()
            found = next((u for u in ("thousand", "million", "billion") if u in low), "thousand" if "000" in low else "元")
    return found


def _captions(text: str) -> dict[str, str]:
    """The unit of each dimension that a line announces for the tables below it."""
    found = {d: m["unit"] for d, g in _GRAMMARS.items() if d != "money" and (m := g.caption.search(text))}
    money = _caption_unit(text)
    return found | {"money": money} if money else found


def _en_unit(text: str) -> str:
    low = text.lower()
    return next((u for u in ("thousand", "million", "billion") if u in low), text)


class Extractor:
    """(metric number, number as stated, unit or None, decimals, 1 if named in English) of every value in a text."""

    def __init__(self, metrics: list[tuple[str, str, str]]):
        """metrics: (metric_name, metric_name_en, dimension)."""
        self.dims = [d if d in UNITS else None for _, _, d in metrics]
        self.names: dict[str, int] = {}
        for i, (zh, en, _) in enumerate(metrics):
            for name in (zh, en):
                if name and name.strip():
                    self.names.setdefault(shape_text(name).strip().lower(), i)
        every = sorted(self.names, key=len, reverse=True)
        self.find = re.compile("|".join(re.escape(x) for x in every) or r"(?!)", re.I)

    def values(self, text: str):
        text = shape_text(text) or ""
        if not self.find.search(text):
            return
        lines = text.split("\n")
        caption, header = {}, None
        for line in lines:
            bare = line.strip()
            if bare.startswith("|"):
                cells = [c.strip() for c in bare.strip("|").split("|")]
                if header is None:
                    header = cells
                    continue
                if set(bare) <= set("|-: "):
                    continue
                yield from self._row(header, cells, caption)
                continue
            header = None
            if bare:
                caption |= _captions(bare)
                yield from self._prose(line)

    def _row(self, header, cells, caption):
        m = self.find.match(cells[0]) if cells else None
        if not m:
            return
        i = self.names[m[0].lower()]
        if self.dims[i] is None:
            return
        g = _GRAMMARS[self.dims[i]]
        rest, unit = cells[0][m.end() :], None
        if rest.strip():
            label = g.label.match(rest)
            if not label:
                if not re.match(r"^\s*\([^()]*\)\s*$|^\s*[:：]?$", rest):
                    return
            else:
                unit = label["unit"]
        column = next((k for k, h in enumerate(header) if _UNIT_COLUMN.match(h.replace(" ", ""))), None)
        if unit is None and column is not None and column < len(cells):
            label = g.label.match(cells[column])
            unit = label["unit"] if label else None
        unit = unit or caption.get(g.dimension)
        for k in range(1, len(cells)):
            if k == column or (k < len(header) and _SKIP_COLUMN.search(header[k])):
                continue
            v = g.value.fullmatch(cells[k])
            if v and not v["after"]:
                number, own = g.amount(v, unit)
                yield i, number, own, _decimals(v), int(m[0].isascii())

    def _prose(self, line):
        for clause in _SENTENCE.split(line):
            hits = list(self.find.finditer(clause))
            if not hits:
                continue
            unit_of = _CLAUSE_UNIT.search(clause[: hits[0].start()])
            for n, m in enumerate(hits):
                i = self.names[m[0].lower()]
                if self.dims[i] is None:
                    continue
                g = _GRAMMARS[self.dims[i]]
                end = hits[n + 1].start() if n + 1 < len(hits) else len(clause)
                shared = _en_unit(unit_of["unit"]) if unit_of and g.dimension == "money" else None
                at = _FILL.match(clause, m.end(), end).end()
                while True:
                    v = g.value.match(clause, at, end)
                    if not v or v["after"] or (v["unit"] is None and v["num"] and re.match(r"\s*(?:年|月|日|次|项|家|个|%)", clause[v.end() : v.end() + 3])):
                        break
                    number, own = g.amount(v, shared)
                    yield i, number, own, _decimals(v), int(m[0].isascii())
                    step = _NEXT.match(clause, v.end(), end)
                    if not step:
                        break
                    at = step.end()


def _decimals(v: re.Match) -> int:
    return len(v["num"].partition(".")[2]) if v["num"] else 0


#: Metrics at most; more raise an error.
MOST_METRICS = 10_000
_RAW = "metric int, number string, unit string, decimals int, style int"


def stated_values(chunks: DataFrame, metrics: DataFrame, id_col: str = "chunk_no", text_col: str = "content") -> DataFrame:
    """``id_col``, ``metric_code``, ``dimension``, ``number`` (as stated), ``unit`` or null, ``decimals``, ``style`` (1: named in English): one row a stated value."""
    rows = [tuple(r) for r in metrics.select("metric_code", "metric_name", "metric_name_en", "dimension").orderBy("metric_code").limit(MOST_METRICS + 1).collect()]
    if len(rows) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics")
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast([(a or "", b or "", d or "") for _, a, b, d in rows])

    def run(batches):
        extract = Extractor(shared.value)
        for pdf in batches:
            out = [(key, *v) for key, text in zip(pdf.id, pdf.text) for v in extract.values(text)]
            if out:
                yield pd.DataFrame({"id": [x[0] for x in out], "metric": [x[1] for x in out], "number": [str(x[2]) for x in out], "unit": [x[3] for x in out], "decimals": [x[4] for x in out], "style": [x[5] for x in out]})

    found = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id long, {_RAW}")
    names = spark.createDataFrame([(i, r[0], r[3]) for i, r in enumerate(rows)], "metric int, metric_code string, dimension string")
    return found.join(F.broadcast(names), "metric").select(F.col("id").alias(id_col), "metric_code", "dimension", "number", "unit", "decimals", "style")


#: Rounds in which the weights of the units are fitted.
ROUNDS = 6


def _factor_rows(spark) -> DataFrame:
    """``dimension``, ``u`` (the unit in lower case), ``factor``: a fixed table."""
    return spark.createDataFrame([(d, u, float(f)) for d, g in _GRAMMARS.items() for u, f in g.units.items()], "dimension string, u string, factor double")


def assign_units(values: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, ``dimension``, ``style``, ``guess`` (a factor), ``posterior``: one row a text and dimension with values without a unit.

    Each metric's known values give its distribution on the log scale of the common unit; a component is
    that distribution offset by a known factor, with the factor's habits in decimals. Values of one text
    share their unit. The weights of the factors come from expectation-maximization. A metric without known
    values takes the distribution of its dimension; a language without stated units the habits of the other.
    """
    spark = values.sparkSession
    factors = F.broadcast(_factor_rows(spark))
    size = F.abs(F.col("number").cast("double"))
    rows = values.where(size > 0).select(id_col, "metric_code", "dimension", "style", F.lower("unit").alias("u"), F.least("decimals", F.lit(5)).alias("decimals"), F.log10(size).alias("x"))
    known = rows.where("u is not null").join(factors, ["dimension", "u"])
    y, least = F.col("x") + F.log10("factor"), F.lit(0.3)
    moments = [F.avg(y).alias("mean"), F.greatest(least, F.coalesce(F.stddev_pop(y), least)).alias("sd")]
    spread, pooled = known.groupBy("metric_code").agg(*moments), known.groupBy("dimension").agg(*moments).toDF("dimension", "any_mean", "any_sd")
    # a row a dimension, style, factor and number of decimals: of bounded number
    habits = known.groupBy("dimension", "style", "factor", "decimals").agg(F.count("*").alias("n")).toPandas()
    table, weights = [], {}
    for d, every in habits.groupby("dimension"):
        for style in (0, 1):
            part = every[every["style"] == style]
            part = part if len(part) else every  # units stated in the other language only
            for f, own in part.groupby("factor"):
                share = own.groupby("decimals").n.sum().reindex(range(6), fill_value=0).to_numpy() + 0.5
                share = np.log(share / share.sum())
                weights[d, style, float(f)] = own.n.sum() / part.n.sum()
                table += [(d, style, float(f), k, float(share[k])) for k in range(6)]
    if not table:
        return spark.createDataFrame([], f"{id_col} long, dimension string, style int, guess double, posterior double")
    table = F.broadcast(spark.createDataFrame(table, "dimension string, style int, factor double, decimals int, habit double"))
    # the rows of a text meet once; the broadcast joins, both sums and all rounds keep that partitioning
    key = [id_col, "dimension", "style"]
    open_ = rows.where("u is null").repartition(*key).join(F.broadcast(spread), "metric_code", "left").join(F.broadcast(pooled), "dimension")
    mean, sd = F.coalesce("mean", "any_mean"), F.coalesce("sd", "any_sd")
    z = (F.col("x") + F.log10("factor") - mean) / sd
    like = F.greatest(F.lit(-12.0), F.col("habit") - z * z / 2 - F.log(sd))
    open_ = open_.join(table, ["dimension", "style", "decimals"]).groupBy(*key, "factor").agg(F.sum(like).alias("like"))
    open_ = written(open_.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("factor", "like"))).alias("likes")), "likelihoods")  # a group has all factors of its dimension and style
    for i in range(ROUNDS):
        now = {}
        for (d, style, _), v in sorted(weights.items()):
            now.setdefault((d, style), []).append(math.log(max(v, 1e-6)))
        now = F.broadcast(spark.createDataFrame([(*k, v) for k, v in now.items()], "dimension string, style int, weight array<double>"))
        post = open_.join(now, ["dimension", "style"]).withColumn("s", F.zip_with("likes", "weight", lambda a, w: a["like"] + w))
        post = post.withColumn("e", F.transform("s", lambda v: F.exp(v - F.array_max("s")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
        post = post.withColumn("post", F.zip_with("likes", "e", lambda a, v: F.struct((v / F.col("total")).alias("posterior"), a["factor"].alias("factor"))))
        if i + 1 < ROUNDS:
            sums = post.select("dimension", "style", F.inline("post")).groupBy("dimension", "style", "factor").agg(F.sum("posterior").alias("n")).collect()  # a row a factor
            for r in sums:
                total = sum(x.n for x in sums if (x.dimension, x.style) == (r.dimension, r.style))
                weights[r.dimension, r.style, r.factor] = 0.5 * weights[r.dimension, r.style, r.factor] + 0.5 * r.n / total
    best = F.array_max("post")
    return post.select(*key, best["factor"].alias("guess"), best["posterior"].alias("posterior"))


def common_amounts(chunks: DataFrame, metrics: DataFrame, id_col: str = "chunk_no", text_col: str = "content", sure: float = 0.8) -> DataFrame:
    """Every stated value in its common unit: ``id_col``, ``metric_code``, ``number``, ``unit``, ``amount``, ``posterior``, ``uncertain``.

    ``amount`` is a BIGINT rounded half away from zero. ``posterior`` is 1 where the unit is stated, and
    where not that of the mixture; below ``sure`` the row is flagged. 0 is 0 in any unit. Another value whose
    unit is missing in a dimension without any stated unit has a null amount. Null and empty texts have no rows.
    """
    values = written(stated_values(chunks, metrics, id_col, text_col), "values")
    guess = assign_units(values, id_col)

    @F.pandas_udf("long")
    def convert(number: pd.Series, unit: pd.Series, dimension: pd.Series, guess: pd.Series) -> pd.Series:
        out = []
        for a, u, d, g in zip(number, unit, dimension, guess):
            f = _GRAMMARS[d].units.get(u.lower()) if u is not None else Decimal(g) if g is not None and g == g else None
            f = Decimal(1) if f is None and not Decimal(a) else f
            v = None if f is None else (Decimal(a) * f).quantize(Decimal(1), ROUND_HALF_UP)
            out.append(int(v) if v is not None and abs(v) < 1 << 62 else None)
        return pd.Series(out, dtype="Int64")

    rows = values.join(guess, [id_col, "dimension", "style"], "left")
    post = F.when(F.col("unit").isNotNull() | (F.col("number").cast("double") == 0), 1.0).otherwise(F.col("posterior"))
    return rows.select(
        id_col, "metric_code", "number", "unit", F.when(F.col("unit").isNull(), F.col("guess")).alias("assigned_factor"),
        convert("number", "unit", "dimension", "guess").alias("amount"), post.alias("posterior"), (F.coalesce(post, F.lit(0.0)) < sure).alias("uncertain"),
    )
