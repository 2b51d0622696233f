"""Problem 5: one consistent form for visually identical text.

Every text gets the base form (width, composition, invisible characters, spaces, dashes). Then look-alike
letters are repaired script-aware. The dominant script of a token (a run of letters) is that of its genuine
letters, those without a look-alike in the token's other script; without any, that of the text's genuine
letters, Latin if there are none. Only letters of a mixed token are replaced, in either direction, and only
if the result stands in the corpus as a token of that one script. One extension goes beyond mixed tokens: a
token wholly of look-alikes, in a text without a genuine letter of their script, is tried as Latin alike.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import LOOKALIKES, base_form_text
from ..session import BROADCAST_ROWS, written
from .pairs import member_pairs

_TO_LATIN = {ord(a): b for a, b in LOOKALIKES.items()}
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯıɡ]")
_LATIN, _GREEK, _CYRILLIC = "A-Za-zÀ-ɏɡ̀-ͯ", "Ͱ-Ͽ", "Ѐ-ԯ"
_RUN = re.compile(f"[{_LATIN}{_GREEK}{_CYRILLIC}]+")
#: Tokens as wholes; one that equals a spelling of one script is a token of that script.
WORDS = f"[{_LATIN}{_GREEK}{_CYRILLIC}]+"


def _script(c: str) -> str:
    if "Ͱ" <= c <= "Ͽ":
        return "greek"
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "latin"


# look-alikes of Latin letters by script, for repairs to that script
_FROM_LATIN: dict[str, dict[int, str]] = {}
for _foreign, _latin in LOOKALIKES.items():
    _FROM_LATIN.setdefault(_script(_foreign), {}).setdefault(ord(_latin), _foreign)


def _spelling(token: str, genuine: dict[str, int]) -> str | None:
    """The token in its dominant script, if it mixes scripts; ``genuine``: how many genuine letters of each script the text has."""
    scripts = {_script(c) for c in token}
    if any(c in "ıɡ" for c in token):  # look-alikes that are Latin themselves
        scripts |= {"latin", "odd"}
    if len(scripts) == 1:  # wholly of look-alikes: the extension
        foreign = next(iter(scripts))
        whole = foreign != "latin" and not genuine.get(foreign) and all(c in LOOKALIKES for c in token)
        return token.translate(_TO_LATIN) if whole else None
    own = dict.fromkeys(scripts - {"odd"}, 0)
    for c in token:
        here = _script(c)
        others = scripts - {here, "odd"}
        if here == "latin":
            own[here] += c not in "ıɡ" and not any(ord(c) in _FROM_LATIN[o] for o in others)
        else:
            own[here] += c not in LOOKALIKES
    if any(own.values()):
        top = max(sorted(own), key=own.get)
    else:
        known = {k: genuine.get(k, 0) for k in own}
        top = max(sorted(known), key=known.get) if any(known.values()) else "latin"
    to = _TO_LATIN if top == "latin" else _TO_LATIN | _FROM_LATIN[top]
    done = "".join(c if _script(c) == top and (top != "latin" or ord(c) not in _TO_LATIN) else to.get(ord(c), c) for c in token)
    if top != "latin":  # a letter of the third script goes by its Latin look-alike
        done = "".join(c if _script(c) == top else _FROM_LATIN[top].get(ord(c), c) for c in done)
    return done if {_script(c) for c in done} == {top} else None


def suspects(text: str) -> list[tuple[str, str]]:
    """(token, proposed spelling) of the tokens of a base-form text that may hold look-alikes."""
    if text.isascii() or not _FOREIGN.search(text):
        return []
    genuine: dict[str, int] = {}
    for c in _FOREIGN.findall(text):
        if c not in LOOKALIKES:
            genuine[_script(c)] = genuine.get(_script(c), 0) + 1
    if genuine:
        back = set().union(*(_FROM_LATIN[k] for k in genuine if k in _FROM_LATIN))
        genuine["latin"] = sum(1 for c in text if c.isascii() and c.isalpha() and ord(c) not in back)
    out = {}
    for token in set(_RUN.findall(text)):
        if _FOREIGN.search(token):
            to = _spelling(token, genuine)
            if to is not None and to != token:
                out[token] = unicodedata.normalize("NFC", to)
    return sorted(out.items())


_FORM = "base string, suspects array<struct<token:string,spelling:string>>"


def consistent_form(df: DataFrame, id_col: str, text_col: str, out_col: str = "form") -> DataFrame:
    """``id_col`` and the consistent form of ``text_col`` for every row.

    ``id_col`` must be unique and not null. A null text has a null form, an empty text an empty one; other
    columns, whatever their names, are not read. Vocabulary and repairs are taken over all rows.
    """

    @F.pandas_udf(_FORM)
    def fold(s: pd.Series) -> pd.DataFrame:
        base = [base_form_text(t) for t in s]
        sus = [[{"token": a, "spelling": b} for a, b in suspects(t)] if t else [] for t in base]
        return pd.DataFrame({"base": pd.Series(base, dtype=object), "suspects": sus})

    rows = df.select(F.col(id_col).alias("_id"), fold(F.col(text_col)).alias("_f"))
    rows = written(rows.select("_id", "_f.base", "_f.suspects"), "base")
    doubtful = rows.where(F.size("suspects") > 0).select("_id", "base", "suspects")
    each = doubtful.select("_id", F.explode("suspects").alias("s")).select("_id", "s.token", "s.spelling")
    proposed = written(each.select("token", "spelling").distinct(), "proposed")
    spelled = proposed.select("spelling").distinct()
    n = spelled.count()
    wanted = F.broadcast(spelled) if n <= BROADCAST_ROWS else spelled
    letters = F.col("base").rlike(f"[{_LATIN}{_GREEK}{_CYRILLIC}]")
    words = rows.where(F.lit(n > 0) & letters).select(F.explode(F.array_distinct(F.regexp_extract_all("base", F.lit(WORDS), 0))).alias("spelling"))
    accepted = proposed.join(words.join(wanted, "spelling", "left_semi").distinct(), "spelling")
    repairs = each.select("_id", "token").join(accepted, "token").groupBy("_id").agg(F.collect_list(F.struct("token", "spelling")).alias("repairs"))

    @F.pandas_udf("string")
    def repair(base: pd.Series, repairs: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(base, repairs):
            if own is not None and len(own):
                to = {r["token"]: r["spelling"] for r in own}
                text = base_form_text(_RUN.sub(lambda m, to=to: to.get(m[0], m[0]), text))
            out.append(text)
        return pd.Series(out, dtype=object)

    fixed = doubtful.select("_id", "base").join(repairs, "_id", "left").select("_id", repair("base", "repairs").alias(out_col))
    fixed = written(fixed, "repaired")
    plain = rows.where(F.size("suspects") == 0).select("_id", F.col("base").alias(out_col))
    return plain.unionByName(fixed).select(F.col("_id").alias(id_col), out_col)


def same_reading_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of ids whose texts read the same but are not the same code points, the smaller id first.

    Null texts have no pair. Distinct spellings of a reading meet, not their rows; their rows are expanded
    last. A reading with one spelling is left out before the join, so that exact copies alone never meet.
    """
    form = consistent_form(df, id_col, text_col)
    raw = df.select(id_col, F.md5(F.col(text_col)).alias("raw"))
    keyed = form.where("form is not null").select(id_col, F.md5("form").alias("reading")).join(raw, id_col)
    keyed = written(keyed, "readings")
    spellings = keyed.groupBy("reading", "raw").agg(F.lit(1).alias("one"))
    several = spellings.groupBy("reading").agg(F.count("*").alias("n")).where("n > 1").select("reading")
    spellings = written(spellings.join(several, "reading").select("reading", "raw"), "spellings")
    # each spelling is a class of its rows, and spellings of one reading are the pairs of classes
    ids = keyed.join(spellings, ["reading", "raw"]).select(F.concat("reading", "raw").alias("class_id"), F.col(id_col).alias("id"))
    a, b = spellings.toDF("reading", "raw_a"), spellings.toDF("reading", "raw_b")
    classes = a.join(b, "reading").where("raw_a < raw_b").select(F.concat("reading", "raw_a").alias("class_a"), F.concat("reading", "raw_b").alias("class_b"))
    return member_pairs(classes, ids)
