"""Problem 8: the subject areas of each document.

Sentences are bags of hashed character and word sequences. Complement naive Bayes is trained from labelled
documents, then refined by expectation-maximization over the sentences of all documents: a sentence's
posterior comes from its own sequences and its document's mix, and the sequences are counted again. Only
sequences that point to one subject are evidence, so that a sentence of office routine has none. A sentence
without evidence goes on about the one before if it holds a sequence that such sentences often have but that
never opens a document, where nothing comes before. A document's subjects are those of enough of its
sentences; their posteriors are calibrated subject by subject, independently, on the labelled documents.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import base_form_text
from ..session import written

#: Labelled documents at most that the first model and the calibration are fitted on.
LABELLED_ROWS = 20_000
#: Buckets that the sequences are hashed into.
BUCKETS = 1 << 18
#: Characters that a task looks at together.
SLICE = 400_000

#: Parts of a sentence that counts are kept in, as whole numbers, so that sums don't depend on their order.
PARTS = 1 << 12
#: A sequence goes on if chance would have it open so many documents, and it opens this share of them at most.
OPENINGS, OPENED = 5.0, 0.02

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1)


#: Ranges of characters of which none composes with the one before, but for those with a combining class.
_PLAIN = ((0, 0x300), (0x370, 0x530), (0x2000, 0x2C00), (0x3000, 0x3400), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xFE30, 0xFE70), (0xFF00, 0xFFF0))
_NOT_ALONE = np.uint32(0xFFFFFFFF)


def _lowered(text: str) -> str:
    return (base_form_text(text) or "").lower().replace("\x00", " ")


@cache
def _folded() -> np.ndarray:
    """What :func:`_lowered` makes of each character, or ``_NOT_ALONE`` if that isn't one character or depends on its neighbours."""
    out = np.full(0x110000, _NOT_ALONE, np.uint32)
    plain = lambda x: any(a <= x < b for a, b in _PLAIN)
    for a, b in _PLAIN:
        if a in (0x3400, 0x4E00):  # ideographs stay
            out[a:b] = np.arange(a, b)
            continue
        for i in range(a, b):
            base = base_form_text(chr(i))
            new = _lowered(chr(i))
            if i != 13 and base != "Σ" and len(base) == len(new) == 1 and all(plain(ord(x)) and not unicodedata.combining(x) for x in (unicodedata.normalize("NFKC", chr(i))[:1], base, new)):
                out[i] = ord(new)
    return out


def _codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of the lowered texts, each with a line break behind it, and a space at the end; length of each with its line break)."""
    own = [t or "" for t in texts]
    raw = np.frombuffer(("\n".join(own) + "\n ").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in own), np.int64, len(own))
    c = _folded()[raw]
    ends = np.cumsum(lengths)
    slow = np.unique(np.searchsorted(ends, np.flatnonzero(c == _NOT_ALONE), "right"))
    if not len(slow):
        return c, lengths
    parts = np.split(c, ends)
    for i in slow:
        parts[i] = np.frombuffer((_lowered(own[i]) + "\n").encode("utf-32-le"), dtype=np.uint32)
        lengths[i] = len(parts[i])
    return np.concatenate(parts), lengths


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse, kept for the next slice."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_P, _P_INVERSE):
            powers = np.full(max(n, 2 * SLICE), base, np.uint64)
            powers[0] = 1
            _POWERS.append(np.multiply.accumulate(powers))
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Sentences:
    """Sequences of a slice of texts: each with its bucket and sentence; sentences with their document."""

    bucket: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    counted: np.ndarray


def sentences_of(texts: list[str | None]) -> Sentences:
    """Sentences end at 。!? and line breaks, and at a full stop before white space.

    A line without an end mark and of at most 30 characters is a heading and isn't counted.
    """
    c, lengths = _codes_of(texts)
    n = len(c)
    doc_at = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    doc_at = np.concatenate([doc_at, np.full(n - len(doc_at), max(0, len(texts) - 1), np.int32)])
    line = c == 10
    mark = (c == 0x3002) | (c == 33) | (c == 63)
    mark[:-1] |= (c[:-1] == 46) & (c[1:] <= 32)
    end = line | mark
    sent = np.cumsum(end) - end
    cjk = ((c >= 0x3400) & (c <= 0x9FFF)) | (c >= 0x20000)
    word = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c <= 0x24F))
    count = int(sent[-1]) + 1
    letters = np.bincount(sent[cjk | word], minlength=count)
    size = np.bincount(sent, minlength=count)
    doc = np.zeros(count, np.int32)
    doc[sent] = doc_at
    marked = np.zeros(count, bool)
    marked[sent[mark]] = True
    first = np.concatenate([[True], end[:-1]])
    bar = np.zeros(count, bool)
    bar[sent[first & (c == 124)]] = True  # rows of tables
    counted = (letters >= 2) & (marked | (size > 31)) & ~bar

    big = c.astype(np.uint64)
    buckets, ats = [], []
    two = cjk[:-1] & cjk[1:]
    i = np.flatnonzero(two)
    h2 = big[i] * _P + big[i + 1]
    buckets.append(_bucket(h2, 2)), ats.append(sent[i])
    keep = i + 2 < n
    i, h2 = i[keep], h2[keep]
    three = cjk[i + 2]
    i, h2 = i[three], h2[three]
    buckets.append(_bucket(h2 * _P + big[i + 2], 3)), ats.append(sent[i])
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(s):
        powers, back = _powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(big * powers, dtype=np.uint64)])
        w = (sums[e] - sums[s]) * back[s]
        buckets.append(_bucket(w, 4)), ats.append(sent[s])
        pair = (s[1:] == e[:-1] + 1) & (sent[s[1:]] == sent[s[:-1]])
        buckets.append(_bucket(w[:-1][pair] * _P + w[1:][pair], 5)), ats.append(sent[s[:-1]][pair])
    return Sentences(np.concatenate(buckets), np.concatenate(ats), doc, counted)


@dataclass
class Model:
    """``index``: a bucket's row in ``weights`` (complement naive Bayes, one column a subject), or -1; ``goes_on``: buckets by which a sentence goes on."""

    subjects: list[str]
    prior: np.ndarray
    index: np.ndarray
    weights: np.ndarray
    goes_on: np.ndarray

    @staticmethod
    def fit(subjects: list[str], totals: np.ndarray, buckets: np.ndarray, counts: np.ndarray, goes_on: np.ndarray, clear: float = 0.4, smooth: float = 0.05) -> Model:
        prior = np.maximum(totals / max(1e-9, totals.sum()), 1e-4)
        n = counts.sum(1)
        share = counts / np.maximum(n, 1e-9)[:, None]
        most = share.max(1)
        # points to one subject: by a clear share of it, far beyond the subject's part of the corpus
        best = share.argmax(1)
        chance = (most * n - n * prior[best]) / np.sqrt(np.maximum(n * prior[best], 1e-9))
        points = (most >= clear + 0.6 / np.sqrt(np.maximum(n, 1))) & (most >= 1.8 * prior[best]) & (chance >= 5)
        buckets, counts, n = buckets[points], counts[points], n[points]
        index = np.full(BUCKETS, -1, np.int32)
        index[buckets] = np.arange(len(buckets), dtype=np.int32)
        own = (counts + smooth) / (totals + smooth * BUCKETS ** 0.5)
        rest = (n[:, None] - counts + smooth) / (totals.sum() - totals + smooth * BUCKETS ** 0.5)
        return Model(subjects, prior, index, np.clip(np.log(own) - np.log(rest), -6, 6).astype(np.float32), goes_on)


def _score(model: Model, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """(summed weights, has evidence) of each sentence."""
    row = model.index[s.bucket]
    hit = np.flatnonzero(row >= 0)
    row, at = row[hit], s.at[hit]
    score = np.stack([np.bincount(at, model.weights[row, k], minlength=len(s.doc)) for k in range(len(model.subjects))], 1)
    return score, np.bincount(at, minlength=len(s.doc)) > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _mix(model: Model, s: Sentences, post: np.ndarray, evident: np.ndarray, docs: int) -> np.ndarray:
    mix = np.zeros((docs, len(model.subjects)))
    np.add.at(mix, s.doc[evident], post[evident])
    return mix + 0.3 * model.prior


def posteriors(model: Model, s: Sentences, labels: np.ndarray | None, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, weight) of each sentence; ``labels``: a row a document, of 1 for its labels, 0 without any."""
    score, evident = _score(model, s)
    mix = _mix(model, s, _softmax(score + np.log(model.prior)), evident, docs)
    mix /= mix.sum(1, keepdims=True)
    if labels is not None:
        some = labels.sum(1, keepdims=True)
        mix = np.where(some > 0, 0.5 * mix + 0.5 * labels / np.maximum(some, 1), mix)
    post = _softmax(np.where(evident[:, None], score, 0) + np.log(mix[s.doc]))
    # a sentence without evidence teaches as much as its document is known
    size = np.maximum(np.bincount(s.doc[s.counted], minlength=docs), 1)
    known = np.bincount(s.doc[evident & s.counted], minlength=docs) / size
    if labels is not None:
        known = np.where(labels.sum(1) > 0, np.maximum(known, 0.5), known)
    return post, np.where(s.counted, np.where(evident, 1.0, known[s.doc]), 0.0)


def _opens(s: Sentences) -> np.ndarray:
    """Whether a sentence is the first counted one of its document."""
    at = np.flatnonzero(s.counted)
    first = np.zeros(len(s.doc), bool)
    first[at[np.unique(s.doc[at], return_index=True)[1]]] = True
    return first


def decide(model: Model, s: Sentences, docs: int) -> np.ndarray:
    """The subject of each sentence, or -1; a sentence that goes on has that of the one before."""
    score, evident = _score(model, s)
    mix = _mix(model, s, _softmax(score + np.log(model.prior)), evident, docs)
    post = _softmax(score + np.log(mix[s.doc] / mix.sum(1)[s.doc][:, None]))
    own = np.where(evident & (score.max(1) > 2.0), post.argmax(1), -1)
    goes_on = np.zeros(len(s.doc), bool)
    goes_on[s.at[model.goes_on[s.bucket]]] = True
    fixed = np.flatnonzero(s.counted & ~(goes_on & (own < 0)))
    out = np.full(len(s.doc), -1)
    out[fixed] = own[fixed]
    last = np.full(len(s.doc), -1)
    last[fixed] = fixed
    last = np.maximum.accumulate(last)
    ask = np.flatnonzero(s.counted & goes_on & (own < 0) & (last >= 0))
    ask = ask[s.doc[last[ask]] == s.doc[ask]]
    out[ask] = out[last[ask]]
    return out


def _slices(pdf: pd.DataFrame):
    size = pdf.text.str.len().fillna(0).to_numpy().cumsum() // SLICE
    for _, part in pdf.groupby(size, sort=False):
        yield part


def _one_hot(labels: pd.Series, subjects: list[str]) -> np.ndarray:
    out = np.zeros((len(labels), len(subjects)))
    for i, own in enumerate(labels):
        for x in own if own is not None else ():
            if x in subjects:
                out[i, subjects.index(x)] = 1
    return out


def _learn(docs: DataFrame, subjects: list[str], model: Model | None, clear: float = 0.4) -> Model:
    """One round: expected counts of every sequence under ``model`` (or the labels alone), then a new model."""
    spark, k = docs.sparkSession, len(subjects)
    shared = spark.sparkContext.broadcast(model)  # of a size bounded by BUCKETS and the subjects
    wide = k + 2  # a column a subject, then sentences without evidence, and those of them that open a document

    def count(batches):
        sums = np.zeros(BUCKETS * wide, np.int64)
        for pdf in batches:
            for part in _slices(pdf):
                s = sentences_of(part.text.tolist())
                labels = _one_hot(part.labels, subjects)
                if shared.value is None:
                    post = labels[s.doc] / np.maximum(labels[s.doc].sum(1, keepdims=True), 1)
                    weight = s.counted & (labels[s.doc].sum(1) > 0)
                else:
                    post, weight = posteriors(shared.value, s, labels, len(part))
                    none = s.counted & ~(np.bincount(s.at, shared.value.index[s.bucket] >= 0, minlength=len(s.doc)) > 0)
                    for column, which in ((k, none), (k + 1, none & _opens(s))):
                        np.add.at(sums, s.bucket[which[s.at]].astype(np.int64) * wide + column, 1)
                top = np.argsort(-post, axis=1, kind="stable")[:, :3]
                value = np.take_along_axis(post, top, 1)
                value = np.rint(value / np.maximum(value.sum(1, keepdims=True), 1e-9) * weight[:, None] * PARTS).astype(np.int64)
                for j in range(top.shape[1]):
                    w = value[:, j][s.at]
                    keep = np.flatnonzero(w > PARTS // 100)
                    np.add.at(sums, s.bucket[keep].astype(np.int64) * wide + top[:, j][s.at[keep]], w[keep])
        key = np.flatnonzero(sums)
        yield pd.DataFrame({"key": key.astype(np.int32), "n": sums[key]})

    raw = docs.mapInPandas(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    raw = written(raw, "counts")
    sums = np.zeros(wide)
    for r in raw.groupBy((F.col("key") % wide).alias("c")).agg(F.sum("n").alias("n")).collect():  # a row a column
        sums[r.c] = r.n
    of = lambda c: F.sum(F.when(F.col("key") % wide == c, F.col("n")).otherwise(0))
    rows = raw.groupBy(F.floor(F.col("key") / wide).cast("int").alias("b")).agg(*[of(c).alias(f"c{c}") for c in range(wide)])
    # BUCKETS rows at most: those seen often enough to point anywhere, and those that go on
    names = [f"c{c}" for c in range(k)]
    n = sum((F.col(c) for c in names), F.lit(0))
    chance = F.col(f"c{k}") * (sums[k + 1] / max(1.0, sums[k]))
    rows = rows.select("b", *names, ((chance >= OPENINGS) & (F.col(f"c{k + 1}") <= OPENED * chance)).alias("on"), ((n >= 6 * PARTS) & (F.greatest(*[F.col(c) for c in names], F.lit(0)) >= 0.2 * n)).alias("points"))
    pdf = rows.where("on or points").orderBy("b").toPandas()
    goes_on = np.zeros(BUCKETS, bool)
    goes_on[pdf.b[pdf.on.astype(bool)]] = True
    pdf = pdf[pdf.points.astype(bool)]
    return Model.fit(subjects, sums[:k] / PARTS, pdf.b.to_numpy(), pdf[names].to_numpy(float) / PARTS, goes_on, clear)


#: Subjects at most; more raise an error.
MOST_SUBJECTS = 1000


def _codes(labels: DataFrame) -> list[str]:
    codes = [r.subject_code for r in labels.select("subject_code").distinct().orderBy("subject_code").limit(MOST_SUBJECTS + 1).collect()]
    if len(codes) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return codes


def train_subjects(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> Model | None:
    """Complement naive Bayes from the labelled documents, refined over all documents; None without any label."""
    named = labels.where("subject_code is not null").select(F.col(id_col).alias("id"), "subject_code").distinct()
    subjects = _codes(named)
    if not subjects:
        return None
    own = named.groupBy("id").agg(F.collect_set("subject_code").alias("labels")).orderBy(F.xxhash64("id")).limit(LABELLED_ROWS)
    own = F.broadcast(written(own, "labelled"))  # LABELLED_ROWS rows at most
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = _learn(docs.join(own, "id").select("text", "labels"), subjects, None)
    everything = docs.join(own, "id", "left").select("text", "labels")
    for i in range(rounds):
        # the last model decides, so that its evidence must be clearer than what the rounds learn from
        model = _learn(everything, subjects, model, 0.4 if i + 1 < rounds else 0.8)
    return model


def subject_shares(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``subject_code``, ``sentences`` about it, ``of`` all its sentences: one row a document and subject found in it."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        k = len(model.subjects)
        names = np.array(model.subjects, dtype=object)
        for pdf in batches:
            for part in _slices(pdf):
                s = sentences_of(part.text.tolist())
                subject = decide(model, s, len(part))
                of = np.bincount(s.doc[s.counted], minlength=len(part))
                has = np.flatnonzero(subject >= 0)
                n = np.bincount(s.doc[has].astype(np.int64) * k + subject[has], minlength=len(part) * k)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"id": part.id.to_numpy()[at // k], "subject_code": names[at % k], "sentences": n[at].astype(np.int32), "of": of[at // k].astype(np.int32)})

    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInPandas(run, "id long, subject_code string, sentences int, of int").withColumnRenamed("id", id_col)


def calibrated(shares: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``shares`` with ``share`` and ``posterior``: for each subject by itself, a logistic curve of the share, fitted on labelled documents.

    Some labels are wrong: the curve runs between the rate of labels at a share of 0 and that at a share of
    half or more, over all subjects, and the posterior is the curve without these rates. The subjects' own
    curves are held to the one of all subjects as far as few labels speak for another one.
    """
    spark = shares.sparkSession
    own = labels.where("subject_code is not null").select(id_col, "subject_code", F.lit(1.0).alias("y")).distinct()
    ids = own.select(id_col).distinct().orderBy(F.xxhash64(id_col)).limit(LABELLED_ROWS)
    codes = _codes(own)
    seen = ids.select(id_col, F.explode(F.array(*[F.lit(c) for c in codes]) if codes else F.array().cast("array<string>")).alias("subject_code"))
    fit = seen.join(shares, [id_col, "subject_code"], "left").join(own, [id_col, "subject_code"], "left")
    x = F.round(F.coalesce(F.col("sentences") / F.col("of"), F.lit(0.0)), 2).alias("x")
    # 101 rows a subject at most
    pdf = fit.select("subject_code", x, F.coalesce("y", F.lit(0.0)).alias("y")).groupBy("subject_code", "x").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("subject_code", "x").toPandas()
    low, high = (float((pdf.y[at].sum() + 0.5) / (pdf.n[at].sum() + 1)) if len(pdf) else 0.0 for at in (pdf.x == 0, pdf.x >= 0.5))
    low, high = min(low, 0.2), max(high, 0.6)
    start = _curve(pdf, low, high, np.array([-5.0, 20.0]), np.array([0.01, 0.001]))
    lines = [(c, *map(float, _curve(part, low, high, start, np.array([4.0, 0.05])))) for c, part in pdf.groupby("subject_code")]
    lines = F.broadcast(spark.createDataFrame(lines, "subject_code string, b0 double, b1 double"))  # a row a subject
    share = F.col("sentences") / F.col("of")
    return shares.join(lines, "subject_code").select(id_col, "subject_code", "sentences", "of", share.alias("share"), (1 / (1 + F.exp(-F.col("b0") - F.col("b1") * share))).alias("posterior"))


def _curve(pdf: pd.DataFrame, low: float, high: float, start: np.ndarray, hold: np.ndarray) -> np.ndarray:
    """(b0, b1) of the likeliest curve low + (high - low) / (1 + exp(-b0 - b1 x)), held to ``start``; by damped scoring."""
    x = np.stack([np.ones(len(pdf)), pdf.x.to_numpy(float)], 1)
    y, n, b = pdf.y.to_numpy(float), pdf.n.to_numpy(float), start.copy()
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        p = low + (high - low) * s
        slope = (high - low) * s * (1 - s)
        step = x.T @ (slope * (y - n * p) / np.maximum(p * (1 - p), 1e-9)) - hold * (b - start)
        spread = (x * (n * slope * slope / np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(hold)
        b = b + np.clip(np.linalg.solve(spread, step), -2, 2) * 0.5
    return b
