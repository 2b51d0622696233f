"""The parts of keyword and vector recall that run in tasks, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Parameters of the keyword score.
K1, B, EPSILON = 1.5, 0.75, 0.25
HITS = "ask long, vector_id long, score double"
POSTINGS = "vector_id long, code string, year string, len long, terms array<long>, tfs array<int>"
#: Queries whose products with a block of items are held at once.
AT_ONCE = 32


def _whole(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _list(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _gather(values: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows one after the other, and how many each has."""
    n = off[rows + 1] - off[rows]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(off[rows] - ends + n, n)], n


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, dict]:
    """A text column as numbers, -1 for null, and the number of each text."""
    a = column.combine_chunks().dictionary_encode()
    a = a.unify_dictionaries().chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return pc.fill_null(a.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), {v: i for i, v in enumerate(a.dictionary.to_pylist())}


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest; ties go to the first."""
    if len(s) <= k:
        return np.arange(len(s))
    least = np.partition(s, len(s) - k)[len(s) - k]
    over, tie = np.flatnonzero(s > least), np.flatnonzero(s == least)
    return np.concatenate([over, tie[: k - len(over)]])


class _Hits:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, ask: int, ids: np.ndarray, score: np.ndarray) -> None:
        if len(ids):
            self.rows.append((np.full(len(ids), ask, np.int64), ids, score))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.rows)], names=["ask", "vector_id", "score"])
            self.rows = []


def _by_filter(asks: Iterable[dict]) -> dict[tuple, list[dict]]:
    out: dict[tuple, list[dict]] = {}
    for a in asks:
        out.setdefault((a.get("code"), None if a["allowed"] is None else tuple(sorted(a["allowed"]))), []).append(a)
    return out


def _of_years(allowed: tuple | None, year: np.ndarray, numbers: dict) -> np.ndarray:
    return np.ones(len(year), bool) if allowed is None else np.isin(year, [numbers[y] for y in allowed if y in numbers])


# keywords


def _score(hits: _Hits, asks: list[tuple], ptr: np.ndarray, doc: np.ndarray, part: np.ndarray, ids: np.ndarray) -> None:
    """The best documents of asks (ask, terms as places in ``ptr``, weights, k); ``ids`` ascend."""
    total = np.zeros(len(ids))
    for ask, places, weights, k in asks:
        total[:] = 0
        for t, w in zip(places, weights):
            at = slice(ptr[t], ptr[t + 1])
            total[doc[at]] += w * part[at]
        s = np.round(total, 4)
        some = np.flatnonzero(s > 0)
        some = some[_best(s[some], k)]
        hits.add(ask, ids[some], total[some])


def _part(tf: np.ndarray, length: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def keyword_by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks and items of whole codes: counts, weights and scores of each filter."""
    t = _whole(batches)
    if t is None:
        return
    hits = _Hits()
    code, _ = _numbers(t["code"])
    year, numbers = _numbers(t["year"])
    values, off = _list(t["terms"])
    is_ask = t["ask"].is_valid().to_numpy()
    vector_id = pc.fill_null(t["vector_id"], -1).to_numpy()
    asked = t.select(["ask", "allowed", "k"]).append_column("row", pa.array(np.arange(t.num_rows))).filter(pa.array(is_ask)).to_pylist()
    own: dict[int, list[dict]] = {}
    for a in asked:
        own.setdefault(code[a["row"]], []).append(a)
    order = np.lexsort([vector_id, code])
    order = order[~is_ask[order]]
    bounds = {c: (np.searchsorted(code[order], c), np.searchsorted(code[order], c, "right")) for c in own}
    for c, asks in own.items():
        rows = order[slice(*bounds[c])]
        if not len(rows):
            continue
        m, ids, years = len(rows), vector_id[rows], year[rows]
        terms, length = _gather(values, off, rows)
        if not len(terms):
            continue
        vocabulary, place = np.unique(terms, return_inverse=True)
        key, tf = np.unique(place * m + np.repeat(np.arange(m), length), return_counts=True)
        term, doc = np.divmod(key, m)
        for (_, allowed), group in _by_filter(asks).items():
            inside = _of_years(allowed, years, numbers)
            n = int(inside.sum())
            if not n or not length[inside].sum():
                continue
            kept = slice(None) if n == m else inside[doc]
            p_term, p_doc, p_tf = term[kept], doc[kept], tf[kept]
            df = np.bincount(p_term, minlength=len(vocabulary))
            with np.errstate(divide="ignore", invalid="ignore"):
                raw = np.log(n - df + 0.5) - np.log(df + 0.5)
            mean = raw[df > 0].mean()
            ptr = np.concatenate([[0], np.cumsum(df)])
            part = _part(p_tf, length[p_doc], length[inside].sum() / n)
            todo = []
            for a in group:
                q, qtf = np.unique(values[off[a["row"]] : off[a["row"] + 1]], return_counts=True)
                at = np.minimum(np.searchsorted(vocabulary, q), len(vocabulary) - 1)
                there = (vocabulary[at] == q) & (df[at] > 0)
                at = at[there]
                todo.append((a["ask"], at, qtf[there] * np.where(raw[at] < 0, EPSILON * mean, raw[at]), a["k"]))
            _score(hits, todo, ptr, p_doc, part, ids)
    yield from hits.batches()


def asked_postings(words: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their length and, of their terms, those of ``words`` with their counts."""
    words = np.sort(words)
    mask = (1 << 20) - 1
    maybe = np.zeros(mask + 1, bool)
    maybe[words & mask] = True
    for b in batches:
        values, off = _list(b.column("terms"))
        n = np.diff(off)
        some = np.flatnonzero(maybe[values & mask])
        place = np.minimum(np.searchsorted(words, values[some]), len(words) - 1)
        right = words[place] == values[some]
        row = np.repeat(np.arange(b.num_rows), n)[some[right]]
        key, tf = np.unique(row * len(words) + place[right], return_counts=True)
        row, place = np.divmod(key, len(words))
        ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words[place], tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([b.column("vector_id"), b.column("code"), b.column("year"), pa.array(n), *lists], names=["vector_id", "code", "year", "len", "terms", "tfs"])


def keyword_in_block(asks: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best items of a block for each ask, whose terms have weights."""
    t = _whole(batches)
    if t is None:
        return
    hits = _Hits()
    t = t.sort_by("vector_id")
    m, ids, length = t.num_rows, t["vector_id"].to_numpy(), t["len"].to_numpy()
    code, codes = _numbers(t["code"])
    year, numbers = _numbers(t["year"])
    values, off = _list(t["terms"])
    doc, tf = np.repeat(np.arange(m), np.diff(off)), _list(t["tfs"])[0]
    order = np.argsort(values, kind="stable")
    vocabulary, start = np.unique(values[order], return_index=True)
    term = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(start, len(order))))
    doc, tf = doc[order], tf[order]
    if not len(vocabulary):
        return
    for (own, allowed), group in _by_filter(asks.to_pylist()).items():
        inside = _of_years(allowed, year, numbers)
        if own is not None:
            inside &= code == codes.get(own, -2)
        if not inside.any():
            continue
        kept = slice(None) if inside.all() else inside[doc]
        p_term, p_doc = term[kept], doc[kept]
        part = _part(tf[kept], length[p_doc], group[0]["avgdl"])
        ptr = np.concatenate([[0], np.cumsum(np.bincount(p_term, minlength=len(vocabulary)))])
        todo = []
        for a in group:
            q, w = np.array(a["terms"]), np.array(a["weights"], float)
            at = np.minimum(np.searchsorted(vocabulary, q), len(vocabulary) - 1)
            there = vocabulary[at] == q
            todo.append((a["ask"], at[there], w[there], a["k"]))
        _score(hits, todo, ptr, p_doc, part, ids)
        yield from hits.batches()


# vectors


def _nearest(hits: _Hits, asks: list[tuple], q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """The nearest rows of ``x`` for asks (ask, k) with vectors ``q``, by products of six decimals; ``ids`` ascend."""
    for i in range(0, len(asks), AT_ONCE):
        exact = q[i : i + AT_ONCE] @ x.T
        for (ask, k), s in zip(asks[i : i + AT_ONCE], exact):
            some = np.arange(len(s))
            if len(s) > k:  # all that could be among the k best once rounded
                some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 2e-6)
            some = some[_best(np.round(s[some], 6), k)]
            hits.add(ask, ids[some], s[some])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values, off = _list(column)
    return values.astype(float).reshape(len(off) - 1, -1)


def vectors_by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks and items of whole codes, ``vec`` of either."""
    t = _whole(batches)
    if t is None:
        return
    hits = _Hits()
    t = t.sort_by([("code", "ascending"), ("vector_id", "ascending")])
    code, _ = _numbers(t["code"])
    year, numbers = _numbers(t["year"])
    x = _matrix(t["vec"])
    is_ask = t["ask"].is_valid().to_numpy()
    ids = pc.fill_null(t["vector_id"], -1).to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = lo + np.flatnonzero(~is_ask[lo:hi])
        asked = lo + np.flatnonzero(is_ask[lo:hi])
        if not len(rows) or not len(asked):
            continue
        own = t.select(["ask", "allowed", "k"]).take(pa.array(asked)).append_column("row", pa.array(asked)).to_pylist()
        for (_, allowed), group in _by_filter(own).items():
            inside = rows[_of_years(allowed, year[rows], numbers)]
            if len(inside):
                _nearest(hits, [(a["ask"], a["k"]) for a in group], x[[a["row"] for a in group]], x[inside], ids[inside])
    yield from hits.batches()


def vectors_in_block(asks: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest items of a block for each ask."""
    t = _whole(batches)
    if t is None:
        return
    hits = _Hits()
    t = t.sort_by("vector_id")
    ids, x = t["vector_id"].to_numpy(), _matrix(t["vec"])
    code, codes = _numbers(t["stock_code"])
    year, numbers = _numbers(t["year"])
    q = _matrix(asks["qvec"])
    rows = asks.drop_columns(["qvec"]).append_column("row", pa.array(np.arange(asks.num_rows))).to_pylist()
    for (own, allowed), group in _by_filter(rows).items():
        inside = _of_years(allowed, year, numbers)
        if own is not None:
            inside &= code == codes.get(own, -2)
        if inside.any():
            _nearest(hits, [(a["ask"], a["k"]) for a in group], q[[a["row"] for a in group]], x if inside.all() else x[inside], ids[inside])
            yield from hits.batches()
