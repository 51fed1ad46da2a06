"""Cells of rows that meet blocks of queries as matrices; only what can be among a query's first k leaves a task.

A key is a score in units of its last decimal, rounded as Spark rounds, so that
equal scores are equal and their order goes on to the id.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 64
ELEMENTS = 1 << 21


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` in units of the last decimal; halves, by the shortest decimal form, go away from zero."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return np.copysign(whole, x).astype(np.int64)


def contenders(scores: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of all scores that may round to one of their row's k highest."""
    rows, n = scores.shape
    if n <= k:
        return np.divmod(np.arange(rows * n), n)
    wide = n // WIDTH
    if wide >= k:  # the k-th of the highest of stretches is no higher than the k-th of all
        highest = scores[:, : wide * WIDTH].reshape(rows, wide, WIDTH).max(axis=2)
        bound = np.partition(highest, wide - k, axis=1)[:, wide - k]
    else:
        bound = np.partition(scores, n - k, axis=1)[:, n - k]
    return np.divmod(np.flatnonzero(scores >= (bound - 2 * 10.0**-digits - 1e-12)[:, None]), n)


def first(row: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (key, id) of each row."""
    order = np.lexsort((ids, keys, row))
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    own = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[own < k]


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as (lengths, whether without nulls, first component's place, components as doubles)."""
    lists = pa.array([], column.type) if column.num_chunks == 0 else pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    nulls = np.concatenate([[0], np.cumsum(holes)])
    whole = (nulls[starts + sizes] == nulls[starts]) & lists.is_valid().to_numpy(zero_copy_only=False)
    return sizes, whole, starts, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, from the left to the right."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def vectors_of(size: int, sizes: np.ndarray, whole: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of ``size`` components without nulls: places of those with a direction, their components and norms, and places of the others."""
    at = np.flatnonzero(whole & (sizes == size))
    v = flat[starts[at][:, None] + np.arange(size)]
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(in_order(v * v))
    usual = np.isfinite(norms) & (norms > 0)
    return at[usual], v[usual], norms[usual], at[~usual]


def by_cosine(k: int, digits: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (query_id, vec_id, odd, key): the first k vectors of a cell for each query of a block.

    ``key`` is the distance; ``odd`` is 1 where it is not a number (a vector
    without direction) and 2 where it is null (a null, or unequal lengths).
    """

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("vec_id").to_numpy()
        vectors, queries = matrix(left.column("v")), matrix(right.column("q"))
        out = []
        for size in np.unique(queries[0]):
            at, v, nv, vague = vectors_of(size, *vectors)
            qat, q, nq, qvague = vectors_of(size, *queries)
            unit = np.ascontiguousarray((v / nv[:, None]).T)
            step = max(1, ELEMENTS // max(1, len(v)))
            for some in (slice(i, i + step) for i in range(0, len(q), step)):
                if not len(v):
                    break
                row, col = contenders((q[some] / nq[some][:, None]) @ unit, k, digits)
                row = row + some.start
                keys = np.empty(len(row), np.int64)
                for i in range(0, len(row), 1 << 14):
                    r, c = row[i : i + (1 << 14)], col[i : i + (1 << 14)]
                    keys[i : i + (1 << 14)] = rounded(1 - in_order(q[r] * v[c]) / (nq[r] * nv[c]), digits)
                kept = first(row, keys, ids[at[col]], k)
                out.append((qat[row[kept]], at[col[kept]], np.zeros(len(kept), np.int64), keys[kept]))
            rest = np.setdiff1d(np.arange(len(ids)), np.concatenate([at, vague]))
            least = lambda places: places[np.argsort(ids[places], kind="stable")][:k]  # noqa: E731, B023
            for which, places, odd in ((qat, least(vague), 1), (qvague, least(np.concatenate([at, vague])), 1), (np.concatenate([qat, qvague]), least(rest), 2)):
                out.append((np.repeat(which, len(places)), np.tile(places, len(which)), np.full(len(which) * len(places), odd), np.zeros(len(which) * len(places), np.int64)))
        # queries with nulls are at no distance from anything
        holed, every = np.flatnonzero(~queries[1]), np.argsort(ids, kind="stable")[:k]
        out = [(*x[:2], x[2].astype(np.int64), x[3]) for x in out]
        out.append((np.repeat(holed, len(every)), np.tile(every, len(holed)), np.full(len(holed) * len(every), 2), np.zeros(len(holed) * len(every), np.int64)))
        row, col, odd, key = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([right.column("query_id").take(pa.array(row)), left.column("vec_id").take(pa.array(col)), pa.array(odd, pa.int64()), pa.array(key)], schema=schema)

    return found


def nearest_of_each(digits: int, least: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (query_id, label, odd, key): for each query of a block, the distance of the nearest other vector of each label of a cell, where the cosine is at least ``least``.

    ``odd`` is 1 where a distance to that label is not a number. A product finds
    the nearest; of those that it cannot tell apart, others than the first are
    looked at only where the key may turn on them.
    """
    unsure = 1e-12

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, wanted = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        kinds = pc.unique(left.column("label"))
        codes = pc.index_in(left.column("label"), value_set=kinds).to_numpy()
        vectors, queries = matrix(left.column("v")), matrix(right.column("q"))
        order = np.argsort(ids, kind="stable")  # each query's own rows among the vectors
        low, high = (np.searchsorted(ids[order], wanted, side) for side in ("left", "right"))
        own_row = np.repeat(np.arange(len(wanted)), high - low)
        own_col = order[np.repeat(high - np.cumsum(high - low), high - low) + np.arange(len(own_row))]

        def own(which: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Own pairs by their places in ``which`` and ``places``."""
            row, col = np.full(len(wanted), -1), np.full(len(ids), -1)
            row[which], col[places] = np.arange(len(which)), np.arange(len(places))
            row, col = row[own_row], col[own_col]
            held = (row >= 0) & (col >= 0)
            return row[held], col[held]

        out = []
        for size in np.unique(queries[0]):
            at, v, nv, vague = vectors_of(size, *vectors)
            qat, q, nq, qvague = vectors_of(size, *queries)
            by = np.argsort(codes[at], kind="stable")
            at, v, nv = at[by], v[by], nv[by]
            starts = np.flatnonzero(np.diff(codes[at], prepend=-1))
            ends = np.append(starts[1:], len(at))
            unit = np.ascontiguousarray((v / nv[:, None]).T)
            mine, self = own(qat, at)
            step = max(1, ELEMENTS // max(1, len(v)))
            keyed = lambda r, c: rounded(1 - in_order(q[r] * v[c]) / (nq[r] * nv[c]), digits)  # noqa: E731, B023
            for i in range(0, len(q) if len(v) else 0, step):
                scores = (q[i : i + step] / nq[i : i + step, None]) @ unit
                here = (mine >= i) & (mine < i + step)
                scores[mine[here] - i, self[here]] = -np.inf
                best = np.stack([a + scores[:, a:b].argmax(axis=1) for a, b in zip(starts, ends, strict=True)], axis=1)
                high = np.take_along_axis(scores, best, axis=1)
                row, part = np.nonzero(high >= least - 2 * 10.0**-digits - unsure)
                keys, edge = np.empty(len(row), np.int64), np.empty(len(row))
                for j in range(0, len(row), 1 << 14):
                    r, c = row[j : j + (1 << 14)], best[row[j : j + (1 << 14)], part[j : j + (1 << 14)]]
                    keys[j : j + (1 << 14)] = keyed(i + r, c)
                    scaled = np.abs(1 - scores[r, c]) * 10.0**digits
                    edge[j : j + (1 << 14)] = np.abs(scaled - np.floor(scaled) - 0.5)
                for j in np.flatnonzero(edge < 4 * unsure * 10.0**digits):
                    r, a, b = row[j], starts[part[j]], ends[part[j]]
                    close = a + np.flatnonzero(scores[r, a:b] >= high[r, part[j]] - unsure)
                    for k in range(0, len(close), 1 << 14):
                        keys[j] = min(keys[j], keyed(np.full(len(close[k : k + (1 << 14)]), i + r), close[k : k + (1 << 14)]).min())
                kept = 1 - keys / 10.0**digits >= least
                out.append((qat[i + row[kept]], codes[at[starts[part[kept]]]], np.zeros(kept.sum(), np.int64), keys[kept]))
            for which, places in ((qat, vague), (qvague, np.concatenate([at, vague]))):
                some, code = np.unique(codes[places], return_inverse=True)
                others = np.tile(np.bincount(code, minlength=len(some)), (len(which), 1))
                row, col = own(which, places)
                np.subtract.at(others, (row, code[col]), 1)
                row, col = np.nonzero(others)
                out.append((which[row], some[col], np.ones(len(row), np.int64), np.zeros(len(row), np.int64)))
        if not out:
            return schema.empty_table()
        row, code, odd, key = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([right.column("query_id").take(pa.array(row)), kinds.take(pa.array(code)), pa.array(odd), pa.array(key)], schema=schema)

    return found


def counted(schema: pa.Schema) -> Callable:
    """Documents (doc_id, t) as rows (doc_id, dl, term, tf) of their distinct tokens, with a row of the empty term for each document."""

    def rows(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("t")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            keys = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
            keys, times = np.unique(keys, return_counts=True)
            row, code = np.divmod(keys, max(1, len(words.dictionary)))
            everyone = np.arange(len(sizes))
            term = pa.concat_arrays([pa.array([""] * len(sizes), words.dictionary.type), words.dictionary.take(pa.array(code))])
            row, tf = np.concatenate([everyone, row]), np.concatenate([np.zeros(len(sizes), np.int64), times])
            yield pa.record_batch([ids.take(pa.array(row)), pa.array(sizes[row], pa.int32()), term.cast(schema.field("term").type), pa.array(tf, pa.int64())], schema=schema)

    return rows


def by_bm25(k: int, digits: int, k1: float, b: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (query_id, doc_id, key, low, high): the first k documents of a cell for each query of a block, with the extremes of the query's hits there."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, query = np.unique(right.column("query_id").to_numpy(), return_inverse=True)
        terms = pc.unique(right.column("term"))
        weights = np.zeros((len(terms), len(queries)))
        weights[pc.index_in(right.column("term"), value_set=terms).to_numpy(), query] = right.column("weight").to_numpy()
        term = pc.index_in(left.column("term"), value_set=terms)
        left = left.append_column("at", term).filter(term.is_valid())
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, dl, at, tf = (left.column(c).to_numpy() for c in ("doc_id", "dl", "at", "tf"))
        order = np.lexsort((at, dl, ids))
        ids, at = ids[order], at[order]
        part = tf[order] / (tf[order] + k1 * (1 - b + b * dl[order] / right.column("avgdl")[0].as_py()))
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ends, docs = np.append(starts[1:], len(ids)), ids[starts]
        out = []
        wide = max(1, ELEMENTS // len(docs))  # queries at a time
        for q in range(0, len(queries), wide):
            some = np.ascontiguousarray(weights[:, q : q + wide])
            scores = np.empty((len(docs), some.shape[1]))
            step = max(1, ELEMENTS // some.shape[1])  # postings at a time
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
                held = slice(starts[i], ends[j - 1])
                scores[i:j] = np.add.reduceat(some[at[held]] * part[held, None], starts[i:j] - starts[i], axis=0)
                i = j
            scores = np.ascontiguousarray(scores.T)
            hit = scores >= 0.5 * 10.0**-digits
            worded = np.flatnonzero(hit.any(axis=1))
            if not len(worded):
                continue
            low, high = (rounded(x, digits) for x in (np.where(hit, scores, np.inf).min(axis=1)[worded], scores.max(axis=1)[worded]))
            row, col = contenders(scores[worded], k, digits)
            real = hit[worded[row], col]
            row, col = row[real], col[real]
            keys = rounded(scores[worded[row], col], digits)
            kept = first(row, -keys, docs[col], k)
            row, col, keys = row[kept], col[kept], keys[kept]
            out.append(pa.table([pa.array(queries[q + worded[row]]), pa.array(docs[col]), pa.array(keys), pa.array(low[row]), pa.array(high[row])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return found
