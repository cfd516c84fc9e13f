"""Nearest and near pairs of vectors: blocks of queries against tiles of items, each a task's product of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile of items and of a block of queries, items that a tile has at least, and similarities held at once.
TILE, BLOCK, LEAST_TILE, CELLS = 32_768, 16_384, 256, 1 << 21


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows that have it and their vectors of norm 1; rows that are null, have a null in them or no norm are left out."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    start = np.cumsum(size) - size
    bad = np.zeros(len(size), bool)
    if flat.null_count:
        bad[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), {}
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero((size == d) & ~bad)
        v = values[start[at][:, None] + np.arange(d)]
        norm = np.sqrt((v * v).sum(axis=1))
        some = ~(norm == 0)
        out[int(d)] = (at[some], v[some] / norm[some][:, None])
    return out


def _incidence(column: pa.ChunkedArray, codes: dict) -> np.ndarray:
    out = np.zeros((len(column), len(codes)), np.float32)
    for i, held in enumerate(column.to_pylist()):
        for c in {codes[e] for e in held or () if e in codes}:
            out[i, c] = 1
    return out


def _best(s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the limit largest of each row, rounded to nine places; of equal ones the first columns, and no -inf."""
    r = np.round(s, 9)
    r[np.isnan(r)] = np.inf  # as Spark sorts them
    least = -np.partition(-r, limit - 1, axis=1)[:, limit - 1, None] if r.shape[1] > limit else -np.inf
    i, j = np.nonzero((r >= least) & (r > -np.inf))
    order = np.lexsort((j, -r[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    held = np.arange(len(i)) - first < limit
    return i[held], j[held]


def near(items: DataFrame, queries: DataFrame, item_key: str, query_key: str, limit: int | None = None, least: float | None = None, ordered: tuple[str, str] | None = None, boost: tuple[str, str, float] | None = None) -> DataFrame:
    """Pairs of items (vector) and queries (query_vector) with similarity and the other columns of both.

    limit: of each query at least its best so many (similarity rounded to nine places, then smallest item_key) are there, each
    tile's own; cut them to rank. least: pairs at least so similar. ordered: only pairs with the item's column less than the query's. boost:
    similarity grows by so much for each entity that the two columns share. Vectors that differ in length, are null or have no norm have
    similarity 0. Both sides are dealt by hashes of their keys, and every tile meets every block.
    """
    n, q = items.count(), queries.count()
    blocks = max(1, -(-q // BLOCK))
    tiles = max(-(-n // TILE), min(items.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_TILE)), 1)
    part = lambda key, parts: F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = items.withColumn("_tile", part(item_key, tiles)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", part(query_key, blocks)).withColumn("_tile", every(tiles))
    keep_i, keep_q = [c for c in items.columns if c != "vector"], [c for c in queries.columns if c != "query_vector"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for of, keep in ((items, keep_i), (queries, keep_q)) for f in of.schema if f.name in keep) + ", similarity double"

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by(item_key) if a.num_rows else a
        of_a, of_b = _units(a["vector"]), _units(b["query_vector"])
        step, parts = max(1, CELLS // max(1, a.num_rows)), []
        if boost:
            seen = {e for x in (b[boost[1]].to_pylist() if a.num_rows else []) for e in x or ()}
            codes = {e: k for k, e in enumerate(seen & {e for x in a[boost[0]].to_pylist() for e in x or ()})}
            has_a, has_b = _incidence(a[boost[0]], codes), _incidence(b[boost[1]], codes)
        if ordered:
            at_a, at_b = a[ordered[0]].to_numpy(), b[ordered[1]].to_numpy()
        for low in range(0, b.num_rows if a.num_rows else 0, step):
            high = min(low + step, b.num_rows)
            s = np.zeros((high - low, a.num_rows))
            for d, (rows, units) in of_b.items():
                here = (rows >= low) & (rows < high)
                if d in of_a and here.any():
                    dots = units[here] @ of_a[d][1].T
                    if dots.shape == s.shape:
                        s = dots
                    else:
                        s[np.ix_(rows[here] - low, of_a[d][0])] = dots
            if boost:
                s *= 1 + boost[2] * (has_b[low:high] @ has_a.T)
            if ordered:
                s[at_a[None, :] >= at_b[low:high, None]] = -np.inf
            i, j = _best(s, limit) if limit else np.nonzero(s > -np.inf)
            if least is not None:
                good = ~(s[i, j] < least)
                i, j = i[good], j[good]
            parts.append((i + low, j, s[i, j]))
        i, j, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.float64 if k == 2 else np.int64) for k in range(3))
        return pa.table([a[c].take(pa.array(j)) for c in keep_i] + [b[c].take(pa.array(i)) for c in keep_q] + [pa.array(s)], names=[*keep_i, *keep_q, "similarity"])

    return left.groupBy("_tile", "_block").cogroup(right.groupBy("_tile", "_block")).applyInArrow(met, schema)
