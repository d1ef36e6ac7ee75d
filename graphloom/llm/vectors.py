"""The k most similar vectors of every vector.

Additive quantisation: a vector is approximated by the sum of one codeword from
each of several full-dimensional codebooks, fitted to residuals and chosen
together by a beam search.  A coarse codebook, extended by the first codes when
the collection outgrows it, divides the collection into cells, so that cells
keep their size while their number grows.  A query visits the cells of its
nearest partial sums.  There the inner products with all codewords are looked
up in tables and summed over the codes of every member, and the best candidates
are ranked again by their true vectors.

Which members are ranked again depends on what is sought.  For neighbours of at
least some cosine, every member is that may reach it: with x the vector, y its
approximation and a query q of cosine c to x, the Cauchy-Schwarz inequality in
the space across x gives ``q.y >= c (x.y) - sqrt(1 - c^2) sqrt(|y|^2 - (x.y)^2)``,
where both norms are stored with the member.  No such member is lost in a cell
that is visited.  Without a least cosine, the ``rerank`` members of a cell with
the greatest looked-up cosine are.

Where a query has found ``k`` neighbours of cosine ``dense`` or more it lies in
a dense group, whose members look alike to the quantiser: it then visits every
cell again that distance bounds do not rule out for anything better than its
k-th neighbour, and all members there that may be better are ranked.  With ``exact`` all queries do, which makes the result exact
and the work quadratic where vectors have no close neighbours.

Codebooks are fitted on a bounded sample; every vector is encoded and is a query.
Copies of one vector are one member, with the least vids that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.scratch import materialise

SAMPLE = 20_000
MAX_COARSE = 4096
MAX_CELLS = 1 << 22
UNIT = 4096  # members searched together
_ASKS = 1 << 18  # visits of cells by queries per task


@dataclass(frozen=True)
class Codebooks:
    """``coarse`` (cells x d) and ``fine`` (levels x codewords x d)."""

    coarse: np.ndarray
    fine: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Indices of the ``n`` nearest centres, the nearest first."""
    half = 0.5 * (centres * centres).sum(1)
    out = np.empty((len(x), n), np.int32)
    for lo in range(0, len(x), 2048):
        score = half - x[lo : lo + 2048] @ centres.T
        if n == 1:
            out[lo : lo + 2048, 0] = score.argmin(1)
        else:
            top = np.argpartition(score, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(score), 1))
            out[lo : lo + 2048] = np.take_along_axis(top, np.take_along_axis(score, top, 1).argsort(1), 1)
    return out


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means; an empty cluster is moved to a random vector."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(k))
        n = np.bincount(own, minlength=k)
        filled = n > 0
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        centres[filled] = sums[filled] / n[filled, None]
        if len(x) > k:
            centres[~filled] = x[rng.integers(0, len(x), int((~filled).sum()))]
    return centres


def fit(sample: np.ndarray, cells: int, levels: int = 4, codewords: int = 64, seed: int = 3) -> Codebooks:
    """Codebooks for unit vectors: cells first, then one codebook per level of residuals."""
    rng = np.random.default_rng(seed)
    sample = np.ascontiguousarray(sample, np.float32)
    coarse = _centres(sample, cells, rng)
    rest = sample - coarse[_nearest(sample, coarse)[:, 0]]
    fine = np.zeros((levels, codewords, sample.shape[1]), np.float32)
    for m in range(levels):
        fine[m] = _centres(rest, codewords, rng, 6)
        rest = rest - fine[m][_nearest(rest, fine[m])[:, 0]]
    return Codebooks(coarse, fine)


def encode(x: np.ndarray, books: Codebooks, beam: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, codes and approximation of each vector: the best sum that a beam of partial sums finds."""
    n = len(x)
    cell = _nearest(x, books.coarse)[:, 0]
    rest = (x - books.coarse[cell])[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books.fine:
        width, k = rest.shape[1], len(book)
        # squared error of each partial sum extended by each codeword
        err = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
        flat = err.reshape(n, width * k)
        keep = min(beam, width * k)
        top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(keep), (n, 1))
        top = np.take_along_axis(top, np.take_along_axis(flat, top, 1).argsort(1), 1)
        parent, code = top // k, top % k
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None].astype(np.uint8)], 2)
    return cell, codes[:, 0], x - rest[:, 0]


def _matrix(blobs: pd.Series, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(-1, width)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, as float64; the length is taken from the vector itself."""
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _bounds(x: np.ndarray, coarse: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance that a member of each cell can have from each of ``x``; ``cell`` is the cell of ``x``.

    Members are between ``low`` and ``high`` away from their centre, and on
    their side of the plane halfway to the centre of ``x``, but for rounding.
    """
    x, c = x.astype(np.float64), coarse.astype(np.float64)
    square = (c * c).sum(1)
    d2 = np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + square, 0)
    apart = np.sqrt(np.maximum(square[cell][:, None] - 2 * (c[cell] @ c.T) + square, 1e-12))
    plane = (d2 - d2[np.arange(len(x)), cell][:, None] - 2e-5) / (2 * apart)
    d = np.sqrt(d2)
    return np.maximum(plane, np.maximum(d - high, low - d))


def _units(coarse: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each cell: neighbouring cells share a unit of at most ``block``, a larger cell has several.

    ``sizes`` has the cells of each coarse codeword in a row.
    """
    near = _nearest(coarse, _centres(coarse, min(len(coarse), ceil(sizes.sum() / block)), np.random.default_rng(3)))[:, 0]
    each = len(sizes) // len(coarse)
    first, count = np.zeros(len(sizes), np.int32), np.maximum(-(-sizes // block), 1).astype(np.int32)
    unit, room = -1, 0
    for c in (np.argsort(near, kind="stable")[:, None] * each + np.arange(each)).ravel().tolist():
        if count[c] > 1:
            first[c], unit, room = unit + 1, unit + count[c], 0
        else:
            if sizes[c] > room or unit < 0:
                unit, room = unit + 1, block
            first[c] = unit
            room -= sizes[c]
    return first, count


def _visits(x: np.ndarray, books: Codebooks, depth: int, n: int) -> np.ndarray:
    """The ``n`` cells whose sums of coarse and first codewords are nearest to each vector, found by a beam of ``n``."""
    cells = _nearest(x, books.coarse, min(n, len(books.coarse)))
    if not depth:
        return cells
    rest = x[:, None, :] - books.coarse[cells]
    cells = cells.astype(np.int64)
    for book in books.fine[:depth]:
        width, k = rest.shape[1], len(book)
        err = ((rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)).reshape(len(x), width * k)
        keep = min(n, width * k)
        top = np.argpartition(err, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(keep), (len(x), 1))
        parent, code = top // k, top % k
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
        cells = np.take_along_axis(cells, parent, 1) * k + code
    return cells


@dataclass(frozen=True)
class _Members:
    """The members of one unit, sorted by cell."""

    ids: np.ndarray
    vids: list
    exact: np.ndarray
    codes: np.ndarray
    norm: np.ndarray
    along: np.ndarray  # inner product of vector and approximation
    across: np.ndarray  # length of the approximation across the vector
    cells: np.ndarray
    starts: np.ndarray


def _candidates(m: _Members, q: np.ndarray, bars: np.ndarray, wanted: list, books: Codebooks, each: int, rerank: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) to rank by true vectors: looked-up inner products of the cells each query visits."""
    tables = [q @ book.T for book in books.fine]
    lens = np.array([len(m.cells) if w is None else len(w) for w in wanted])
    cell = np.concatenate([m.cells if w is None else w for w in wanted]) if lens.sum() else np.empty(0, np.int64)
    asked = np.repeat(np.arange(len(q)), lens)
    spot = np.searchsorted(m.cells, cell)
    there = spot < len(m.cells)
    there[there] = m.cells[spot[there]] == cell[there]
    asked, spot = asked[there], spot[there]
    order = np.argsort(spot, kind="stable")
    asked, spot = asked[order], spot[order]
    far = np.sqrt(np.maximum(1 - bars * bars, 0))
    rows, cols = [], []
    cuts = np.flatnonzero(np.append(True, np.diff(spot) != 0)) if len(spot) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(spot)]):
        at, who = spot[lo], asked[lo:hi]
        part = slice(m.starts[at], m.starts[at + 1])
        codes = m.codes[part]
        score = np.repeat((q[who] @ books.coarse[m.cells[at] // each])[:, None], len(codes), 1)
        for level, table in enumerate(tables):
            score += np.take(table[who], codes[:, level], axis=1)
        bounded = bars[who] >= 0
        if bounded.any():
            b = np.flatnonzero(bounded)
            least = bars[who[b], None].astype(np.float32) * m.along[part] - far[who[b], None].astype(np.float32) * m.across[part] - np.float32(1e-4)
            hit = (score[b] >= least) | (m.along[part] <= 0)
            r, c = np.nonzero(hit)
            rows.append(who[b[r]])
            cols.append(c + part.start)
        if not bounded.all():
            b = np.flatnonzero(~bounded)
            n = len(codes) if rerank is None else min(rerank, len(codes))
            top = np.argpartition(-score[b] / m.norm[part], n - 1, axis=1)[:, :n] if n < len(codes) else np.tile(np.arange(n), (len(b), 1))
            rows.append(np.repeat(who[b], n))
            cols.append(top.ravel() + part.start)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def _best(m: _Members, own: np.ndarray, q: np.ndarray, bars: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k + 1`` best vids of each query among its candidates, if their true cosine reaches the query's bar."""
    sizes = np.array([len(v) for v in m.vids])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(m.vids)
    take = (own[row] != m.ids[col]) | (sizes[col] > 1)
    row, col = row[take], col[take]
    cosine = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        cosine[part] = np.einsum("ij,ij->i", q[row[part]], m.exact[col[part]])
    take = cosine >= bars[row]
    row, col, cosine = row[take], col[take], cosine[take]
    # few members of a row are needed; those below its k + 1 best members are not
    order = np.lexsort((m.ids[col], -cosine, row))
    row, col, cosine = row[order], col[order], cosine[order]
    first = np.searchsorted(row, row)
    keep = cosine >= cosine[np.minimum(first + k, np.searchsorted(row, row, "right") - 1)]
    row, col, cosine = row[keep], col[keep], cosine[keep]
    each = np.repeat(np.arange(len(row)), sizes[col])
    nth = np.arange(len(each)) - np.repeat(np.cumsum(sizes[col]) - sizes[col], sizes[col])
    row, other, cosine = row[each], flat[starts[col][each] + nth], cosine[each]
    order = np.lexsort((other, -cosine, row))
    row, other, cosine = row[order], other[order], cosine[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) <= k
    return pd.DataFrame({"vid": own[row[keep]], "other": other[keep], "cosine": cosine[keep]})


def _search_units(batches: Iterator[pd.DataFrame], books, each: int, k: int, rerank: int | None, dim: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by work unit, members by cell before queries; members of a unit are bounded, queries stream."""
    levels = len(books.value.fine)
    current, members, ready = None, [], None

    def prepare() -> _Members:
        pdf = pd.concat(members)
        cell = pdf["cell"].to_numpy()
        starts = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        f32 = {c: pdf[c].to_numpy(np.float32) for c in ("norm", "along", "across")}
        return _Members(pdf["vid"].to_numpy(), pdf["vids"].to_list(), _unit(_matrix(pdf["vector"], np.float32, dim)), _matrix(pdf["codes"], np.uint8, levels), **f32, cells=cell[starts], starts=np.append(starts, len(cell)))

    for batch in batches:
        unit = batch["work"].to_numpy()
        role = batch["role"].to_numpy()
        cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (role[1:] != role[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(unit)]):
            if hi == lo:
                continue
            part = batch.iloc[lo:hi]
            if unit[lo] != current:
                current, members, ready = unit[lo], [], None
            if role[lo] == 0:
                members.append(part)
                continue
            if not members:
                continue
            ready = ready or prepare()
            for at in range(0, len(part), 2048):
                some = part.iloc[at : at + 2048]
                own, bars, q = some["vid"].to_numpy(), some["bar"].to_numpy(), _unit(_matrix(some["vector"], np.float32, dim))
                row, col = _candidates(ready, q.astype(np.float32), bars, some["cells"].to_list(), books.value, each, rerank)
                yield _best(ready, own, q, bars, row, col, k)


def usable_vectors(nodes: DataFrame, dim: int = 64, vid: str = "vid", vector: str = "vector", deleted: str = "deleted", seen: str = "indexed_at") -> DataFrame:
    """``vid`` and ``vector`` (array<float>) of the states that count.

    The state with the greatest ``seen`` of a vid counts (ties by the vector).
    Nodes that are deleted (null is not), and vectors that are null, of another
    size than ``dim``, hold a null, NaN or infinity, or are all zero, are left
    out, and so are rows without a vid.
    """
    state = F.struct(F.col(seen).alias("seen"), F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"), F.col(vector).cast("array<float>").alias("vector"))
    latest = nodes.select(F.col(vid).cast("bigint").alias("vid"), state.alias("s")).where("vid is not null").groupBy("vid").agg(F.max("s").alias("s"))
    fine = F.forall("s.vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("s.vector", lambda x: x != 0)
    return latest.where(~F.col("s.deleted") & (F.size("s.vector") == dim) & fine).select("vid", F.col("s.vector").alias("vector"))


def _bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of float32; zeros have no sign, so that equal vectors are equal bytes."""
    for b in batches:
        if len(b):
            x = np.stack(b["vector"].to_numpy()).astype(np.float32) + np.float32(0)
            yield pd.DataFrame({"vid": b["vid"], "vector": [r.tobytes() for r in x]})


def _bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of float32; zeros have no sign, so that equal vectors are equal bytes."""
    for b in batches:
        if len(b):
            x = np.stack(b["vector"].to_numpy()).astype(np.float32) + np.float32(0)
            yield pd.DataFrame({"vid": b["vid"], "vector": [r.tobytes() for r in x]})


_FOUND = "vid bigint, other bigint, cosine double"
_ASK = "unit int, vid bigint, vector binary, bar double, cells array<bigint>"
_ROW = "work bigint, role int, vid bigint, vids array<bigint>, vector binary, codes binary, norm float, along float, across float, cell bigint, bar double, cells array<bigint>"
_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def nearest(
    vectors: DataFrame, k: int = 5, dim: int = 64, probes: int = 16, rerank: int = 64, cell_size: int = 256, levels: int = 8, codewords: int = 64, beam: int = 4, unit: int = UNIT,
    sample: int = SAMPLE, least: float = -2.0, dense: float = 0.9, exact: bool = False, max_coarse: int = MAX_COARSE,
) -> DataFrame:
    """``vid``, ``other``, ``cosine``: the ``k`` most similar other vectors of each ``vid`` (ties by the smaller vid).

    ``vectors`` has unique ``vid`` and usable ``vector``; other columns are
    ignored.  Equal vectors are neighbours of cosine 1 like any others.  There
    are ``n / cell_size`` cells, at most ``MAX_CELLS``; a cell of more than
    ``unit`` members is searched in blocks, and the queries of a unit that is
    asked very often are split.  Neighbours below the cosine ``least`` are not
    sought.  The result may miss neighbours in cells that are not visited (and
    without ``least`` members beyond ``rerank`` in a cell), unless ``exact``;
    ``recall`` measures how many.  No vectors, or one, give no rows.
    """
    spark: SparkSession = vectors.sparkSession
    raw = materialise(vectors.select("vid", "vector").mapInPandas(_bytes, "vid bigint, vector binary"), "raw")
    if len(raw.head(2)) < 2:
        return spark.createDataFrame([], _FOUND)
    # a member stands for all copies; beyond k + 1 vids no more of them can be neighbours
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vid"))
    least_vids = raw.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vid")).alias("vids"))
    distinct = materialise(least_vids.select(F.col("vids")[0].alias("vid"), "vids", "vector"), "distinct")
    n = distinct.count()
    drawn = distinct.select("vector").orderBy(F.xxhash64("vid"), F.col("vids")[0]).limit(sample).toPandas()
    top, depth = max(1, min(max_coarse, len(drawn) // 8)), 0
    while n > cell_size * top * codewords**depth and depth < levels and top * codewords ** (depth + 1) <= MAX_CELLS:
        depth += 1
    each = codewords**depth
    n_coarse = max(1, min(top, ceil(n / cell_size / each)))
    books = fit(_unit(_matrix(drawn["vector"], np.float32, dim)), n_coarse, levels, codewords)
    shared = spark.sparkContext.broadcast(books)  # at most (MAX_COARSE + levels * codewords) * dim floats
    n_cells = n_coarse * each
    visit = min(probes, n_cells)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 2048):
                part = b.iloc[lo : lo + 2048]
                true = _unit(_matrix(part["vector"], np.float32, dim))
                x = true.astype(np.float32)
                coarse, codes, near = encode(x, shared.value, beam)
                norm, along = np.linalg.norm(near.astype(np.float64), axis=1), (true * near).sum(1)
                across = np.sqrt(np.maximum(norm * norm - along * along, 0)) + 1e-5
                away = np.linalg.norm(x.astype(np.float64) - shared.value.coarse[coarse], axis=1)
                cell = coarse.astype(np.int64)
                for level in range(depth):
                    cell = cell * codewords + codes[:, level]
                yield pd.DataFrame({
                    "vid": part["vid"].to_numpy(), "vids": part["vids"].to_numpy(), "vector": part["vector"].to_numpy(), "cell": cell, "away": away, "codes": [c.tobytes() for c in codes],
                    "norm": np.maximum(norm, 1e-6), "along": along, "across": across, "visits": list(_visits(x, shared.value, depth, visit)),
                })

    index = materialise(distinct.mapInPandas(encoded, "vid bigint, vids array<bigint>, vector binary, cell bigint, away double, codes binary, norm float, along float, across float, visits array<bigint>"), "index")
    known = index.groupBy("cell").agg(F.count("*").alias("m"), F.min("away").alias("low"), F.max("away").alias("high")).toPandas()  # at most MAX_CELLS rows
    size = np.zeros(n_cells, np.int64)
    size[known["cell"]] = known["m"]
    # all members of a coarse codeword are between low and high away from it
    low, high = np.full(n_coarse, np.inf), np.zeros(n_coarse)
    np.minimum.at(low, known["cell"] // each, known["low"] - 1e-5)
    np.maximum.at(high, known["cell"] // each, known["high"] + 1e-5)
    first, count = _units(books.coarse, size, unit)
    n_units = int((first + count).max())
    plan = spark.sparkContext.broadcast((first, count, size > 0, low, high))  # at most MAX_CELLS rows

    def searched(asks: DataFrame, load: np.ndarray) -> DataFrame:
        """The best of each query in each unit it asks; ``load``: visits of cells per unit."""
        parts = np.maximum(-(-load // _ASKS), 1)
        base = np.cumsum(parts) - parts
        work = spark.sparkContext.broadcast((base, parts))  # one row a unit

        def members_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, count = plan.value[:2]
            base, parts = work.value
            for b in batches:
                cell = b["cell"].to_numpy()
                own = first[cell] + b["salt"].to_numpy() % count[cell]
                times = np.repeat(np.arange(len(b)), parts[own])
                nth = np.arange(len(times)) - np.repeat(np.cumsum(parts[own]) - parts[own], parts[own])
                out = b.iloc[times].drop(columns="salt")
                yield out.assign(work=base[own[times]] + nth, role=0, bar=0.0, cells=None)[_ROW_NAMES]

        def asked_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base, parts = work.value
            for b in batches:
                own = b["unit"].to_numpy()
                empty = dict.fromkeys(("vids", "codes", "cells"))
                out = pd.DataFrame({"work": base[own] + b["salt"].to_numpy() % parts[own], "role": 1, "vid": b["vid"], "vector": b["vector"], "bar": b["bar"], "norm": 0.0, "along": 0.0, "across": 0.0, "cell": -1, **empty})
                yield out.assign(cells=b["cells"])[_ROW_NAMES]

        salt = F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(1 << 30)).alias("salt")
        members = index.select("vid", "vids", "vector", "codes", "norm", "along", "across", "cell", salt).mapInPandas(members_of, _ROW)
        rows = members.unionByName(asks.select("*", salt).mapInPandas(asked_of, _ROW))
        tasks = int(min(max(parts.sum(), 1), 10_000))
        placed = rows.repartitionById(tasks, F.pmod("work", F.lit(tasks)).cast("int")).sortWithinPartitions("work", "role", "cell")
        return placed.mapInPandas(lambda it: _search_units(it, shared, each, k, rerank, dim), _FOUND)

    def grouped(vid: np.ndarray, vector: pd.Series, bar: np.ndarray, row: np.ndarray, cell: np.ndarray) -> Iterator[pd.DataFrame]:
        """One row for each query and unit, with the cells to visit there; all blocks of a cell in several units."""
        first, count = plan.value[:2]
        times = np.repeat(np.arange(len(cell)), count[cell])
        nth = np.arange(len(times)) - np.repeat(np.cumsum(count[cell]) - count[cell], count[cell])
        row, cell, own = row[times], cell[times], first[cell[times]] + nth
        order = np.lexsort((cell, own, row))
        row, cell, own = row[order], cell[order], own[order]
        cuts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(own) != 0)))
        if len(row):
            yield pd.DataFrame({"unit": own[cuts], "vid": vid[row[cuts]], "vector": vector.to_numpy()[row[cuts]], "bar": bar[row[cuts]], "cells": np.split(cell, cuts[1:])})

    def first_asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                visits = np.stack(b["visits"].to_numpy())
                yield from grouped(b["vid"].to_numpy(), b["vector"], np.full(len(b), float(least)), np.repeat(np.arange(len(b)), visits.shape[1]), visits.ravel())

    visits = index.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # at most MAX_CELLS rows
    load = np.bincount(first[visits["cell"]], visits["n"], n_units).astype(np.int64)
    for c in np.flatnonzero(count > 1):  # blocks of one cell are asked alike
        load[first[c] : first[c] + count[c]] = load[first[c]]
    found = searched(index.select("vid", "vector", "visits").mapInPandas(first_asks, _ASK), load)
    best = Window.partitionBy("vid").orderBy(F.desc("cosine"), "other")
    whole = least >= 0  # then visited cells need no second look
    if visit < n_cells or not whole:
        found = materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank"), "found")
        # the k-th other vid of every copy is at least this near; copies are not rows of their own here
        reached = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("vid", (F.col("cosine") - 1e-6).alias("reached"))
        bar = F.greatest(F.when(F.size("vids") > k, 1.0 - 1e-9).otherwise(F.coalesce("reached", F.lit(-2.0))), F.lit(float(least)))
        again = index.join(reached, "vid", "left").select("vid", "vector", "cell", "visits", bar.alias("bar"), ((F.size("vids") > k) | (F.coalesce("reached", F.lit(-2.0)) >= dense)).alias("dense"))
        again = again.where("true" if exact else "dense")

        def more_asks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, _, filled, low, high = plan.value
            for b in batches:
                for lo in range(0, len(b), 512):
                    part = b.iloc[lo : lo + 512]
                    bars = part["bar"].to_numpy()
                    x = _unit(_matrix(part["vector"], np.float32, dim)).astype(np.float32)
                    # with float32 rounding, the distance at which a vector has the cosine of the bar
                    far = np.sqrt(np.maximum(2 - 2 * bars, 0) + 4e-5)
                    near = _bounds(x, shared.value.coarse, part["cell"].to_numpy() // each, low, high) <= far[:, None]
                    near = np.repeat(near, each, axis=1) & filled
                    if whole:
                        np.put_along_axis(near, np.stack(part["visits"].to_numpy()), False, 1)
                    yield from grouped(part["vid"].to_numpy(), part["vector"], bars, *np.nonzero(near))

        asks = materialise(again.drop("dense").mapInPandas(more_asks, _ASK), "asks")
        asked = asks.groupBy("unit").agg(F.sum(F.size("cells")).alias("n")).toPandas()  # one row a unit
        if len(asked):
            load = np.bincount(asked["unit"], asked["n"], n_units).astype(np.int64)
            found = found.unionByName(searched(asks, load)).dropDuplicates(["vid", "other"])
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    near = found.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("near"))
    alike = raw.join(distinct.select(F.col("vid").alias("rep"), "vector"), "vector").select("rep", F.col("vid").alias("own"))
    out = alike.join(near, F.col("rep") == F.col("vid")).select("own", F.explode(F.expr(f"slice(filter(near, x -> x.other <> own), 1, {k})")).alias("x"))
    return out.select(F.col("own").alias("vid"), F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine")).where(F.col("cosine") >= least)


def recall(vectors: DataFrame, found: DataFrame, queries: DataFrame, k: int = 5, least: float = -2.0, dim: int = 64, block: int = 20_000) -> DataFrame:
    """``n_queries``, ``n_true``, ``n_found``, ``recall`` of ``found`` (as from ``nearest``) by brute force, for the ``queries`` (``vid``).

    Queries are ranked against all ``vectors`` in blocks of bounded number, so
    neither side is held whole.  A neighbour counts as found if its cosine
    reaches that of the true k-th neighbour.
    """
    spark = vectors.sparkSession
    raw = materialise(vectors.select("vid", "vector").mapInPandas(_bytes, "vid bigint, vector binary"), "recall")
    asked = materialise(queries.select("vid").join(raw, "vid").withColumn("nth", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("vid"), F.lit(64))).orderBy("vid"))), "queries")
    n = asked.count()
    parts = max(1, ceil(n / block))
    truth: DataFrame | None = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("vid", F.lit(2)), F.lit(parts)) == part).select("vid", "vector").toPandas()
        if not len(some):
            continue
        held = spark.sparkContext.broadcast((some["vid"].to_numpy(), _unit(_matrix(some["vector"], np.float32, dim))))  # about ``block`` rows

        def ranked(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for b in batches:
                if not len(b):
                    continue
                own, x = b["vid"].to_numpy(), _unit(_matrix(b["vector"], np.float32, dim))
                for lo in range(0, len(q), 512):
                    score = q[lo : lo + 512] @ x.T
                    score[ids[lo : lo + 512, None] == own] = -np.inf
                    m = min(k, len(own))
                    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    row, value = np.repeat(np.arange(len(score)), m), np.take_along_axis(score, top, 1).ravel()
                    keep = np.isfinite(value) & (value >= least)
                    yield pd.DataFrame({"vid": ids[lo : lo + 512][row[keep]], "other": own[top.ravel()[keep]], "cosine": value[keep]})

        step = raw.mapInPandas(ranked, _FOUND)
        truth = step if truth is None else truth.unionByName(step)
    if truth is None:
        return spark.createDataFrame([(0, 0, 0, None)], "n_queries bigint, n_true bigint, n_found bigint, recall double")
    order = Window.partitionBy("vid").orderBy(F.desc("cosine"), "other")
    top = materialise(truth.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "truth")
    bar = top.groupBy("vid").agg(F.count("*").alias("n"), (F.min("cosine") - 1e-9).alias("bar"))
    hits = found.join(bar, "vid").where(F.col("cosine") >= F.col("bar")).groupBy("vid").agg(F.count("*").alias("hits"))
    per = bar.join(hits, "vid", "left").agg(F.sum("n").alias("n_true"), F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")).alias("n_found"))
    return per.select(F.lit(n).cast("bigint").alias("n_queries"), "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))
