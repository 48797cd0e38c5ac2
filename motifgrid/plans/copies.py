"""Positions whose best partner is a copy of their own window.

Two windows with the same differences between their values have the greatest
correlation there is (1 but for rounding), so a position with an admissible copy
needs no search: the copy is its best partner, unless another window is as good.
That takes a window that is nearly proportional to it (correlation within 5e-13
of 1), and such windows are close in every normalised value: they share a cell
of a fine grid over four of these. Windows that share a cell with another class are
doubtful and get no partner here. All the rest is one pass: windows are grouped by
a digest of their differences, and each position takes its least admissible copy.

This holds for exact whole values only, where equal windows give equal doubles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifgrid.sources.generate import draw
from motifgrid.storage import discard, materialize, ship_package

from .kernel import sliding

#: Width of the grid's cells, and how near to a border a value belongs to both sides (windows within 5e-13 differ by 1e-6 at most).
CELL, NEAR = 1e-4, 1.02e-6
#: Rows of a class that a task holds; tiles of a class that are tried for an early profile before it is searched in full.
HELD, TRIES = 1 << 20, 64


def digested(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of the complete windows of whole values: places, digests (two numbers), correlation with a copy, and the grid's cells.

    Cells are pairs of rows (of these arrays) and numbers, a row more than once near a border;
    constant windows, whose only equals are constant, have none.
    """
    bad = np.isnan(x)
    v = np.where(bad, 0.0, x).astype(np.int64)
    at = np.flatnonzero(sliding(bad.astype(np.int64), m) == 0)
    s, spread = sliding(v, m), m * sliding(v * v, m) - sliding(v, m) ** 2
    s, spread = s[at].astype(float), spread[at].astype(float)
    raw = memoryview(np.diff(v).astype(np.int32).tobytes())
    width = 4 * (m - 1)
    h = np.frombuffer(b"".join([blake2b(raw[4 * k : 4 * k + width], digest_size=16).digest() for k in at.tolist()]), "<i8").reshape(-1, 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(spread)
        r = np.where(spread > 0, spread / (sd * sd), 1.0)
        rows = np.flatnonzero(spread > 0)
        places = (0, m // 3, 2 * m // 3, m - 1)
        z = np.stack([(v[at[rows] + k] - s[rows] / m) * np.sqrt(m) / sd[rows] for k in places]) / CELL + 0.37
    level = np.floor(z)
    part, level = z - level, level.astype(np.int64) + (1 << 14)
    other = np.where(part < NEAR / CELL, -1, np.where(part > 1 - NEAR / CELL, 1, 0))
    shift = np.array([45, 30, 15, 0])
    base, cells = (level << shift[:, None]).sum(axis=0), []
    for chosen in range(16):
        of = [k for k in range(4) if chosen >> k & 1]
        there = np.flatnonzero((other[of] != 0).all(axis=0)) if of else np.arange(len(rows))
        if len(there):
            cells.append((rows[there], base[there] + (other[of][:, there] << shift[of][:, None]).sum(axis=0)))
    return at, h, r, cells


def windows(blocked: DataFrame, m: int, size: int) -> DataFrame:
    """``pos, h1, h2, r, cell`` of every complete window of blocks ``b, a``, written once; further cells of a window have no ``pos``."""
    ship_package(blocked.sparkSession)
    names = ["pos", "h1", "h2", "r", "cell"]

    def batch(pos, h, r, cell, lone=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pos, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(r), pa.array(cell, mask=lone)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for k, b in enumerate(got.column(0).to_pylist()):
                at, h, r, cells = digested(got.column(1)[k].values.to_numpy(zero_copy_only=False), m)
                cell, lone = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for rows, number in cells[:1]:
                    cell[rows], lone[rows] = number, False
                yield batch(pa.array(at + b * size), h, r, cell, lone)
                for rows, number in cells[1:]:
                    yield batch(pa.nulls(len(rows), pa.int64()), h[rows], r[rows], number)

    return materialize(blocked.select("b", "a").mapInArrow(run, "pos bigint, h1 bigint, h2 bigint, r double, cell bigint"), "windows")


def doubtful(found: DataFrame) -> DataFrame:
    """``h1, h2`` of the classes that share a cell with another one, written once."""
    cells = found.filter("cell IS NOT NULL").select("cell", "h1", "h2")
    ends = cells.groupBy("cell").agg(F.min("h1").alias("a1"), F.max("h1").alias("z1"), F.min("h2").alias("a2"), F.max("h2").alias("z2"))
    return materialize(cells.join(ends.filter("a1 <> z1 OR a2 <> z2").select("cell"), "cell", "left_semi").select("h1", "h2").distinct(), "doubtful")


def kept_tiles(t: np.ndarray, u: np.ndarray, fraction: float, seed: int) -> np.ndarray:
    """Whether an early profile evaluates the tiles of the block numbers, given in any order."""
    pairs, back = np.unique(np.stack([np.minimum(t, u), np.maximum(t, u)]), axis=1, return_inverse=True)
    return np.array([draw(seed, a, b) < fraction for a, b in zip(*pairs.tolist())], bool)[back.reshape(-1)]


def least_partners(cid: np.ndarray, pos: np.ndarray, upto: int, lead: int | None, band: int, half: str, early: tuple[int, float, int] | None) -> np.ndarray:
    """The least admissible copy of the first ``upto`` rows, -1 where there is none here.

    Rows are classes in order, each with its positions in order; ``lead`` is the first
    position of class 0 where that began in earlier rows.
    """
    new = np.concatenate([[True], cid[1:] != cid[:-1]])
    first = pos[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
    if lead is not None:
        first[cid == 0] = lead
    key, out = (cid << 40) + pos, np.full(upto, -1)
    if half == "left":
        return np.where(first[:upto] < pos[:upto] - band, first[:upto], -1)

    def after(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first of the rows' class from a position on, -1 without any."""
        k = np.searchsorted(key, (cid[rows] << 40) + least)
        there = np.minimum(k, len(key) - 1)
        return np.where((k < len(key)) & (cid[there] == cid[rows]), pos[there], -1)

    rows = np.arange(upto)
    if early and lead is not None:
        rows = rows[cid[:upto] != 0]
    found = after(rows, pos[rows] + band + 1) if half == "right" else first[rows]
    for _ in range(TRIES):
        rows, found = rows[found >= 0], found[found >= 0]
        if not len(rows):
            break
        near = np.abs(found - pos[rows]) <= band
        good, least = ~near, pos[rows] + band + 1
        if early:
            size, fraction, seed = early
            good[~near] = kept_tiles(pos[rows[~near]] // size, found[~near] // size, fraction, seed)
            least = np.where(near, least, (found // size + 1) * size)
        out[rows[good]] = found[good]
        rows = rows[~good]
        found = after(rows, least[~good])
    return out


def partners(found: DataFrame, doubt: DataFrame, band: int, half: str = "both", early: tuple[int, float, int] | None = None) -> DataFrame:
    """``pos, r, nn`` of every window without doubt: its least admissible copy, ``nn`` null where it has none.

    ``early`` (tile size, fraction, seed) admits only pairs in the tiles that an early profile evaluates. A
    task holds ``HELD`` rows and one batch, however large a class is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, None

        def out(upto: int) -> pa.RecordBatch:
            h1, h2, pos, r = held
            cid = np.cumsum(np.concatenate([[0], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])).astype(np.int64)
            nn = least_partners(cid, pos, upto, lead, band, half, early)
            return pa.RecordBatch.from_arrays([pa.array(pos[:upto]), pa.array(r[:upto]), pa.array(nn, mask=nn < 0)], names=["pos", "r", "nn"])

        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(4)]
            held = part if held is None else [np.concatenate(v) for v in zip(held, part)]
            if not len(held[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            done, goes_on = (int(last[-1]) + 1 if len(last) else 0), None
            if not done and len(held[0]) > HELD:  # one class: what has a copy beyond its band here is settled
                done, goes_on = int(np.searchsorted(held[2], held[2][-1] - band)), held[2][0] if lead is None else lead
            if done:
                yield out(done)
                held, lead = [v[done:] for v in held], goes_on
        if held is not None and len(held[0]):
            yield out(len(held[0]))

    sure = found.filter("pos IS NOT NULL").join(doubt, ["h1", "h2"], "left_anti").select("h1", "h2", "pos", "r")
    return sure.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "pos").mapInArrow(run, "pos bigint, r double, nn bigint")


def settled(blocked: DataFrame, m: int, band: int, size: int, half: str = "both", early: tuple[int, float, int] | None = None) -> tuple[DataFrame, list[int]]:
    """``pos, r, nn`` of the positions whose best partner is a copy, and the numbers of the blocks that hold any other window."""
    found = windows(blocked, m, size)
    doubt = doubtful(found)
    own = materialize(partners(found, doubt, band, half, early), "partners")
    block = F.expr(f"pos div {size}").alias("b")
    left = own.filter("nn IS NULL").select(block).unionByName(found.filter("pos IS NOT NULL").join(doubt, ["h1", "h2"], "left_semi").select(block))
    rest = sorted(r["b"] for r in left.distinct().collect())  # one for each block at most
    discard(found)
    discard(doubt)
    return own.filter("nn IS NOT NULL"), rest
