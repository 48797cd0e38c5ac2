"""SimHash near-duplicates over a Gray-order hierarchical index.

1. Every text gets a 64-bit SimHash of its word shingles (each shingle counts
   as often as it occurs; a bit is 1 if more than half of the hashes have it).
2. Equal fingerprints collapse first (partial aggregation), so a group of exact
   copies is one row from here on, however large.
3. The 64 bits are cut into ``bits + 1`` masked parts. Two fingerprints within
   ``bits`` differing bits agree on one part at least, so each part's masked
   pattern is an upper node of the index and rows are dealt out by
   ``(mask, pattern)``. A node with more rows than ``node_rows`` is split again
   over its free bits in the same way (exact: the pair still agrees on a part),
   to at most 2^19 rows, so no task holds an unbounded node.
4. Inside a node the fingerprints are sorted by Gray rank, so neighbours share
   long bit patterns; runs of ``FANOUT`` fold into parent nodes that keep the
   bits common to all members (mask and pattern). Two sub-trees are compared by
   the differences of their common bits: over ``bits``, the whole group pair is
   pruned; else their children are compared. What reaches the leaves is a link.
5. A node emits a spanning forest of its links (never all pairs). Alternating
   large-star and small-star rounds on written tables join the forests into
   components.

Edge cases: a null text counts as empty; an empty text has fingerprint zero,
which links like any other; fewer words than the width make one shingle; rows
repeated with the same id get equal rows back; null ids never become a
component's id unless no member has an id; an empty table gives an empty
result. Only the id and text columns are read, so clashing extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, passing, ship_package, whole

#: Children of an index node.
FANOUT = 8
#: Words of a shingle and differing bits of a link.
WIDTH, BITS = 3, 2
#: Largest node that is searched without splitting it over its free bits.
NODE_ROWS = 20_000
#: Node pairs compared at once.
CHUNK = 1 << 19
_SEED = 42


# --- fingerprints -------------------------------------------------------------------------


def simhash(text: str, width: int = WIDTH) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned integer."""
    words = text.encode("utf-8", "replace").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], _SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row; narrow, no shuffle."""

    def make():
        def run(columns):
            ids, texts = columns
            return [ids, np.array([simhash(x, width) for x in texts], np.uint64).view(np.int64)]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), make, f"doc_id {kind}, fp bigint")


# --- the index inside a node --------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _levels(fps: np.ndarray, nodes: np.ndarray) -> list[dict]:
    """From the leaves up to one root for each node: first child, child count, common-bit mask and pattern."""
    n = len(fps)
    levels = [{"of": nodes, "all": fps, "any": fps, "first": np.arange(n), "count": np.ones(n, np.int64)}]
    while True:
        of = levels[-1]["of"]
        change = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        if len(change) == len(of):
            return levels
        start = np.repeat(change, np.diff(np.r_[change, len(of)]))
        first = np.flatnonzero((np.arange(len(of)) - start) % FANOUT == 0)
        levels.append({"of": of[first], "all": np.bitwise_and.reduceat(levels[-1]["all"], first), "any": np.bitwise_or.reduceat(levels[-1]["any"], first), "first": first, "count": np.diff(np.r_[first, len(of)])})


def _children(level: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b), each unordered pair once."""
    na, nb = level["count"][a], level["count"][b]
    each = na * nb
    at = np.repeat(np.arange(len(a)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    x, y = level["first"][a][at] + k // nb[at], level["first"][b][at] + k % nb[at]
    keep = x <= y if len(a) else np.zeros(0, bool)
    return x[keep], y[keep]


def gray_links(fps: np.ndarray, nodes: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints of one node that differ in at most ``bits`` bits.

    ``fps`` must be sorted by node and Gray rank. Depth first in chunks, so the
    pairs in hand stay bounded.
    """
    if not len(fps):
        return
    levels = _levels(fps, nodes)
    top = len(levels) - 1
    todo = [(top, (r := np.arange(len(levels[top]["of"]))), r)]
    while todo:
        depth, a, b = todo.pop()
        if len(a) > CHUNK:
            todo += [(depth, a[k : k + CHUNK], b[k : k + CHUNK]) for k in range(0, len(a), CHUNK)]
            continue
        x = levels[depth]
        common = ~(x["all"][a] ^ x["any"][a]) & ~(x["all"][b] ^ x["any"][b])
        near = np.bitwise_count((x["all"][a] ^ x["all"][b]) & common) <= bits
        a, b = a[near], b[near]
        if depth:
            todo.append((depth - 1, *_children(x, a, b)))
        elif (other := a != b).any():
            yield a[other], b[other]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge links into ``label`` (each position points to the least position of its component)."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt


def node_edges(fps: np.ndarray, nodes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each node, as pairs of fingerprints."""
    order = np.lexsort((gray_rank(fps), nodes))
    fps, nodes = fps[order], nodes[order]
    label = np.arange(len(fps))
    for a, b in gray_links(fps, nodes, bits):
        _forest(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


# --- dealing out --------------------------------------------------------------------------


def _parts(free: int, n: int) -> list[int]:
    """``n`` masks that split the bits of ``free``."""
    at = [k for k in range(64) if free >> k & 1]
    cuts = [len(at) * k // n for k in range(n + 1)]
    return [sum(1 << k for k in at[cuts[j] : cuts[j + 1]]) for j in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tree(bits: int = BITS, depth: int = 3) -> list[dict[int, list[int]]]:
    """For each depth, the masks that refine each mask of the depth above (0: none)."""
    full, tree, above = (1 << 64) - 1, [], [0]
    for _ in range(depth):
        tree.append({m: [m | p for p in _parts(full & ~m, bits + 1)] for m in above})
        above = [x for made in tree[-1].values() for x in made]
    return tree


def _deal(rows: DataFrame, refine: dict[int, list[int]]) -> DataFrame:
    """Each row once under each mask that refines its own."""
    branch = None
    for parent, children in refine.items():
        made = F.array(*[F.lit(_signed(c)) for c in children])
        hit = F.col("mask") == F.lit(_signed(parent))
        branch = F.when(hit, made) if branch is None else branch.when(hit, made)
    rows = rows.select("fp", F.explode(branch).alias("mask"))
    return rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"))


def _search(dealt: DataFrame, bits: int) -> DataFrame:
    """Forest edges ``a, b`` of all nodes; nodes arrive whole and sorted."""
    ship_package(dealt.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out(part: np.ndarray):
            node = np.cumsum(np.r_[True, (part[1:, 1:] != part[:-1, 1:]).any(axis=1)])
            a, b = node_edges(part[:, 0].view(np.uint64), node, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1))
            rows += len(held[-1])
            if rows >= 40_000:
                part = np.concatenate(held)
                last = np.flatnonzero((part[1:, 1:] != part[:-1, 1:]).any(axis=1))
                cut = last[-1] + 1 if len(last) else 0  # the last node may go on
                if cut:
                    yield out(np.ascontiguousarray(part[:cut]))
                held, rows = [part[cut:]], len(part) - cut
        if rows:
            yield out(np.ascontiguousarray(np.concatenate(held)))

    return dealt.select("fp", "mask", "pattern").mapInArrow(run, "a bigint, b bigint")


def link_forest(distinct: DataFrame, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges that connect exactly the fingerprints connected by links of ``bits`` or fewer."""
    spark, tree = distinct.sparkSession, mask_tree(bits)
    rows, found = distinct.select("fp", F.lit(0).cast("bigint").alias("mask")), None
    for depth, refine in enumerate(tree):
        dealt = _deal(rows, refine)
        sizes = dealt.groupBy("mask", "pattern").agg(F.count("*").alias("n")).filter("n > 1")
        big = None
        if depth + 1 < len(tree):
            big = materialize(sizes.filter(F.col("n") > node_rows).select("mask", "pattern"), "nodes")
            if big.isEmpty():
                discard(big)
                big = None
        if big is not None:
            small, large = dealt.join(big, ["mask", "pattern"], "left_anti"), dealt.join(big, ["mask", "pattern"], "left_semi")
        else:
            small, large = dealt, None
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        edges = _search(small.repartition(parts, "mask", "pattern").sortWithinPartitions("mask", "pattern"), bits)
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            break
        rows = large.select("fp", "mask")
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component, for every node with an edge.

    Large-star and small-star rounds in turn until the edges stop changing;
    each round is a written table, so lineage stays one round deep.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            around = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            around = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        if large:
            new = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.filter("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(now)
    while seen[0]:
        new = materialize(star(star(now, True), False), "edges")
        discard(now)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, fp, component_id``, one row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = components(link_forest(distinct, bits, node_rows))
    # star edges point every node at its root; a root points at itself
    rooted = distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least id stays.

    Rows without an id can't name a group, so they take no part and stay. Rows
    that repeat a kept id fall together to one: the one with the least text, of
    these the least when all columns are written as JSON.
    """
    named = docs.filter(F.col(id_col).isNotNull())
    with passing() as kept:
        found = materialize(near_duplicates(named, id_col, text_col, **how), "groups")
        kept.append(found)
    kept = found.select(F.col("component_id").alias("__kept")).distinct()
    out = named.join(kept, named[id_col] == kept["__kept"], "left_semi")
    if not found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = out.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(row, F.struct(whole(text_col), F.to_json(row))).alias("__row"))
        out = one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return out.unionByName(docs.filter(F.col(id_col).isNull()))
