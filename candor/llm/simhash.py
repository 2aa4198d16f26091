"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has bit b set if more than half of its shingle hashes have it. Fingerprints that differ in at
most `radius` bits are linked, and every one of those links is found: fingerprints are dealt into tiles by the
population counts of their four 16-bit quarters, and two fingerprints within the radius have quarter counts that
differ by at most the radius in sum. So a tile is compared with itself and with the few tiles whose counts are that
near, and every other pair of tiles is skipped unseen. Inside a pair numpy takes exclusive-or and bit counts of blocks.
Tiles of over TILE fingerprints are split into chunks. What a chunk is compared with comes to it in parts of about PART
fingerprints, each beside a copy of the chunk, so a task's input does not grow with the tiles around it.

Work is done on distinct fingerprints, so a large group of copies is one of them. A block hands on a spanning forest
of the links it found, not the links. Components come from alternating large-star and small-star steps, whose state is
checkpointed in the shared folder.

Defined cases
* null text, or text without words: fingerprint zero, linked like any other.
* fewer words than a shingle: the whole sequence is the one shingle.
* null ids: such rows have a fingerprint and link others; a component of null ids alone has a null component_id.
* repeated rows: each is returned. Empty table: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_BYTES, fresh, released, shared_dir, text_key, written

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a tile's chunk: 32 KB, compared in blocks of BLOCK rows.
TILE = 4096
BLOCK = 256
#: Fingerprints that a chunk is compared with in one task, on average.
PART = 65536

_LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; bytes.lower() and split() touch ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros((8, 8), np.int64)
    at = np.arange(0, len(h), 255)  # so many single bits add up in a byte without a carry
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LOW_BITS, at)
        counts[:, k] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """The id, any extra columns, and the fingerprint as a signed long."""
    keep = [id_col, *(extra or [])]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found.view(np.int64))], names=schema.names)
        released()

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as a-b, at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def compare(own: np.ndarray, other: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between own and other, or inside own, as forests block by block."""
    for s in range(0, len(own), BLOCK):
        rows = own[s : s + BLOCK]
        for t in range(s if other is None else 0, len(own if other is None else other), TILE):
            cols = (own if other is None else other)[t : t + TILE]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
            a, b = rows[i], cols[j]
            a, b = a[a != b], b[a != b]
            if len(a):
                yield forest(a, b) if len(a) > 64 else (a, b)


def _neighbours(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of quarter counts within the radius; of each two opposite ones the later, and none."""
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def dealt(prints: DataFrame, radius: int, tile: int = TILE, part: int = PART) -> DataFrame:
    """at (chunk of a tile, and a part of what it is compared with), role (0: of the chunk itself, 1: compared with it), fingerprint."""
    q = [F.bit_count(F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    code = lambda parts: (((parts[0] * 17 + parts[1]) * 17 + parts[2]) * 17 + parts[3]).cast("long")
    tiled = prints.select("fingerprint", *[x.alias(f"q{k}") for k, x in enumerate(q)])
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in _neighbours(radius)])).alias("d")
    quarters = [F.col(f"q{k}") for k in range(4)]
    to = [x + F.col("d")[f"d{k}"] for k, x in enumerate(quarters)]
    inside = to[0].between(0, 16) & to[1].between(0, 16) & to[2].between(0, 16) & to[3].between(0, 16)
    # one row a tile and one for each two that are near: at most 17^4, and some 20 times that, whatever the input
    tiles = tiled.groupBy(*quarters).agg(F.count(F.lit(1)).alias("n"))
    pairs = tiles.select(*quarters, "n", steps).filter(inside).select(code(to).alias("to"), code(quarters).alias("from"), "n")
    sizes = tiles.select(code(quarters).alias("to"), F.ceil(F.col("n") / tile).alias("chunks"))
    pairs = written(pairs.join(sizes, "to").select("to", "from", "n", "chunks", F.sum("n").over(Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)).alias("before")), "tile-pairs")
    own = pairs.groupBy("to").agg(F.first("chunks").alias("chunks"), (F.floor(F.sum("n") / part) + 1).alias("parts"))
    home = tiled.select("fingerprint", code(quarters).alias("tile"))
    # a tile's fingerprints lie behind each other in no order among all that are compared with a chunk
    place = F.coalesce("before", F.lit(0)) + F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("n"))
    chunk = lambda n: F.pmod(F.xxhash64("fingerprint"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = home.join(F.broadcast(own), home["tile"] == own["to"]).select("to", chunk(F.col("chunks")).alias("chunk"), every(F.col("parts")).alias("part"), F.lit(0).alias("role"), "fingerprint")
    sent = home.join(F.broadcast(pairs), home["tile"] == pairs["from"]).select("to", "from", F.floor(place / part).alias("part"), chunk(F.col("chunks")).alias("mine"), every(F.col("chunks")).alias("chunk"), "fingerprint")
    sent = sent.filter((F.col("to") != F.col("from")) | (F.col("chunk") > F.col("mine"))).select("to", "chunk", "part", F.lit(1).alias("role"), "fingerprint")
    at = F.col("to") * (1 << 46) + F.col("chunk") * (1 << 23) + F.col("part")
    return held.union(sent).select(at.alias("at"), "role", "fingerprint")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, part: int = PART) -> DataFrame:
    """A spanning forest (a, b) of all links between distinct fingerprints (column fingerprint)."""

    def inside(at: int | None, own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A chunk is compared with itself beside the first part."""
        return compare(np.concatenate(own), None, radius) if own and at % (1 << 23) == 0 else iter(())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, whole = None, [], np.zeros(0, np.uint64)
        for batch in batches:
            at, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints_ = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.nonzero((at[1:] != at[:-1]) | (role[1:] != role[:-1]))[0] + 1
            found = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if at[s] != here:
                    found += inside(here, own)
                    here, own, whole = int(at[s]), [], np.zeros(0, np.uint64)
                if role[s] == 0:
                    own.append(prints_[s:e])
                    continue
                if own:
                    whole = np.concatenate(own)
                    found += inside(here, own)
                    own = []
                found += compare(whole, prints_[s:e], radius)
            yield from _edges(found)
        yield from _edges(list(inside(here, own)))

    return dealt(prints, radius, tile, part).repartition("at").sortWithinPartitions("at", "role").mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (a, b): alternating large-star and small-star steps until nothing changes.

    The least neighbours are checkpointed before they are joined back, so that Spark can split a node of many edges.
    """
    shared_dir(edges.sparkSession)
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    state = None
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = large.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        stars = small.checkpoint()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(prints: DataFrame, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """Of each distinct fingerprint its root and component_id. prints: fingerprint and low, the smallest id that has it."""
    root = components(links(prints, radius, **sizes))
    linked = prints.join(root, prints["fingerprint"] == root["node"]).select("fingerprint", "low", "root")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    found = linked.select("fingerprint", "root").join(lowest, "root")
    return prints.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, extra: list[str] | None = None) -> DataFrame:
    """Each row's id (and extra columns), fingerprint, root and component_id."""
    own = written(fingerprints(docs, id_col=id_col, text_col=text_col, extra=extra), "fingerprints", batch_bytes=TEXT_BYTES)
    prints = written(own.groupBy("fingerprint").agg(F.min(id_col).alias("low")), "distinct-fingerprints")
    # both sides of the join are plain tables, so Spark can split a fingerprint that many rows share
    return own.join(written(classes(prints, radius), "classes"), "fingerprint")


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents of which each component keeps one: that with the smallest id, of several such that with the least text hash."""
    kid, kkey, kn, pick = (fresh(docs.columns, f"_sim_{x}") for x in ("id", "key", "n", "pick"))
    keyed = docs.select(F.col(id_col), F.col(text_col), text_key(F.col(text_col)).alias("_key"))
    found = near_duplicates(keyed, id_col=id_col, text_col=text_col, radius=radius, extra=["_key"])
    kept = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_key").alias("key"))).alias("k"), F.count(F.lit(1)).alias("n")).select(F.col("k.id").alias(kid), F.col("k.key").alias(kkey), F.col("n").alias(kn))
    same = docs[id_col].eqNullSafe(F.col(kid)) & (text_key(docs[text_col]) == F.col(kkey))
    joined = docs.join(kept, same, "inner")
    # rows alike in id and text can only both be kept where a component has several rows; the least of them stays
    alone, several = joined.filter(F.col(kn) == 1), joined.filter(F.col(kn) > 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = several.groupBy(kid, kkey).agg(F.min_by(whole, F.to_json(whole)).alias(pick))
    return alone.select(*[F.col(f"`{c}`") for c in docs.columns]).union(several.select(*[F.col(pick)[c].alias(c) for c in docs.columns]))
