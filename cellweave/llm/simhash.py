"""SimHash near-dedup: 64-bit fingerprints, linked at ``RADIUS`` or fewer differing bits.

Fingerprints come from Arrow batches of whole texts. Equal ones are grouped first, so exact copies
cost one row. The search for links is exact: with the bits cut into ``SEGMENTS`` parts, two
fingerprints within the radius agree on at least ``SEGMENTS - RADIUS`` of them, so each goes to one
bucket for every such choice of parts. A bucket is compared bit-sliced: its fingerprints' bits are
stored as vertical planes, one integer a bit with a lane a row; a query adds the planes into
carry-save counters for all lanes at once and abandons the block when every lane has exceeded the
radius. Buckets beyond ``TILE`` are cut into tiles and compared tile by tile, all pairs of tiles.
A block returns only a spanning forest of its links, so output is linear whatever a group's size,
and no link between groups is lost. Components come from alternating large-star and small-star
steps on written tables.

Defined cases: null and empty texts have fingerprint zero; repeated rows share a component; null
doc_ids take part in links and never are the smallest id unless a component has no other; doc_ids may
be integers or text; other columns, of any name, are ignored or passed on; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import free_names, keep_rows, released, table, text_hash, written

BITS = 64
RADIUS = 2
SEGMENTS = 4
TILE = 4096
SEED = 42
SHINGLE = 3
#: Shingles whose bits are counted at once, to bound memory on long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text; bytes.lower() and bytes.split() know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    ones, n = np.zeros(BITS, np.int64), 0
    while part := list(itertools.islice(grams, CHUNK)):
        raw = b"".join(map(xxhash.xxh64_digest, part, itertools.repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(part)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2)
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): a row for each document row."""
    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(
        _fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, fp bigint"
    )


class BitSliced:
    """Fingerprints stored as vertical bit planes: lane r of plane b is bit b of row r."""

    def __init__(self, rows: list[int]):
        self.lanes = (1 << len(rows)) - 1
        if len(rows) < 64:
            self.planes = [sum(((x >> b) & 1) << r for r, x in enumerate(rows)) for b in range(BITS)]
        else:
            bits = np.unpackbits(np.array(rows, ">u8").view(np.uint8).reshape(-1, 8), axis=1)  # column 0: bit 63
            packed = np.packbits(bits.T, axis=1, bitorder="little")
            self.planes = [int.from_bytes(packed[BITS - 1 - b].tobytes(), "little") for b in range(BITS)]

    def within(self, query: int, radius: int, planes: list[int], lanes: int) -> int:
        """Lanes among ``lanes`` whose distance from the query over the given planes is at most ``radius``."""
        width = max(1, (radius + 1).bit_length())
        bias = (1 << width) - 1 - radius  # the counter overflows on the first bit beyond the radius
        counters = [self.lanes if bias >> i & 1 else 0 for i in range(width)]
        over = self.lanes & ~lanes
        for b in planes:
            carry = self.planes[b] ^ (self.lanes if query >> b & 1 else 0)
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
                if not carry:
                    break
            over |= carry
            if over == self.lanes:
                return 0
        return self.lanes & ~over


def segment_choices() -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(SEGMENTS), SEGMENTS - RADIUS))


def _segment_planes(choice: tuple[int, ...]) -> list[int]:
    """Planes that the bucket's key does not fix, high bits first."""
    width = BITS // SEGMENTS
    return [b for b in range(BITS - 1, -1, -1) if b // width not in choice]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is a block: its choice of segments, whether both tiles are one, and the tiles' fingerprints."""
    planes = [_segment_planes(c) for c in segment_choices()]
    for batch in batches:
        low, high = [], []
        for choice, left, right in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for a, b in block_forest([x % 2**64 for x in left], [x % 2**64 for x in right or []], planes[choice]):
                low.append(a)
                high.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)], names=["a", "b"]
        )


def block_forest(left: list[int], right: list[int], planes: list[int]) -> list[tuple[int, int]]:
    """Spanning forest of the links of one tile (no ``right``) or between two tiles."""
    rows = left + right
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    block, shift = BitSliced(right or left), len(left) if right else 0
    for i, query in enumerate(left):
        lanes = block.lanes if right else block.lanes & ~((1 << (i + 1)) - 1)
        near = block.within(query, RADIUS, planes, lanes) if lanes else 0
        while near:
            bit = near & -near
            near ^= bit
            x, y = find(i), find(bit.bit_length() - 1 + shift)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(rows[r], rows[i]) for i in range(len(rows)) if (r := find(i)) != i]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges between different fingerprints that join all that are linked. ``fps``: distinct fp."""
    width = BITS // SEGMENTS
    part = lambda s: f"(shiftrightunsigned(fp, {s * width}) & {(1 << width) - 1})"
    keys = [
        f"struct({i} as choice, {' | '.join(f'shiftleft({part(s)}, {j * width})' for j, s in enumerate(c))} as seg)"
        for i, c in enumerate(segment_choices())
    ]
    rows = fps.select("fp", F.expr(f"inline(array({', '.join(keys)}))"))
    sizes = rows.groupBy("choice", "seg").agg(F.count("*").alias("m")).where("m > 1")
    rows = rows.join(sizes, ["choice", "seg"])
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    blocks = rows.groupBy(
        "choice", "seg", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    ).agg(
        F.collect_list(F.when(F.col("tile") <= F.col("other"), F.col("fp"))).alias("left"),
        F.collect_list(F.when(F.col("tile") > F.col("other"), F.col("fp"))).alias("right"),
    )
    blocks = blocks.where(F.when(F.col("lo") == F.col("hi"), F.size("left") > 1).otherwise((F.size("left") > 0) & (F.size("right") > 0)))
    return blocks.select("choice", "left", "right").mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the component's smallest node. Edges need not be distinct or ordered.

    Alternates large-star and small-star on written tables; each step keeps at most one edge a node
    and neighbour. Minima are written before they are joined, so that both sides of the join are plain
    exchanges and a hub's neighbours can be split over tasks.
    """
    ordered = lambda e: e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = written(ordered(edges), "edges")
    state = None
    while True:
        # Large star: every neighbour above a node is tied to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = written(ordered(large), "large")
        released(now, least)
        # Small star: a node's smaller neighbours and itself are tied to the smallest of them.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        now = written(ordered(small), "small")
        released(large, least)
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, root, component_id): a row for each document row."""
    marks = written(fingerprints(docs), "fingerprints")
    fps = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps.select("fp")))
    fps = written(fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    # Written before each join, so that a component or a fingerprint of many can be split.
    ids = written(fps.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    named = written(fps.select("fp", "root").join(ids, "root"), "named")
    return marks.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: its smallest doc_id's (then smallest text hash's); nulls come last."""
    marks = written(grouped(docs), "groups")
    pick = marks.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("p"))
    out = keep_rows(docs, pick.select("p.doc_id", "p.th"), "left_semi")
    if not marks.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        (own,) = free_names(docs, 1)
        out = out.withColumn(own, text_hash()).dropDuplicates(["doc_id", own]).drop(own)
    return out
