"""SimHash near duplicates by tiled exact comparison.

Fingerprint: majority bits of the XXH64 (seed 42) of all word shingles. Equal fingerprints
are one node. Nodes are keyed by the population counts of their four 16-bit words; two
fingerprints within ``radius`` bits have keys at most ``radius`` apart (sum of differences),
so only those tile pairs are compared, by numpy exclusive-or and bit counts. A tile pair
returns a spanning forest of its links, never all pairs, and components come from repeated
minimum labels in written tables.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share
a fingerprint; a null doc_id never names a component unless the whole component is null. A bit that
exactly half of the shingles have is 0; of equal doc_ids either names a component. Very long texts count
whole. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, small_batches, write_table

RADIUS = 3
SHINGLE = 3
TILE = 4096
#: ASCII white space to one separator, A-Z to a-z; other bytes stay (UTF-8 continuation bytes are above both).
_TABLE = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; the whole sequence if there are fewer words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.empty(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - shingle)])]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:], strict=False)], "<u8")


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(majority(shingle_hashes(text, shingle)))


#: Odd multipliers, one for each bit of the widest signature.
_ODD = np.random.RandomState(42).randint(0, 2**31, 4096).astype("<u4") * np.uint32(2) + np.uint32(1)


def signature(hashes: np.ndarray, words: int) -> bytes:
    """``words`` times 64 bits of a set of shingle hashes, each a bit of another minimum over the set: with similarity
    (Jaccard) s a bit differs with probability (1 - s) / 2, however small the sets are."""
    if not len(hashes):
        return bytes(8 * words)
    x, odd, low = (hashes ^ (hashes >> np.uint64(32))).astype("<u4"), _ODD[: 64 * words], np.full(64 * words, 2**32 - 1, "<u4")
    for at in range(0, len(x), 256):
        np.minimum(low, (odd[:, None] * x[None, at : at + 256]).min(1), out=low)
    for shift, by in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        low = (low ^ (low >> np.uint32(shift))) * np.uint32(by)
    return np.packbits((low >> np.uint32(31)).astype(bool), bitorder="little").tobytes()


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x if isinstance(x, str) else None, shingle) for x in texts], np.uint64).view(np.int64))

    return of(text)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest linked index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(one: np.ndarray, two: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, fingerprint) links, of what lies within the radius in a tile (two: None) or between two."""
    nodes = one if two is None else np.concatenate((one, two))
    left, right = [], []
    other, shift = (one, 0) if two is None else (two, len(one))
    step = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(one), step):
        i, j = np.nonzero(np.bitwise_count(one[at : at + step, None] ^ other[None, :]) <= radius)
        i += at
        if two is None:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j + shift)
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return nodes[:0], nodes[:0]
    label = _forest(a, b, len(nodes))
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``radius`` among the distinct column ``fp``."""
    words = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int") for k in range(4)]
    cell = F.lit(0)
    for w in words:  # four counts of 0 to 16 as one number of base 32, room for the offsets left
        cell = cell * 32 + w + 4
    keyed = prints.select("fp", cell.alias("cell"))
    # at most 17^4 cells exist whatever the input is, so their counts may be broadcast
    tiles = keyed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = keyed.join(F.broadcast(tiles), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"))
    offsets = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    steps = [((d[0] * 32 + d[1]) * 32 + d[2]) * 32 + d[3] for d in offsets]
    there = packed.select(F.col("cell").alias("from"), F.col("tile").alias("from_tile"), F.col("fps").alias("fps2"), F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    there = there.select((F.col("from") + F.col("step")).alias("cell"), "step", "from_tile", "fps2").join(F.broadcast(tiles), "cell")
    there = there.select("cell", "step", "from_tile", "fps2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).where("step <> 0 or tile <= from_tile")
    pairs = packed.join(there, ["cell", "tile"]).select((F.expr("step = 0 and tile = from_tile")).alias("own"), "fps", F.when(F.expr("step = 0 and tile = from_tile"), F.array().cast("array<long>")).otherwise(F.col("fps2")).alias("fps2"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            own = batch.column("own").to_pylist()
            one, two = batch.column("fps"), batch.column("fps2")
            for k, same in enumerate(own):
                x = np.asarray(one[k].values).view(np.uint64)
                found = tile_links(x, None if same else np.asarray(two[k].values).view(np.uint64), radius)
                if len(found[0]):
                    a.append(found[0])
                    b.append(found[1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b). root: one node of each component. Minimum labels over
    neighbours with pointer jumping; each round is a written table, of which the last two are kept."""
    spark = edges.sparkSession
    edges, edge_path = write_table(edges.where("a <> b").distinct(), "cc-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "cc-0")
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        # jump: the root of my root
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = hooked.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("top", "root")).alias("root"))
        new, new_path = write_table(jumped, f"cc-{k}")
        done = new.where("was <> root").isEmpty()
        remove(spark, path)
        labels, path = new.select("node", "root"), new_path
        if done:
            remove(spark, edge_path)
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long), component_id of every row of ``docs``."""
    small_batches(docs.sparkSession)
    marked, _ = write_table(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, radius))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")
