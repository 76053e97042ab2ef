"""Near duplicates by the similarity (Jaccard) of word shingle sets, found by tiled exact comparison.

Rows with equal sets are one node. Nodes are sorted by the population count of their set (the number
of its shingles) and written as tiles. Two sets that are similar have counts in the ratio of
the similarity, so tile pairs, and rows of a tile pair, whose counts differ beyond it are
skipped; the others are compared by exclusive-or and bit counts of minimum signatures. What is
within the radius are candidates only: their components are written as tiles of shingle sets, and
the sets themselves decide.

Both comparisons go in two steps. A tile's own links are resolved to components of the tile first
and written with it; a pair of tiles then gives a spanning forest of links between components of the
two, so a group of copies of any size costs one link for a pair of tiles, not one for each of its
members.

Null and empty texts have the empty set: they are near duplicates of each other and of nothing
else. Repeated rows are copies. Of a group the row with the smallest doc_id stays (null last), of
equal ones the first row. A text of fewer words than a shingle has its whole sequence as its
only shingle. Very long texts are compared by all their shingles. Columns of any name pass
through. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import give_back, remove, small_batches, temp_name, write_table
from .simhash import components, shingle_hashes, signature
from .tokenbin import filesystem

#: Near duplicates share at least 4 of 5. At 0.8 a bit of the signature differs with probability 0.1: of 512 bits 51 on
#: average and over 100 in less than one of 10^9 pairs; of the first 128 over 40 as rarely.
SIMILAR, WORDS, RADIUS, EARLY_WORDS, EARLY_RADIUS = (4, 5), 8, 100, 2, 40
#: Rows of a tile of signatures; rows and characters of text of a tile of sets; rows compared at a time.
TILE, SET_TILE, SET_CHARS, STRIP = 8192, 2048, 1 << 22, 16


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a representative, smallest first) after the places a and b are linked."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _sizes_meet(a: tuple[int, int], b: tuple[int, int], similar: tuple[int, int]) -> bool:
    """Whether counts of two ranges can be in the ratio."""
    num, den = similar
    return a[0] * num <= b[1] * den and b[0] * num <= a[1] * den


class Signatures:
    """A tile of nodes with signatures, by population count."""

    COLUMNS = "key long, size long, sig binary, label int, head long, members long"
    REACH = ("size",)

    def __init__(self, table, similar: tuple[int, int]):
        self.similar = similar
        self.key, self.size = table.column("key").to_numpy(), table.column("size").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(table.num_rows, -1)
        self.sig = np.ascontiguousarray(sig.T)
        self.label = table.column("label").to_numpy() if "label" in table.column_names else None

    @staticmethod
    def meet(lo, hi, other_lo, other_hi, similar) -> bool:
        return _sizes_meet((lo[0], hi[0]), (other_lo[0], other_hi[0]), similar)

    def link(self, two: Signatures, label: np.ndarray, shift: int) -> np.ndarray:
        num, den = self.similar
        early = self.sig.shape[0] > EARLY_WORDS
        for at in range(0, len(self.key), STRIP):
            size = self.size[at : at + STRIP]
            lo, hi = np.searchsorted(two.size, -(-int(size[0]) * num // den)), np.searchsorted(two.size, int(size[-1]) * den // num, "right")
            lo = lo if shift else max(lo, at)
            if lo >= hi:
                continue
            # a strip stays in the processor's cache, and the first words already tell most pairs apart
            away = np.zeros((len(size), hi - lo), np.uint16)
            for a, b in zip(self.sig[: EARLY_WORDS if early else None], two.sig, strict=False):
                away += np.bitwise_count(a[at : at + STRIP, None] ^ b[None, lo:hi])
            i, j = np.nonzero(away <= (EARLY_RADIUS if early else RADIUS))
            i, j = i + at, j + lo
            if not shift:
                i, j = i[i < j], j[i < j]
            apart = label[i] != label[j + shift]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(self.sig[:, i] ^ two.sig[:, j]).sum(0, dtype=np.int64) <= RADIUS
            label = joined(label, i[near], j[near] + shift)
        return label


class Sets:
    """A tile of shingle sets, by the component of candidates they are in and their population count."""

    COLUMNS = "key long, root long, size long, sig binary, shingles binary, label int, head long, members long"
    REACH = ("root", "size")

    def __init__(self, table, similar: tuple[int, int]):
        self.similar = similar
        self.key, self.size, self.root = (table.column(c).to_numpy() for c in ("key", "size", "root"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(table.num_rows, -1)
        self.sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        self.label = table.column("label").to_numpy() if "label" in table.column_names else None

    @staticmethod
    def meet(lo, hi, other_lo, other_hi, similar) -> bool:
        if max(lo[0], other_lo[0]) > min(hi[0], other_hi[0]):
            return False
        one = lo[0] == hi[0] == other_lo[0] == other_hi[0]
        return not one or _sizes_meet((lo[1], hi[1]), (other_lo[1], other_hi[1]), similar)

    def link(self, two: Sets, label: np.ndarray, shift: int) -> np.ndarray:
        num, den = self.similar
        for root in np.intersect1d(self.root, two.root):
            lo, hi = np.searchsorted(two.root, root, "left"), np.searchsorted(two.root, root, "right")
            for i in range(np.searchsorted(self.root, root, "left"), np.searchsorted(self.root, root, "right")):
                n = int(self.size[i])
                first, last = lo + np.searchsorted(two.size[lo:hi], -(-n * num // den)), lo + np.searchsorted(two.size[lo:hi], n * den // num, "right")
                j = np.arange(first if shift else max(first, i + 1), last)
                j = j[label[j + shift] != label[i]]
                if not len(j):
                    continue
                away = np.bitwise_count(two.sig[j] ^ self.sig[i]).sum(1, dtype=np.int64)
                j = j[np.argsort(away, kind="stable")][: int((away <= RADIUS).sum())]
                many = 1
                while len(j):  # nearest first, more at a time
                    some = j[:many]
                    both = _shared(self.sets[i], [two.sets[k] for k in some])
                    good = some[both * den >= (n + two.size[some] - both) * num]
                    label = joined(label, np.full(len(good), i), good + shift)
                    j = j[many:]
                    j = j[label[j + shift] != label[i]]
                    many = min(4 * many, 256)
        return label


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Elements that a sorted set has in common with each of some others; none is empty."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def link_tiles(tiles: DataFrame, kind: type[Signatures] | type[Sets], similar: tuple[int, int], name: str) -> DataFrame:
    """A written table (key, root) of the nodes that are linked to any other; root: one key of each component. ``tiles``: a
    written table, a file for each tile, in ``kind``'s columns up to label; removed. Driver: the bounds of each tile."""
    spark, order = tiles.sparkSession, [(c, "ascending") for c in (*kind.REACH, "key")]
    files, schema = list(tiles.inputFiles()), T.StructType.fromDDL(kind.COLUMNS)
    if not files:
        return spark.createDataFrame([], "key long, root long")

    def load(uri: str):
        import pyarrow.parquet as pq

        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            return pq.read_table(f)

    def own(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column("id").to_pylist():
                table = load(files[k]).sort_by(order)
                if not table.num_rows:
                    continue
                tile = kind(table, similar)
                label = tile.link(tile, np.arange(len(tile.key)), 0)
                members = np.bincount(label, minlength=len(label))[label]
                for c, v in (("label", pa.array(label, pa.int32())), ("head", pa.array(tile.key[label])), ("members", pa.array(members, pa.int64()))):
                    table = table.append_column(c, v)
                for c in table.to_batches(max_chunksize=256):
                    yield c.select(schema.names)
                del table, tile
                give_back()

    labelled, path = write_table(spark.range(0, len(files), 1, len(files)).mapInArrow(own, schema), f"{name}-own")
    bounds = [F.struct(*kind.REACH), F.input_file_name()]
    by_name = {f.rpartition("/")[2]: f for f in labelled.inputFiles()}
    reach = labelled.groupBy(bounds[1].alias("file")).agg(F.min(bounds[0]).alias("lo"), F.max(bounds[0]).alias("hi")).collect()
    reach = sorted((tuple(r["lo"]), tuple(r["hi"]), by_name[r["file"].rpartition("/")[2]]) for r in reach)

    def across(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column("id").to_pylist():
                lo, hi, uri = reach[k]
                near = [r for r in reach[k + 1 :] if kind.meet(lo, hi, r[0], r[1], similar)]
                one = kind(load(uri), similar) if near else None
                for _, _, other in near:
                    two, shift = kind(load(other), similar), len(one.key)
                    before = np.concatenate((one.label, two.label + shift))
                    label, keys = one.link(two, before, shift), np.concatenate((one.key, two.key))
                    moved = np.unique(before[label != before])
                    if len(moved):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[label[moved]])], names=["a", "b"])
                    del two
                give_back()

    # nodes of these links are components of tiles; each stands for at most a tile's rows
    top = components(spark.range(0, len(reach), 1, len(reach)).mapInArrow(across, "a long, b long"))
    rooted = labelled.select("key", "head", "members").join(top.select(F.col("node").alias("head"), F.col("root").alias("top")), "head", "left")
    out, _ = write_table(rooted.where("members > 1 or top is not null").select("key", F.coalesce("top", "head").alias("root")), f"{name}-roots")
    remove(spark, path)
    return out


def tiled(df: DataFrame, rows: int, by: list[str], name: str, n: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a written table of files of about ``rows`` rows, in ranges of ``by``."""
    n = n or max(1, -(-df.count() // rows))
    return write_table(df.repartitionByRange(n, *by), name)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similar: tuple[int, int] = SIMILAR, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without all but one of each group of near duplicates, in its columns.
    Rows are linked if the Jaccard similarity of their sets of shingles is ``similar`` or more; groups are the components."""
    spark = docs.sparkSession

    def shingles(text) -> np.ndarray:
        return np.unique(shingle_hashes(text if isinstance(text, str) else None, shingle))

    @F.pandas_udf("sig binary, digest binary, size long")
    def sign(texts: pd.Series) -> pd.DataFrame:
        tokens.forget()
        sets = [shingles(x) for x in texts]
        return pd.DataFrame({"sig": [signature(x, WORDS) for x in sets], "digest": [hashlib.sha256(x.tobytes()).digest() for x in sets], "size": [len(x) for x in sets]})

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).tobytes() for x in texts])

    small_batches(spark)
    key, made = temp_name(docs, "row_key"), temp_name(docs, "sig")
    signed, _ = write_table(docs.withColumns({key: F.monotonically_increasing_id(), made: sign("text")}), "near-signed")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    # equal sets are one node, which has the key of its best row
    each = signed.groupBy(F.col(f"{made}.digest").alias("digest")).agg(F.min(best).alias("best"), F.first(f"{made}.sig").alias("sig"), F.first(f"{made}.size").alias("size"))
    nodes, _ = write_table(each.select("best", F.col("best.key").alias("key"), "size", "sig"), "near-nodes")
    tiles, path = tiled(nodes.select("key", "size", "sig"), tile, ["size", "key"], "near-tiles")
    nearby = link_tiles(tiles, Signatures, similar, "near-candidates")
    remove(spark, path)
    rows = signed.select(F.col(key).alias("key"), F.col(f"{made}.size").alias("size"), F.col(f"{made}.sig").alias("sig"), "text").join(nearby, "key")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-total["n"] // set_tile), -(-total["chars"] // SET_CHARS))
    sets, path = write_table(rows.repartitionByRange(n, "root", "size", "key").select("key", "root", "size", "sig", whole("text").alias("shingles")), "near-sets")
    roots = link_tiles(sets, Sets, similar, "near-links")
    remove(spark, path)
    kept = nodes.select("best", "key").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.key").alias(key))
    return signed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
