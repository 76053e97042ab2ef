"""Exact BM25 top-k search: sharded inverted index with block-max pruning.

Each input task writes its documents as immutable index shards of at most ``SHARD_DOCS``
documents into the shared folder (term dictionary, postings in document order, lengths).
Documents of a shard are ordered so that like ones are neighbours. Corpus statistics (number
and mean length of documents, document frequencies) are global, so scores do not depend on the
shards.

A few shards and a file of queries are one task, and a shard meets a batch of queries at a time, as a
cursor that moves from document to document would be a Python loop. The most frequent terms of a
shard (they hold six of seven postings that queries meet) are kept by block of ``BLOCK`` documents, with the
largest impact of each term in each block. A query adds up the postings of its other terms; a
block is then bounded by its best document so far and the largest impacts of the frequent terms in
it, and only blocks whose bound reaches the k-th score are read: block-max WAND with the blocks of
all queries of a batch side by side, so that a block that several queries reach is read once for them.
The first k-th score comes from the blocks of the best bounds, and the first group of shards gives every
query a k-th score from which all other groups start. Bounds have room for the error of single precision;
what can be among the best gets an exact sum, rounded once, so scores are the same numbers however
documents are dealt, and tasks' results merge exactly by score, then doc_id.

Words: runs of letters and digits, lower-cased. Documents that share no word with a query are
no hits. Null and empty texts have no words: they are neither found nor find anything. Very long
texts count whole, as documents and as queries. Repeated rows are documents and queries of their own;
ties go to the smallest doc_id, null first. Other columns are not read, whatever their names. An empty
table and no queries give no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import struct
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import run_path, small_batches, write_table
from .tokenbin import filesystem

K, K1, B = 10, 1.2, 0.75
SHARD_DOCS, BLOCK, QUERY_FILE, SHARDS_A_TASK = 10_000, 64, 2048, 8
#: Blocks of the best bounds that give the first k-th score; frequent terms of a shard; queries of a batch; room for the error of
#: sums in single precision (2^-24 for each of the frequent terms, at most).
FIRST_BLOCKS, FREQUENT, BATCH, ROOM = 4, 512, 256, 1e-4
_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> Counter:
    return Counter(_WORDS((text or "").lower()))


class Builder:
    """Collects documents of one shard."""

    def __init__(self):
        self.ids, self.terms, self.doc, self.term, self.tf = [], {}, [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        found, k, own = words(text), len(self.ids), self.terms
        self.ids.append(doc_id)
        self.term.append(np.fromiter((own.setdefault(w, len(own)) for w in found), np.int32, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int32, len(found)))
        self.doc.append(np.full(len(found), k, np.int32))

    def arrays(self) -> dict[str, np.ndarray]:
        n, names = len(self.ids), sorted(self.terms)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter((self.terms[w] for w in names), np.int64, len(names))] = np.arange(len(names), dtype=np.int32)
        term, tf, doc = rank[np.concatenate(self.term)], np.concatenate(self.tf), np.concatenate(self.doc)
        df = np.bincount(term, minlength=len(names))
        # like documents become neighbours: order by which of the most frequent words they have
        common = np.argsort(-df, kind="stable")[:48]
        has = np.zeros((n, len(common)), bool)
        place = np.full(len(names), -1)
        place[common] = np.arange(len(common))
        hit = place[term] >= 0
        has[doc[hit], place[term[hit]]] = True
        new = np.empty(n, np.int32)
        order = np.lexsort(has.T[::-1]) if len(common) else np.arange(n)
        new[order] = np.arange(n, dtype=np.int32)
        at = np.lexsort((new[doc], term))
        blob = [w.encode("utf-8", "surrogatepass") for w in names]
        # the first entry stands for null: a number that is no id here
        taken = set(self.ids)
        null = next(x for x in itertools.count(-1, -1) if x not in taken)
        ids = np.array([null if x is None else x for x in self.ids], "<i8")
        length = np.bincount(new[doc], weights=tf, minlength=n).astype("<i8")
        return {"ids": np.concatenate((np.array([null], "<i8"), ids[order])), "length": length, "doc": new[doc][at].astype("<u2"), "tf": tf[at].astype("<i4"), "df": df.astype("<i4"), "size": np.array([len(x) for x in blob], "<i4"), "names": np.frombuffer(b"".join(blob), np.uint8)}


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    import pyarrow as pa

    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for a in arrays.values():
            data = pa.compress(a.tobytes(), codec="zstd", asbytes=True) if a.nbytes else b""
            out.write(struct.pack("<QQ", a.nbytes, len(data)))
            out.write(data)
    fs.move(temporary, path)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """An index shard in memory: postings by term, in runs of one block each."""

    def __init__(self, uri: str, mean_length: float, k1: float = K1, b: float = B):
        import pyarrow as pa

        fs, path = filesystem(uri)
        kinds, parts = ("<i8", "<i8", "<u2", "<i4", "<i4", "<i4", np.uint8), []
        with fs.open_input_stream(path) as file:
            for kind in kinds:
                size, packed = struct.unpack("<QQ", file.read(16))
                parts.append(np.frombuffer(pa.decompress(file.read(packed), size, codec="zstd", asbytes=True) if size else b"", kind))
        self.null, self.ids, length = parts[0][0], parts[0][1:], parts[1]
        self.doc, self.tf, df, size, names = parts[2:]
        edges, blob = np.concatenate(([0], np.cumsum(size))).tolist(), names.tobytes()
        self.names = [blob[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
        self.k1, self.norm = k1, k1 * (1 - b + b * length / mean_length) if mean_length else np.ones(len(length))
        n = len(self.ids)
        self.impact = (self.tf * (k1 + 1) / (self.tf + self.norm[self.doc])).astype(np.float32)
        self.df, self.edges = df.astype(np.int64), np.concatenate(([0], np.cumsum(df, dtype=np.int64)))
        # frequent terms by block, and their largest impact in each
        often = np.argsort(-self.df, kind="stable")[:FREQUENT]
        self.row, self.blocks = np.full(len(df), -1), max(1, -(-n // BLOCK))
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        for k, t in enumerate(often.tolist()):
            self.rows[self.doc[self.edges[t] : self.edges[t + 1]], k] = self.impact[self.edges[t] : self.edges[t + 1]]
        self.rows = self.rows.reshape(self.blocks, BLOCK, -1)
        self.most = self.rows.max(1)
        # all postings by document
        order = np.argsort(self.doc, kind="stable")
        self.doc_edges = np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=n))))
        self.doc_term, self.doc_tf = np.repeat(np.arange(len(df), dtype=np.int32), df)[order], self.tf[order]
        self.weight = np.zeros(len(df))
        #: Blocks that hold a word of a query, and those that were read.
        self.met = self.read = 0

    def _scored(self, docs: np.ndarray, best: list[tuple], k: int, floor: float) -> list[tuple]:
        """``best`` after these documents, by the weights of the query at work."""
        size = self.doc_edges[docs + 1] - self.doc_edges[docs]
        at, of = _ranges(self.doc_edges[docs], size), np.repeat(np.arange(len(docs)), size)
        weight = self.weight.take(self.doc_term.take(at))
        hit = np.flatnonzero(weight)
        at, of, weight = at.take(hit), of.take(hit), weight.take(hit)
        tf = self.doc_tf[at]
        part = tf * (self.k1 + 1) / (tf + self.norm[docs][of]) * weight
        score = np.bincount(of, weights=part, minlength=len(docs))
        least = -best[-1][0] if len(best) == k else floor
        if len(score) > k:
            least = max(least, np.partition(score, len(score) - k)[len(score) - k])
        # in doubles only the last digits depend on the order of the sum
        good = np.flatnonzero((score >= least * (1 - 1e-9)) & (score > 0))
        edge, new, known = np.searchsorted(of, np.arange(len(docs) + 1)), [], {}
        for d in good.tolist():
            parts = part[edge[d] : edge[d + 1]]
            sums = known.get(same := parts.tobytes())
            if sums is None:
                sums = known[same] = math.fsum(parts.tolist())
            x = self.ids[docs[d]]
            new.append((-sums, x != self.null, int(x)))
        return sorted([*best, *new])[:k]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], best: list[list[tuple]], floor: list[float], k: int = K) -> list[list[tuple]]:
        """For each query (places of its terms in names, weights) the k best of its ``best`` ((-score, has an id, id) so far,
        sorted) and this shard's documents. Documents below its ``floor`` may be left out."""
        n, m = self.blocks * BLOCK, len(queries)
        score, weight = np.zeros((m, n), np.float32), np.zeros((m, self.rows.shape[2]), np.float32)
        for q, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            weight[q, row[row >= 0]] = weights[row >= 0]
            terms, weights = terms[row < 0], weights[row < 0]
            size = self.df[terms]
            posting = _ranges(self.edges[terms], size)
            score[q] = np.bincount(self.doc.take(posting), weights=self.impact.take(posting) * np.repeat(weights.astype(np.float32), size), minlength=n)
        score = score.reshape(m, self.blocks, BLOCK)
        bound = (score.max(2) + weight @ self.most.T) * (1 + ROOM)
        done = np.zeros((m, self.blocks), bool)

        def read(want: np.ndarray) -> None:
            """Add the frequent terms in these blocks (query, block)."""
            for b in np.flatnonzero(want.any(0)).tolist():
                q = np.flatnonzero(want[:, b])
                score[q, b] += weight[q] @ self.rows[b].T
            done[want] = True

        least = np.array([max(f, -x[-1][0]) if len(x) == k else f for f, x in zip(floor, best, strict=True)])
        cold = np.flatnonzero(least == 0)
        if len(cold):
            top, want = np.argsort(-bound[cold], axis=1, kind="stable")[:, :FIRST_BLOCKS], np.zeros_like(done)
            want[cold[:, None], top] = True
            read(want & (bound > 0))
            known = score[cold[:, None], top].reshape(len(cold), -1)
            if known.shape[1] >= k:
                least[cold] = np.maximum(0, np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k] * (1 - ROOM))
        read((bound >= least[:, None]) & (bound > 0) & ~done)
        self.met, self.read = self.met + int(np.count_nonzero(bound)), self.read + int(np.count_nonzero(done))
        score[~done] = 0
        out = []
        for q, (terms, weights) in enumerate(queries):
            near = np.flatnonzero((score[q] >= least[q] * (1 - ROOM)) & (score[q] > 0))
            if len(near) > k:
                own = score[q].ravel()[near]
                near = near[own >= np.partition(own, len(own) - k)[len(own) - k] * (1 - ROOM)]
            if len(near):
                self.weight[terms] = weights
                out.append(self._scored(near, best[q], k, floor[q]))
                self.weight[terms] = 0.0
            else:
                out.append(best[q])
        return out


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text). Returns the written catalogue: uri, docs, length, and for each
    shard and term a row with term, df."""
    folder = run_path(docs.sparkSession, "index")

    def index(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, own = TaskContext.get().partitionId(), 0, Builder()

        def flush():
            arrays, uri = own.arrays(), f"{folder}/{part:06d}-{n:06d}.idx"
            save(uri, arrays)
            names = sorted(own.terms)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(own.ids)], pa.int64()), pa.array([int(arrays["length"].sum())], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.int64())], names=["uri", "docs", "length", "term", "df"])
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some), pa.array(arrays["df"][at : at + 50_000].astype(np.int64))], names=["uri", "docs", "length", "term", "df"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own.add(doc_id, text.as_py())
                if len(own.ids) == shard_docs:
                    yield from flush()
                    n, own = n + 1, Builder()
        if own.ids:
            yield from flush()

    return write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, "uri string, docs long, length long, term string, df long"), "index-catalogue")[0]


def query_terms(queries: DataFrame, catalogue: DataFrame, total: int) -> DataFrame:
    """query_key, query_id, terms: array of struct(term, weight): idf times the term's number in the query."""
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [words(t) for t in part.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(rows)) for c in ("query_key", "query_id")] + [pa.array([w for c in found for w in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["query_key", "query_id", "term", "n"])

    keyed = queries.select(F.monotonically_increasing_id().alias("query_key"), F.col("doc_id").cast("long").alias("query_id"), "text")
    each, _ = write_table(keyed.mapInArrow(cut, "query_key long, query_id long, term string, n long"), "query-terms")
    df = catalogue.where("term is not null").join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return each.join(df, "term").select("query_key", "query_id", F.struct("term", (idf * F.col("n")).alias("weight")).alias("t")).groupBy("query_key", "query_id").agg(F.collect_list("t").alias("terms"))


def search(docs: DataFrame, is_query: Column, k: int = K, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents for every row of ``docs`` (doc_id, text) that
    ``is_query`` holds for, by the row's whole text, against all rows."""
    spark = docs.sparkSession
    if shard_docs > 1 << 16:
        raise ValueError("places of documents in a shard are 16-bit numbers")
    small_batches(spark)
    catalogue = build(docs, shard_docs)
    shards = catalogue.where("uri is not null").select("uri", "docs", "length")
    sums = shards.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    schema = T.StructType.fromDDL("query_key long, query_id long, doc_id long, score double")
    empty = spark.createDataFrame([], schema)
    if not sums["docs"]:
        return empty.select("query_id", F.lit(0).alias("rank"), "doc_id", "score")
    queries = docs.where(is_query).select("doc_id", "text")
    files = max(1, math.ceil(queries.count() / QUERY_FILE))
    terms, _ = write_table(query_terms(queries, catalogue, sums["docs"]).withColumn("floor", F.lit(0.0)).repartition(files), "queries")
    mean = sums["length"] / sums["docs"]
    if not terms.inputFiles():
        return empty.select("query_id", F.lit(0).alias("rank"), "doc_id", "score")
    # a few shards and a file of queries are a task: the k-th score so far prunes in the next shard
    groups = max(1, math.ceil(shards.count() / SHARDS_A_TASK))
    listed = shards.groupBy(F.pmod(F.xxhash64("uri"), F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list("uri")).alias("uris"))
    listed, _ = write_table(listed, "search-shards")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for uris, block in zip(batch.column("uris").to_pylist(), batch.column("block").to_pylist(), strict=True):
                fs, path = filesystem(block)
                with fs.open_input_file(path) as handle:
                    queries = pq.read_table(handle)
                keys, ids, floor, lists = *(queries.column(c).to_pylist() for c in ("query_key", "query_id", "floor")), queries.column("terms").combine_chunks()
                flat = lists.flatten()
                weights, edges = flat.field(1).to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).tolist()
                known: dict[bytes, int] = {}
                place = np.array([known.setdefault(x.encode("utf-8", "surrogatepass"), len(known)) for x in flat.field(0).to_pylist()], np.int64)
                best: list[list[tuple]] = [[] for _ in keys]
                for uri in uris:
                    shard, local = Shard(uri, mean), np.full(len(known), -1)
                    here = np.fromiter((known.get(x, -1) for x in shard.names), np.int64, len(shard.names))
                    local[here[here >= 0]] = np.flatnonzero(here >= 0)
                    own = local[place]
                    for at in range(0, len(keys), BATCH):
                        some = [(own[a:z], weights[a:z]) for a, z in itertools.pairwise(edges[at : at + BATCH + 1])]
                        best[at : at + BATCH] = shard.search([(t[t >= 0], w[t >= 0]) for t, w in some], best[at : at + BATCH], floor[at : at + BATCH], k)
                rows = [(keys[q], ids[q], has, i, -s) for q, b in enumerate(best) for s, has, i in b]
                if rows:
                    key, query, has, doc, score = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(query, pa.int64()), pa.array(np.array(doc, np.int64), mask=~np.array(has, bool)), pa.array(score, pa.float64())], names=["query_key", "query_id", "doc_id", "score"])

    def found_in(some: DataFrame, terms: DataFrame) -> DataFrame:
        jobs, _ = write_table(some.select("uris", F.explode(F.array(*[F.lit(b) for b in terms.inputFiles()])).alias("block")), "search-jobs")
        return jobs.repartition(max(1, jobs.count())).mapInArrow(run, schema)

    # the first shards give every query a k-th score, a floor for all others
    start = listed.agg(F.min("group")).first()[0]
    found, _ = write_table(found_in(listed.where(F.col("group") == start), terms), "search-first")
    if groups > 1:
        floors = found.groupBy("query_key").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_key", "kth")
        raised, _ = write_table(terms.drop("floor").join(floors, "query_key", "left").select("query_key", "query_id", "terms", F.coalesce("kth", F.lit(0.0)).alias("floor")).repartition(files), "queries-raised")
        found = found.unionByName(found_in(listed.where(F.col("group") != start), raised))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
