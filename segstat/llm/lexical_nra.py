"""Ranked lexical search by NRA: sorted reads only, with an interval for every document met.

A document's score for a query sums ``weight * ((10^9 * tf) div (1000 * tf + 8 * m))`` over the query's
terms, repeats included, all in 64-bit integers; ``m`` grows with the document's length. Terms are runs of ASCII letters and
digits and of all code points from 128, with A-Z lower-cased.

One pass over the texts writes, for each document with a term, its length and its counts of query terms (words are
found by a hash and held against the term's bytes). Sums over that table give N, L and df. A second pass cuts it
into segments of about ``SEGMENT`` postings, as a task meets them, and sorts each term's postings by impact. A query
reads its lists from the highest impact down, a growing stretch of all lists in each round: a document's lower
bound is what has been read of it, its upper bound adds the last impact read of each list that it was not met in. Reading
ends when no document that is unmet or still uncertain can reach or tie the k-th lower bound and all that do are exact.
The k-th score of a task's segments so far is the next one's bound to reach. Each task sends k documents for a query.

Queries are dealt into blocks of at most ``BLOCK_TERMS`` terms (or one query); a block's terms go to every task, and blocks
are worked off one after the other, so what is sent does not grow with the documents and is bounded for any number of queries.

Defined cases: missing and empty texts have no terms and count nowhere; a query without known terms has no rows; rows that
share an id are documents, or queries, of their own; equal scores go by id (a missing one first), then by place; long texts are
read whole; empty tables give no rows; extra columns play no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.ordering import running_totals
from . import bytescan
from .tables import map_texts, materialize

TOP = 10
BLOCK_TERMS = 200_000
SEGMENT = 1_000_000
FIRST_READ = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _scan(texts: pa.Array) -> tuple[bytescan.Scan, np.ndarray, np.ndarray]:
    """Texts with A-Z lower-cased, and where their terms start and end."""
    scan = bytescan.scan(texts)
    scan.data = _LOWER[scan.data]
    scan.space = ~_TERM[scan.data]
    return scan, *scan.words()


def _terms(text: str | None) -> list[bytes]:
    scan, starts, ends = _scan(pa.array([text or ""]))
    data = scan.data.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(query, item_id, terms, counts) of each row that has terms; terms and counts are arrays."""
    named = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found: dict[bytes, int] = {}
                for term in _terms(batch.column(2)[i].as_py()):
                    found[term] = found.get(term, 0) + 1
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(found)], pa.int64()),
                         pa.array([list(found)], pa.list_(pa.binary())), pa.array([list(found.values())], pa.list_(pa.int64()))],
                        names=["query", "item_id", "n", "terms", "counts"])

    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("item_id", named.schema["item_id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    return named.mapInArrow(run, schema)


class Terms:
    """The terms of a block of queries, found in texts by hash and bytes."""

    def __init__(self, terms: list[bytes]):
        scan = bytescan.scan(pa.array(terms, pa.binary()))
        hashes = scan.hashes(scan.starts, scan.ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], order
        self.data, self.starts, self.lengths = scan.data, scan.starts, scan.ends - scan.starts
        # Where terms share a hash, or a word has a term's hash but other bytes, the bytes decide.
        shared = bytescan.repeated(hashes)
        self.shared = set(hashes[shared].tolist())
        self.numbers = {terms[i]: i for i in np.flatnonzero(shared)}

    def find(self, scan: bytescan.Scan, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that are no term."""
        found = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.hashes):
            return found
        hashes = scan.hashes(starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = self.at[place]
        maybe = np.flatnonzero((self.hashes[place] == hashes) & (self.lengths[number] == ends - starts))
        equal = bytescan.same_bytes(scan.data, starts[maybe], self.data, self.starts[number[maybe]], (ends - starts)[maybe])
        found[maybe[equal]] = number[maybe[equal]]
        if self.shared:
            for i in np.flatnonzero(np.isin(hashes, np.array(list(self.shared), np.uint64))):
                found[i] = self.numbers.get(scan.data[starts[i]:ends[i]].tobytes(), -1)
        return found


def index(docs: DataFrame, terms: Terms, id_column: str, text: str) -> DataFrame:
    """(doc_id, uid, n, terms, tfs) of every document with a term: its length, and numbers and counts of query terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(texts: pa.Array) -> list:
        scan, starts, ends = _scan(texts)
        number = sent.value.find(scan, starts, ends)
        met = np.flatnonzero(number >= 0)
        owner = scan.owner(starts[met])
        pair, counts = np.unique(owner << 32 | number[met], return_counts=True)
        cut = np.searchsorted(pair, np.arange(1, scan.n) << 32)
        split = lambda x: [p.tobytes() for p in np.split(x.astype("<i4"), cut)]
        return [pa.array(scan.per_text(starts)), split(pair & 0xFFFFFFFF), split(counts)]

    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())]
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(named, ["doc_id"], fields, run).where("n > 0").withColumn("uid", F.monotonically_increasing_id())


def _frequencies(indexed: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; tasks add up first, and the driver gets one number for each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    counted = indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return df


class Reader:
    """The impact-sorted lists of one segment, read from the top by one query at a time."""

    def __init__(self, docs: int, terms: np.ndarray, owners: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((owners, -impacts, terms))
        self.docs, self.owners, self.impacts = docs, owners[order], impacts[order]
        ranked = terms[order]
        known = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        self.span = dict(zip(ranked[known].tolist(), zip(known.tolist(), np.append(known[1:], len(ranked)).tolist())))

    def top(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach ``floor`` (at least 1) and the k-th best score, and their exact scores."""
        lists = [(count, *self.span[t]) for t, count in query if t in self.span]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower = np.zeros(self.docs, np.int64)
        unseen = np.ones((len(lists), self.docs))
        read = [start for _, start, _ in lists]
        frontier = np.array([count * int(self.impacts[start]) for count, start, _ in lists], np.int64)
        if int(frontier.sum()) >= 1 << 53:
            unseen = unseen.astype(np.int64)       # doubles would not hold the bounds exactly
        step = FIRST_READ
        while True:
            for i, (count, _, end) in enumerate(lists):
                stop = min(read[i] + step, end)
                if stop > read[i]:
                    met = self.owners[read[i]:stop]
                    lower[met] += count * self.impacts[read[i]:stop]
                    unseen[i, met] = 0
                    frontier[i] = count * int(self.impacts[stop - 1]) if stop < end else 0
                    read[i] = stop
            step *= 2
            need = max(floor, int(np.partition(lower, -k)[-k]) if self.docs >= k else 0, 1)
            rest = int(frontier.sum())
            if rest >= need:
                continue                            # a document not met so far could still be among the best
            open_ = np.flatnonzero(lower + rest >= need)
            more = frontier.astype(unseen.dtype) @ unseen[:, open_]
            within = lower[open_] + more >= need
            if not more[within].any():
                chosen = open_[within]
                return chosen, lower[chosen]


def _ranked(indexed: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, segment: int) -> DataFrame:
    """(query, doc_id, uid, score): at least the k best documents of each task for each query."""
    sent = indexed.sparkSession.sparkContext.broadcast((queries, weights))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", indexed.schema["doc_id"].dataType), T.StructField("uid", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best: dict[int, list[tuple]] = {}
        held, size = [], 0

        def settle() -> None:
            rows = pa.Table.from_batches(held)
            terms, tfs = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("terms", "tfs"))
            owners = np.repeat(np.arange(rows.num_rows), [len(x) // 4 for x in rows.column("terms").to_pylist()])
            m = 100 - 75 + (75 * rows.column("n").to_numpy() * n_docs) // n_terms
            impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owners]))
            reader = Reader(rows.num_rows, terms, owners, impacts)
            ids, uids = rows.column("doc_id"), rows.column("uid").to_numpy()
            for query, wanted in queries:
                top = best.get(query, [])
                docs, scores = reader.top(wanted, k, top[-1][0] if len(top) == k else 1)
                if len(docs):
                    met = [(s, ids[d].as_py(), int(uids[d])) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[query] = sorted(top + met, key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0, x[2]))[:k]

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                held.append(part)
                size += sum(map(len, part.column(2).to_pylist())) // 4
                if size >= segment:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        found = [(q, d, u, s) for q, top in best.items() for s, d, u in top]
        if found:
            columns = zip(*found)
            kinds = [pa.int64(), ids_type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "doc_id", "uid", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    ids_type = to_arrow_type(indexed.schema["doc_id"].dataType)
    return indexed.select("doc_id", "n", "terms", "tfs", "uid").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           k: int = TOP, block_terms: int = BLOCK_TERMS, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 for each row of ``items``."""
    queries = materialize(query_terms(items, item_id, item_text), "queries")
    blocked = materialize(running_totals(queries.select("query", "n"), [], "query", ["n"])
                          .select("query", F.expr(f"(cum_n - n) div {block_terms}").alias("block")), "query-blocks")
    found = None
    for (block,) in blocked.select("block").distinct().orderBy("block").toLocalIterator():
        # At most block_terms terms, or one query more.
        own = queries.join(blocked.where(F.col("block") == block), "query").select("query", "terms", "counts").toArrow()
        numbers: dict[bytes, int] = {}
        wanted = [(q, [(numbers.setdefault(t, len(numbers)), c) for t, c in zip(ts, cs)])
                  for q, ts, cs in zip(*(own.column(c).to_pylist() for c in ("query", "terms", "counts")))]
        indexed = materialize(index(docs, Terms(list(numbers)), id_column, text), "postings")
        n_docs, n_terms = indexed.agg(F.count("*"), F.sum("n")).first()
        df = _frequencies(indexed, len(numbers))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        ranked = materialize(_ranked(indexed, wanted, weights, n_docs, n_terms or 1, k, segment), "ranked")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        kind = docs.schema[id_column].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"query long, doc_id {kind}, uid long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "uid")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_SQL_TERMS}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, t),
size AS (SELECT doc_id, sum(tf) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM size),
met AS (SELECT doc_id, CAST(100 - 75 + (75 * n * docs) // terms AS BIGINT) AS m FROM size, total),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, total GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_SQL_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, t),
scored AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN d USING (t) JOIN weight USING (t) JOIN met USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {TOP}"""
