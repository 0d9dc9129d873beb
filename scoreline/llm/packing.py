"""Lexical retrieval packing: windows filled with a seed document and its closest unused neighbours.

1. Token ids of all documents are written once; document frequencies and the mean length count the whole corpus.
2. Documents are dealt to shards of about SHARD_BYTES of text by lexical content: about PIVOTS documents a shard are
   pivots, related ones next to each other, in a tree of up to FAN branches a node. Each document goes to the pivot
   with the largest cosine of its terms' weights, as a random projection keeps it. Ranges of the order of pivots, cut
   where a sample says, are sorted by it, and shards are cut off them as they pass by.
   Related documents thus stand in the same or in adjoining shards at any size; documents of one pivot stand in order
   of a hash.
3. In each shard all terms of a seed give BM25 scores, with the corpus' statistics: the first unused document seeds a
   window, unused neighbours in order of score fill it greedily; the document that no longer fits is cut, and its
   rest opens the next window, whose neighbours it seeks. So every sequence but a shard's last one is exactly full.

A shard's size doesn't depend on the corpus or on the sample: rows are counted as they pass, so memory is bounded by
2 * SHARD_BYTES and the longest document, while Spark's sort holds a range, which may spill; the driver holds the pivots' projections, MAX_PIVOTS at most, and SAMPLE keys. Rows that are equal in id and text are dealt out
by their place in the input, so that many of them don't meet in one shard.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; null ids stay null; an
empty table gives an empty table; other columns are ignored. Ties of scores go to the document that comes last by (doc_id, token ids).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import sum_over, written
from scoreline.llm.tokens import encoder_on, shared_encoder

WINDOW = 4096
END_ID = 2
#: Text of a shard, about; none holds more than twice as much, unless one document does.
SHARD_BYTES = 4 << 20
#: BM25's two constants.
K1, B = 1.2, 0.75
#: A term that more than one in DENSE of a shard's documents hold is kept as a row of all their weights; best documents sorted at first.
DENSE, FEW = 4, 64
#: Pivots for each shard, FAN at least in all; branches of a node of their tree, and its levels (10 bits of a key each).
PIVOTS, FAN, LEVELS = 4, 512, 3
#: No more pivots than this (64 MB), enough for 256 GB of text; beyond that more documents share a pivot.
MAX_PIVOTS = 1 << 18
#: Dimensions in which documents and pivots are compared, and terms that numpy projects at once.
DIM, STEP = 64, 1 << 12
#: Rows, about, whose keys tell where ranges of keys are cut; where there are more shards than keys, ranges hold several shards.
SAMPLE = 1 << 17
#: What sequence_id grows by from range to range: no range has so many sequences.
STRIDE = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def distinct_terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of each term of each document, in this order."""
    n = len(bounds) - 1
    terms = int(ids.max()) + 1 if len(ids) else 1
    kind = np.uint32 if terms * n < 1 << 32 else np.uint64
    key = np.repeat(np.arange(n, dtype=kind), np.diff(bounds)) * kind(terms) + ids.astype(kind)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    doc, term = np.divmod(key[first], kind(terms))
    return doc.astype(np.int32), term.astype(np.int32), np.diff(np.append(first, len(key))).astype(np.float32)


class Corpus:
    """What BM25 knows of all documents: for each term how many hold it, and their number and mean length."""

    def __init__(self, df: np.ndarray, docs: float, tokens: float):
        self.df, self.docs, self.mean = df, docs, max(1.0, tokens / docs if docs else 1.0)
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)

    @cached_property
    def directions(self) -> np.ndarray:
        """Made once by a worker, not by each of its tasks."""
        return projection(self)


class Index:
    """The inverted index of one shard: for each term the documents that hold it, with their BM25 weights."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, corpus: Corpus | None = None):
        self.docs = np.arange(len(bounds) - 1)
        doc, term, tf = distinct_terms(ids, bounds)
        corpus = corpus or Corpus(np.bincount(term), len(self.docs), len(ids))
        norm = (K1 * (1 - B + B * np.diff(bounds) / corpus.mean)).astype(np.float32)
        weight = corpus.idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        self.terms = len(corpus.idf)
        many = np.bincount(term, minlength=self.terms) * DENSE > len(self.docs)
        often = many[term]
        #: For each term that very many documents hold its row in dense, which has a column a document; else -1.
        self.row = np.where(many, many.cumsum() - 1, -1)
        self.dense = np.zeros((int(many.sum()), len(self.docs)))
        self.dense[self.row[term[often]], doc[often]] = weight[often]
        doc, term, weight = doc[~often], term[~often], weight[~often]
        self._hold(np.argsort(term, kind="stable"), doc.astype(np.intp), term, weight.astype(float))

    def _hold(self, order: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        #: Postings by term; owner is a place in docs.
        self.owner, self.term, self.weight = owner[order], term[order], weight[order]
        self.bounds = np.append(0, np.bincount(self.term, minlength=self.terms).cumsum())

    def keep(self, unused: np.ndarray) -> None:
        """Forgets used documents once they are half of those held."""
        kept = unused[self.docs]
        if 2 * kept.sum() < len(kept):
            place = kept.cumsum() - 1
            self.docs, self.dense = self.docs[kept], self.dense[:, kept]
            self._hold(np.flatnonzero(kept[self.owner]), place[self.owner], self.term, self.weight)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of the documents that are held, against all terms of these ids."""
        ids = np.sort(ids)
        asked = ids[np.append(True, ids[1:] != ids[:-1])[: len(ids)]]
        low, n = self.bounds[asked], self.bounds[asked + 1] - self.bounds[asked]
        entry = np.arange(n.sum()) + np.repeat(low - n.cumsum() + n, n)
        out = np.bincount(self.owner.take(entry, mode="clip"), self.weight.take(entry, mode="clip"), len(self.docs)).astype(float, copy=False)
        row = self.row[asked]
        for k in row[row >= 0].tolist():
            out += self.dense[k]
        return out


def best_first(docs: np.ndarray, score: np.ndarray) -> Iterator[int]:
    """docs by falling score, later ones first among equals; sorts the best FEW, then, if they are asked for, eight times as many, and so on."""
    few = FEW
    while len(docs):
        best = score >= np.partition(score, -few)[-few] if len(docs) > 2 * few else np.ones(len(docs), bool)
        yield from docs[best][np.argsort(score[best], kind="stable")][::-1].tolist()
        docs, score, few = docs[~best], score[~best], 8 * few


def fill_windows(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; document d is ids[bounds[d]:bounds[d + 1]], never empty."""
    index = Index(ids, bounds, corpus)
    n, sizes = len(bounds) - 1, np.diff(bounds).tolist()
    unused = np.ones(n, bool)
    sequence = offset = next_seed = 0
    rest: tuple[int, int] | None = None  # a document that was cut, and how much of it is placed
    while True:
        if rest is None:
            while next_seed < n and not unused[next_seed]:
                next_seed += 1
            if next_seed == n:
                return
            rest = (next_seed, 0)
            unused[next_seed] = False
        seed = rest[0]
        queue: Iterator[int] | None = None
        while rest is not None:
            doc, start = rest
            length = min(sizes[doc] - start, window - offset)
            yield doc, start, length, sequence, offset
            offset += length
            rest = (doc, start + length) if start + length < sizes[doc] else None
            if offset == window:
                sequence, offset = sequence + 1, 0
                break  # the window is full: what is left of the document seeds the next one
            if queue is None:
                index.keep(unused)
                score = index.scores(ids[bounds[seed] : bounds[seed + 1]])
                left = unused[index.docs]
                queue = best_first(index.docs[left], score[left])
            if (doc := next(queue, None)) is not None:
                rest = (doc, 0)
                unused[doc] = False
        # Here a window has just been filled, or no document is left unused.


def ids_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of a column of binaries one after another, and where each row begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    data = column.buffers()[2]
    ids = np.frombuffer(data, kind)[offsets[0] : offsets[-1]] if data and len(column) else np.empty(0, kind)
    return ids, (offsets - offsets[0]).astype(np.int64)


def projection(corpus: Corpus) -> np.ndarray:
    """For each term a random direction in DIM dimensions, as long as the term is telling. The same on every machine."""
    table = np.random.default_rng(17).standard_normal((len(corpus.idf), DIM), np.float32)
    return table * corpus.idf[:, None]


def projected(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One row of length 1 for each document: the sum of all its terms' directions, weighted by BM25's count weight.

    Cosines of rows are those of the documents' weighted terms, give or take 1 / sqrt(DIM).
    """
    doc, term, tf = distinct_terms(ids, bounds)
    n = len(bounds) - 1
    out, first = np.zeros((n, DIM), np.float32), np.searchsorted(doc, np.arange(n + 1))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(first, first[a] + STEP, "right")) - 1)
        part = slice(first[a], first[b])
        rows = table[term[part]] * (tf[part] / (tf[part] + np.float32(K1)))[:, None]
        out[a:b] = np.add.reduceat(rows, first[a:b] - first[a])
        a = b
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Pivots:
    """A node of the tree: up to FAN pivots, each next to a related one, and nodes of the pivots closest to each."""

    def __init__(self, rows: np.ndarray, level: int = 1):
        heads = rows[:FAN]
        # A chain: after each pivot comes the closest one that is left.
        alike, chain, left = heads @ heads.T, [0], np.ones(len(heads), bool)
        left[0] = False
        while len(chain) < len(heads):
            chain.append(int(np.argmax(np.where(left, alike[chain[-1]], -2))))
            left[chain[-1]] = False
        self.heads = heads[chain]
        self.under: dict[int, Pivots] = {}
        if len(rows) > FAN and level < LEVELS:
            rest = rows[FAN:]
            near = self.nearest(rest)
            for k in np.unique(near).tolist():
                self.under[k] = Pivots(np.vstack([self.heads[k : k + 1], rest[near == k]]), level + 1)

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """For each row the pivot of the largest cosine."""
        return np.concatenate([np.empty(0, np.int64), *((rows[k : k + 4096] @ self.heads.T).argmax(axis=1) for k in range(0, len(rows), 4096))])

    def places(self, rows: np.ndarray, level: int = 1) -> np.ndarray:
        """For each row where its pivot stands in the order of all pivots."""
        near = self.nearest(rows)
        out = near << 10 * (LEVELS - level)
        for k in np.unique(near).tolist():
            if k in self.under:
                members = np.flatnonzero(near == k)
                out[members] += self.under[k].places(rows[members], level + 1)
        return out


def lexical_keys(ids: np.ndarray, bounds: np.ndarray, salt: np.ndarray, table: np.ndarray, pivots: Pivots) -> np.ndarray:
    """For each document the place of its pivot, then the salt, in one number that sorts like them."""
    return pivots.places(projected(ids, bounds, table)) << 32 | salt & 0xFFFFFFFF


def shard_cuts(keys: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """Keys at which a next shard begins, so that the sampled sizes are shared out evenly."""
    if not len(keys):
        return keys
    order = np.argsort(keys, kind="stable")
    total = sizes[order].cumsum()
    return np.unique(keys[order][np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most window tokens; needs doc_id and text."""
    spark = docs.sparkSession
    shared = shared_encoder(spark, tokenizer_path)
    terms = encoder_on(shared).tokenizer.get_vocab_size()
    kind = "<u2" if terms <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_on(shared)
        for batch in batches:
            ids, bounds = encoder.flat_ids(batch.column("text"), END_ID)
            ids = ids.astype(kind)
            offsets = (bounds * ids.itemsize).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "place")), raw], names=["doc_id", "size", "place", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(terms + 2)
        for batch in batches:
            ids, bounds = ids_of(batch.column("ids"), kind)
            out[:terms] += np.bincount(distinct_terms(ids, bounds)[1], minlength=terms)
            out[terms:] += len(batch), len(ids)
        return out

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    coded = written(texts.withColumns({"size": (F.octet_length("text") + 1).cast("long"), "place": F.monotonically_increasing_id()}).mapInArrow(encode, "doc_id long, size long, place long, ids binary"))
    counts = sum_over(coded.select("ids"), count, terms + 2, "<f8")
    corpus = spark.sparkContext.broadcast(Corpus(counts[:terms], counts[terms], counts[terms + 1]))
    # The salt tells equal rows apart by where they stand in the written table.
    hashed = coded.withColumns({"hash": F.xxhash64("doc_id", "ids"), "salt": F.pmod(F.xxhash64("doc_id", "ids", "place"), F.lit(1 << 32))})
    total = coded.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    one_in = lambda n: F.pmod("hash", F.lit(max(1, int(counts[terms]) // n))) == 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = corpus.value.directions
        for batch in batches:
            if len(batch):
                rows = projected(*ids_of(batch.column("ids"), kind), table)
                yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["hash", "row"])

    wanted = min(MAX_PIVOTS, max(FAN, PIVOTS * shards))
    chosen = hashed.filter(one_in(wanted)).select("hash", "ids").mapInArrow(project, "hash long, row binary").distinct().toArrow().sort_by("hash")
    rows = np.frombuffer(b"".join(chosen.column("row").to_pylist()), np.float32).reshape(-1, DIM)
    pivots = spark.sparkContext.broadcast(Pivots(rows if len(rows) else np.zeros((1, DIM), np.float32)))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        table = corpus.value.directions
        for batch in batches:
            if len(batch):
                ids, bounds = ids_of(batch.column("ids"), kind)
                yield batch, lexical_keys(ids, bounds, batch.column("salt").to_numpy(), table, pivots.value)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in with_keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("size")], names=["key", "size"])

    sampled = hashed.filter(F.pmod("salt", F.lit(max(1, int(counts[terms]) // SAMPLE))) == 0).mapInArrow(sample, "key long, size long").toArrow()  # about SAMPLE rows
    cuts = shard_cuts(sampled.column("key").to_numpy(), sampled.column("size").to_numpy(), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, keys in with_keys(batches):
            part = pa.array(np.searchsorted(cuts, keys, "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), batch.column("size"), pa.array(keys), part], names=["doc_id", "ids", "size", "_key", "_range"])

    def pack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = -1, 0
        for part, rows in shards_of(batches):
            first, at = (0 if part != at else first), part
            pieces, used = pack_rows(rows, kind, window, corpus.value, part * STRIDE + first)
            first += used
            yield pieces

    ranges = hashed.mapInArrow(deal, "doc_id long, ids binary, size long, _key long, _range int").repartition("_range").sortWithinPartitions("_range", "_key")
    return ranges.mapInArrow(pack_ranges, SCHEMA)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(range, rows) of shards: the rows of a range in order, cut where they would pass 2 * SHARD_BYTES. A longer row is a shard."""
    held: list[pa.RecordBatch] = []
    part, total = -1, 0
    for batch in batches:
        begin = 0
        for k, (r, size) in enumerate(zip(batch.column("_range").to_pylist(), batch.column("size").to_pylist())):
            if (held or k > begin) and (r != part or total + size > 2 * SHARD_BYTES):
                yield part, pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                held, begin, total = [], k, 0
            part, total = r, total + size
        if begin < len(batch):
            held.append(batch.slice(begin))
    if held:
        yield part, pa.Table.from_batches(held)


def pack_rows(rows: pa.Table, kind: str, window: int, corpus: Corpus, first: int) -> tuple[pa.RecordBatch, int]:
    """SCHEMA for the rows of one shard, whose sequences count from first, and how many sequences they are."""
    rows = rows.select(["doc_id", "ids"]).sort_by([("doc_id", "ascending"), ("ids", "ascending")]).combine_chunks()
    doc_ids = rows.column("doc_id").to_pylist()
    ids, bounds = ids_of(rows.column("ids").chunk(0), kind)
    raw = ids.astype("<u4").view(np.uint8)
    sizes, begins = np.diff(bounds).tolist(), bounds.tolist()
    out = [
        (doc_ids[d], start, length, zlib.crc32(raw[4 * (begins[d] + start) : 4 * (begins[d] + start + length)]), sizes[d], first + sequence, offset)
        for d, start, length, sequence, offset in fill_windows(ids, bounds, window, corpus)
    ]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pieces = pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*out)], names=names)
    return pieces, out[-1][5] - first + 1
