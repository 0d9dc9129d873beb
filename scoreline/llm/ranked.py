"""Ranked lexical search with bag deduplication: documents that look alike to every item are scored once.

1. Bags. The items' terms are the vocabulary; each document becomes its bag: the vocabulary's terms in it with how
   often they occur, and its length. Corpus statistics count all documents and all their terms.
2. Classes. A document's length enters scores only by its m, so documents with the same bag and the same m have the
   same score for every item. Bags are hashed and grouped by hash, m and the bag itself, so that equal hashes are
   verified. Each task keeps at most k members of a class before the shuffle, in order of doc_id: no item can have
   more of them among its first k.
3. Scores. An inverted index of the items gives the scores of a batch of classes at once; a task keeps the first k
   classes of each item, and so does the whole.
4. Members. Classes become their documents again, and the first k of these are the result.

Items go in blocks of at most BLOCK_ITEMS rows and about BLOCK_BYTES of text, so what is broadcast is bounded; the
result of each block is written, and all blocks are read as one table.

Defined results: null and empty texts have no terms and are never found; an item without terms has no rows; repeated
rows of documents or items count each; null ids come after all others; empty tables give an empty table. Other
columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import sum_over, written
from scoreline.sources.scratch import shared_path

#: Documents kept for each item.
TOP = 10
#: Items that are searched for in one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Sums that numpy holds at once, and entries of the items' index that it adds up at once.
CELLS, STEP = 4 << 20, 4 << 20
#: Ids of nulls in orders: after all others.
LAST = (1 << 63) - 1

#: For each byte what it stands for in a term: ASCII letters in lower case, digits, and all bytes of other letters; else a space.
_BYTES = bytes(i if i > 127 or chr(i).isdigit() or chr(i).islower() else i + 32 if chr(i).isupper() and i < 128 else 32 for i in range(256))

RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return raw.translate(_BYTES).split()


def rows_of(column: pa.Array) -> list[bytes]:
    """A column of strings as bytes, nulls as nothing."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


class Items:
    """The vocabulary and, for each term, the items that hold it with how often."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.vocabulary = ids, {}
        counts: dict[tuple[int, int], int] = {}
        for i, raw in enumerate(texts):
            for term in terms_of(raw):
                at = (self.vocabulary.setdefault(term, len(self.vocabulary)), i)
                counts[at] = counts.get(at, 0) + 1
        rows = np.array([(t, i, n) for (t, i), n in sorted(counts.items())], np.int64).reshape(-1, 3)
        self.item, self.times = rows[:, 1], rows[:, 2]
        self.bounds = np.append(0, np.bincount(rows[:, 0], minlength=len(self.vocabulary)).cumsum())

    def weigh(self, docs: int, df: np.ndarray) -> None:
        """Sets what each posting is worth: the term's weight as often as the item holds it."""
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        self.worth = np.repeat(weights, np.diff(self.bounds)) * self.times
        # Doubles hold all whole sums below 2 ** 53; beyond, sums are taken in integers.
        self.exact = len(self.item) == 0 or np.bincount(self.item, self.worth * 1e6).max() < 2**53

    def scores(self, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """(classes x items): the scores of classes with these entries, in order of owner."""
        out = np.zeros(len(m) * len(self.ids), float if self.exact else np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
        n = self.bounds[term + 1] - self.bounds[term]
        upto = n.cumsum()
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, "right")))
            k = n[a:b]
            entry = np.arange(k.sum()) + np.repeat(self.bounds[term[a:b]] - k.cumsum() + k, k)
            cell = np.repeat(owner[a:b] * len(self.ids), k) + self.item[entry]
            add = self.worth[entry] * np.repeat(share[a:b], k)
            if self.exact:
                low = int(owner[a]) * len(self.ids)
                sums = np.bincount(cell - low, add)
                out[low : low + len(sums)] += sums
            else:
                np.add.at(out, cell, add)
            a = b
        return out.astype(np.int64).reshape(len(m), len(self.ids))


class Best:
    """The first k classes of each item among those seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.first = np.empty(0, np.int64)
        self.docs: list = []

    def see(self, scores: np.ndarray, first: np.ndarray, docs: pa.Array) -> None:
        row, item = np.nonzero(scores >= self.least)
        every = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.first, first[row]))]
        order = np.lexsort((every[2], -every[1], every[0]))
        item = every[0][order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        held = len(self.docs)
        self.docs = [self.docs[j] if j < held else docs[int(row[j - held])].as_py() for j in kept.tolist()]
        self.item, self.score, self.first = (x[kept] for x in every)
        full = place[place < self.k] == self.k - 1
        self.least[self.item[full]] = self.score[full]


def classes_of(bags: DataFrame, k: int) -> DataFrame:
    """(m, bag, docs): bags (doc_id, m, bag), each once, with the first k documents that have it."""
    hashed = bags.withColumn("hash", F.xxhash64("m", "bag"))
    # Numbered and cut to k in each task before the shuffle, so a class of very many copies doesn't meet in one task.
    of_class = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    return hashed.withColumn("_n", F.row_number().over(of_class)).filter(F.col("_n") <= k).groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list(member)).alias("docs"))


def search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """RESULT for the items of one block; docs: (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items.vocabulary)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            sizes, bags = [], []
            for raw in rows_of(batch.column("text")):
                found = terms_of(raw)
                held = [t for t in map(get, found) if t is not None]
                term, tf = np.unique(np.array(held, "<u4"), return_counts=True)
                sizes.append(len(found))
                bags.append(term.tobytes() + tf.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            held = [np.frombuffer(b, "<u4") for b in batch.column("bag").to_pylist()]
            out += np.bincount(np.concatenate([np.empty(0, "<u4"), *(b[: len(b) // 2] for b in held)]), minlength=len(out))
        return out

    bags = written(docs.mapInArrow(bag, "doc_id long, n long, bag binary"), "bags")
    docs_with, length = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    found = bags.filter("length(bag) > 0")
    items.weigh(docs_with, sum_over(found.select("bag"), count, len(items.vocabulary), "<i8") if items.vocabulary else np.empty(0, np.int64))
    index = spark.sparkContext.broadcast(items)
    m = F.expr(f"25 + (75 * n * {docs_with}L) div {length or 1}L")
    classes = classes_of(found.select("doc_id", m.alias("m"), "bag"), k)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        best, rows = Best(len(items.ids), k), max(1, CELLS // max(1, len(items.ids)))
        for whole in batches:
            for start in range(0, len(whole), rows):
                batch = whole.slice(start, rows)  # never empty
                held = [np.frombuffer(b, "<u4").astype(np.int64) for b in batch.column("bag").to_pylist()]
                sizes = np.array([len(b) // 2 for b in held])
                term, tf = (np.concatenate([b[s * n : (s + 1) * n] for b, n in zip(held, sizes)]) for s in (0, 1))
                best.see(items.scores(batch.column("m").to_numpy(), np.repeat(np.arange(len(held)), sizes), term, tf), batch.column("first").to_numpy(), batch.column("docs"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()), pa.array([items.ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.score, pa.int64()), pa.array(best.first, pa.int64()), pa.array([[d["doc_id"] for d in x] for x in best.docs], pa.list_(pa.int64()))],
            names=["item", "item_id", "score", "first", "docs"],
        )

    scored = classes.select("m", "bag", F.coalesce(F.col("docs")[0]["doc_id"], F.lit(LAST)).alias("first"), "docs").mapInArrow(score, "item long, item_id long, score long, first long, docs array<long>")
    by_class = Window.partitionBy("item").orderBy(F.col("score").desc(), "first")
    by_doc = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    members = scored.withColumn("_n", F.row_number().over(by_class)).filter(F.col("_n") <= k).select("item", "item_id", "score", F.explode("docs").alias("doc_id"))
    return members.withColumn("rank", F.row_number().over(by_doc)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    placed = written(items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.monotonically_increasing_id()), "items")
    rows, size = placed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(rows / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    out = shared_path(spark, "ranked")
    for block in range(blocks):
        # A block's rows, bounded above.
        part = placed.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block).select("item_id", "text").toArrow()
        found = search_block(texts, Items(part.column("item_id").to_pylist(), rows_of(part.column("text"))), k)
        found.write.parquet(f"{out}/block={block}")
    return spark.read.schema(RESULT).parquet(out).select("item_id", "rank", "doc_id", "score")
