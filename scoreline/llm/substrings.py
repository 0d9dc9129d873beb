"""Substring dedup by prefix-partitioned suffix trees: words of passages that stand in an earlier document go.

A window is WINDOW consecutive words. A suffix, the text from some word on, is a sequence of symbols of BLOCK words
each, taken as hashes; its first five symbols, 160 bits in all, are its window.

1. Prints. Of documents with the same words only the first by doc_id, the leader, goes on: all windows of the others
   start in it. Each window has an anchor, its BLOCK words with the smallest hash. Equal windows have equal anchors, so
   a window whose anchor stands in no other leader starts in no other leader. Only texts with shared anchors are shuffled.
2. Suffixes. A task sorts the suffixes whose windows have shared anchors. Where a window starts in several of its
   documents, those after the first are marked at once: of very many copies only one a task goes on.
3. Prefixes. Counts of suffixes by their prefixes give groups of at most about GROUP of them. A prefix with more is
   split by its next symbol, up to the whole window; short prefixes of few suffixes share a group.
4. Trees. Sorted suffixes of a group, and how many symbols neighbours share, are its suffix tree: its internal nodes
   of depth WINDOW are the repeats. Leaves under such a node in documents after its first are marked.
5. Marked windows are cut out of their texts.

What is broadcast is the tree of prefixes, some bytes for each group. A group holds what tasks have left of its
suffixes; one window is at most one leader of each sorted run.

Defined results: null and empty texts have no words; texts of fewer than WINDOW words stay whole; a null id comes
after all others, and rows of one id never cut each other; repeated rows have the same result each; an empty table
gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import sum_over, written
from scoreline.llm.neardup import mix
from scoreline.llm.ranked import LAST, rows_of

WINDOW, BLOCK = 50, 10
SYMBOLS = WINDOW // BLOCK
#: Suffixes that a task sorts at once, and that a group holds.
RUN, GROUP = 1 << 19, 1 << 19
#: Children of a split prefix.
FAN = 256

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A sorted run, or its part in a group: symbols, one column after the other, and for each suffix its place in rows and in the text.
RUNS = "symbols binary, doc binary, pos binary, rows array<long>, orders array<long>"


class Words(dict):
    """Word to a 64-bit hash that is the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 100:
            self[word] = value
        return value


def blocks_of(words: list[bytes], hashes: Words) -> np.ndarray:
    """The hash of the BLOCK words from each word on."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(0, len(w) - BLOCK + 1)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BLOCK):
            code = mix(code * _GOLDEN + w[k : k + n]) if k % 4 == 3 else code * _GOLDEN + w[k : k + n]
        return mix(code)


def anchors_of(blocks: np.ndarray) -> np.ndarray:
    """For each window where its anchor, the first of its smallest blocks, begins."""
    span = WINDOW - BLOCK + 1
    at, width = np.arange(len(blocks)), 1
    while 2 * width <= span:
        left, right = at[:-width], at[width:]
        at = np.where(blocks[right] < blocks[left], right, left)
        width *= 2
    n = max(0, len(blocks) - span + 1)
    left, right = at[:n], at[span - width : span - width + n]
    return np.where(blocks[right] < blocks[left], right, left)


def print_of(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) to (doc_id, key, n, print, anchors): the distinct anchors of all windows."""
    hashes = Words()
    for batch in batches:
        sizes, prints, anchors = [], [], []
        for raw in rows_of(batch.column("text")):
            words = raw.split()
            blocks = blocks_of(words, hashes) if len(words) >= WINDOW else np.empty(0, np.uint64)
            sizes.append(len(words))
            prints.append(print_of(words))
            anchors.append(np.unique(blocks[anchors_of(blocks)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "print", "anchors"])


class Run:
    """Suffixes of several documents: symbols (SYMBOLS x suffixes), the document of each and where it begins there."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, pos: np.ndarray, rows: np.ndarray, orders: np.ndarray):
        self.symbols, self.doc, self.pos, self.rows, self.orders = symbols, doc, pos, rows, orders

    @staticmethod
    def joined(runs: list[Run]) -> Run:
        shift = np.cumsum([0, *(len(r.rows) for r in runs)])
        return Run(np.hstack([r.symbols for r in runs]), np.concatenate([r.doc + s for r, s in zip(runs, shift)]), *(np.concatenate([getattr(r, c) for r in runs]) for c in ("pos", "rows", "orders")))

    def nodes(self) -> np.ndarray:
        """Sorts the suffixes, those of a window by document; then for each whether it shares its window with the one before."""
        order = np.lexsort((self.orders[self.doc], *self.symbols[::-1]))
        self.symbols, self.doc, self.pos = self.symbols[:, order], self.doc[order], self.pos[order]
        return np.append(False, (self.symbols[:, 1:] == self.symbols[:, :-1]).all(axis=0))[: len(order)]

    def marked(self) -> np.ndarray:
        """Sorts; then for each suffix whether its window starts in an earlier document too."""
        deep = self.nodes()
        first = np.maximum.accumulate(np.where(deep, 0, np.arange(len(deep))))
        mine = self.orders[self.doc]
        return mine > mine[first]

    def take(self, which: np.ndarray) -> Run:
        docs, doc = np.unique(self.doc[which], return_inverse=True)
        return Run(self.symbols[:, which], doc, self.pos[which], self.rows[docs], self.orders[docs])

    def columns(self) -> list:
        return [self.symbols.astype("<u4").tobytes(), self.doc.astype("<u4").tobytes(), self.pos.astype("<u4").tobytes(), self.rows, self.orders]

    @staticmethod
    def read(batch) -> list[Run]:
        columns = [batch.column(c).to_pylist() for c in ("symbols", "doc", "pos", "rows", "orders")]
        return [
            Run(np.frombuffer(s, "<u4").reshape(SYMBOLS, -1), np.frombuffer(d, "<u4").astype(np.int64), np.frombuffer(p, "<u4"), np.array(r, np.int64), np.array(o, np.int64))
            for s, d, p, r, o in zip(*columns)
        ]

    def starts(self, which: np.ndarray) -> dict[int, bytes]:
        """The row of each document and where the chosen suffixes begin in it."""
        rows, pos = self.rows[self.doc[which]], self.pos[which]
        order = np.lexsort((pos, rows))
        rows, pos = rows[order], pos[order].astype("<u4")
        found, first = np.unique(rows, return_index=True)
        return {row: part.tobytes() for row, part in zip(found.tolist(), np.split(pos, first[1:]))} if len(found) else {}


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, order, print, shared, text) to RUNS of what goes on, and (row, starts) of what is marked."""
    hashes, held, size = Words(), [], 0
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["symbols", "doc", "pos", "rows", "orders", "row", "starts"]

    def flushed() -> Iterator[pa.RecordBatch]:
        run = Run.joined(held)
        marked = run.marked()
        starts, left = run.starts(marked), run.take(np.flatnonzero(~marked))
        yield pa.RecordBatch.from_arrays([*(pa.array([c], t) for c, t in zip(left.columns(), kinds)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(starts), t) for t in kinds), pa.array(list(starts), pa.int64()), pa.array(list(starts.values()), pa.binary())], names=names)

    for batch in batches:
        rows = (batch.column(c).to_pylist() for c in ("row", "order", "print", "shared"))
        for row, order, ident, shared, raw in zip(*rows, rows_of(batch.column("text"))):
            words = raw.split()
            if print_of(words) != ident:
                continue  # another text with the same key
            blocks = blocks_of(words, hashes)
            at = np.flatnonzero(np.isin(blocks[anchors_of(blocks)], np.array(shared, np.int64).view(np.uint64)))
            high = (blocks >> np.uint64(32)).astype(np.uint32)
            for a in range(0, len(at), RUN):
                part = at[a : a + RUN]
                held.append(Run(np.stack([high[part + k * BLOCK] for k in range(SYMBOLS)]), np.zeros(len(part), np.int64), part.astype(np.uint32), np.array([row]), np.array([order])))
                size += len(part)
                if size >= RUN:
                    yield from flushed()
                    held, size = [], 0
    if held:
        yield from flushed()


class Prefixes:
    """A tree of prefixes: a slot holds a group, or, below zero, the node that splits it by the next symbol."""

    def __init__(self, bits: int):
        self.bits, self.base, self.slots = bits, np.zeros(1, np.int64), np.zeros(1 << bits, np.int64)
        #: Slots to be counted and split at the next level.
        self.open = np.arange(1 << bits)
        self.groups = 0

    def slots_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix its last slot, and how many symbols lead there."""
        slot = (symbols[0] >> np.uint32(32 - self.bits)).astype(np.int64)
        depth = np.ones(len(slot), np.int64)
        for k in range(1, SYMBOLS):
            below = np.flatnonzero(self.slots[slot] < 0)
            slot[below] = self.base[-self.slots[slot[below]]] + (symbols[k][below] >> np.uint32(24))
            depth[below] = k + 1
        return slot, depth

    def settle(self, counts: np.ndarray, last: bool) -> None:
        """Gives groups to the open slots with these counts; those that are too large become nodes, unless it is the last level."""
        split = np.zeros(len(counts), bool) if last else counts > GROUP
        # Neighbouring slots share a group up to its size.
        self.slots[self.open] = self.groups + np.where(split, 0, counts).cumsum() // GROUP
        self.groups = int(self.slots[self.open].max(initial=self.groups)) + 1
        nodes = self.open[split]
        first = len(self.slots)
        self.slots[nodes] = -np.arange(len(self.base), len(self.base) + len(nodes))
        self.base = np.append(self.base, first + FAN * np.arange(len(nodes)))
        self.slots = np.append(self.slots, np.zeros(FAN * len(nodes), np.int64))
        self.open = np.arange(first, len(self.slots))


def prefixes_of(runs: DataFrame, size: int) -> Prefixes:
    """The prefixes that share out so many suffixes: each level counts those under slots that are still open."""
    tree = Prefixes(min(20, max(6, math.ceil(math.log2(max(1, size / GROUP))) + 4)))
    for level in range(SYMBOLS):
        first, n = int(tree.open[0]), len(tree.open)
        shared = runs.sparkSession.sparkContext.broadcast(tree)

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(n, np.int64)
            for batch in batches:
                for run in Run.read(batch):
                    slot = shared.value.slots_of(run.symbols)[0] - first
                    out += np.bincount(slot[slot >= 0], minlength=n)
            return out

        tree.settle(sum_over(runs, count, n, "<i8"), level == SYMBOLS - 1)
        if not len(tree.open):
            break
    return tree


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; needs doc_id and text."""
    spark = docs.sparkSession
    # The key brings a leader's text back, whatever rows share its id.
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    order = F.coalesce("doc_id", F.lit(LAST))
    signed = written(texts.mapInArrow(sign, "doc_id long, key long, n long, print binary, anchors array<long>"), "signed")
    # One row of each print; the window is cut to it in each task before the shuffle.
    of_print = Window.partitionBy("print").orderBy("order")
    leaders = signed.filter(F.col("n") >= WINDOW).withColumn("order", order).withColumn("_n", F.row_number().over(of_print)).filter("_n = 1")
    leaders = written(leaders.select(F.monotonically_increasing_id().alias("row"), "order", "key", "print", "anchors"), "leaders")
    anchors = leaders.select("row", F.explode("anchors").alias("anchor"))
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor")
    shared = anchors.join(repeated, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("shared"))
    live = leaders.select("row", "order", "key", "print").join(shared, "row")
    held = written(live.join(texts.select(order.alias("order"), "key", "text"), ["order", "key"]), "held")
    cut_up = written(held.mapInArrow(suffixes, RUNS + ", row long, starts binary"), "suffixes")
    runs = cut_up.filter("row IS NULL").select("symbols", "doc", "pos", "rows", "orders")
    size = runs.agg(F.sum(F.octet_length("pos"))).first()[0] or 0
    tree = spark.sparkContext.broadcast(prefixes_of(runs, size // 4))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in Run.read(batch):
                group = tree.value.slots[tree.value.slots_of(run.symbols)[0]]
                by_group = np.argsort(group, kind="stable")
                found, first = np.unique(group[by_group], return_index=True)
                for g, which in zip(found.tolist(), np.split(by_group, first[1:])):
                    columns = [pa.array([c], t) for c, t in zip(run.take(which).columns(), [pa.binary()] * 3 + [pa.list_(pa.int64())] * 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *columns], names=["group", "symbols", "doc", "pos", "rows", "orders"])

    def tree_of(rows: pa.Table) -> pa.Table:
        run = Run.joined(Run.read(rows))
        starts = run.starts(run.marked())
        return pa.table({"row": pa.array(list(starts), pa.int64()), "starts": pa.array(list(starts.values()), pa.binary())})

    marks = runs.mapInArrow(deal, "group long, " + RUNS).groupBy("group").applyInArrow(tree_of, "row long, starts binary")
    marks = marks.union(cut_up.filter("row IS NOT NULL").select("row", "starts")).groupBy("row").agg(F.collect_list("starts").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, starts, raw in zip(batch.column("print").to_pylist(), batch.column("starts").to_pylist(), rows_of(batch.column("text"))):
                words = raw.split()
                if print_of(words) != ident:
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.frombuffer(b"".join(starts), "<u4")).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = edge.cumsum()[:-1] > 0
                out.append((ident, int(gone.sum()), print_of([w for w, g in zip(words, gone.tolist()) if not g])))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["print", "n_removed", "kept"])

    # Repeated rows of one id and text are cut each, alike.
    cuts = held.select("row", "print", "text").join(marks, "row").select("print", "starts", "text").mapInArrow(cut, "print binary, n_removed long, kept binary").dropDuplicates(["print"])
    known = leaders.select("print", F.col("order").alias("first")).join(cuts, "print", "left")
    copy = order > F.col("first")
    return signed.join(written(known, "known"), "print", "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("kept", "print")))).alias("kept_sha256"),
    )
