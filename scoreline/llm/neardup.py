"""MinHash near-duplicates by ProbMinHash over weighted five-word shingles.

1. Signatures. A shingle of weight w (its count in the text) gets arrivals of a Poisson process of rate w,
   each at a random register; a register keeps the shingle that arrived first. A shingle stops once its next
   arrival is later than every register of its text. Equal registers estimate the probability Jaccard.
2. Banding. Texts with the same shingle counts are collapsed to the one with the smallest id. Texts that
   agree on all registers of a band meet in a bucket; the bucket's smallest id is its leader, and every
   member joins its leader's group. Any two texts that share a bucket share a group.
3. Verification. Groups are split into blocks of about BLOCK members and BLOCK_SHINGLES shingles at most. In a block all pairs that are not yet
   linked are compared exactly; then the blocks of one group are compared pairwise, except for texts already
   linked to the leader. Only links that join parts are kept, so there are fewer of them than members.
4. Classes are the connected components of the links; the class id is the smallest doc_id of the class, null if
   all are null.

Rows are told apart by 128 bits of hashes of doc_id and text, so that null and shared ids keep their texts apart;
collapsed texts have numbers without clashes.

Defined results: texts without a word (null, empty) are classes of their own; texts of fewer than five words
are one shingle; repeated rows share their class; an empty table gives an empty table. The probability
Jaccard is the plain Jaccard where no shingle repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import written

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 6 registers: a pair of similarity 0.8 shares a band with probability 0.9999.
BANDS, ROWS = 32, 6
#: Members of a group that are compared in one task, and distinct shingles of them, about.
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
#: Shingles per numpy step.
STEP = 400_000

_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs to equal, well-spread outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to a 64-bit hash that is the same on every machine."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 400_000:
            self.clear()
        if len(word) <= 100:
            self[word] = value
        return value


def shingle(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.float64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(w))):
            code = mix(code * _GOLDEN + w[k : k + n])
    code, count = np.unique(code, return_counts=True)
    return code, count.astype(np.float64)


def prob_minhash(codes: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """The shingle that comes first at each register of each text; texts are not empty."""
    docs = len(codes)
    doc = np.repeat(np.arange(docs), [len(c) for c in codes])
    code, weight = np.concatenate(codes), np.concatenate(weights)
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    time, alive = np.zeros(len(code)), np.arange(len(code))
    latest = np.full(docs, np.inf)
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(alive):
            turn += np.uint64(1)
            c = code[alive]
            u = mix(c + turn * _GOLDEN)
            t = time[alive] - np.log((u >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[alive]
            ahead = t < latest[doc[alive]]
            alive, t, c, u = alive[ahead], t[ahead], c[ahead], u[ahead]
            at = doc[alive] * registers + (mix(u ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, at, t)
            won = first[at] == t
            winner[at[won]] = c[won]
            time[alive] = t
            latest = first.reshape(docs, registers).max(axis=1)
    return winner.reshape(docs, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * _GOLDEN + parts[:, :, k])
    return key.view(np.int64)


def in_steps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about STEP in all, whatever one item has."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > STEP:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id1, id2, text) to (id1, id2, print, size, bands), size being the distinct shingles; texts without words are left out."""
    hashes = WordHashes()
    for batch in batches:
        rows = [(i, *shingle(t, hashes)) for i, t in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()) if t]
        rows = [r for r in rows if len(r[1])]
        for a, b in in_steps([len(r[1]) for r in rows]):
            part = rows[a:b]
            keys = band_keys(prob_minhash([r[1] for r in part], [r[2] for r in part], BANDS * ROWS))
            prints = [hashlib.blake2b(r[1].tobytes() + r[2].tobytes(), digest_size=16).digest() for r in part]
            bands = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(part) + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            ids = [pa.array([r[0][k] for r in part], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(prints, pa.binary()), pa.array([len(r[1]) for r in part], pa.int32()), bands], names=["id1", "id2", "print", "size", "bands"])


def prob_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets, given as sorted codes and weights."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # For shingle d the denominator adds max(x'/x, y'/y): x'/x where x'/y' is at least d's own ratio.
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    start = np.searchsorted(ratio, ratio, "left")
    below_y = np.concatenate([[0], np.cumsum(y)])[start]
    above_x = x.sum() - np.concatenate([[0], np.cumsum(x)])[start]
    return float((1 / ((only_a + above_x) / x + (only_b + below_y) / y)).sum())


class Links:
    """Union-find over positions; the root of a part is its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.parent[j] = i

    def roots(self) -> np.ndarray:
        while (nxt := self.parent[self.parent]).tolist() != self.parent.tolist():
            self.parent = nxt
        return self.parent


def link_members(sets: list[tuple[np.ndarray, np.ndarray]], links: Links, queries: list[int], others: np.ndarray) -> None:
    """Joins each query to all members that are as similar as THRESHOLD and marked in others; parts stay parts."""
    sizes = np.array([len(c) for c, _ in sets])
    total = np.array([w.sum() for _, w in sets])
    plain = total == sizes  # no shingle repeats
    codes, owner = np.concatenate([c for c, _ in sets]), np.repeat(np.arange(len(sets)), sizes)
    weight = np.concatenate([w for _, w in sets])
    order = np.argsort(codes, kind="stable")
    codes, owner, weight = codes[order], owner[order], weight[order]
    terms, first = np.unique(codes, return_index=True)
    bounds = np.append(first, len(codes))
    for q in queries:
        at = np.searchsorted(terms, sets[q][0])
        low, n = bounds[at], bounds[at + 1] - bounds[at]
        entry = np.arange(n.sum()) + np.repeat(low - n.cumsum() + n, n)
        held = np.bincount(owner[entry], weight[entry], len(sets))
        mine = np.bincount(owner[entry], np.repeat(sets[q][1], n), len(sets))
        # A shared draw must be a shared shingle, so the share of either side bounds the similarity.
        near = others & (np.minimum(held / total, mine / total[q]) >= THRESHOLD - 1e-9) & (links.roots() != links.root(q))
        exact = near & plain & plain[q]
        similarity = held / (total + total[q] - held)
        for j in np.flatnonzero(exact & (similarity >= THRESHOLD - 1e-12)):
            links.join(q, int(j))
        for j in np.flatnonzero(near & ~exact):
            if links.root(q) != links.root(int(j)) and prob_jaccard(*sets[q], *sets[j]) >= THRESHOLD - 1e-12:
                links.join(q, int(j))


def link_block(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of a group, with the group's leader in it: each member and the smallest id of its part."""
    hashes = WordHashes()
    rows = rows.sort_by("doc_id")
    ids, leader = rows.column("doc_id").to_pylist(), key[0].as_py()
    sets = [shingle(t, hashes) for t in rows.column("text").to_pylist()]
    links, everyone = Links(len(ids)), np.ones(len(ids), bool)
    at = ids.index(leader)
    link_members(sets, links, [at], everyone)
    core = links.roots() == links.root(at)
    link_members(sets, links, np.flatnonzero(~core).tolist(), everyone)
    roots = links.roots()
    core = roots == roots[at]
    return pa.table({"leader": pa.array([leader] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "root": pa.array([ids[r] for r in roots], pa.int64()), "core": pa.array(core)})


def link_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """Two blocks of a group: texts that are not linked to the leader are compared with the other block."""
    hashes = WordHashes()
    rows = rows.sort_by("doc_id")
    ids, side, core = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "side", "core"))
    links = Links(len(ids))
    if not core.all():
        sets = [shingle(t, hashes) for t in rows.column("text").to_pylist()]
        for k in (0, 1):
            link_members(sets, links, np.flatnonzero((side == k) & ~core).tolist(), side != k)
    roots = links.roots()
    moved = roots != np.arange(len(ids))
    return pa.table({"doc_id": pa.array(ids[moved], pa.int64()), "root": pa.array(ids[roots[moved]], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, root), root being the smallest id that edges lead to; ids without edges are left out.

    Alternates hanging each id's larger, then its smaller neighbours on its smallest neighbour, until nothing moves.
    The smallest neighbours of the first step are written, one row an id, and joined back, so that the rows of an id
    with very many neighbours can be split.
    """
    now, sums = counted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while sums != before:
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before = sums
        now, sums = counted(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and two sums of their hashes: equal for equal sets of edges."""
    table = written(edges)
    total = lambda seed: F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(20,0)"))
    return table, tuple(table.agg(F.count("*"), total(1), total(2)).first())


def row_ids() -> list[Column]:
    """Two ids of the row's doc_id and text, 128 bits together; other columns don't count."""
    ident = F.col("doc_id").cast("long")
    return [F.xxhash64(*salt, ident.isNull(), ident, F.col("text").isNull(), "text") for salt in ((), (F.lit("second"),))]


def row_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, id1, id2, class_id, kept1, kept2) of every row: its row_ids, the smallest doc_id of its class, nulls last, and that row's row_ids."""
    named = docs.select(F.col("doc_id").cast("long").alias("given"), *[c.alias(f"id{k}") for k, c in enumerate(row_ids(), 1)], "text")
    signed = written(named.select("id1", "id2", "text").mapInArrow(sign, "id1 long, id2 long, print binary, size int, bands array<long>"))
    # Of texts with the same shingles one goes on, under a number of its own.
    first = signed.groupBy("print").agg(F.min(F.struct("id1", "id2", "size", "bands")).alias("x")).select("print", "x.*")
    reps = written(first.withColumn("doc_id", F.monotonically_increasing_id()))
    keys = written(reps.select("doc_id", "size", F.explode("bands").alias("key")))
    leaders = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    members = written(keys.join(leaders, "key").select("leader", "doc_id", "size").distinct())
    # Blocks by texts and by shingles, whichever asks for more.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("leader").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "leader").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("size")
    # The leader stands in every block of its group.
    inside = placed.filter("doc_id <> leader").union(sizes.select("leader", F.col("leader").alias("doc_id"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    # The texts of members only, each once; the ids of members are what tells which.
    asked = reps.select("id1", "id2", "doc_id").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    held = written(named.select("id1", "id2", "text").join(asked, ["id1", "id2"]).select("doc_id", "text").dropDuplicates(["doc_id"]))
    linked = written(inside.join(held, "doc_id").groupBy("leader", "block").applyInArrow(link_block, "leader long, doc_id long, root long, core boolean"))
    # Blocks meet only where one of them has texts that aren't linked to the leader: those against all of the other block.
    large = written(placed.filter("blocks > 1").join(linked.groupBy("leader", "doc_id").agg(F.max("core").alias("core")), ["leader", "doc_id"]))
    apart = large.filter("NOT core").select("leader", F.col("block").alias("other")).distinct()
    loose = large.filter("NOT core").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = (
        loose.select("leader", "doc_id", "core", "block", "other")
        .union(large.filter("core").join(apart, "leader").select("leader", "doc_id", "core", "block", "other"))
        .filter("other <> block")
        .select("leader", "doc_id", "core", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    crossed = pairs.join(held, "doc_id").groupBy("leader", "low", "high").applyInArrow(link_blocks, "doc_id long, root long")
    edges = linked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).union(crossed.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    roots = components(edges)
    # Written, so that both sides of the next joins are shuffled for them alone and a common text's or class' rows can be split.
    of_print = written(reps.select("print", "doc_id").join(roots, F.col("doc_id") == F.col("id"), "left").select("print", F.coalesce("root", "doc_id").alias("root")))
    of_row = written(signed.select("id1", "id2", "print").distinct().join(of_print, "print").select("id1", "id2", "root"))
    # A row without words is of a class of its row_ids.
    own = lambda c: F.when(F.col("root").isNull(), F.col(c)).otherwise(0)
    rooted = written(named.drop("text").join(of_row, ["id1", "id2"], "left").select("given", "id1", "id2", F.coalesce("root", F.lit(-1)).alias("root"), own("id1").alias("own1"), own("id2").alias("own2")))
    least = F.struct(F.col("given").isNull().alias("unnamed"), "given", "id1", "id2")
    first = written(rooted.groupBy("root", "own1", "own2").agg(F.min(least).alias("least")))
    out = rooted.join(first, ["root", "own1", "own2"])
    return out.select(F.col("given").alias("doc_id"), "id1", "id2", F.col("least.given").alias("class_id"), F.col("least.id1").alias("kept1"), F.col("least.id2").alias("kept2"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row; needs doc_id and text. Rows that share a doc_id can be of several classes."""
    return row_classes(docs).select("doc_id", "class_id")
