"""Benchmark decontamination by latent semantic retrieval.

1. Words. Texts become arrays of 32-bit word codes, written once to the shared folder.
2. TF-IDF. Passages are runs of PASSAGE words; their terms are word codes folded to TERMS buckets. Document
   frequencies count every passage of the corpus.
3. Randomised SVD. With A the matrix of all passages and W a random one, A'(A W) is added up over all tasks; the
   Nystroem form of the method then gives A's singular values and right singular vectors without another pass.
   Only arrays of fixed size leave the tasks.
4. Candidates. Overlapping windows and benchmark passages are compared in the latent space (left singular
   coordinates) by cosine. A count of the passage's rare words around the window goes first: with too few of them no
   common subsequence can be long enough, so only pairs with enough of them are compared, which an index of rare
   words gives. The work grows with such pairs, not with windows times passages.
5. Checks. In a stretch around a candidate window the longest common subsequence must hold LCS_SHARE of the benchmark
   passage's words, and, if the passage goes up to the end of its item, where the answer stands, ANSWER_SHARE of the
   last ANSWER_WORDS words.

Defined results: only documents that hold a benchmark passage are returned, one row for each (doc_id, item_id);
null and empty texts hold none; benchmark items of fewer than LEAST_WORDS words, which no share of common words can
tell, are found where all their words stand in order without a gap, with a cosine and share of 1; items without words
are left out; longer items are cut into passages of up to ITEM_WORDS words; an empty corpus or benchmark gives an
empty table.

A benchmark of any size is searched for in blocks; what each finds is written, so neither the plan nor the driver's
memory grows with their number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import sum_over, written
from scoreline.sources.scratch import shared_path

TERMS, RANK, EXTRA = 4096, 96, 16
#: Words of a passage; windows have as many and start at every block of half of it.
PASSAGE = 32
BLOCK = PASSAGE // 2
#: Words on either side of a window in which the passage is looked for: whole blocks.
AROUND = 3 * BLOCK
COSINE, LCS_SHARE = 0.2, 0.7
#: A term is rare if fewer passages than this share hold it.
RARE = 0.02
ANSWER_WORDS, ANSWER_SHARE = 8, 0.5
LEAST_WORDS, ITEM_WORDS = 8, 64
#: Benchmark items, and bytes of their texts, in one broadcast; a larger benchmark is searched for block by block.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Words, and window-item pairs, that numpy handles at once; rare words of items are looked up in so many blocks times items.
STEP, PAIRS, HITS = 1 << 17, 1 << 14, 1 << 20
#: A longer text is written as several rows, which overlap so that no passage is cut.
PIECE, OVERLAP = 1 << 18, PASSAGE + 2 * AROUND + ITEM_WORDS


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, one text after another, and where each text begins; last, where all end."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}\p{N}_]+")
    words = parts.flatten().dictionary_encode()
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    code = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    empty = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    at = words.indices.to_numpy()
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    if len(at) == 0:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    kept = ~empty[at]
    return code[at][kept], np.append(0, kept.cumsum())[offsets]


def code_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, bounds = word_codes(batch.column("text"))
        raw = codes.astype("<u4", copy=False)
        rows = [(i, raw[k : min(b, k + PIECE + OVERLAP)].tobytes()) for i, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()) for k in range(a, b, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())], names=["doc_id", "codes"])


class Padded:
    """The texts of a batch of codes, each filled up to whole passages."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.words = np.frombuffer(data, "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data and len(column) else np.empty(0, np.uint32)
        self.sizes = pc.binary_length(column).to_numpy() // 4
        padded = -(-self.sizes // PASSAGE) * PASSAGE
        self.starts, self.first = np.append(0, self.sizes.cumsum()), np.append(0, padded.cumsum())
        #: Of each word among the filled-up texts.
        self.at = np.arange(len(self.words)) + np.repeat(self.first[:-1] - self.starts[:-1], self.sizes)
        self.terms = np.full(self.first[-1], TERMS, np.int16)
        self.terms[self.at] = (self.words % TERMS).astype(np.int16)


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of PASSAGE terms, up to STEP words at a time; TERMS stands where a text has no more words."""
    for batch in batches:
        terms = Padded(batch.column("codes")).terms.reshape(-1, PASSAGE)
        for k in range(0, len(terms), STEP // PASSAGE):
            yield terms[k : k + STEP // PASSAGE]


def sums(table: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each row of terms the sum of their rows of the table, whose last row is zero."""
    out = table[terms[:, 0]]
    for k in range(1, terms.shape[1]):
        out += table[terms[:, k]]
    return out


def with_zero(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """For each term the passages that hold it; last, the number of passages."""
    out = np.zeros(TERMS + 1)
    for terms in passages(batches):
        ordered = np.sort(terms, axis=1)
        new = np.ones(ordered.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        out[:TERMS] += np.bincount(ordered[new], minlength=TERMS + 1)[:TERMS]
        out[TERMS] += len(terms)
    return out


def spread(rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each term the sum of the rows of the passages that it stands in, as often as it does."""
    flat = terms.ravel()
    order = np.argsort(flat, kind="stable")
    count = np.bincount(flat, minlength=TERMS + 1)
    count[TERMS] = 0
    # Eight occurrences of a term are added at once, by gathers of whole columns; places left over hold a zero row.
    groups = -(-count // 8)
    first = np.append(0, groups.cumsum())
    used = order[: count.sum()]
    rank = np.arange(len(used)) - np.repeat(count.cumsum() - count, count)
    owner = np.full((first[-1], 8), len(rows))
    owner[np.repeat(first[:-1], count) + rank // 8, rank % 8] = used // terms.shape[1]
    eights = sums(np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), owner)
    out = np.zeros((TERMS, rows.shape[1]))
    found = np.flatnonzero(count[:TERMS])
    out[found] = np.add.reduceat(eights, first[found], axis=0)
    return out


def fit_latent(coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """TERMS rows of RANK, what one occurrence of a term adds to a passage's latent coordinates; which terms are rare."""
    sc = coded.sparkSession.sparkContext
    counts = sum_over(coded, frequencies, TERMS + 1, "<f8")
    idf = np.log((counts[TERMS] + 1) / (counts[:TERMS] + 1))
    width = RANK + EXTRA
    omega = np.linalg.qr(np.random.default_rng(11).standard_normal((TERMS, width)))[0]
    shared = sc.broadcast(with_zero(idf[:, None] * omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((TERMS, width))
        for terms in passages(batches):
            out += spread(sums(shared.value, terms), terms)
        return out.ravel()

    y = idf[:, None] * sum_over(coded, sketch, TERMS * width, "<f4").reshape(TERMS, width).astype(float)
    # G = A'A is close to Y (W'Y)^-1 Y', here through a Cholesky factor, with a small shift against rounding.
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y += shift * omega
    core = omega.T @ y
    factor = np.linalg.cholesky((core + core.T) / 2)
    vectors, roots, _ = np.linalg.svd(np.linalg.solve(factor, y.T).T, full_matrices=False)
    singular = np.sqrt(np.maximum(roots[:RANK] ** 2 - shift, 1e-9))
    return (idf[:, None] * vectors[:, :RANK] / singular).astype(np.float32), counts[:TERMS] < RARE * counts[TERMS]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def common_words(item: list[int], region: list[int]) -> list[bool]:
    """For each word of the item whether it is in one longest common subsequence, bit by bit in whole numbers."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    state = full
    for word in region:
        hit = state & masks.get(word, 0)
        state = ((state + hit) | (state - hit)) & full
    return [not state >> i & 1 for i in range(len(item))]


def check(item: list[int], region: list[int], ends: bool = True) -> float:
    """Share of the item's words in a longest common subsequence, or 0 where it or the answer, if it ends there, has too few.

    The share counts within stretches half as long again as the item, so that words common to all texts don't add
    up over a wide region.
    """
    if sum(common_words(item, region)) < LCS_SHARE * len(item):
        return 0.0
    span, last = len(item) + len(item) // 2, max(0, len(region) - len(item) - len(item) // 2)
    stretches = [region[k : k + span] for k in [*range(0, last, max(1, len(item) // 4)), last]]
    shares = [sum(common_words(item, s)) / len(item) for s in stretches]
    best = max(shares)
    if best < LCS_SHARE:
        return 0.0
    if not ends:
        return best
    answer = item[-ANSWER_WORDS:]
    return best if sum(common_words(answer, stretches[shares.index(best)])) >= ANSWER_SHARE * len(answer) else 0.0


class Benchmark:
    """Benchmark passages as latent vectors, and which rare words each of them needs."""

    def __init__(self, items: list[tuple[int, list[int], bool]], latent: np.ndarray, rare: np.ndarray):
        self.items, self.latent = items, with_zero(latent)
        self.vectors = unit(np.array([latent[np.array(p) % TERMS].sum(axis=0) for _, p, _ in items])).astype(np.float32)
        held = [np.unique(np.array([w for w in p if rare[w % TERMS]], np.uint32)) for _, p, _ in items]
        words, owner = np.concatenate(held), np.repeat(np.arange(len(items)), [len(h) for h in held])
        order = np.argsort(words, kind="stable")
        self.owner = owner[order]
        #: Rare words, and where the items that hold each of them begin in owner.
        self.words, first = np.unique(words[order], return_index=True)
        self.bounds = np.append(first, len(words))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.words & 0xFFFF] = True
        count = np.array([sum(bool(rare[w % TERMS]) for w in p) for _, p, _ in items])
        self.needed = (count - np.array([len(p) - math.ceil(LCS_SHARE * len(p) - 1e-9) for _, p, _ in items]))

    def rare_hits(self, texts: Padded, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) of each rare word of an item that these blocks of the texts hold, by block."""
        first, last = np.searchsorted(texts.at, (low * BLOCK, high * BLOCK))
        at = first + np.flatnonzero(self.maybe[texts.words[first:last] & 0xFFFF])
        place = np.minimum(np.searchsorted(self.words, texts.words[at]), max(0, len(self.words) - 1))
        if len(self.words):
            at, place = (x[self.words[place] == texts.words[at]] for x in (at, place))
        n = self.bounds[place + 1] - self.bounds[place] if len(self.words) else np.empty(0, int)
        entry = np.arange(n.sum()) + np.repeat(self.bounds[place] - n.cumsum() + n, n) if len(n) else np.empty(0, int)
        return np.repeat(texts.at[at] // BLOCK, n) if len(n) else np.empty(0, int), self.owner[entry]

    def pairs(self, texts: Padded, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) wherever a window and what stands around it has the item's rare words, by window.

        Windows begin at each block from low to high. Words of other texts' blocks count too: that can only add pairs.
        """
        reach = AROUND // BLOCK
        block, item = self.rare_hits(texts, low - reach, high + reach + 1)
        # A word counts for all windows that have its block in them or around them.
        window = (block[:, None] + np.arange(-1 - reach, reach + 1)).ravel()
        key = window * len(self.items) + np.repeat(item, 2 * reach + 2)
        key, count = np.unique(key[(window >= low) & (window < high)], return_counts=True)
        key = key[count >= self.needed[key % len(self.items)]]
        # Items without enough rare words of their own are compared with every window.
        free = np.flatnonzero(self.needed <= 0)
        if len(free):
            key = np.union1d(key, (np.arange(low, high)[:, None] * len(self.items) + free).ravel())
        return np.divmod(key, len(self.items))

    def candidates(self, texts: Padded) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, item, cosine) of windows that have an item's rare words around them and are close to it."""
        terms = texts.terms.reshape(-1, BLOCK)
        begins = texts.first // BLOCK
        ends = np.zeros(len(terms), bool)
        ends[begins[1:][texts.sizes > 0] - 1] = True
        step = max(64, HITS // len(self.items))
        found = (self.pairs(texts, k, min(k + step, len(terms))) for k in range(0, len(terms), step))
        for at, item in ((w[k : k + PAIRS], i[k : k + PAIRS]) for w, i in found for k in range(0, len(w), PAIRS)):
            asked, place = np.unique(at, return_inverse=True)
            rows = sums(self.latent, terms[asked])
            both = ~ends[asked]
            rows[both] += sums(self.latent, terms[asked[both] + 1])
            cosines = np.einsum("ij,ij->i", unit(rows)[place], self.vectors[item])
            for j in np.flatnonzero(cosines >= COSINE).tolist():
                text = int(np.searchsorted(begins, at[j], "right")) - 1
                yield text, int(at[j] - begins[text]) * BLOCK, int(item[j]), float(cosines[j])


def item_passages(item_id: int, codes: np.ndarray) -> list[tuple[int, list[int], bool]]:
    """(item, words, whether they go up to the item's end) of the passages that an item is cut into."""
    if len(codes) < LEAST_WORDS:
        return []
    starts = range(0, max(1, len(codes) - ITEM_WORDS // 2), ITEM_WORDS // 2) if len(codes) > ITEM_WORDS else [0]
    return [(item_id, codes[s : s + ITEM_WORDS].tolist(), s + ITEM_WORDS >= len(codes)) for s in starts]


class Short:
    """Items of fewer than LEAST_WORDS words, by their number of words."""

    def __init__(self, items: list[tuple[int, tuple[int, ...]]]):
        self.by_size: dict[int, dict[tuple, list[int]]] = {}
        for item, words in items:
            self.by_size.setdefault(len(words), {}).setdefault(words, []).append(item)
        #: Hashes of the items of each size, in order.
        self.known = {n: np.unique(self._hashed(np.array(list(held), np.uint32))) for n, held in self.by_size.items()}

    @staticmethod
    def _hashed(words: np.ndarray) -> np.ndarray:
        code = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                code = (code + words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        return code

    def found(self, words: np.ndarray) -> set[int]:
        """The items that stand in these words."""
        out: set[int] = set()
        for n, held in self.by_size.items():
            if len(words) >= n:
                runs = np.lib.stride_tricks.sliding_window_view(words, n)
                for at in np.flatnonzero(np.isin(self._hashed(runs), self.known[n])).tolist():
                    out.update(held.get(tuple(runs[at].tolist()), ()))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share): documents (doc_id, text) that hold items (item_id, text)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs_share double"
    coded = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(code_texts, "doc_id long, codes binary"))
    latent, rare = fit_latent(coded)
    asked = written(benchmark.filter("item_id IS NOT NULL").select("item_id", "text").withColumn("place", F.monotonically_increasing_id()), "items")
    count, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(count / ITEMS), math.ceil((size or 0) / ITEM_BYTES))
    out, wrote = shared_path(spark, "contaminated"), False
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block).select("item_id", "text").collect()  # bounded above
        codes, bounds = word_codes(pa.array([r["text"] for r in rows], pa.string()))
        each = [(r["item_id"], codes[a:b]) for r, a, b in zip(rows, bounds[:-1], bounds[1:])]
        items = sorted(p for item, words in each for p in item_passages(item, words))
        short = [(item, tuple(words.tolist())) for item, words in each if 0 < len(words) < LEAST_WORDS]
        shared = spark.sparkContext.broadcast((items, short, latent, rare))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, short, latent, rare = shared.value
            bench, short = Benchmark(items, latent, rare) if items else None, Short(short)
            for batch in batches:
                texts, best = Padded(batch.column("codes")), {}
                for text in range(len(texts.starts) - 1) if short.by_size else ():
                    best |= {(text, i): (1.0, 1.0) for i in short.found(texts.words[texts.starts[text] : texts.starts[text + 1]])}
                for text, at, i, cosine in bench.candidates(texts) if bench else ():
                    item_id, item, ends = bench.items[i]
                    if best.get((text, item_id), (0.0,))[0] < 1.0:
                        begin, end = texts.starts[text : text + 2].tolist()
                        region = texts.words[max(begin, begin + at - AROUND) : min(end, begin + at + PASSAGE + AROUND)]
                        if share := check(item, region.tolist(), ends):
                            best[text, item_id] = max(best.get((text, item_id), (0.0, 0.0)), (share, cosine))
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*((ids[t], i, c, s) for (t, i), (s, c) in best.items()))) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs_share"])

        if items or short:
            coded.mapInArrow(search, schema).write.parquet(f"{out}/block={block}")
            wrote = True
        shared.unpersist()
    if not wrote:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(out).select("doc_id", "item_id", "cosine", "lcs_share")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))
