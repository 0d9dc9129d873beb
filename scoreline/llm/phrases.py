"""Phrase collocation mining with an FM-index per shard over word ids.

1. Shards. A task turns about SHARD_BYTES of text into word ids, pieces set apart by 0; words are counted over all
   shards, and only those that are frequent there (LEAST times in their language) get an id of the whole corpus.
2. Pairs. Each shard's index extends the intervals of frequent words to the left and sends its pairs, packed, to the
   buckets that sum them. A bucket answers each shard with those of its pairs that are frequent in the whole corpus.
3. Longer phrases. The index is bidirectional: intervals of frequent pairs are extended to the left, those of the
   triples found to the right, as long as each pair within is frequent, which every pair of a frequent phrase is.
   Buckets sum them; phrases of LEAST occurrences are candidates.
4. Scores. Cuts are looked up by joins on the phrases' word ids; arithmetic is in decimals of 38 digits.

Nothing but the numbers of words and rows reaches the driver. A shard is bounded by its bytes, and so is what it sends
and gets back, which pass by sorted, row after row: no list or row holds all of it in the JVM. Its index is extended
AT_ONCE occurrences at a time. A bucket takes about BUCKET of the corpus' tokens, of which it sees distinct phrases only.

Defined results: null and empty texts have no words; a null lang is `und`; repeated rows count each; an empty table
gives an empty table. doc_id and other columns don't matter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import written
from scoreline.llm.neardup import mix
from scoreline.llm.ranked import rows_of

#: Words of a phrase at most, occurrences at least, and phrases of a language in the result.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Cutting a phrase in two and the whole weigh so much; a phrase goes if a longer one has this share of its occurrences, in percent.
SCALE, SHARE = 2_000_000, 80
SHARD_BYTES = 8 << 20
#: Tokens of the corpus for each bucket that sums phrases.
BUCKET = 2 << 20
#: Occurrences whose intervals are extended at once, and phrases or words that stand in one batch.
AT_ONCE = 1 << 18
#: Words are numbered in 32 bits: each occurs LEAST times, so as many take a hundred billion words of text.
MOST_WORDS = 1 << 32
#: Bytes of a row group of tables whose rows are long, which is what is written and read at once.
GROUP_BYTES = 16 << 20
#: Parts of a language that are ranked first, so that no task ranks all of its phrases.
SALTS = 64

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z, and turns what ends a piece into a new line.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else 10 if i in b".,;:!?\x0a\x0b\x0c\x0d" else i for i in range(256))
#: Stands for the end of a piece among its words, none of which can be it.
_END = b","

SHARDS = "shard long, tokens binary, lang string, word string, id int, n long"
NUMBERED = "shard long, ids binary, numbers binary"
PACKED = "length int, bucket int, shard long, words binary, counts binary"
ANSWERS = "shard long, words binary, counts binary"


class Ids(dict):
    """Words of one language to their ids; the list holds (lang, word) of all ids so far, whatever their language."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({_END: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to SHARDS: one row with the tokens of each shard, and one for each of its words."""
    types = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SHARDS.split(", ")]
    words: list[tuple[str, bytes]] = []
    langs: dict[str, Ids] = {}
    runs: list[np.ndarray] = []
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([np.zeros(1, np.uint32), *runs, np.zeros(1, np.uint32)])
        tokens = tokens[np.append(True, (tokens[1:] > 0) | (tokens[:-1] > 0))]  # one 0 between pieces
        name, counts = uuid.uuid4().int >> 65, np.bincount(tokens, minlength=len(words) + 1)[1:]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, tokens.astype("<u4").tobytes(), None, None, None, None), types)], names=names)
        for a in range(0, len(words), 10_000):
            part = words[a : a + 10_000]
            n = len(part)
            columns = [pa.array([name] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([w[0] for w in part]), pa.array([w[1] for w in part], pa.binary()).cast(pa.string()), pa.array(range(a + 1, a + n + 1), pa.int32()), pa.array(counts[a : a + n])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), rows_of(batch.column("text"))):
            found = raw.translate(_BYTES).replace(b"\n", b" , ").split()
            ids = langs.get(lang) or langs.setdefault(lang, Ids(lang, words))
            runs.append(np.append(np.fromiter(map(ids.__getitem__, found), np.uint32, len(found)), np.uint32(0)))
            size += len(raw)
            if size >= SHARD_BYTES:
                yield from flushed()
                words, langs, runs, size = [], {}, [], 0
    if words:
        yield from flushed()


def by_rank(keys: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit keys, by halves, which numpy sorts by counting."""
    low = np.argsort(keys.astype(np.uint16), kind="stable").astype(np.int32)
    high = (keys >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Index:
    """One direction of an FM-index: the word before each suffix, suffixes being sorted by their first words, as many as depth."""

    def __init__(self, tokens: np.ndarray, depth: int):
        order = np.arange(len(tokens), dtype=np.int32)
        for k in reversed(range(depth)):
            order = order[by_rank(np.roll(tokens, -k)[order])]
        self.before, self._place = tokens[order - 1], None
        #: Where the suffixes that begin with each word begin.
        self.first = np.append(0, np.bincount(tokens).cumsum())

    def longer(self, row: np.ndarray) -> np.ndarray:
        """For each row the row of the suffix that is one word longer: rows with the same word before them keep their order."""
        if self._place is None:
            self._place = np.empty(len(self.before), np.int32)
            self._place[by_rank(self.before)] = np.arange(len(self._place), dtype=np.int32)
        return self._place[row].astype(np.int64)


class Phrases:
    """Phrases of one length: words (phrases x length) and their intervals of a forward and a backward index."""

    def __init__(self, words: np.ndarray, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.words, self.low, self.back, self.size = words, low, back, size

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.words[which], self.low[which], self.back[which], self.size[which])

    def small(self) -> Phrases:
        """Words and occurrences alone, in 32 bits."""
        none = np.zeros(0, np.int64)
        return Phrases(self.words.astype(np.uint32), none, none, self.size.astype(np.uint32))


class ShardIndex:
    """A bidirectional FM-index of tokens, the pieces of which stand between 0s; the backward one is made when it is first asked.

    Intervals of pairs are whole in the forward index, and those of triples in the backward one, which is all that
    phrases of LONGEST words need.
    """

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.forward, self._backward = tokens, Index(tokens, 2), None

    @property
    def backward(self) -> Index:
        self._backward = self._backward or Index(self.tokens[::-1], LONGEST - 1)
        return self._backward

    def words(self, ids: np.ndarray) -> Phrases:
        """The intervals of single words."""
        low = self.forward.first[ids]
        return Phrases(ids[:, None], low, low, self.forward.first[ids + 1] - low)

    def extended(self, phrases: Phrases, left: bool, last: bool = False) -> Phrases:
        """All phrases of one more word on that side, with as many occurrences as they have; the last ones need no interval there."""
        index, low, other = (self.forward, phrases.low, phrases.back) if left else (self.backward, phrases.back, phrases.low)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), phrases.size)
        begin = phrases.size.cumsum() - phrases.size
        row = np.arange(len(owner)) + np.repeat(low - begin, phrases.size)
        word = index.before[row]
        # By phrase, then by word; rows keep their order. In the other index a phrase's rows are sorted by just this word.
        order = by_rank(word)
        order = order[by_rank(owner[order])]
        owner, word = owner[order], word[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))[: len(owner)])
        size = np.diff(np.append(first, len(owner)))
        owner, word = owner[first], word[first].astype(np.int64)
        near, far = first if last else index.longer(row[order[first]]), other[owner] + first - begin[owner]
        words = np.column_stack([word, phrases.words[owner]] if left else [phrases.words[owner], word])
        found = Phrases(words, near, far, size) if left else Phrases(words, far, near, size)
        return found.take(np.flatnonzero(word))  # 0 is no word


def runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Cuts a list so that these sizes add up to most in a run, or the run is one place."""
    ends, begin = sizes.cumsum(), 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


def rows_of_runs(values: np.ndarray, cuts: list[int]) -> list[bytes]:
    """The bytes between these places; of several rows of values, each of them one after another."""
    return [np.ascontiguousarray(values[..., a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]


def packed(name: int, found: list[Phrases], length: int, number: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED: phrases of one length by bucket; their words are ids of the shard, and are sent as those of the whole corpus."""
    words = np.concatenate([np.zeros((length, 0), np.uint32), *[number[p.words].T.astype("<u4") for p in found]], axis=1)
    counts = np.concatenate([np.zeros(0, "<u4"), *[p.size.astype("<u4") for p in found]])
    code = np.zeros(len(counts), np.uint64)
    with np.errstate(over="ignore"):
        for row in words:
            code = mix(code * _GOLDEN + row)
    bucket = (code % np.uint64(buckets)).astype(np.int32)
    del code
    order = by_rank(bucket)
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)[: len(order)]), len(order))
    for run in runs(np.diff(cuts), AT_ONCE):
        ends = cuts[run.start : run.stop + 1]
        which, ends, n = order[ends[0] : ends[-1]], (ends - ends[0]).tolist(), len(ends) - 1
        columns = [pa.array([length] * n, pa.int32()), pa.array(bucket[which[ends[:-1]]], pa.int32()), pa.array([name] * n, pa.int64()), pa.array(rows_of_runs(words[:, which], ends), pa.binary()), pa.array(rows_of_runs(counts[which], ends), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers in one."""
    return first.astype(np.uint64) << np.uint64(32) | second


class Bucket:
    """Phrases of one length that several shards sent, summed; keys hold two words each."""

    def __init__(self, rows: pa.Table, length: int):
        self.length, self.shards = length, rows.column("shard").to_pylist()
        words, counts = ([x for chunk in rows.column(c).chunks for x in views(chunk)] for c in ("words", "counts"))
        self.sizes = [len(c) for c in counts]
        keys = [np.concatenate([paired(w[k], w[k + 1]) if k + 1 < length else w[k].astype(np.uint64) for w in (x.reshape(length, -1) for x in words)]) for k in range(0, length, 2)]
        self.order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        keys = [k[self.order] for k in keys]
        self.first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(self.order)])
        self.total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[self.order], self.first)
        self.keys = [k[self.first] for k in keys]

    def frequent(self) -> np.ndarray:
        return np.flatnonzero(self.total >= LEAST)

    def place(self) -> np.ndarray:
        """For each phrase as it was sent its place among the distinct ones."""
        out = np.empty(len(self.order), np.int32)
        out[self.order] = np.repeat(np.arange(len(self.first), dtype=np.int32), np.diff(np.append(self.first, len(self.order))))
        return out


def views(column: pa.Array) -> list[np.ndarray]:
    """Rows of 32-bit numbers, without a copy."""
    return [np.frombuffer(x.as_buffer(), "<u4") for x in column]


def lists(keys: list[np.ndarray], length: int) -> pa.Array:
    """Phrases as lists of their words."""
    words = np.empty((len(keys[0]), length), np.int64)
    for k in range(length):
        words[:, k] = keys[k // 2] >> np.uint64(32) if k % 2 == 0 and k + 1 < length else keys[k // 2] & np.uint64(MOST_WORDS - 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * length, pa.int32()), pa.array(words.ravel()))


def answer(key: tuple, rows: pa.Table) -> pa.Table:
    """(shard, words, counts): for each shard which of its pairs are frequent; without a shard, all frequent pairs and their counts."""
    bucket = Bucket(rows, 2)
    often, which = bucket.total >= LEAST, bucket.frequent()
    names, words, counts = [None], [bucket.keys[0][which].tobytes()], [bucket.total[which].astype("<i8").tobytes()]
    for name, place in zip(bucket.shards, np.split(bucket.place(), np.cumsum(bucket.sizes)[:-1])):
        names.append(name)
        words.append(bucket.keys[0][place[often[place]]].tobytes())
        counts.append(None)
    return pa.table({"shard": pa.array(names, pa.int64()), "words": pa.array(words, pa.binary()), "counts": pa.array(counts, pa.binary())})


def summed(key: tuple, rows: pa.Table) -> pa.Table:
    """(ws, a): the frequent phrases of a bucket, all of one length."""
    bucket = Bucket(rows, key[0].as_py())
    often = bucket.frequent()
    return pa.table({"ws": lists([k[often] for k in bucket.keys], bucket.length), "a": pa.array(bucket.total[often])})


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, counts) of pairs to (ws, a)."""
    for batch in batches:
        for keys, counts in zip(batch.column("words"), batch.column("counts")):
            yield pa.RecordBatch.from_arrays([lists([np.frombuffer(keys.as_buffer(), "<u8")], 2), pa.array(np.frombuffer(counts.as_buffer(), "<i8"))], names=["ws", "a"])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, id, number) to NUMBERED: of so many rows as stand together, one for each shard."""

    def flushed() -> pa.RecordBatch:
        shard, ids, numbers = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        cuts = [*first.tolist(), len(shard)]
        columns = [pa.array(shard[first]), *(pa.array(rows_of_runs(x[order].astype("<u4"), cuts), pa.binary()) for x in (ids, numbers))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NUMBERED.split(", ")])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if len(batch):
            held.append([c.to_numpy().copy() for c in batch.columns])
        if sum(len(h[0]) for h in held) >= AT_ONCE:
            yield flushed()
            held = []
    if held:
        yield flushed()


def frequent_words(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NUMBERED, the frequent words of each shard, and (number, lang, word, f) of each."""
    counted = parts.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= LEAST)
    placed = written(counted.withColumn("place", F.monotonically_increasing_id()), "words")
    # Numbers without gaps stay small: a partition's first number is how many words come before it.
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    if sum(s["n"] for s in sizes) > MOST_WORDS:
        raise OverflowError("more frequent words than 32 bits can number")
    offsets = [(r["part"], sum(s["n"] for s in sizes[:i])) for i, r in enumerate(sizes)]
    starts = parts.sparkSession.createDataFrame(offsets, "part long, start long")
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"), "lang", "word", "f")
    numbered = written(numbered, "numbers")
    return written(parts.join(numbered, ["lang", "word"]).select("shard", "id", "number").mapInArrow(by_shard, NUMBERED), "replies", GROUP_BYTES), numbered


class Shard:
    """A shard's tokens, for each of its ids the word's number in the whole corpus, or -1, and its frequent pairs."""

    def __init__(self, name: int, tokens: bytes):
        self.name, self.tokens, self.pairs, self.asked = name, np.frombuffer(tokens, "<u4"), [], False
        self.number = np.full(int(self.tokens.max()) + 1, -1, np.int64)

    def known(self) -> np.ndarray:
        """The frequent pairs in the shard's own ids, each in one number, sorted."""
        ids = np.flatnonzero(self.number >= 0)
        ids = ids[np.argsort(self.number[ids])]
        sent, self.pairs = np.concatenate([np.zeros(0, "<u8"), *self.pairs]), []
        first, second = (ids[np.searchsorted(self.number[ids], x)] for x in (sent >> np.uint64(32), sent & np.uint64(MOST_WORDS - 1)))
        return np.sort(first * len(self.number) + second)


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards that have frequent words, from (shard, kind, a, b) in order."""
    held = None
    for batch in batches:
        for name, kind, a, b in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("a"), batch.column("b")):
            if kind == 0:
                if held and held.asked:
                    yield held
                held = Shard(name, a.as_py())
            elif kind == 1:
                held.number[np.frombuffer(a.as_buffer(), "<u4")] = np.frombuffer(b.as_buffer(), "<u4")
                held.asked = True
            else:
                held.pairs.append(np.frombuffer(a.as_py(), "<u8"))
    if held and held.asked:
        yield held


def sent(shard: Shard, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED: a shard's pairs of frequent words."""
    index, found = ShardIndex(shard.tokens), []
    one = index.words(np.flatnonzero(shard.number >= 0))
    for run in runs(one.size, AT_ONCE):
        two = index.extended(one.take(run), left=True, last=True)
        found.append(two.take(np.flatnonzero(shard.number[two.words[:, 0]] >= 0)).small())
    yield from packed(shard.name, found, 2, shard.number, buckets)


def longer(shard: Shard, buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED: a shard's phrases of three and more words, as long as each pair within is frequent."""
    known, span = shard.known(), len(shard.number)
    if not len(known):
        return

    def frequent(phrases: Phrases, at: int) -> Phrases:
        """Those of which the words from this place on are a frequent pair."""
        code = phrases.words[:, at] * span + phrases.words[:, at + 1]
        return phrases.take(np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code))

    index, threes, fours = ShardIndex(shard.tokens), [], []
    often = np.zeros(span, bool)
    often[known // span] = often[known % span] = True
    one = index.words(np.flatnonzero(often))
    for run in runs(one.size, AT_ONCE):
        two = frequent(index.extended(one.take(run), left=True), 0)
        three = frequent(index.extended(two, left=True, last=True), 0)
        threes.append(three.small())
        fours.append(frequent(index.extended(three, left=False, last=True), 2).small())
    del index, known
    for length, found in ((3, threes), (4, fours)):
        yield from packed(shard.name, found, length, shard.number, buckets)
        found.clear()


def count_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ws, a) of frequent phrases of 2 to LONGEST words, (number, lang, word, f) of frequent words, and (lang, n) of all words."""
    shards = written(docs.mapInArrow(shard, SHARDS), "shards")
    words = shards.filter("tokens IS NULL").select("shard", "lang", "word", "id", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    tokens = shards.filter("tokens IS NOT NULL").select("shard", "tokens")
    size = tokens.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 4 / BUCKET))
    replies, numbered = frequent_words(words)

    def of_shards(function: Callable[[Shard, int], Iterator[pa.RecordBatch]], *more: DataFrame) -> DataFrame:
        """PACKED, from each shard's rows side by side: its tokens, its frequent words, and what more there is."""
        rows = tokens.select("shard", F.lit(0).alias("kind"), F.col("tokens").alias("a"), F.lit(None).cast("binary").alias("b"))
        for kind, part in enumerate((replies, *more), 1):
            rows = rows.union(part.select("shard", F.lit(kind), *part.columns[1:3]))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in shards_of(batches):
                yield from function(one, buckets)

        return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(send, PACKED).groupBy("length", "bucket")

    answers = written(of_shards(sent).applyInArrow(answer, ANSWERS), "pairs", GROUP_BYTES)
    more = of_shards(longer, answers.filter("shard IS NOT NULL")).applyInArrow(summed, "ws array<long>, a long")
    two = answers.filter("shard IS NULL").select("words", "counts").mapInArrow(listed, "ws array<long>, a long")
    return written(two.union(more), "phrases"), numbered, totals


def mine_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score; needs lang and text."""
    found, numbered, totals = count_phrases(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    every = found.union(numbered.select(F.array("number"), "f"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("ws", "a", "k", F.expr("slice(ws, 1, k)").alias("left"), F.expr("slice(ws, k + 1, size(ws))").alias("right"))
    parts = cuts.join(every.select(F.col("ws").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("ws").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    scored = parts.withColumn("score", score).groupBy("ws").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("ws", "best.*")
    # Each phrase inside a longer one, with the most occurrences that one has.
    inner = found.filter(F.size("ws") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("ws") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)))
    inside = inner.select(F.expr("slice(ws, at, size)").alias("ws"), "a").groupBy("ws").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, "ws", "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * SHARE))
    words = kept.select("ws", F.posexplode("ws").alias("at", "number")).join(numbered.select("number", "lang", "word"), "number")
    named = words.groupBy("ws").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word)).alias("phrase"), F.first("lang").alias("lang"))
    rows = kept.join(named, "ws").join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("_n") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
