"""Checks of read scores against expected ones, and of logs against image lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.similarity import with_similar
from scoreline.functions.text import normalize_name
from scoreline.sources.scratch import BATCH_BYTES, written


def read_expected_csv(rows: DataFrame, path: str = "image_path", order: str = "line") -> DataFrame:
    """Keyed by the file's name; of several rows the last by order counts; rows without a name are dropped."""
    named = rows.withColumn("image", F.regexp_extract(path, "[^/]+$", 0)).filter("image <> ''")
    others = [c for c in rows.columns if c not in (path, order)]
    return named.groupBy("image").agg(F.max_by(F.struct(*others), order).alias("_r")).select("image", "_r.*")


def expected_vs_actual(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(image, passed, mismatches, hard): actual scores by image against exp_player1/2, exp_set1/2, exp_game1/2."""
    joined = actual.join(expected.withColumn("_known", F.lit(True)), "image", "left")
    text = lambda c: F.when(F.col("success"), F.col(c).cast("string")).otherwise("")
    joined = with_similar(joined, {f"_named{i}": (F.col(f"exp_player{i}"), text(f"player{i}")) for i in (1, 2)})
    wrong, hard = [], []
    for i in (1, 2):
        game = text(f"game{i}")
        named = F.col(f"_named{i}")
        wrong += [
            F.when(~named, f"player{i}"),
            F.when(F.col(f"exp_set{i}") != text(f"set{i}"), f"set{i}"),
            F.when(F.col(f"exp_game{i}") != F.when(game == "-1", "").otherwise(game), f"game{i}"),
        ]
        hard.append(F.when(named & (normalize_name(F.col(f"exp_player{i}")) != normalize_name(text(f"player{i}"))), f"player{i}"))
    found = lambda items: F.array_join(F.array(*items), ",")  # noqa: E731  leaves out nulls
    mismatches = F.when(F.col("_known").isNull(), "No expected data found in CSV").otherwise(found(wrong))
    return joined.select("image", (mismatches == "").alias("passed"), mismatches.alias("mismatches"), F.when(F.col("_known"), found(hard)).otherwise("").alias("hard"))


def mine_errors(variance: DataFrame, truth: DataFrame) -> DataFrame:
    """Variance candidates (image, name) whose name isn't the true one."""
    return variance.join(truth.select("image", F.col("name").alias("true_name")), "image").filter(normalize_name(F.col("name")) != normalize_name(F.col("true_name")))


def reconcile_counts(candidates: DataFrame) -> DataFrame:
    """(video_id, candidates, skipped, added, consistent) from rows with status 'skipped' or 'added'."""
    skipped, added = F.count_if(F.col("status") == "skipped"), F.count_if(F.col("status") == "added")
    return candidates.groupBy("video_id").agg(F.count("*").alias("candidates"), skipped.alias("skipped"), added.alias("added"), (F.count("*") == skipped + added).alias("consistent"))


#: Paths, and characters of them, that one automaton holds; more of them are found by the hashes of their windows.
BLOCK_PATHS, BLOCK_CHARS = 100_000, 2 << 20

#: Bits of all filters: 64 for each path, of which it sets PROBES, at most 2 ** MOST_BITS (32 MB) shared by the paths' number,
#: but LEAST_BITS for paths of each class of lengths.
MOST_BITS, LEAST_BITS, PROBES = 28, 1 << 20, 4

#: UTF-8 bytes of lines that are hashed, and of found texts that are sent, at once; paths whose bits are sent at once.
AT_ONCE, PATHS_AT_ONCE = 1 << 20, 1 << 17

#: Bytes of a row group of the written lines, so that few long ones are read at once.
GROUP_BYTES = 16 << 20


def containing(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(image, line): each distinct image in each line that contains it; nulls contain nothing."""
    _, held, hits = searched(images, lines, F.lit(False))
    return held.join(hits, "number").select("image", "line")


def searched(images: DataFrame, lines: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct images, (number, flag, line) of all lines, and (image, number, flag) of each image in each line.

    Each line is read once, however many images there are, and stands nowhere beside an image. A few images go to the tasks
    whole, as an automaton; of more only filters of bounded size do, and the texts that pass them meet the images by a join.
    """
    asked = written(images.filter("image IS NOT NULL").select("image").distinct(), "images")
    count, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("image")), F.lit(0))).first()
    some = lines.filter("line IS NOT NULL").select("line")
    held = written(some.select(F.monotonically_increasing_id().alias("number"), flag.alias("flag"), "line"), "lines", GROUP_BYTES)
    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    few = count <= BLOCK_PATHS and chars <= BLOCK_CHARS
    return asked, held, hits_of_few([r["image"] for r in asked.toLocalIterator()], held) if few else hits_of_many(asked, held)


def hits_of_few(images: list[str], held: DataFrame) -> DataFrame:
    """(image, number, flag), for images of one automaton."""
    shared = held.sparkSession.sparkContext.broadcast(images)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), [w for w in shared.value if not w]
        for word in shared.value:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            found = [(w, k) for k, line in enumerate(batch.column("line").to_pylist()) for w in everywhere + (sorted({w for _, w in automaton.iter(line)}) if len(automaton) else [])]
            yield with_images(batch, pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.string()))

    return written(held.mapInArrow(find, HITS), "contained")


HITS = "image string, number long, flag boolean"


def with_images(batch: pa.RecordBatch, owner: pa.Array, images: pa.Array) -> pa.RecordBatch:
    """HITS, from the lines' places in the batch."""
    return pa.RecordBatch.from_arrays([images, batch.column("number").take(owner), batch.column("flag").take(owner)], names=["image", "number", "flag"])


def window_hashes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of the w bytes from each place on) for w = 1, 2, 4, ... up to longest."""
    hashes, w, base = mixed(data.astype(np.uint64) + np.uint64(1)), 1, np.uint64(0x9E3779B97F4A7C15)
    while w <= longest and len(hashes):
        yield w, hashes
        hashes = mixed(hashes[:-w] * base + hashes[w:])
        w *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole 64-bit number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def whole(first: np.ndarray, last: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """The hash of a text of this length: its first and its last window, of a power of two bytes, cover it."""
    return mixed(mixed(first + np.asarray(length).astype(np.uint64)) * np.uint64(0x94D049BB133111EB) + last)


@dataclass
class Lengths:
    """Images of w to 2 w - 1 bytes: their lengths, and the size and the two places of their filters in the bits of all."""

    w: int
    own: list[int]
    size: int
    begins: int
    wholes: int


def classes_of(counts: dict[int, int]) -> list[Lengths]:
    """By how many images there are of each length. A few long images have filters of their own, which many short ones don't fill."""
    out, begin, total = [], 0, sum(counts.values())
    for w in sorted({1 << n.bit_length() - 1 for n in counts}):
        own = sorted(n for n in counts if w <= n < 2 * w)
        here = sum(counts[n] for n in own)
        size = max(1024, min(64 * here, max(LEAST_BITS, (here << MOST_BITS) // total)) // 8 * 8)
        out.append(Lengths(w, own, size, begin, begin + size))
        begin += 2 * size
    return out


def place(hashes: np.ndarray, probe: int, begin: int, size: int) -> np.ndarray:
    """One of the bits of a hash in a filter."""
    low = np.uint64(0xFFFFFFFF)
    return (((hashes >> np.uint64(32)) + np.uint64(probe) * (hashes & low | np.uint64(1)) & low) * np.uint64(size) >> np.uint64(32)).astype(np.int64) + begin


def passing(filter_: np.ndarray, hashes: np.ndarray, begin: int, size: int) -> np.ndarray:
    """The places of hashes that have all their bits."""
    at = np.arange(len(hashes))
    for probe in range(PROBES):
        bit = place(hashes, probe, begin, size)
        good = np.flatnonzero(filter_[bit >> 3] >> (bit & 7) & 1)
        at, hashes = at[good], hashes[good]
    return at


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes with a byte that no such text holds between them, so no window of a text reaches over it; and where each begins."""
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"\xff".join(coded), np.uint8), np.cumsum([0, *[len(t) + 1 for t in coded]])


def bits_of(images: list[str], classes: list[Lengths]) -> np.ndarray:
    """The bits of these images: of the hashes of their first windows and of the whole."""
    data, starts = joined(images)
    n, bits = np.diff(starts) - 1, [np.zeros(0, np.int64)]
    for w, hashes in window_hashes(data, n.max(initial=0)):
        for c in classes:
            if c.w == w:
                own = np.flatnonzero((n >= w) & (n < 2 * w))
                first, at = hashes[starts[own]], starts[own] + n[own] - w
                key = whole(first, hashes[at], n[own])
                bits += [place(h, probe, begin, c.size) for h, begin in ((first, c.begins), (key, c.wholes)) for probe in range(PROBES)]
    return np.unique(np.concatenate(bits))


def filter_of(asked: DataFrame, classes: list[Lengths]) -> np.ndarray:
    """The bits of all images. Pieces of it are put together in tasks; the driver gets 64 MB at most."""
    piece, size = 1 << 18, sum(2 * c.size for c in classes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "image", PATHS_AT_ONCE):
                bits = bits_of(part.column("image").to_pylist(), classes)
                pieces, first = np.unique(bits // piece, return_index=True)
                held = [x.tobytes() for x in np.split((bits % piece).astype("<u4"), first[1:])][: len(pieces)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(held, pa.binary())], names=["piece", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros(piece, np.uint8)
        for bits in table.column("bits"):
            out[np.frombuffer(bits.as_buffer(), "<u4")] = 1
        return pa.table({"piece": table.column("piece")[:1], "held": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(-(-size // piece) * piece // 8, np.uint8)
    for row in asked.mapInArrow(send, "piece long, bits binary").groupBy("piece").applyInArrow(join, "piece long, held binary").toLocalIterator():
        out[row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["held"], np.uint8)
    return out


def hits_of_many(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(image, number, flag), for any number of images: lines are searched for windows that begin an image, and then for whole images.

    Windows and images are known by hashes in filters; each text that passes both goes, with its line's number, to the image
    that it is, if there is one.
    """
    some = asked.filter("image <> ''")
    # Different lengths add up to the text: a few thousand of them at most.
    classes = classes_of({r["n"]: r["count"] for r in some.groupBy(F.octet_length("image").alias("n")).count().collect()})
    shared = held.sparkSession.sparkContext.broadcast(filter_of(some, classes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "line", len(batch)):
                for owner, texts in texts_like_images(part.column("line").to_pylist(), classes, shared.value):
                    yield with_images(part, owner, texts)

    hits = held.mapInArrow(search, HITS).join(some, "image")
    if asked.filter("image = ''").count():
        hits = hits.union(held.select(F.lit("").alias("image"), "number", "flag"))
    return written(hits, "contained")


def parts_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """So many rows of a batch at once as are AT_ONCE bytes of this column, one at least and most of them."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, min(begin + most, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def texts_like_images(lines: list[str], classes: list[Lengths], filter_: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(line, text), each pair once, of all places of these lines that pass the filters; AT_ONCE bytes of texts at once."""
    data, starts = joined(lines)
    data = np.append(data, np.uint8(0xFF))
    by_window = {c.w: c for c in classes}
    owners, texts, size = [], [], 0
    for w, hashes in window_hashes(data, max(by_window, default=0)):
        c = by_window.get(w)
        at = passing(filter_, hashes, c.begins, c.size) if c else []
        for n in c.own if len(at) else []:
            here = at[at + n - w < len(hashes) - 1]  # the last byte is no line's
            keys = whole(hashes[here], hashes[here + n - w], n)
            good = passing(filter_, keys, c.wholes, c.size)
            here, keys = here[good], keys[good]
            owner = np.searchsorted(starts, here, "right") - 1
            known = (owner, keys, hashes[here])
            order = np.lexsort(known[::-1])
            once = order[np.append(True, np.any([x[order][1:] != x[order][:-1] for x in known], axis=0))[: len(order)]]
            # Neither over the end of a line nor from within a character to within another.
            once = once[(here[once] + n < starts[owner[once] + 1]) & ((data[here[once]] & 0xC0) != 0x80) & ((data[here[once] + n] & 0xC0) != 0x80)]
            for some in np.array_split(once, max(1, -(-len(once) * n // AT_ONCE))):
                if len(some):
                    owners.append(owner[some])
                    texts.append(cut(data, here[some], n))
                    size += len(some) * n
                if size >= AT_ONCE:
                    yield pa.array(np.concatenate(owners)), pa.concat_arrays(texts)
                    owners, texts, size = [], [], 0
    if owners:
        yield pa.array(np.concatenate(owners)), pa.concat_arrays(texts)


def cut(data: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The texts of n bytes from these places on."""
    taken = np.lib.stride_tricks.sliding_window_view(data, n)[at]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * n).astype(np.int32)), pa.py_buffer(taken.tobytes()))


def log_contains_join(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(image, line, preferred): the log lines that contain each image, only preferred ones where there are any.

    An image that no line contains has one row without a line.
    """
    preferred = F.col("line").contains("Sampling at") | F.col("line").contains("OCR_NAME_VARIANCE")
    asked, held, hits = searched(images, lines, preferred)
    best = hits.groupBy("image").agg(F.max("flag").alias("_best"))
    chosen = hits.join(best, "image").filter(F.col("flag") == F.col("_best")).select("number", "image", "flag")
    found = held.select("number", "line").join(chosen, "number").select("image", "line", F.col("flag").alias("preferred"))
    none = asked.join(best, "image", "left_anti").select("image", F.lit(None).cast("string").alias("line"), F.lit(None).cast("boolean").alias("preferred"))
    return found.union(none)
