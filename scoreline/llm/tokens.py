"""Token counts with a whole-token shortcut.

Offline, ``prove_whole_tokens`` runs every vocabulary string through the library and keeps those that come
back as the one token they name. Over the corpus, a batch of texts is cut at spaces into words, and its distinct
words into pre-tokens; of those that differ, the ones in the proven table count as one token directly, and only the
rest go through the library's merges (kept per worker). Words and texts then add up what their parts have.

The pre-token pattern is exact for Latin-1 characters, where case folding, white space and letter classes are the
same in this module and the library. A word that holds any other character counts directly if the table proves it
as it stands, and is given to the library if not. Texts that may hold a special string go to the library whole.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted each; an empty
table gives an empty table; columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreline.llm.common import with_arrow

#: A worker's table of merged pre-tokens starts anew beyond so many entries; strings of more bytes aren't kept.
CACHE, LONGEST = 1_000_000, 200

_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^ \t-\r\x85\xa0{_DIGIT}{_LETTER}]+)"
_BEYOND_LATIN1 = r"[^\x00-\x{ff}]"


def load(spec: str) -> Tokenizer:
    """From the text of a tokenizer file, without truncation or padding."""
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
#: Byte to the character that stands for it in the vocabulary: itself where it is visible, else from 256 on.
_BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def prove_whole_tokens(spec: str) -> dict[str, int]:
    """Vocabulary strings (as text) that alone encode as exactly the token they name. Bounded by the vocabulary."""
    tokenizer = load(spec)
    byte_of = {c: b for b, c in _BYTE_CHARS.items()}
    texts: dict[str, int] = {}
    for string, ident in tokenizer.get_vocab(with_added_tokens=False).items():
        if string.endswith("</w>"):
            try:
                texts[bytes(byte_of[c] for c in string[:-4]).decode()] = ident
            except (KeyError, UnicodeDecodeError):
                continue
    encoded = tokenizer.encode_batch(list(texts), add_special_tokens=False)
    return {t: i for (t, i), e in zip(texts.items(), encoded) if e.ids == [i]}


class Known:
    """Strings and their rows in an encoder's table. An Arrow array holds them, which takes a tenth of a dictionary's memory."""

    def __init__(self, strings: pa.Array, rows: np.ndarray):
        self.strings, self.rows = strings, rows

    def rows_of(self, strings: pa.Array, new: Callable[[str], int]) -> np.ndarray:
        """Of distinct strings; new gives the row of one that isn't known yet."""
        at = pc.index_in(strings, value_set=self.strings)
        fresh = strings.filter(pc.is_null(at))
        added = np.fromiter(map(new, fresh.to_pylist()), np.int64, len(fresh))
        out = self.rows[pc.fill_null(at, 0).to_numpy()]
        out[pc.is_null(at).to_numpy(zero_copy_only=False)] = added
        short = pc.less_equal(pc.binary_length(fresh), LONGEST)
        self.strings = pa.concat_arrays([self.strings, fresh.filter(short)])
        self.rows = np.append(self.rows, added[short.to_numpy(zero_copy_only=False)])
        return out


class Encoder:
    """A table of token ids, and the rows in it of proven strings, of pre-tokens that were merged, and of odd words."""

    def __init__(self, spec: str, whole: dict[str, int]):
        self.whole, self.tokenizer = whole, load(spec)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        """Only the proven strings are known: row k is the k-th of them."""
        self.flat = array("I", self.whole.values())
        self.starts = array("I", range(len(self.whole)))
        self.sizes = array("I", [1]) * len(self.whole)
        proven = pa.array(list(self.whole), pa.string()), np.arange(len(self.whole))
        self.pieces, self.words = Known(*proven), Known(*proven)

    def add(self, ids: list[int]) -> int:
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return len(self.sizes) - 1

    def merged(self, piece: str) -> int:
        return self.add([t.id for t in self.merge(piece.encode().decode("latin-1").translate(_BYTE_CHARS))])

    def by_library(self, text: str) -> int:
        return self.add(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def rows_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all pre-tokens of these words, and where each word begins. Words beyond Latin-1 are one row each."""
        odd = pc.match_substring_regex(words, _BEYOND_LATIN1)
        plain = pc.if_else(odd, "", words)
        # A space after each piece, and in place of the two spaces beyond ASCII, so that splitting finds the pieces.
        spaced = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(plain), "[\x85\xa0]", " "), _PIECE, r"\1 ")
        parts = pc.ascii_split_whitespace(spaced)
        # Splitting leaves an empty string where a word ends in a space: it has no tokens.
        pieces = parts.flatten().dictionary_encode()
        rows = self.pieces.rows_of(pieces.dictionary, self.merged)[pieces.indices.to_numpy()]
        bounds = parts.offsets.to_numpy().astype(np.int64) if len(words) else np.zeros(1, np.int64)
        return with_whole(rows, bounds - bounds[0], odd.to_numpy(zero_copy_only=False), self.words.rows_of(words.filter(odd), self.by_library))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the parts that the library encodes one by one as it does the whole texts, and where each text begins."""
        texts = pc.fill_null(texts, "")
        held = np.zeros(len(texts), bool)
        for string in self.special:
            held |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(held), "", texts) if held.any() else texts)
        words = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy().astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        rows, starts = self.rows_of_words(words.dictionary)
        at = words.indices.to_numpy()
        sizes = np.diff(starts)[at]
        ends = np.append(0, sizes.cumsum())
        rows = rows[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], sizes)]
        return with_whole(rows, ends[bounds - bounds[0]], held, np.array([self.by_library(texts[i].as_py()) for i in np.flatnonzero(held).tolist()], np.int64))

    def trim(self) -> None:
        """Between batches: forgets what was seen once it is much."""
        if len(self.sizes) > CACHE:
            self.reset()

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Numbers of tokens."""
        rows, bounds = self.rows(texts)
        upto = np.append(0, np.array(self.sizes, np.int64)[rows].cumsum())[bounds]
        self.trim()
        return np.diff(upto)

    def flat_ids(self, texts: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the id last at its end, and where each text begins."""
        rows, bounds = self.rows(texts)
        if last is not None:
            rows = np.insert(rows, bounds[1:], self.add([last]))
            bounds = bounds + np.arange(len(bounds))
        flat = np.frombuffer(self.flat, np.uint32).copy()
        starts, sizes = (np.array(x, np.int32) for x in (self.starts, self.sizes))
        self.trim()
        size = sizes[rows]
        ends = size.cumsum(dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int32)
        at += np.repeat((starts[rows] - (ends - size)).astype(np.int32), size)
        return flat[at], np.append(0, ends)[bounds]

    def ids(self, text: str) -> np.ndarray:
        """The token ids of one text."""
        return self.flat_ids(pa.array([text]))[0]


def with_whole(rows: np.ndarray, bounds: np.ndarray, whole: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows and bounds with one row each for the texts that are marked as whole."""
    if not len(row):
        return rows, bounds
    return np.insert(rows, bounds[:-1][whole], row), bounds + np.append(0, whole.cumsum())


def shared_encoder(spark: SparkSession, path: str) -> Broadcast:
    """What encoder_on needs on the executors: the tokenizer's file and the proven table, bounded by the vocabulary."""
    spec = spec_of(path)
    return spark.sparkContext.broadcast({"spec": spec, "whole": prove_whole_tokens(spec)})


def encoder_on(shared: Broadcast) -> Encoder:
    """This worker's encoder; later tasks of the same worker find it again."""
    value = shared.value
    if "encoder" not in value:
        value["encoder"] = Encoder(value["spec"], value["whole"])
    return value["encoder"]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than limit tokens); needs a column text."""
    shared = shared_encoder(docs.sparkSession, tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_on(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(encoder.counts(batch.column("text")), pa.int64())], names=[*batch.schema.names, "n_tokens"])

    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    counted = with_arrow(kept, count, "n_tokens long")
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
