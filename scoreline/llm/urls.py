"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

``judge_urls`` walks each url through one broadcast trie. A rule fits its host and all subdomains if the
url's path starts with the rule's path; of the rules that fit, the one with the most host labels wins, then
the one with the longest path, then block before allow. Urls that no rule fits get the default verdict.

Defined results: a null url, or one without ``://``, has an empty host and path and the default verdict;
repeated rows are judged each; an empty table gives an empty table; columns named like the results are
replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import with_arrow

#: A broadcast trie of more rules than this is refused: about 200 bytes a rule.
MAX_RULES = 1_000_000

_END = "\0rules"


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """rules: (verdict, host, path). Host labels lead from the last to the first, then path segments.

    The last path segment may be cut short (``/en/7`` fits ``/en/78``), so each node keeps the rules that end
    there as (rest of the segment, verdict, rule text).
    """
    root: dict = {}
    for count, (verdict, host, path) in enumerate(rules, 1):
        if count > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules; the trie must fit in a broadcast")
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("." + label, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        node.setdefault(_END, []).append((last, verdict, host + path))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits, or None."""
    node, best, segments = trie, None, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        at = node
        found = None
        for i, segment in enumerate(segments):
            for last, verdict, text in at.get(_END, ()):
                if segment.startswith(last):
                    rank = (i, len(last), verdict == "block")
                    if found is None or rank >= found[0]:
                        found = (rank, text, verdict)
            at = at.get("/" + segment) if i + 1 < len(segments) else None
            if at is None:
                break
        best = found or best
    return best and best[1:]


def split_url(url) -> tuple:
    """Columns (host, path): A-Z of the host are lower-cased; both are empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; needs a column url."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(k).to_pylist() for k in ("host", "path"))
            found = [longest_match(trie.value, h, p) if h else None for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x and x[0] for x in found], pa.string()), pa.array([x[1] if x else default for x in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    kept = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col("url"))
    parts = kept.withColumns({"host": host, "path": path})
    return with_arrow(parts, walk, "rule string, verdict string")
