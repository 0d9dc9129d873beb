"""The opN queries themselves, over the smallest tables: columns, types and digests, each against a plain calculation."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from scoreline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

TYPES = {
    "op1_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet")
    return dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == TYPES[name]
    return df.collect()


def test_op1(spark, texts):
    found = {r.doc_id: r for r in rows_of(spark, "op1_secret_scans")}
    assert set(found) == set(texts)
    kinds = ["assign", "access", "hex"]
    assign = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for i, text in texts.items():
        spans = [("assign", *m.span()) for m in re.finditer(assign, text or "") if len(m[2]) >= 12]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in kinds]
        assert set(listed.split(",")) <= set(r.spans.split(","))
    assert any(r.spans for r in found.values())


def test_op2(spark, texts):
    bench = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{DATA}/benchmark.parquet").columns)))
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_benchmark_decontamination"](spark, DATA).collect()}
    flat = lambda t: f" {' '.join(re.findall(r'[^\W]+', (t or '').lower()))} "
    held = {(i, b) for i, t in texts.items() for b, item in bench.items() if len(flat(item).split()) >= 8 and flat(item) in flat(t)}
    assert held <= found


def test_op3(spark, texts, library):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(spark, "op3_token_counts")}
    for i, text in texts.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert found[i] == (len((text or "").encode()), n, n > 2048)


def test_op4_pairs_share_a_prompt(spark):
    rows = queries.QUERIES["op4_chat_formatting"](spark, DATA).collect()
    assert sum(r.common_turns >= 1 and bool(r.prompt) for r in rows) >= 0.9 * len(rows) > 0
    assert sum(r.chosen != r.rejected for r in rows) >= 0.9 * len(rows)


def test_op5(spark, texts):
    rows = rows_of(spark, "op5_quality_classifier")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op6(spark):
    urls = dict(zip(*(pq.read_table(f"{DATA}/pages.parquet").column(c).to_pylist() for c in ("page_id", "url"))))
    rows = rows_of(spark, "op6_url_filters")
    assert len(rows) == len(urls)
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)(/[^?#]*)?", rest).groups("")
        host = host.lower() if host.isascii() else host
        fit = [(len(h), len(p), h + p[0:], v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_op7(spark, texts):
    rows = queries.QUERIES["op7_minhash_near_dedup"](spark, DATA).collect()
    found = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(texts) and all(found[c] == c for c in found.values())
    same = {}
    for i, text in texts.items():
        if re.search(r"\w", text or ""):
            assert found[same.setdefault(text, i)] == found[i]


def test_op8(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, x = np.array(table.column("vec_id").to_pylist()), np.array(table.column("embedding").to_pylist(), float)
    rows = rows_of(spark, "op8_nearest_neighbours")
    hits = 0
    for q in ids[ids % 100 == 0]:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        want = [i for _, i in sorted((d, i) for d, i in zip(away, ids) if i != q)[:10]]
        assert [k for k, *_ in mine] == list(range(1, 11)) and all(s == away[ids == i][0] for _, i, s in mine)
        hits += len(set(want) & {i for _, i, _ in mine})
    assert hits >= 0.9 * len(rows) and len(rows) == 10 * (ids % 100 == 0).sum()


def test_op9(spark, texts):
    rows = rows_of(spark, "op9_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, load, shard_of = {}, {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_op10(spark, texts, library):
    rows = rows_of(spark, "op10_packing")
    ends, placed = {}, {}
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        ends[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        placed.setdefault(r.doc_id, []).append((r.start, r.length))
    assert max(ends.values()) <= 4096 and set(placed) == set(texts)
    for i, parts in placed.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
