"""Each corpus operator against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import hmac
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreline.llm import ann, chat, decontam, neardup, packing, quality, secrets, shards, tokens, urls
from scoreline.llm.common import limit_batches

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(autouse=True)
def small_batches(spark):
    limit_batches(spark)


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# 1. Secret scans


def b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def signed(alg="HS256"):
    head, body = b64(json.dumps({"alg": alg, "typ": "JWT"}).encode()), b64(b'{"sub":"someone"}')
    return f"{head}.{body}.{b64(hmac.new(b'k', f'{head}.{body}'.encode(), hashlib.sha256).digest())}"


def tlv(tag, content):
    size = bytes([len(content)]) if len(content) < 128 else b"\x82" + len(content).to_bytes(2, "big")
    return bytes([tag]) + size + content


def key_bytes(rng):
    number = lambda n: tlv(2, b"\x01" + rng.randbytes(n - 1))
    return tlv(0x30, tlv(2, b"\0") + number(128) + tlv(2, b"\1\0\1") + b"".join(number(64) for _ in range(6)))


def naive_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return secrets.in_order(out)


def test_secret_base_spans_match_plain_patterns():
    rng = random.Random(1)
    pieces = ["password", "TOKEN", "api_key", "apiKey", "secret", "pa\u017f\u017fword", " = ", ": ", "=", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "\n", " ", "deadbeef", "x.y-z/w+v_u=t", "\U0001f600", "to\u212aen"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert secrets.in_order(secrets.base_spans(text)) == naive_base(text), text


def test_secret_structures_are_confirmed():
    rng = random.Random(2)
    key = key_bytes(rng)
    field = lambda b: len(b).to_bytes(4, "big") + b
    keyfile = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"s" * 80)
    armour = base64.encodebytes(key).decode()
    for text, kind in ((signed(), "token"), (b64(key), "key"), (base64.b64encode(key).decode(), "key"), (key.hex(), "key"), (b64(keyfile), "keyfile"), (f"-----BEGIN RSA PRIVATE KEY-----\n{armour}-----END RSA PRIVATE KEY-----", "armour")):
        assert kind in {k for _, _, k in secrets.confirmed_spans(f"é before {text} after")}, kind
    broken = key[:-1], key + b"\0", bytes([key[0]]) + key[2:], rng.randbytes(len(key)), b"0" * 300
    for data in broken:
        assert not secrets.confirmed_spans(base64.b64encode(data).decode())
    assert not secrets.confirmed_spans(signed("HS512")) and not secrets.confirmed_spans(signed("none"))
    assert not secrets.confirmed_spans(signed()[:-3] + ".")


def naive_elements(data):
    """(tag, content) of a whole encoding, or None; written apart from the operator's reader."""
    out = []
    while data:
        if len(data) < 2:
            return None
        tag, size, head = data[0], data[1], 2
        if size > 127:
            head = 2 + size - 128
            if size == 128 or head > 6 or len(data) < head:
                return None
            size = int(data[2:head].hex(), 16)
            if size < 128:
                return None
        if len(data) < head + size:
            return None
        content = data[head : head + size]
        if tag & 32 and naive_elements(content) is None:
            return None
        out.append((tag, content))
        data = data[head + size :]
    return out


def naive_key(data):
    top = naive_elements(data)
    if len(data) < 24 or top is None or [t for t, _ in top] != [48]:
        return False
    parts = naive_elements(top[0][1])
    shape = " ".join(f"{t:02x}" for t, _ in parts)
    whole = lambda b: b and b[0] < 128 and not (len(b) > 1 and b[0] == 0 and b[1] < 128)
    value = lambda b: int.from_bytes(b, "big")

    def plain(parts, shape):
        if re.fullmatch("02 04( a0)?( a1)?", shape):
            return parts[0][1] == b"\x01" and 16 <= len(parts[1][1]) <= 72
        if re.fullmatch("02( 02){5}(( 02){3})?", shape):
            return all(whole(b) for _, b in parts) and value(parts[0][1]) < 2 and value(parts[1][1]) >= 2**255 and all(value(b) > 0 for _, b in parts[2:])
        return False

    if shape == "30 04":
        inner = naive_elements(parts[0][1])
        return [t for t, _ in inner] == [6, 48] and inner[1][1] != b"" and len(parts[1][1]) >= 24
    if re.fullmatch("02 30 04( a0)?( 81| a1)?", shape):
        scheme, octets = naive_elements(parts[1][1]), naive_elements(parts[2][1])
        if not whole(parts[0][1]) or value(parts[0][1]) > 1 or not scheme or scheme[0][0] != 6 or not octets or len(octets) != 1:
            return False
        tag, inside = octets[0]
        if tag == 48:
            return plain(naive_elements(inside), " ".join(f"{t:02x}" for t, _ in naive_elements(inside)))
        if tag == 2:
            return bool(whole(inside)) and value(inside) >= 2**127 and len(scheme) == 2 and scheme[1][0] == 48
        return tag == 4 and len(inside) in (32, 56, 57) and len(scheme) == 1
    return plain(parts, shape)


def keys_of_all_kinds(rng):
    oid, name = tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(6, bytes.fromhex("2a8648ce3d030107"))
    scalar = tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, name) + tlv(0xA1, tlv(3, b"\0" + rng.randbytes(64))))
    wrap = lambda scheme, octets, more=b"": tlv(0x30, tlv(2, b"\0") + tlv(0x30, scheme) + tlv(4, octets) + more)
    return [
        key_bytes(rng),
        scalar,
        wrap(oid + tlv(5, b""), key_bytes(rng)),
        wrap(oid + name, scalar, tlv(0xA0, tlv(0x30, oid))),
        wrap(tlv(6, b"\x2b\x65\x70"), tlv(4, rng.randbytes(32))),
        wrap(oid + tlv(0x30, tlv(2, b"\5")), tlv(2, b"\x40" + rng.randbytes(19))),
        tlv(0x30, tlv(0x30, oid + tlv(0x30, tlv(4, b"salt"))) + tlv(4, rng.randbytes(48))),
    ]


def test_secret_keys_agree_with_a_plain_reader():
    rng = random.Random(20)
    found = 0
    for _ in range(40):
        for key in keys_of_all_kinds(rng):
            assert secrets.is_private_key(key) and naive_key(key)
            for _ in range(25):
                broken = bytearray(key)
                for _ in range(rng.randrange(1, 3)):
                    broken[rng.randrange(min(len(broken), 60))] = rng.choice([0, 1, 2, 4, 6, 48, 127, 128, 129, 130, 255, rng.randrange(256)])
                broken = bytes(broken[: rng.choice([len(broken), len(broken) - 1])])
                assert secrets.is_private_key(broken) == bool(naive_key(broken)), broken.hex()
                found += secrets.is_private_key(broken)
    assert found > 100


def test_wrapped_octets_must_be_a_key():
    oid = tlv(6, bytes.fromhex("2a864886f70d010101"))
    for inside in (b"just plain text!", tlv(4, b"just plain text!"), tlv(0x30, tlv(2, b"\0")), random.Random(21).randbytes(40)):
        text = base64.b64encode(tlv(0x30, tlv(2, b"\0") + tlv(0x30, oid) + tlv(4, inside))).decode()
        assert secrets.confirmed_spans(f"key {text} end") == []


def test_armoured_keys_in_base64_and_encrypted_ones():
    rng = random.Random(22)
    for key in keys_of_all_kinds(rng):
        armour = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END ENCRYPTED PRIVATE KEY-----\n"
        assert "armour" in {k for _, _, k in secrets.confirmed_spans("x\n" + armour)}
        text = base64.b64encode(armour.encode()).decode()
        assert secrets.confirmed_spans(f"KEY_B64={text}\n") == [(8, 8 + len(text), "armour")]
    text = base64.b64encode(armour.replace("M", "N", 1).encode()).decode()
    assert secrets.confirmed_spans(text) == []


def test_secret_keys_after_an_equals_sign():
    key = key_bytes(random.Random(3))
    for value in (b64(key), base64.b64encode(key).decode()):
        for before, after in (("private_key=", "\n"), ("export SIGNING_KEY=", ""), ("secret=", " "), ("https://example.com/?k=", "&x=1"), ("a==", ""), ("key = ", ""), ("key='", "'")):
            text = before + value + after
            assert (len(before), len(before) + len(value), "key") in secrets.confirmed_spans(text), before
            assert value not in secrets.redact(text, secrets.in_order(secrets.base_spans(text) + secrets.confirmed_spans(text)))


def test_secrets_over_odd_rows(spark):
    token = signed()
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, f"é token = 'abcdef0123456789' {token}", "c"), (None, "x " * 200_000, "d"), (4, "no secrets", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.secrets], r.redacted) for r in secrets.find_secrets(df).collect()]
    assert len(got) == 6 and sorted(i for i, s, _ in got if s) == [3]
    (found,) = [x for x in got if x[1]]
    assert [k for k, _, _ in found[1]] == ["assign", "hex", "token"]
    assert found[2] == "é [SECRET]' [SECRET]" and secrets.find_secrets(df.limit(0)).count() == 0


# 2. Benchmark decontamination


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


def test_longest_common_subsequence_is_exact():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        assert sum(decontam.common_words(a, b)) == naive_lcs(a, b)


def test_term_sums_and_spread_match_dense_algebra():
    rng = np.random.default_rng(4)
    terms = rng.integers(0, decontam.TERMS + 1, (50, decontam.PASSAGE)).astype(np.int16)
    dense = np.zeros((50, decontam.TERMS + 1))
    np.add.at(dense, (np.arange(50)[:, None], terms), 1)
    table = decontam.with_zero(rng.standard_normal((decontam.TERMS, 7)))
    rows = decontam.sums(table, terms)
    assert np.allclose(rows, dense @ table, atol=1e-3)
    assert np.allclose(decontam.spread(rows, terms), (dense.T @ rows)[: decontam.TERMS], atol=1e-2)


def test_planted_passages_and_paraphrases_are_found(spark):
    rng = random.Random(5)
    bench = [(i, words(rng, rng.randrange(15, 59))) for i in range(40)] + [(900, None), (901, "too short"), (902, words(rng, 150))]
    texts, truth = [], set()
    for d in range(300):
        text = words(rng, rng.randrange(0, 600))
        if d % 6 == 0:
            i, item = bench[d // 6 % 40]
            item = item.split()
            if d % 12 == 0:  # a paraphrase: one word in eight replaced
                item = [w if k % 8 or k == 0 else "other" for k, w in enumerate(item)]
            text += " " + " ".join(item).upper() + " " + words(rng, 40)
            truth.add((d, i))
        texts.append(text)
    texts += [bench[42][1], None, "", "w1x " * 5000]
    truth.add((300, 902))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    df = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df.union(df.filter("doc_id = 6")), benchmark).collect()}
    assert got == truth
    assert decontam.contaminated(df.limit(0), benchmark).count() == 0 and decontam.contaminated(df, benchmark.limit(0)).count() == 0


def test_sparse_pairs_are_those_of_plain_counting():
    rng = random.Random(23)
    import pyarrow as pa

    for n_items, least in ((6, 1), (6, -40)):
        items = [(i, [rng.randrange(3000) for _ in range(20)], True) for i in range(n_items)]
        bench = decontam.Benchmark(items, np.ones((decontam.TERMS, 3), np.float32), np.arange(decontam.TERMS) % 3 != 0)
        bench.needed = np.minimum(bench.needed, least)
        texts = [[rng.randrange(3000) for _ in range(rng.randrange(200))] + items[k % n_items][1] for k in range(12)] + [[]]
        raw = decontam.Padded(pa.array([np.array(t, "<u4").tobytes() for t in texts], pa.binary()))
        blocks, reach = len(raw.terms) // decontam.BLOCK, decontam.AROUND // decontam.BLOCK
        word = np.full(len(raw.terms), -1)
        word[raw.at] = raw.words
        want = []
        for w in range(blocks):
            around = word[max(0, w - reach) * decontam.BLOCK : (w + reach + 2) * decontam.BLOCK].tolist()
            for i, (_, codes, _) in enumerate(items):
                rare = {c for c in codes if c % decontam.TERMS % 3}
                held = sum(x in rare for x in around)
                if held >= bench.needed[i] and (held or bench.needed[i] <= 0):
                    want.append((w, i))
        got = [(w, i) for k in range(0, blocks, 7) for w, i in zip(*bench.pairs(raw, k, min(blocks, k + 7)))]
        assert got == want


def test_retrieval_recalls_what_a_full_comparison_finds(spark):
    """Paraphrases near the share of 0.7, at any offset, against the longest common subsequence over all windows."""
    rng = random.Random(24)
    bench = [(i, words(rng, rng.randrange(15, 60), 20_000)) for i in range(60)]
    texts = []
    for d in range(240):
        item = bench[d % 60][1].split()
        cut = {k for k in range(len(item) - 6) if rng.random() < rng.choice([0.1, 0.2, 0.28])}
        told = [f"other{rng.randrange(1000)}" if k in cut else w for k, w in enumerate(item)]
        texts.append(" ".join([words(rng, rng.randrange(0, 120)), *told, words(rng, rng.randrange(0, 120))]))
    code = lambda t: [zlib.crc32(w.encode()) for w in t.lower().split()]
    span = decontam.PASSAGE + 2 * decontam.AROUND
    want = set()
    for d, text in enumerate(texts):
        have = code(text)
        for i, item in ((bench[d % 60]), bench[(d + 7) % 60]):
            if any(decontam.check(code(item), have[k : k + span]) for k in range(0, max(1, len(have)), decontam.BLOCK)):
                want.add((d, i))
    found = decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(want) > 150 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)


def test_only_the_end_of_an_item_is_its_answer():
    item = list(range(1, 65))
    lost_end = item[:56] + [999] * 8
    assert decontam.check(item, lost_end) == 0 and decontam.check(item, lost_end, ends=False) == 56 / 64
    assert [ends for *_, ends in decontam.item_passages(7, np.arange(150))] == [False, False, False, True]


def test_long_texts_in_pieces_keep_passages(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 500)
    rng = random.Random(6)
    item = words(rng, 50)
    texts = [words(rng, n) + " " + item + " " + words(rng, 700) for n in (0, 440, 470, 480, 499, 1000, 1490)]
    found = decontam.contaminated(docs_of(spark, texts + [words(rng, 900) for _ in range(30)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, 1) for i in range(len(texts))]


def test_short_items_are_found_word_for_word(spark, monkeypatch):
    rng = random.Random(23)
    plain = [words(rng, 60) for _ in range(30)]
    texts = plain + [plain[0] + " alpha Beta, gamma", "alpha beta", "alpha x beta gamma", "solo", "so lo", "beta gamma alpha", "one two three four five six seven eight", None, ""]
    bench = [(1, "Alpha beta gamma!"), (2, "solo"), (3, "alpha beta"), (4, ""), (5, None), (6, "one two three four five six seven"), (7, "!?"), (None, "solo"), (8, "alpha beta gamma")]
    want = {(30, 1), (30, 3), (30, 8), (31, 3), (33, 2), (36, 6)}
    for items in (20_000, 2):
        monkeypatch.setattr(decontam, "ITEMS", items)
        found = decontam.contaminated(docs_of(spark, texts).repartition(3), spark.createDataFrame(bench, "item_id long, text string"))
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
        assert found._jdf.queryExecution().analyzed().toString().count("Relation") == 1  # however many blocks


# 3. Token counts


def test_token_counts_equal_the_library(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in range(0x250)] + list("\u0130\u03a3\u03c2\u2028\u3000\u0301\U0001f600\u4e00\uac00\u1100\u1161\u2160\u0661\u200b\u212a\u017f") + ["'s", "'LL", "<|endoftext|>", "<|STARTOFTEXT|>", "the", " ", "\n"]
    texts = ["".join(rng.choice(alphabet if k % 3 else alphabet[:256]) for _ in range(rng.randrange(40))) for k in range(1500)] + ["", None, "a" * 5000, words(rng, 3000)]
    library = Tokenizer.from_file(BPE)
    want = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts]
    df = docs_of(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, BPE).collect()}
    assert [got[i] for i in range(len(texts))] == [(b, n, n > 2048) for b, n in want]
    assert tokens.count_tokens(df.limit(0), BPE).count() == 0


def test_whole_tokens_are_proven():
    whole = tokens.prove_whole_tokens(tokens.spec_of(BPE))
    library = Tokenizer.from_file(BPE)
    assert len(whole) > 30_000 and all(library.encode(t, add_special_tokens=False).ids == [i] for t, i in list(whole.items())[::500])


def test_one_odd_character_leaves_the_shortcut_on(monkeypatch):
    spec = tokens.spec_of(BPE)
    encoder, asked = tokens.Encoder(spec, tokens.prove_whole_tokens(spec)), []
    by_library = tokens.Encoder.by_library
    monkeypatch.setattr(tokens.Encoder, "by_library", lambda self, text: (asked.append(text), by_library(self, text))[1])
    assert len(encoder.ids("The cat sat \u2014 on the mat\nwith a \u201cquoted\u201d word, the mat \u2014")) > 11
    # The dash is proven to be one token and counts directly; the library is asked for the quoted word alone.
    assert "\u2014" in tokens.prove_whole_tokens(spec) and asked == ["\u201cquoted\u201d"]


def test_key_forms_and_decoys():
    """Keys after delimiters, over lines, with written-out breaks and in mixed-case hex; near misses of each give nothing."""
    rng = random.Random(77)
    key = key_bytes(rng)
    std, url = base64.b64encode(key).decode(), b64(key)
    lines = [std[k : k + 64] for k in range(0, len(std), 64)]
    armour = lambda br: "-----BEGIN PRIVATE KEY-----" + br + br.join(lines) + br + "-----END PRIVATE KEY-----"
    found = lambda text: [(k, text[a:b]) for a, b, k in secrets.confirmed_spans(text)]
    for before in ("https://h/p/", "KEY_", "key-", "x=", "?k=", "a+", '"', " "):
        for body in (std, url):
            assert found(f"see {before}{body} end") == [("key", body)], before
            assert found(f"{before}{body}") == [("key", body)]
    for br in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n"):
        assert found(f"{{k: {armour(br)}}}") == [("armour", armour(br))], br
        assert found("key:\n  " + br.join(lines) + "\nmore text") == [("key", br.join(lines))], br
    mixed = "".join(rng.choice((c.upper(), c.lower())) for c in key.hex())
    assert found(f"hex {mixed}.") == [("key", mixed)]
    assert found(f"two {std} and/{url}") == [("key", std), ("key", url)]
    broken = bytearray(key)
    broken[9] ^= 0x40
    for decoy in (std[:-8], std[1:], "x" + std, std + "A", std[:40] + " " + std[40:], base64.b64encode(bytes(broken)).decode(), "M" * 4000, "MIIE-" * 5000, "MII/" * 5000, key.hex()[:-2], "/".join(lines)):
        assert found(f"see {decoy} end") == [], decoy[:60]


def test_columns_with_dots_pass_all_operators(spark):
    df = docs_of(spark, ["token = 'abcdef0123456789abcdef'", None, "b"]).withColumns({"a.b": F.col("doc_id") + 1, "doc_id.text": F.lit("x")})
    for out in (secrets.find_secrets(df), tokens.count_tokens(df, BPE), shards.shard_rows(df, 2), urls.judge_urls(df.withColumn("url", F.lit("http://h/p")), [("block", "h", "/")])):
        assert sorted((r.doc_id, r["a.b"], r["doc_id.text"]) for r in out.collect()) == [(0, 1, "x"), (1, 2, "x"), (2, 3, "x")]


# 4. Chat formatting


def test_answers_of_sparse_ids(spark, monkeypatch):
    """Every conversation with an answer gets another one's, whatever the ids; others stand for themselves."""
    ids = [1, 5, 70, 8_000_000_000, -3]
    turns = [(i, t, role, f"{role} {i}") for i in ids for t, role in enumerate(["user", "assistant"])] + [(9, 0, "user", "alone"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("last", F.lit("clash"))
    got = {r.pair_id: r for r in chat.answer_pairs(df).collect()}
    assert sorted(got) == sorted([*ids, 9]) and got[9].chosen == "" and "assistant 70<" in got[9].rejected
    after = dict(zip(sorted(ids), [*sorted(ids)[1:], min(ids)]))
    for i in ids:
        assert got[i].common_turns == 1 and f"assistant {i}<" in got[i].chosen and f"assistant {after[i]}<" in got[i].rejected
    monkeypatch.setattr(chat, "RING", 2)
    assert sorted(r.pair_id for r in chat.answer_pairs(df).collect()) == sorted(got)
    assert chat.answer_pairs(df.limit(0)).count() == 0



def test_preference_pairs(spark):
    schema = "conv long, turn long, role string, text string, prompt string"
    chosen = [(1, 0, "system", "S", ""), (1, 1, "user", "Q", ""), (1, 2, "assistant", "good é", ""), (2, 0, "user", "only", ""), (3, 0, "user", "same", ""), (4, 0, None, None, ""), (4, 0, None, None, ""), (None, 0, "user", "lost", "")]
    rejected = [(1, 2, "assistant", "bad", ""), (1, 1, "user", "Q", ""), (1, 0, "system", "S", ""), (1, 3, "user", "?", ""), (3, 0, "user", "same", ""), (3, 1, "assistant", "more", ""), (4, None, "user", "x", ""), (5, 0, "assistant", "alone", "")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema), F.col("conv")).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert sorted(got) == [1, 2, 3, 4, 5]
    one = got[1]
    assert one.common_turns == 2 and one.prompt == show("system", "S") + show("user", "Q")
    assert one.chosen == show("assistant", "good é") and [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["good é<|im_end|>\n"]
    assert one.rejected == show("assistant", "bad") + show("user", "?") and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["bad<|im_end|>\n"]
    assert (got[2].common_turns, got[2].rejected, got[2].chosen) == (0, None, show("user", "only"))
    assert (got[3].common_turns, got[3].chosen, got[3].rejected) == (1, "", show("assistant", "more"))
    assert got[4].chosen == show("", "") * 2 and got[5].chosen is None and got[5].chosen_spans is None
    empty = spark.createDataFrame([], schema)
    assert chat.preference_pairs(empty, empty, F.col("conv")).count() == 0


# 5. Quality classifier


def labelled(spark, n=1200):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        base = [f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'tion', 'er', 'the'])}{rng.randrange(40)}" for _ in range(60)]
        text = " ".join(base) + "." if good else rng.choice([" | ".join(base), " ".join(b.upper() + "!!" for b in base), " ".join([base[0]] * 40)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9002, ""), (9003, "ab " * 100_000)], docs.schema)
    model = quality.fit_quality(docs, labels.union(spark.createDataFrame([(5, None, None), (None, 1, 0), (77777, 1, 0)], labels.schema)))
    scored = quality.score_quality(docs.union(odd).withColumn("score", F.lit("clash")), model)
    rows = scored.join(labels, "doc_id").filter(quality.is_held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200 and sum((r.score >= 0.7) == (r.quality == 1) for r in rows) > 0.97 * len(rows)
    assert sorted(r.doc_id for r in scored.filter("doc_id > 9000 AND score BETWEEN 0 AND 1").collect()) == [9001, 9002, 9002, 9003]
    assert scored.limit(0).count() == 0


def test_held_out_labels_never_count(spark):
    docs, labels = labelled(spark, 400)
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit_quality(docs, x)[1] for x in (labels, flipped))
    assert np.array_equal(one.w1, two.w1) and one.temperature == two.temperature


def test_word_vector_sums_match_a_plain_count():
    import pyarrow as pa

    texts = ["a b c a", None, "", "b | b | B!! 12"]
    got = quality.context_sums(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])).reshape(quality.BUCKETS, quality.DIM)
    places, signs = quality.index_vectors()
    want = np.zeros_like(got)
    for t in texts:
        ids = quality.bucket_ids(t, quality.Buckets()) if t else []
        for i, word in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(want[word], places[ids[j]], signs[ids[j]])
    assert np.array_equal(got, want)


# 6. URL filters


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("allow", "a.org", "/es/x/"), ("block", "a.org", "/es/x/y")]


def naive_judge(host, path):
    fit = [(h.count(".") + 1, len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


def test_urls_against_all_rules(spark):
    rng = random.Random(9)
    hosts = ["com", "example.com", "EXAMPLE.com", "notexample.com", "a.b.example.net", ".net", "org", "x.a.org", "a..org", "com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/78?x", "/en/6#y", "/de/8/9", "/de/", "/es/x", "/es/x/", "/es/x/y", "/es/x/yz", "?q=/en/", "#/en/"]
    urls_ = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "://", "http://a://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = urls.judge_urls(df, RULES).collect()
    assert len(rows) == len(urls_)
    for r in rows:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host, path = re.match(r"([^/?#]*)(/[^?#]*)?", rest).groups("")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict) == naive_judge(host, path), r
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


# 7. Near-duplicates


def brute_classes(texts):
    hashes = neardup.WordHashes()
    sets = [neardup.shingle(t or "", hashes) for t in texts]
    links = neardup.Links(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a[0]) and len(sets[j][0]) and plain_jaccard(a, sets[j]) >= neardup.THRESHOLD - 1e-12:
                links.join(i, j)
    return links.roots().tolist()


def plain_jaccard(a, b):
    x, y = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (a, b))
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in both) for d in set(x) & set(y))


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(10)
    a, b = (np.unique(rng.integers(0, 150, 90)).astype(np.uint64) for _ in range(2))
    wa, wb = (rng.integers(1, 5, len(x)).astype(float) for x in (a, b))
    exact = plain_jaccard((a, wa), (b, wb))
    assert abs(neardup.prob_jaccard(a, wa, b, wb) - exact) < 1e-12
    signatures = neardup.prob_minhash([a, b], [wa, wb], 4000)
    assert abs((signatures[0] == signatures[1]).mean() - exact) < 0.04
    again = neardup.prob_minhash([b, a], [wb * 3, wa], 4000)
    assert (again[0] == signatures[1]).all()  # scaling a side's weights changes nothing


def family(rng, base, rate):
    return " ".join(w if rng.random() > rate else f"n{rng.randrange(10**6)}" for w in base.split())


@pytest.mark.parametrize("block", [neardup.BLOCK, 12])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for size, rate in ((40, 0.02), (40, 0.05), (6, 0.01), (25, 0.0)):
        base = words(rng, rng.randrange(40, 200))
        texts += [family(rng, base, rate * rng.random()) for _ in range(size)]
    texts += [words(rng, n) for n in (1, 2, 4, 5, 6, 300)] + ["a b", "a b", "A  b!", "line one two three four five\n" * 50, "line one two three four five\n" * 60, None, None, "", "", "!!", "!!"]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts).withColumn("class_id", F.lit(0))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_of_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "z")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.class_id) for r in neardup.near_duplicates(df).collect())
    assert rows[:3] == [("1", 1), ("3", 1), ("3", 1)] and len(rows) == 4
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_equal_first_hashes_lose_no_row(spark, monkeypatch):
    """All rows share the first 64 bits of their hashes; the second tell them apart."""
    ids = neardup.row_ids
    monkeypatch.setattr(neardup, "row_ids", lambda: [F.lit(5).cast("long"), ids()[1]])
    rng = random.Random(18)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (2, a), (3, b), (4, b + " more"), (None, ""), (None, None), (6, words(rng, 30))]
    got = neardup.row_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (3, 3), (4, 3), (6, 6)] and len(got) == len(rows)


def test_groups_of_long_texts_are_split_by_shingles(spark, monkeypatch):
    """Few texts with many shingles are as many blocks as their shingles ask for, with the same classes."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3000)
    rng = random.Random(19)
    base = words(rng, 900, 50_000).split()
    texts = [" ".join(w if rng.random() > 0.012 * (k % 4) else "x" + w for w in base) for k in range(24)]
    seen = []
    block = neardup.F.ceil
    monkeypatch.setattr(neardup.F, "ceil", lambda c: seen.append(c) or block(c))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert seen and [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_of_null_and_shared_ids(spark):
    rng = random.Random(17)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, a), (None, b), (None, b + " "), (5, c), (5, a), (7, c), (8, None), (8, ""), (None, None)]
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 5), (None, None), (5, 5), (7, 5), (8, 8)}
    classes = neardup.row_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(classes) == len(rows) and len({(r.kept1, r.kept2) for r in classes}) == 6


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 204), (204, 203), (7, 7)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 205: 203, 204: 203}


# 8. Nearest neighbours


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 150)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    rng = np.random.default_rng(12)
    vectors = {i: rng.standard_normal(16).round(2).tolist() for i in range(600)}
    vectors |= {i: vectors[7] for i in range(600, 700)}  # a common vector
    rows = list(vectors.items()) + [(800, None), (801, [0.0] * 16), (802, [float("nan")] + [1.0] * 15), (900, [1.0, None] + [1.0] * 14), (1000, [float("inf")] * 16), (1100, [1.0, 2.0]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    ids = sorted(vectors)
    x = np.array([np.array(vectors[i], np.float32) for i in ids], float)
    for factor, least in ((1.0, 1.0), (0.9, 0.9)):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10, factor).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert sorted(got) == [i for i in ids if i % 100 == 0]
        hits = 0
        for q, found in got.items():
            away = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
            want = [(ids[j], away[j]) for j in np.lexsort((ids, away)) if ids[j] != q][:10]
            mine = [found[k] for k in range(1, 11)]
            hits += len({i for i, _ in want} & {i for i, _ in mine})
            if factor == 1.0:
                assert [i for i, _ in mine] == [i for i, _ in want] and np.allclose([d for _, d in mine], [d for _, d in want])
        assert hits >= least * 10 * len(got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    nodes = lambda: ann.nearest(df, F.col("vec_id") % 100 == 0)._jdf.queryExecution().analyzed().toString().count("\n")
    several = nodes()
    monkeypatch.setattr(ann, "QUERY_ROWS", 100_000)
    assert nodes() == several  # the plan doesn't grow with the blocks of queries
    few = ann.nearest(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_neighbours_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 8)
    rng = np.random.default_rng(18)
    rows = [(100 + i, rng.standard_normal(4).tolist()) for i in range(30)] + [(7, rng.standard_normal(4).tolist())] * 3
    rows += [rows[0]] * 40 + [(200, rows[0][1]), (200, rng.standard_normal(4).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.pmod("vec_id", F.lit(100)) == 0, 10, 1.0).collect()
    want = []
    for own, vector in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        away = sorted((float(np.sqrt(((np.array(v) - vector) ** 2).sum())), i) for i, v in rows if i != own)[:10]
        want += [(own, n, i, round(d, 9)) for n, (d, i) in enumerate(away, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


# 9. Sharding


@pytest.mark.parametrize("bucket", [shards.BUCKET, 7])
def test_sharding_laws(spark, monkeypatch, bucket):
    monkeypatch.setattr(shards, "BUCKET", bucket)
    monkeypatch.setattr(shards, "ONE_BY_ONE", 1 if bucket == 7 else 64)
    rng = random.Random(13)
    texts = [words(rng, rng.randrange(0, 80)) for _ in range(900)] + ["copy of one text"] * 400 + [None] * 5 + [""] * 5 + ["é" * 3000] + [f"{k:04d}" for k in range(100)]
    df = docs_of(spark, texts)
    clash = df.union(df.filter("doc_id = 1")).withColumns({c: F.lit("clash") for c in ("slot", "group", "bytes", "row", "part", "_group", "_bucket", "_offset")})
    rows = shards.shard_rows(clash, 8).collect()
    assert len(rows) == len(texts) + 1 and {r["row"] for r in rows} == {"clash"}
    load, slots, of_text = [0] * 8, [[] for _ in range(8)], {}
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert of_text.setdefault(r.text, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # The same loads as by dealing every single group.
    groups = {}
    for r in rows:
        groups[r.text] = groups.get(r.text, 0) + r["size"]
    want = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += size
    assert load == want
    assert shards.shard_rows(df.limit(0)).count() == 0


def test_counted_deals_equal_a_heap():
    rng = random.Random(19)
    for _ in range(300):
        loads, size, groups = [rng.randrange(60) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 9), rng.randrange(1, 60)
        want, now = [0] * len(loads), list(loads)
        for _ in range(groups):
            s = now.index(min(now))
            want[s], now[s] = want[s] + 1, now[s] + size
        assert shards.dealt_counts(loads, size, groups) == want
    plan = shards.longest_first([(5, 1), (4, 1), (3, 3)], 2)
    assert plan == {5: [1, 1], 4: [0, 1], 3: [1, 3]}


def test_many_groups_are_dealt_one_by_one_in_effect(spark):
    """100,000 groups of a few sizes: loads are those of the law, not of bundles."""
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), (F.col("id") % 3).cast("int"))).alias("text"))
    load = {r.shard: (r.bytes, r.n) for r in shards.shard_rows(df, 8, keep=["doc_id"]).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    want = [0] * 8
    for size in sorted((7 + i % 3 for i in range(100_000)), reverse=True):
        want[want.index(min(want))] += size
    assert [load[s][0] for s in range(8)] == want and sum(n for _, n in load.values()) == 100_000


# 10. Packing


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 60_000)
    rng = random.Random(14)
    topics = [[f"t{k}word{j}" for j in range(30)] for k in range(6)]
    texts = [" ".join(rng.choices(topics[k % 6], k=rng.randrange(1, 400))) for k in range(150)] + [None, "", words(rng, 9000)]
    df = docs_of(spark, texts).withColumn("offset", F.lit("clash"))
    rows = packing.pack(df.union(df.filter("doc_id = 3")), BPE).collect()
    library = Tokenizer.from_file(BPE)
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]
    sequences, pieces = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for d, parts in pieces.items():
        assert sum(n for _, n in parts) == len(ids[d]) * (2 if d == 3 else 1)
    assert set(pieces) == set(range(len(texts)))
    total = sum(map(len, ids)) + len(ids[3])
    assert len(sequences) <= total / packing.WINDOW + 60 and packing.pack(df.limit(0), BPE).count() == 0


def test_packing_joins_related_documents():
    rng = np.random.default_rng(15)
    docs = [rng.integers(100 * (k % 4), 100 * (k % 4) + 100, 100).astype(np.uint32) for k in range(40)]
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    topics = {}
    for d, _, _, sequence, _ in packing.fill_windows(np.concatenate(docs), bounds, 500):
        topics.setdefault(sequence, []).append(d % 4)
    assert all(len(set(t)) == 1 for t in topics.values())


def test_packing_brings_related_documents_together_over_many_shards(spark, monkeypatch):
    rng = random.Random(16)
    whole = sorted(t for t in tokens.prove_whole_tokens(tokens.spec_of(BPE)) if t.isalpha() and t.isascii())
    rng.shuffle(whole)
    topics, common = [whole[30 * k : 30 * k + 30] for k in range(40)], whole[1200:1400]
    texts = [" ".join(rng.choices(topics[k % 40], k=60) + rng.choices(common, k=60)) for k in range(1600)]
    size = sum(map(len, texts))
    shares = []
    for shards in (4, 40):
        monkeypatch.setattr(packing, "SHARD_BYTES", size // shards)
        windows = {}
        for r in packing.pack(docs_of(spark, texts), BPE).collect():
            windows.setdefault(r.sequence_id, set()).add(r.doc_id)
        shares.append(np.mean([max(np.bincount([d % 40 for d in w])) / len(w) for w in windows.values()]))
    assert min(shares) > 0.7, shares


def test_shards_are_cut_as_rows_pass(monkeypatch):
    """However few ranges a sample gave, no shard holds more than twice SHARD_BYTES, unless one row does; rows keep their order."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 1000)
    rng = random.Random(3)
    sizes = [rng.choice([1, 30, 200, 900, 2000, 5000]) for _ in range(600)]
    ranges = sorted(rng.choice([0, 0, 0, 1, 5]) for _ in sizes)
    table = pa.table({"doc_id": range(600), "ids": [b""] * 600, "size": sizes, "_key": range(600), "_range": ranges})
    for step in (1, 7, 600):
        shards = list(packing.shards_of(iter(table.to_batches(max_chunksize=step))))
        assert [i for _, rows in shards for i in rows.column("doc_id").to_pylist()] == list(range(600))
        for part, rows in shards:
            held = rows.column("size").to_pylist()
            assert set(rows.column("_range").to_pylist()) == {part} and (sum(held) <= 2000 or len(held) == 1)
        assert len(shards) <= 3 + 2 * sum(sizes) / 2000 + sum(s == 5000 for s in sizes)
    assert list(packing.shards_of(iter([]))) == []


def test_packing_with_far_more_shards_than_sampled_keys(spark, monkeypatch):
    monkeypatch.setattr(packing, "SAMPLE", 4)
    monkeypatch.setattr(packing, "SHARD_BYTES", 500)
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 60), 300) for _ in range(300)]
    rows = packing.pack(docs_of(spark, texts).repartition(3), BPE, 128).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert sorted(pieces) == list(range(300))
    for held in pieces.values():
        held.sort()
        assert [s for s, _, _ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))] and sum(n for _, n, _ in held) == held[0][2]


def test_packing_counts_terms_of_the_whole_corpus():
    ids, bounds = np.array([5, 6, 5, 7], np.uint32), np.array([0, 2, 4])
    df = np.zeros(8)
    df[[5, 6, 7]] = 2, 500, 2
    index = packing.Index(ids, bounds, packing.Corpus(df, 1000.0, 2000.0))
    norm = 1 / (1 + packing.K1 * (1 - packing.B + packing.B * 2 / 2)) * (packing.K1 + 1)
    idf = lambda n: np.log1p((1000 - n + 0.5) / (n + 0.5))
    assert np.allclose(index.scores(ids[:2]), [norm * (idf(2) + idf(500)), norm * idf(2)], rtol=1e-5)


def test_packing_asks_for_all_terms_of_a_seed():
    # The seed shares none of its strongest terms, but its 17th one with document 1 only; document 2 would win a tie.
    seed = np.repeat(np.arange(10, 40), 3)
    docs = [np.append(seed, 50), np.array([50, 60, 61]), np.array([70, 71, 72])]
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    order = [d for d, *_ in packing.fill_windows(np.concatenate(docs).astype(np.uint32), bounds, 1000)]
    assert order == [0, 1, 2]


def naive_scores(docs, query, df, count, mean):
    """BM25 of each document for the distinct terms of a query, written out."""
    out = []
    for doc in docs:
        total = 0.0
        for term in set(query):
            tf = doc.count(term)
            idf = np.log(1 + (count - df[term] + 0.5) / (df[term] + 0.5))
            total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean))
        out.append(total)
    return out


def test_bm25_and_windows_against_plain_ones():
    rng = random.Random(25)
    docs = [[rng.randrange(60) for _ in range(rng.randrange(1, 40))] for _ in range(50)]
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    flat = np.array([t for d in docs for t in d], np.uint32)
    df = np.array([sum(t in d for d in docs) for t in range(61)], float)
    corpus = packing.Corpus(df, 50.0, float(len(flat)))
    index = packing.Index(flat, bounds, corpus)
    for q in range(50):
        assert np.allclose(index.scores(flat[bounds[q] : bounds[q + 1]]), naive_scores(docs, docs[q], df, 50, len(flat) / 50), rtol=1e-5)
    # The whole greedy filling: seed, then unused neighbours by score, ties to the later document.
    window, unused, want, rest, room, opens = 64, list(range(50)), [], None, 64, True
    while unused or rest:
        if rest is None:
            rest = (unused.pop(0), 0)
        seed = rest[0]
        queue = None
        while rest:
            doc, start = rest
            n = min(len(docs[doc]) - start, room)
            want.append((doc, start, n))
            room -= n
            rest = (doc, start + n) if start + n < len(docs[doc]) else None
            if room == 0:
                room = window
                break
            if queue is None:
                score = naive_scores(docs, docs[seed], df, 50, len(flat) / 50)
                queue = sorted(unused, key=lambda d: (round(score[d], 9), d))
            if queue:
                rest = (queue.pop(), 0)
                unused.remove(rest[0])
    assert [(d, a, n) for d, a, n, *_ in packing.fill_windows(flat, bounds, window, corpus)] == want
