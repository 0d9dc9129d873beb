"""Ranked search, substring dedup and phrases against plain versions, on odd rows and with forced splits."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import phrases, ranked, substrings
from scoreline.llm.common import limit_batches


@pytest.fixture(autouse=True)
def small_batches(spark):
    limit_batches(spark)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11. Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, count = sum(n for *_, n in bags), len(bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = TERM.findall(lowered(text)), []
        for i, b, n in bags:
            m = 25 + 75 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ranking_case(rng):
    pool = [f"w{k}" for k in range(40)] + ["Été", "naïve", "x1", "ß"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    docs += [(1000 - k, "w1 W2, w3") for k in range(60)] + [(i, docs[3][1]) for i in (7, 7, 2000)] + [(None, "w1 w2"), (None, None), (5, ""), (6, "., !"), (9, "long " * 5000 + "w1")]
    items = [(k, " ".join(rng.choice(pool) for _ in range(12))) for k in range(15)] + [(3, "w1 w1 W1 w2"), (None, "w5 x1"), (20, None), (21, "unknownterm"), (22, "w1 w2 w3")]
    return docs, items


def test_ranking_equals_a_plain_one(spark, monkeypatch):
    docs, items = ranking_case(random.Random(11))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = plain_ranking(docs, items)
    assert found(ranked.search(df, asked)) == want and len(want) > 150
    # The same in blocks of items, in small steps, and without exact doubles.
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 6)
    assert found(ranked.search(df, asked, 3)) == plain_ranking(docs, items, 3)


def test_scores_in_steps_and_in_integers(monkeypatch):
    items = ranked.Items([0, 1], [b"a b b c", b"b d"])
    items.weigh(10, np.array([1, 2, 3, 4]))
    case = np.array([30, 40]), np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2, 1, 3])
    want = items.scores(*case)
    monkeypatch.setattr(ranked, "STEP", 1)
    assert (items.scores(*case) == want).all()
    items.exact = False
    assert (items.scores(*case) == want).all() and want[1, 1] > 0


def test_copies_are_one_class_with_its_first_documents(spark):
    bags = spark.createDataFrame([(i if i % 9 else None, 30 + i % 2, bytearray(b"ab")) for i in range(400)] + [(5, 30, bytearray(b"c"))], "doc_id long, m long, bag binary").repartition(5)
    got = {(r.m, bytes(r.bag)): [d.doc_id for d in r.docs] for r in ranked.classes_of(bags, 4).collect()}
    assert got == {(30, b"ab"): [2, 4, 6, 8], (31, b"ab"): [1, 3, 5, 7], (30, b"c"): [5]}
    plan = ranked.classes_of(bags, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0


# 12. Substring dedup

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(docs):
    order = lambda i: math.inf if i is None else i
    split = [(i, GAP.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, math.inf), order(i))
    out = []
    for i, w in split:
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < order(i) for q in range(p, p + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def dedup_case(rng):
    word = lambda: f"w{rng.randrange(500)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other, exact = text(80), text(51), text(50)
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 90))]
        for p in (passage, other, exact):
            if rng.random() < 0.3:
                words = p.split()
                a = rng.randrange(0, 12)
                parts += ["\t".join(words[a : len(words) - rng.randrange(0, 12)]), text(rng.randrange(0, 40))]
        docs.append((i, "\n".join(parts)))
    copy = text(120)
    docs += [(100 + k, copy) for k in range(20)] + [(200 + k, copy.replace(copy.split()[60], f"n{k}", 1)) for k in range(10)]
    docs += [(3, docs[7][1]), (7, docs[7][1]), (7, docs[7][1]), (8, passage), (None, passage), (None, passage), (None, None), (300, ""), (301, " \x0b\x0c "), (302, text(49)), (303, "repeat " * 400), (304, "repeat " * 60), (305, "nb sp " * 55)]
    docs += [(400, " ".join(passage.split()[:60] + passage.split()[:60]))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("run,group", [(1 << 20, 1 << 20), (64, 40)])
def test_substrings_equal_a_plain_version(spark, monkeypatch, run, group):
    """With small runs and groups prefixes are split down to whole windows."""
    monkeypatch.setattr(substrings, "RUN", run)
    monkeypatch.setattr(substrings, "GROUP", group)
    docs = dedup_case(random.Random(12))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumn("n_words", F.lit("clash"))
    got = found(substrings.remove_repeats(df))
    assert got == plain_dedup(docs) and sum(r[2] for r in got) > 2000
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_prefixes_grow_until_groups_are_small(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 50)
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 1 << 32, (5, 3000), dtype=np.uint32)
    symbols[:3, :2000] = symbols[:3, :1]  # two thirds share three symbols
    symbols[:, :400] = symbols[:, :1]  # and one window is much more frequent
    run = substrings.Run(symbols, np.zeros(3000, np.int64), np.arange(3000, dtype=np.uint32), np.array([5]), np.array([5]))
    df = spark.createDataFrame([tuple(bytearray(c) if isinstance(c, bytes) else c.tolist() for c in run.columns())], substrings.RUNS)
    tree = substrings.prefixes_of(df, 3000)
    slot, depth = tree.slots_of(symbols)
    groups = tree.slots[slot]
    sizes = np.bincount(groups)
    assert len(set(groups[:400])) == 1 and depth[:400].min() == 5 and depth[2000:].max() == 1
    assert sorted(sizes)[-2] <= 2 * 50 and sizes.max() < 400 + 2 * 50


def test_anchors_are_the_smallest_blocks():
    rng = np.random.default_rng(2)
    for n in (41, 42, 100, 333):
        blocks = rng.integers(0, 60, n).astype(np.uint64)
        want = [p + int(np.argmin(blocks[p : p + 41])) for p in range(n - 40)]
        assert substrings.anchors_of(blocks).tolist() == want


# 13. Phrases


def plain_phrases(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[p : p + size]) for p in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in often.items():
            for size in range(2, len(p)):
                for q in range(len(p) - size + 1):
                    inside[p[q : q + size]] = max(inside[p[q : q + size]], a)
        rows = []
        for p, a in often.items():
            if 100 * inside[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrase_case(rng):
    pool = ["a", "b", "C", "d", "É", "née", "x y", "w1", "\x01", " z"]
    fixed = ["a b c d", "b c", "É née w1", "d d d d d", "a\tb", "C  d"]
    docs = []
    for k in range(300):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        docs.append((rng.choice(["en", "de", None, "en"]), "".join(w + rng.choice([" ", " ", " ", ". ", "\n", ",", "?!", "\r\n"]) for w in words)))
    return docs + [("en", None), ("fr", ""), (None, " . "), ("es", "solo"), ("en", "a b c d " * 3000)]


@pytest.mark.parametrize("shard,bucket", [(8 << 20, 4 << 20), (300, 200)])
def test_phrases_equal_a_plain_version(spark, monkeypatch, shard, bucket):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "BUCKET", bucket)
    docs = phrase_case(random.Random(13))
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("rank", F.lit("clash"))
    df = df.repartition(3)
    want = plain_phrases(docs, 30, 60)
    assert found(phrases.mine_phrases(df, 60)) == sorted(want, key=repr) and len(want) > 25
    assert phrases.mine_phrases(df.limit(0)).count() == 0


def test_index_extends_both_ways():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([[0], rng.integers(0, 6, 400), [0]]).astype(np.uint32)
    index = phrases.ShardIndex(tokens)

    def plain(size):
        got = Counter(tuple(tokens[p : p + size].tolist()) for p in range(len(tokens) - size + 1))
        return {p: c for p, c in got.items() if 0 not in p}

    one = index.words(np.arange(1, 6))
    two = index.extended(one, left=True)
    three = index.extended(two, left=True, last=True)
    four = index.extended(three, left=False, last=True)
    for size, held in ((1, one), (2, two), (3, three), (4, four)):
        assert dict(zip(map(tuple, held.words.tolist()), held.size.tolist())) == plain(size)


def test_a_shard_takes_few_bytes_for_a_word_of_it():
    """Where every pair is frequent, as in a large corpus: the index and what is sent, not the work of all extensions at once."""
    rng = np.random.default_rng(7)
    tokens = np.concatenate([[0], rng.zipf(1.3, 1_500_000).clip(1, 60_000), [0]]).astype(np.uint32)
    held = phrases.Shard(1, tokens.tobytes())
    held.number[1:] = np.arange(len(held.number) - 1)
    codes = np.unique(held.number[tokens[1:-2]] << 32 | held.number[tokens[2:-1]]).astype("<u8")
    held.pairs = list(np.array_split(codes, 50))
    tracemalloc.start()
    rows = [0, 0, 0, 0, 0]
    for batch in phrases.longer(held, 200):
        assert batch.nbytes < 10 << 20
        for length, counts in zip(batch.column("length").to_pylist(), batch.column("counts").to_pylist()):
            rows[length] += int(np.frombuffer(counts, "<u4").sum())
    assert rows[3:] == [1_499_998, 1_499_997]
    assert tracemalloc.get_traced_memory()[1] < 150 * len(tokens)
    tracemalloc.stop()


def test_a_shard_is_no_row_of_lists(spark):
    """What comes back to a shard passes by sorted, for lists and joined rows of it pile up in the JVM."""
    docs = spark.createDataFrame([("en", "a b c d " * 40)] * 3, "lang string, text string")
    plans = []
    real = phrases.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "written", lambda df, name="", *a: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name, *a))[1])
        assert phrases.mine_phrases(docs).count() > 0
    for name, plan in plans:
        assert name not in ("pairs", "phrases") or "collect_list" not in plan and "SortMergeJoin" not in plan
