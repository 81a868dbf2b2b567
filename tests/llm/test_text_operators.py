"""Word hashing, near-dedup, substring dedup and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstream.llm import words as W
from siltstream.llm.decontaminate import mark_benchmark
from siltstream.llm.graph import components
from siltstream.llm.minhash import near_duplicates
from siltstream.llm.substring import remove_repeats

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary(r, n=400):
    return ["".join(r.choices("abcdeéXY", k=r.randint(1, 6))) for _ in range(n)]


# ---------------------------------------------------------------- words
@pytest.mark.parametrize(("rule", "pattern", "fold"), [(W.SPACED, SPACED, False), (W.SPACED_LOWER, SPACED, True), (W.ALNUM_LOWER, ALNUM, True)])
def test_words_equal_regular_expression(rule, pattern, fold):
    r = random.Random(3)
    texts = [None, "", " ", "x", "  a\nb "] + ["".join(r.choices("aB é\n\t!9ß\x0b　", k=r.randint(0, 50))) for _ in range(2000)]
    found = W.find_words(pa.array(texts).slice(1), rule)
    seen = {}
    for i, text in enumerate(texts[1:]):
        want = re.findall(pattern, lower(text) if fold else text or "")
        own = found.hashes[found.first[i] : found.first[i + 1]].tolist()
        assert len(own) == len(want)
        for word, h in zip(want, own, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    at, hashes = found.windows(3)
    assert len(at) == np.maximum(found.counts - 2, 0).sum()
    names = {h: w for w, h in seen.items()}
    grams = {}
    for a, h in zip(at.tolist(), hashes.tolist(), strict=True):
        assert grams.setdefault(tuple(names[x] for x in found.hashes[a : a + 3].tolist()), h) == h
    assert len(set(grams.values())) == len(grams)


def test_pieces_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 100, 1, 0, 50)] + [None])], ["t"])
    parts = list(W.pieces(batch, "t", 60))
    assert sum(p.num_rows for p in parts) == 6 and [p.num_rows for p in parts][:2] == [1, 1]


# ---------------------------------------------------------------- components
def test_components_of_chains_stars_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 150)] + [(7, 5), (5, 6), (6, 7), (3, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(10, 41)} == {10} and {got[i] for i in range(100, 150)} == {100} and {got[i] for i in (5, 6, 7)} == {5}


# ---------------------------------------------------------------- near-duplicates
def shingles(text):
    w = re.findall(SPACED, lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}, [(i, len(s)) for i, s in sets]


def near_texts(seed, n=220):
    """Unrelated texts, exact copies, chains of small edits, and a group around one text with J from 0.5 to 1."""
    r = random.Random(seed)
    vocab = vocabulary(r)
    out = []
    base = r.choices(vocab, k=120)
    chain = r.choices(vocab, k=60)
    for _ in range(n):
        x = r.random()
        if x < 0.35:
            words = list(base)
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = r.choice(vocab)
        elif x < 0.6:
            chain = list(chain)
            chain[r.randrange(len(chain))] = r.choice(vocab)
            words = chain
        elif x < 0.7:
            words = r.choices(vocab, k=r.randint(1, 7))
        elif x < 0.75 and out:
            out.append(r.choice(out))
            continue
        else:
            words = r.choices(vocab, k=r.randint(1, 200))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = near_texts(seed) + [None, "", "  \n ", "One two", "one TWO"]
    got = near_duplicates(docs(spark, texts)).collect()
    want, sizes = brute_components(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_cases(spark):
    same = "a b c d e f g h"
    rows = [(1, same), (1, same), (2, same), (3, "other words are in here now"), (3, same.replace("h", "h i j k l m")), (None, same), (4, None)]
    table = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert got[(1, 1, True)] == 2 and got[(2, 1, False)] == 1 and got[(None, None, True)] == 1 and got[(4, 4, True)] == 1 and sum(got.values()) == 7
    assert near_duplicates(table.limit(0)).count() == 0


# ---------------------------------------------------------------- substring dedup
def brute_repeats(rows, k=13):
    words = [(i, re.findall(SPACED, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, 1 << 62), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return sorted(out)


def repeat_texts(seed, n=120):
    r = random.Random(seed)
    vocab = vocabulary(r, 60)
    passages = [r.choices(vocab, k=k) for k in (11, 12, 13, 14, 20, 26, 60)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choices(vocab, k=r.randint(0, 30)) + (r.choice(passages) if r.random() < 0.6 else [])
        if out and r.random() < 0.1:
            words = out[-1].split()
        out.append(r.choice([" ", "\n", "  "]).join(words))
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 400), (2, 2 << 20)])
def test_repeats_equal_brute_force(spark, seed, chunk):
    texts = repeat_texts(seed) + [None, "", "word", "x " * 40]
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    out = remove_repeats(docs(spark, texts, ids), chunk_bytes=chunk)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept_text", "n_words", "n_removed"]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == brute_repeats(list(zip(ids, texts, strict=True)))
    assert sum(r[2] for r in got) > 100


def test_repeats_edge_cases(spark):
    same = " ".join(f"w{i}" for i in range(15))
    table = spark.createDataFrame([(2, same, 1), (2, same, 2), (1, "z " + same, 3), (None, same, 4)], "doc_id long, text string, n_removed int")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(table).collect())
    assert got == [("1", 0), ("2", 15), ("2", 15), ("None", 15)]
    assert remove_repeats(table.filter("doc_id = 2")).filter("n_removed > 0").count() == 0  # equal ids keep both
    assert remove_repeats(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="whole block"):
        remove_repeats(table, window=12, block=7)


# ---------------------------------------------------------------- decontamination
def brute_hits(rows, items, k=10):
    windows = {}
    for i, t in items:
        w = re.findall(ALNUM, lower(t))
        for a in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for i, t in rows:
        w = re.findall(ALNUM, lower(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if x := windows.get(tuple(w[a : a + n])):
                    found |= x
                    hit[a : a + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_hits_equal_brute_force_on_both_paths(spark, limit):
    r = random.Random(5)
    vocab = vocabulary(r, 80)
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 9, 10, 11, 30])))) for i in range(40)] + [(100, None), (101, "..."), (7, "Repeated id")]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(r.randint(0, 4)):
            source = r.choice(items)[1] or ""
            cut = source.split()[r.randint(0, 2) :]
            words += r.choices(vocab, k=r.randint(0, 20)) + [x.upper() + r.choice(["", ".", ","]) for x in cut]
        texts.append(" ".join(words))
    texts += [None, "", "!!"]
    table = docs(spark, texts).withColumnRenamed("lang", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in mark_benchmark(table, bench, broadcast_bytes=limit, chunk_bytes=2000).collect())
    assert got == brute_hits(list(enumerate(texts)), items)
    assert mark_benchmark(table.limit(0), bench, broadcast_bytes=limit).count() == 0
    empty = mark_benchmark(table, bench.limit(0), broadcast_bytes=limit)
    assert empty.filter("n_hit > 0").count() == 0 and empty.count() == len(texts)
