"""The corpus operators against brute force and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import textwrap
from collections import Counter
from itertools import product

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from starmill.llm import chat, classifier, common, licences, line_dedup, minhash, mixing, neighbours, packing, quality_rules, substrings, suffixes
from starmill.llm.suffixes import suffix_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, size string, h string, bin_id string"
WORDS = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("ti", "es", "or", "ed") for c in ("s", "nd", "ly", "ing", "ou", "ha")]


def make(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, long, empty and null ones; extra columns clash with inner names."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    texts = ["\n".join(sentence(r.randint(8, 30)) + "." for _ in range(r.randint(1, 6))) for _ in range(n)]
    passage = sentence(60)
    for k in range(0, n, 6):
        texts[k] = texts[k] + "\n" + passage
    for k in range(3, n, 9):
        words = texts[k - 3].split(" ")
        words[len(words) // 2] = "changed"
        texts[k] = " ".join(words)
    for k in range(5, n, 10):
        texts[k] = texts[1]
    texts += ["", None, "one", "one", "two words", " \n ", sentence(4000), "é" * 60 + " " + "é" * 60, "é" * 60 + " " + "é" * 61, "Licensed under the Apache License, Version 2.0.\n" + sentence(30), "THE&&& " * 200]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    return rows + [(2, rows[2][1], "en", "b", 1, "x", "y", "z", "w"), (None, "a null id has this text of nine words here", None, "b", None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int("&&&" not in (r[1] or "") and len(r[1] or "") > 5), 0) for r in rows if r[0] is not None] + [(None, 1, None), (3, None, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def test_rules(spark, docs, empty, labels, rows):
    got = sorted(map(tuple, quality_rules.score_quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)

    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        k, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if k[tuple(w[i : i + 8])] > 1:
                hit |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)

    assert got == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    assert quality_rules.score_quality(empty, labels).isEmpty()


def test_ratio(spark, docs, labels, rows):
    """Mean log ratio and verdict of every document, recomputed from Spark's hashes of tokens found in Python."""
    token = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")
    grams = []
    for d, t, *_ in rows:
        one = token.findall((t or "").lower())
        grams.append((d, one, list(zip(one[:-1], one[1:], strict=True))))
    named = sorted({x for _, one, _ in grams for x in one})
    table = spark.createDataFrame([(x,) for x in named], "x string").select("x", F.xxhash64("x").alias("h")).collect()
    single = {r.x: r.h for r in table}
    twos = sorted({p for _, _, two in grams for p in two})
    pair = {(r.x, r.y): r.h for r in spark.createDataFrame([(*p, single[p[0]], single[p[1]]) for p in twos], "x string, y string, a long, b long").select("x", "y", F.xxhash64("a", "b").alias("h")).collect()}
    m = quality_rules.BUCKETS
    own = [(d, [single[x] % m for x in one] + [pair[p] % m for p in two]) for d, one, two in grams]
    good = {r.doc_id for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").collect()}
    raw, target = Counter(g for _, gs in own for g in gs), Counter(g for d, gs in own if d in good for g in gs)
    a, b = sum(target.values()), sum(raw.values())
    want = sorted((str(d), round(float(np.mean([np.log((target[g] + 1) / (a + m)) - np.log((raw[g] + 1) / (b + m)) for g in gs] or [0.0])), 3)) for d, gs in own)
    out = quality_rules.score_quality(docs, labels).collect()
    got = sorted((str(r.doc_id), round(r.log_ratio, 3)) for r in out)
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 2e-3 for x, y in zip(got, want, strict=True))
    assert all(r.kept == (not r.base_failed and r.log_ratio >= quality_rules.THRESHOLD) for r in out) and {r.kept for r in out} == {True, False}
    assert {r.log_ratio for r in quality_rules.score_quality(docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("few", [0, 3, 12])
def test_suffix_arrays(monkeypatch, few):
    monkeypatch.setattr(suffixes, "FEW", few)
    r = np.random.default_rng(0)
    for _ in range(60):
        some = [r.integers(0, r.integers(1, 5), r.integers(0, 30)) for _ in range(r.integers(1, 20))]
        begin = np.r_[0, np.cumsum([len(s) for s in some])]
        sa = suffix_arrays(np.concatenate(some).astype(np.int64), begin)
        for k, s in enumerate(some):
            assert list(sa[begin[k] : begin[k + 1]] - begin[k]) == sorted(range(len(s)), key=lambda i, s=s: tuple(s[i:]))


@pytest.mark.parametrize(("length", "frequent"), [(50, 20_000), (50, 2), (31, 20_000)])
def test_substrings(docs, empty, rows, length, frequent):
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(docs, length, frequent).collect()}
    first = {}
    named = sorted((r[0], (r[1] or "").encode()) for r in rows if r[0] is not None)
    for d, b in named:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, b in named:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert got[d, len(b)] == (sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)), d
    assert got[None, 42][0] == 0 and substrings.dedup_substrings(empty).isEmpty()


@pytest.mark.parametrize("frequent", [20_000, 30])
def test_substrings_of_one_id(spark, monkeypatch, frequent):
    """Texts of one doc_id are each compared with smaller ids, not with each other; a passage that most texts have; texts of one letter; hashes that collide."""
    r = random.Random(3)
    word = lambda: r.choice(WORDS)
    passage = " ".join(word() for _ in range(30))
    rows = [(i // 2, " ".join(word() for _ in range(r.randint(5, 40))) + " " + passage * (i % 3) + " " + " ".join(word() for _ in range(20))) for i in range(80)]
    rows += [(k, "a" * (40 + k)) for k in range(40, 60)] + [(70, rows[4][1]), (70, rows[5][1]), (71, passage), (3, passage)]
    if frequent == 30:
        monkeypatch.setattr(substrings, "BROADCAST", 3)
    out = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 50, frequent).collect()
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), "".join(c for c, g in zip(t, gone, strict=True) if not g).encode()))
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in out) == sorted(want)


def test_equal_hashes_of_slices():
    data = np.frombuffer(b"abcabdabcxyzab", np.uint8)
    begin, size = np.array([0, 3, 6, 9, 12]), np.array([3, 3, 3, 3, 2])
    lead, back = substrings.leaders(np.zeros(5, np.uint64), data, begin, size)
    assert len(lead) == 4 and back[0] == back[2] and len({*back}) == 4


def test_chats(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a\\n\\\\", "<|im_escaped|>x", "", None, "plain\ntext <| |>", "<\\\\|", "|>" * 3]
    rows = [(c, t, ["user", "assistant", None, "a\nb", "<|im_end|>"][(c + t) % 5], odd[(c * 3 + t) % len(odd)], "f") for c in range(9) for t in range(4)]
    rows += [(3, 1, "user", "again", "f"), (3, 1, "user", "again", "f"), (None, None, "user", "no id", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).collect()
    assert all(r.round_trip for r in out) and any(r.escaped for r in out) and not all(r.escaped for r in out)
    rows.append((None, 5, "assistant", "no id either", "f"))
    df = spark.createDataFrame(rows, df.schema)
    out = chat.format_chats(df).collect()
    assert sorted([(t.role, t.text) for t in r.turns] for r in out if r.conv_id is None) == [[("assistant", "no id either")], [("user", "no id")]]
    out, rows = [r for r in out if r.conv_id is not None], [r for r in rows if r[0] is not None]
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    assert chat.format_chats(df.limit(0)).isEmpty()


def near_brute(rows, least=0.8):
    def shingles(t):
        w = WORD.findall(t or "")
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    known = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {d: d for d in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(known)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((known[a] & known[b]).values())
            if both and both >= least * sum((known[a] | known[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in known}


def test_near_classes(docs, empty, rows):
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert got.pop(None) is None and got == near_brute(rows)
    assert minhash.near_classes(empty).isEmpty()


def test_near_classes_of_a_hub(spark):
    """Copies of one text that are further from each other than from it."""
    base = [f"w{k}" for k in range(300)]
    r, rows = random.Random(4), []
    for i in range(40):
        words = list(base)
        for k in r.sample(range(300), 5):
            words[k] = f"x{i}_{k}"
        rows.append((i if i < 20 else i + 1, " ".join(words)))
    rows.append((20, " ".join(base)))
    got = {x.doc_id: x.class_id for x in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_brute(rows)


@pytest.mark.parametrize("closest", [0, 3])
def test_near_classes_of_families(spark, monkeypatch, closest):
    """Families of edited copies about as similar as a link has to be: rejected partners hide no others, whatever the rounds look at."""
    monkeypatch.setattr(minhash, "CLOSEST", closest)
    r, rows = random.Random(7), []
    for f in range(3):
        for i in range(60):
            words = [f"f{f}w{k}" for k in range(300)]
            for k in r.sample(range(300), r.choice((4, 4, 5))):
                words[k] = f"x{f}_{i}_{k}"
            rows.append((len(rows), " ".join(words)))
    got = {x.doc_id: x.class_id for x in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == near_brute(rows)


def test_first_common_band_is_by_hash(spark):
    """Bytes that agree by chance in an earlier band don't hide the band in which two texts meet."""
    one, bands = bytes(range(128)), list(range(100, 132))
    other = bytes(b if k < 100 else b ^ 1 for k, b in enumerate(one))
    rows = [(105, 5, 1, 1, one, bands), (105, 5, 2, 2, other, [-k for k in range(1, 6)] + bands[5:])]
    df = spark.createDataFrame(rows, "band long, place int, tag long, root long, signature binary, bands array<long>")
    assert [tuple(r) for r in minhash.across(df, 3).collect()] == [(1, 2)]


def test_pairs_of_a_large_bucket(spark, monkeypatch):
    """A text of a bucket of many blocks gives no pairs in each of them: less than CLOSEST per class and round."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r, n = random.Random(5), 300
    rows = [(105, 5, k, k, bytes(7 if r.random() < 0.9 else r.randrange(256) for _ in range(128)), list(range(32))) for k in range(n)]
    rows = [(*x[:5], [-(32 * k + j) - 1 for j in range(5)] + x[5][5:]) for k, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "band long, place int, tag long, root long, signature binary, bands array<long>")
    pairs = [tuple(x) for step in (1, 2) for x in minhash.across(df, 3, step).collect()]
    assert 0 < len(pairs) < 2 * 3 * n and len({t for p in pairs for t in p}) == n
    assert minhash.forests({(-9, 0, 1), (-8, 0, 2), (-7, 1, 2)}, [4, 5, 6], 1) == [(0, 1), (0, 2)] and len(minhash.forests({(-9, 0, 1), (-8, 0, 2), (-7, 1, 2)}, [4, 5, 6], 2)) == 3


def test_signature_agreement():
    r = np.random.default_rng(2)
    a = r.integers(1, 1 << 62, 400).astype(np.uint64)
    b = np.r_[a[:340], r.integers(1, 1 << 62, 60).astype(np.uint64)]
    w = r.integers(1, 6, 400)
    s = minhash.signatures(np.r_[a, b], np.repeat([0, 1], 400), np.r_[w, w], 2, 2048)
    want = w[:340].sum() / (2 * w.sum() - w[:340].sum())
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_lines(docs, empty, rows):
    got = {(r.doc_id, r.before): r.text for r in line_dedup.dedup_lines(docs.withColumn("before", F.col("text"))).collect()}
    named = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0])
    first = {}
    for d, t in named:
        for x in (t or "").split("\n"):
            if x.strip(" "):
                first.setdefault(x.strip(" "), d)
    text = dict(named)
    for d, t in named:
        lines = (t or "").split("\n")
        clean = [x.strip(" ") for x in lines]
        gone = set()
        copy = next((e for e, u in named if e < d and u == t and t), None)
        if copy is not None and sum(map(len, clean)) >= line_dedup.LEAST_CHARS:
            gone = set(range(len(lines)))
        for e in {first[x] for x in clean if x} - {d}:
            if e < d:
                a = [x.strip(" ") for x in text[e].split("\n")]
                gone |= set(line_dedup.common_lines(a, clean, [len(x) for x in clean], line_dedup.LEAST_CHARS))
        want = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert got[d, t] == want, d
    assert line_dedup.dedup_lines(empty).isEmpty()


def test_lines_of_all_earlier_documents(spark):
    """A block goes whose lines stand earlier elsewhere, one by one; of a passage that stands twice in the later document goes what can be aligned."""
    menu = [f"menu item number {k} of this" for k in range(5)]
    tail = ["p" * 40, "q" * 15, "r" * 5]
    twice = [f"a line of the passage, {k}" for k in range(4)]
    own = lambda k: [f"own line {k} {i}" for i in range(3)]
    texts = [[x, *own(k)] for k, x in enumerate([*menu, *tail])]
    texts += [[*own(20), *menu, *own(21)], [*own(22), *menu, *own(23)], [*own(24), *tail, *own(25)], [*own(26), *tail, *own(27)]]
    texts += [[*own(30), *twice, *own(31)], [*own(32), *twice, *own(33), *twice, *own(34)], [*own(35), *twice, *own(36)]]
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    for k in (9, 11, 14):
        assert got[k] == [x for x in texts[k] if x.startswith("own")], k
    assert got[13] == [*own(32), *own(33), *twice, *own(34)] or got[13] == [*own(32), *twice, *own(33), *own(34)]
    assert all(got[k] == texts[k] for k in (*range(9), 10, 12))


def test_lines_of_crossing_blocks(spark):
    """Blocks that cross those of the first document that holds them go with a later one; compared with alignments of all pairs."""
    r = random.Random(7)
    block = {n: [f"block {n} line {k} of the shared text" for k in range(3)] for n in "XYZW"}
    own = lambda k: [f"own line {k} of document {k}" for _ in range(1)]
    texts = [[*block["X"], *own(0), *block["Y"]], [*own(1), *block["Y"], *own(91)], [*block["Y"], *own(2), *block["X"]]]
    for k in range(3, 30):
        some = r.sample("XYZW", r.randint(2, 4))
        texts.append([x for n in some for x in [*block[n][: r.choice([2, 3, 3])], *own(100 * k + ord(n))]])
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text.split("\n") for x in line_dedup.dedup_lines(df).collect()}
    assert got[2] == own(2)
    for k, t in enumerate(texts):
        gone = set()
        for e in texts[:k]:
            gone |= set(line_dedup.common_lines(e, t, [len(x) for x in t], line_dedup.LEAST_CHARS))
        assert got[k] == ([x for i, x in enumerate(t) if i not in gone] or [""]), k


def test_longest_run():
    """Parts without a line of its own on both sides: the blocks found are those of a search over all runs."""
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(0, 14))] for _ in "ab")
        size = {1: 5, 2: 10, 3: 20, 4: 0}
        chars = [size[x] for x in b]
        fits = [sum(chars[y : y + k]) for x in range(len(a)) for y in range(len(b)) for k in range(1, 15) if len(a[x : x + k]) == k and a[x : x + k] == b[y : y + k]]
        found = line_dedup.longest(line_dedup.Runs(a, [size[x] for x in a]), line_dedup.Runs(b, chars), 0, len(a), 0, len(b), 15)
        assert (found is None) == (max(fits, default=0) < 15)
        if found:
            x, y, k = found
            assert a[x : x + k] == b[y : y + k] and sum(chars[y : y + k]) == max(fits)


def test_patience():
    assert line_dedup.aligned([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.aligned([1, 2, 3], [3, 2, 1]) in ([(1, 1)], [(0, 2)], [(2, 0)])
    assert line_dedup.aligned([], [1]) == [] and line_dedup.aligned([7, 7], [7, 7, 7]) == [(0, 0), (1, 1)]


def test_mix(docs, empty, rows):
    out = mixing.mix(docs, block=4).collect()
    assert len(out) == len(rows) and mixing.mix(empty).isEmpty()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(x for x in sizes if x is not None) + [None]
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
    taken, of = Counter(), {}
    for r in out:
        of[r.source_size] = r.target
        taken[r.source_size] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s in names:
        assert abs(of[sizes[s]] - target[s]) < 1e-6 * target[s] and abs(taken[sizes[s]] - target[s]) <= 5
    again = mixing.mix(docs.repartition(5), block=4).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_sainte_lague(spark):
    r = random.Random(5)
    for seats in (0, 1, 3, 17, 200):
        votes = {k: r.choice([0.0, 1.0, 5.5, 40.0, 1000.0]) for k in range(9)}
        df = spark.createDataFrame([(0, k, float(v), seats) for k, v in votes.items()], "g int, k int, v double, seats long")
        got = {x.k: x.quota for x in mixing.sainte_lague(df, ["g"], "k", "seats", "v").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            want[max(votes, key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == want


def test_pack(docs, empty, rows):
    out = packing.pack(docs, 100).toPandas()
    some = out[out.piece_words > 0]
    for _, g in some.groupby("bin_id"):
        assert g.piece_words.sum() <= 100 and not g.source.dropna().duplicated().any() and not g.cluster.duplicated().any()
        at = g.sort_values("bin_offset")
        assert (at.bin_offset.to_numpy() == np.r_[0, np.cumsum(at.piece_words.to_numpy())[:-1]]).all()
    assert sorted(len(WORD.findall(r[1] or "")) for r in rows) == sorted(out.drop_duplicates(["doc_id", "cluster", "piece", "bin_id"]).groupby(["doc_id", "cluster"], dropna=False).piece_words.sum().tolist() + [len(WORD.findall(rows[2][1]))])[: len(rows)] or out.piece_words.sum() == sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert packing.pack(empty).isEmpty()


def test_pack_repeated_rows(spark):
    """Rows that are one like the other, without an id, spread over the shards; none is lost."""
    df = spark.createDataFrame([(None, "one two three", "a")] * 500 + [(k, f"w{k} " * 3, "b") for k in range(20)], "doc_id long, text string, source string")
    out = packing.pack(df, 12, 64).toPandas()
    same = out[out.source == "a"]
    assert len(out) == 520 and len(same) == 500 and (same.bin_id // (1 << 32)).nunique() > 4 and out.piece_words.sum() == 1560
    assert not out.duplicated(["bin_id", "source"]).any()


def test_best_fit_is_tightest():
    r, bins, plain = random.Random(6), packing.Bins(64), []
    for _ in range(400):
        need, s, c = r.randint(1, 40), 1 << r.randint(0, 4), 1 << r.randint(0, 30)
        fits = [(room, k) for k, (room, a, b) in enumerate(plain) if room >= need and not a & s and not b & c]
        b, at = bins.add(need, s, c)
        if fits:
            assert plain[b][0] == min(fits)[0] and at == 64 - plain[b][0]
        else:
            assert b == len(plain)
            plain.append((64, 0, 0))
        room, x, y = plain[b]
        plain[b] = (room - need, x | s, y | c)


def test_classifier(spark, docs, empty, labels, rows):
    out = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    assert set(out) == {r[0] for r in rows} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert classifier.classify(empty, labels).isEmpty()
    assert {r.score for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_discriminant_by_numpy(spark):
    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 1, (200, 9)), r.normal(1, 2, (100, 9))]
    y = np.repeat([1, 0], [200, 100])
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], [*classifier.FEATURES, "label"])
    model = classifier.fit(df)
    got = np.array([v[0] for v in df.select(model.log_odds([F.col(c) for c in classifier.FEATURES])).collect()])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    diag = np.diag(np.diag(cov[0]) / 3 + np.diag(cov[1]) * 2 / 3)
    score = []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * diag + 1e-3 * np.eye(9)
        d = x - x[y == k].mean(0)
        score.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log([1 / 3, 2 / 3][k]))
    assert np.allclose(got, score[1] - score[0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = classifier.op8_quadratic_discriminant(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert out.where("predicted <> quality").count() <= 0.03 * out.count()


def test_neighbours(spark):
    r = np.random.default_rng(8)
    x = np.repeat(r.normal(size=(60, 16)), 10, 0) + 0.6 * r.normal(size=(600, 16))
    rows = [(i, [float(f) for f in v], 1) for i, v in enumerate(x)] + [(50, [9.0] * 16, 1), (700, None, 1), (750, [0.0] * 16, 1), (800, [float("nan")] * 16, 1), (850, [1.0, None] + [1.0] * 14, 1), (900, [], 1), (950, [1.0], 1), (None, [1.0] * 16, 1)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = {}
    for q in out.orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    v = np.array([np.float32(a) for a in x], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    asked = [q for q in range(0, 600, 50) if q != 50]
    hit = sum(len(set(got[q]) & set([k for k in np.argsort(-(v @ v[q]), kind="stable") if k != q][:5])) for q in asked)
    assert set(got) == set(range(0, 600, 50)) and hit >= 0.9 * 5 * len(asked)


def test_neighbours_of_copies(spark):
    """Of a large group of copies the smallest ids are the nearest, for its members and for the vectors nearest to it."""
    r = np.random.default_rng(9)
    x = r.normal(size=(1200, 16))
    x[r.permutation(1200)[:900]] = x[7]
    x[50] = x[7] + 0.01 * r.normal(size=16)
    x[100], x[150] = x[7], x[7]
    out = neighbours.nearest(spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3))
    got = {}
    for q in out.orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    copies = [i for i in range(1200) if (x[i] == x[7]).all()]
    for q in (50, *[c for c in copies if c % 50 == 0]):
        assert got[q] == [c for c in copies if c != q][:5], q
    assert set(got) == set(range(0, 1200, 50)) and all(len(v) == 5 for v in got.values())


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).orderBy("rank").collect()] == [(1, 3, 1.0), (2, 7, 1.0), (3, 9, 0.0)]
    assert neighbours.nearest(df.limit(0)).isEmpty() and neighbours.nearest(df.where("vec_id = 0")).isEmpty()


@pytest.fixture(scope="module")
def licence_model(docs):
    return licences.train(docs)


def test_licences(spark, docs, rows, licence_model):
    out = licences.scan(docs, licence_model).collect()
    assert [(r.doc_id, r.paragraph, r.n_lines, r.family, r.confirmed) for r in out if r.confirmed] == [(69, 0, 1, "apache", True)]
    notices = [(k, t) for k, ts in enumerate(licences.NOTICES.values()) for t in ts]
    df = spark.createDataFrame([(k, t) for k, t in notices] + [(99, None), (98, ""), (None, notices[0][1]), (0, notices[0][1])], "doc_id long, text string")
    found = Counter((r.doc_id, r.family) for r in licences.scan(df, licence_model).collect())
    right = sum((k, list(licences.NOTICES)[k]) in found for k, _ in notices)
    assert right >= 0.9 * len(notices) and licences.scan(df.limit(0), licence_model).isEmpty()
    assert found[None, "apache"] == 1 and found[0, "apache"] == len(licences.NOTICES["apache"]) + 1


def test_wrapped_licences(spark, rows, licence_model):
    """Notices wrapped at 60 characters, behind comment marks, between other lines; unseen licences are not taken for a family; two notices in neighbouring lines are two."""
    texts, want = [], []
    for f, notices in licences.NOTICES.items():
        for t in notices:
            for mark in ("", "# ", " * "):
                lines = textwrap.wrap(t, 60)
                texts.append("\n".join(["some words of a text that has no such thing", "", *[mark + x for x in lines], "", rows[1][1]]))
                want.append((f, len(lines)))
    two = len(texts)
    texts.append("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")
    unseen = ["Licensed under the Academic Free License version 3.0", "This program is distributed under the Q Public License", "Permission to use this chart has been asked for", "The works are published under a licence of the museum"]
    texts += unseen
    got = {}
    for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).collect():
        if r.confirmed:
            got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.n_lines))
    hit = sum((2, f) in {x[:2] for x in got.get(k, [])} or any(x[1] == f for x in got.get(k, [])) for k, (f, _) in enumerate(want))
    assert hit >= 0.9 * len(want), [texts[k][:200] for k, (f, _) in enumerate(want) if not any(x[1] == f for x in got.get(k, []))]
    assert sorted(x[1] for x in got[two]) == ["apache", "mit"] and not any(two + 1 + k in got for k in range(len(unseen)))


def test_segments(spark):
    """The pieces' sum is that of a search over all ways."""
    r = random.Random(6)
    rows = [(k, [(i, [round(r.uniform(-1, 4), 3) for _ in range(3)]) for i in range(r.randint(1, 5))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, scores array<struct<at:int,of:array<double>>>").select("k", licences.segments(F.col("scores"), 3, 2.5).alias("pieces"))
    got = {x.k: x.pieces for x in df.collect()}
    for k, scores in rows:
        cost = lambda way, scores=scores: sum(x[1][f] for x, f in zip(scores, way, strict=True)) - 2.5 * sum(a != b for a, b in zip(way[:-1], way[1:], strict=True))
        way = [p.family for p in got[k] for _ in range(p.n)]
        assert [p.at for p in got[k]] == list(np.cumsum([0, *[p.n for p in got[k]]])[:-1]) and len(way) == len(scores)
        assert np.isclose(cost(way), max(cost(w) for w in product(range(3), repeat=len(scores))))


def test_sums_over_telling_ngrams_alone(spark, licence_model, monkeypatch):
    """Lines keep the n-grams that weigh something in some family, once each, and no others."""
    hits, kept = [], licences.kept
    monkeypatch.setattr(licences, "kept", lambda df, name: hits.append(kept(df, name)) or hits[-1])
    lines = ["Licensed under the MIT License, thereof thereof words of no licence at all", "Released under the MIT License."]
    assert {r.family for r in licences.scan(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), licence_model).collect()} >= {"mit"}
    some = set(np.flatnonzero(np.round(licence_model[0], 3).any(0)).tolist())
    all_grams = {r.line: r.grams for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", licences.ngrams(F.col("line")).alias("grams")).collect()}
    got = {x: g for r in hits[0].collect() for x, g in zip(r.lines, r.grams, strict=True)}
    assert got and got == {x: [b for b in all_grams[x] if b in some] for x in got} and any(len(got[x]) < len(all_grams[x]) for x in got)


def test_neighbouring_and_near_licences(spark, licence_model):
    """Wrapped notices one above the other are both found; licences near a family are not taken for it."""
    wrapped = lambda t: "\n".join(textwrap.wrap(t, 60))
    longest = {f: max(ts, key=len) for f, ts in licences.NOTICES.items()}
    pairs = [("mit", "apache"), ("bsd", "apache"), ("mit", "bsd"), ("gpl", "mpl")]
    near = [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.",
    ]
    texts = [wrapped(longest[a]) + "\n" + wrapped(longest[b]) for a, b in pairs] + near + [wrapped(x) for x in near] + [longest["gpl"], longest["lgpl"], longest["cc_by"], longest["cc_by_sa"], longest["cc_by_nc"]]
    got = {}
    for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).collect():
        if r.confirmed:
            got.setdefault(r.doc_id, set()).add(r.family)
    for k, pair in enumerate(pairs):
        assert got.get(k) == set(pair), pair
    assert [texts[k] for k in range(4, 12) if k in got] == []
    assert [got.get(k) for k in range(12, 17)] == [{"gpl"}, {"lgpl"}, {"cc_by"}, {"cc_by_sa"}, {"cc_by_nc"}]


def test_licence_scores_by_numpy(spark, docs, rows, licence_model):
    """Logits, bound, family and similarity of single lines, recomputed from Spark's hashes of words."""
    weights, biases = (np.round(x, 3) for x in licence_model)
    lines = [t for ts in licences.NOTICES.values() for t in ts] + [t for _, t in licences.CALIBRATION] + [x for r in rows[:20] for x in (r[1] or "").split("\n")]
    words = [re.findall(r"[^\W_]+", x.lower()) for x in lines]
    single = {r.x: r.h for r in spark.createDataFrame([(w,) for w in {w for ws in words for w in ws}], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    pairs = {(a, b) for ws in words for a, b in zip(ws[:-1], ws[1:], strict=True)}
    pair = {(r.x, r.y): r.h for r in spark.createDataFrame([(*p, single[p[0]], single[p[1]]) for p in pairs], "x string, y string, a long, b long").select("x", "y", F.xxhash64("a", "b").alias("h")).collect()}
    want = {}
    for k, ws in enumerate(words):
        grams = {single[w] % licences.BUCKETS for w in ws} | {pair[p] % licences.BUCKETS for p in zip(ws[:-1], ws[1:], strict=True)}
        z = biases + weights[:, sorted(grams)].sum(1)
        at = int(z.argmax())
        if licences.FAMILIES[at] == licences.NONE:
            continue
        runs = lambda v: {tuple(v[i : i + 3]) for i in range(len(v) - 2)} or {tuple(v)}
        notices = [re.findall(r"[^\W_]+", t.lower()) for t in licences.NOTICES.get(licences.FAMILIES[at], [])]
        share = max((len(runs(t) & runs(ws)) / len(runs(t)) for t in notices), default=0.0)
        near = max((len(runs(t) & runs(ws)) / len(runs(t)) for some, ts in licences.SIBLINGS.items() if licences.FAMILIES[at] in some for t in (re.findall(r"[^\W_]+", x.lower()) for x in ts)), default=0.0)
        share = share if notices and share >= near else 0.0
        probability = float(np.exp(z[at] - z.max()) / np.exp(z - z.max()).sum())
        want[k] = (licences.FAMILIES[at] if share >= licences.CONFIRMED and probability >= licences.LEAST else "unknown", round(probability, 2), round(share, 6))
    out = licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), licence_model).collect()
    got = {r.doc_id: (r.family, round(r.probability, 2), round(r.similarity, 6)) for r in out}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 0.011 and got[k][2] == want[k][2] for k in want)


def test_null_ids_in_stages(spark, docs, labels):
    """Rows with a null id pass the mix once and the classifier by their own text; the other stages keep them as they are."""
    text = "a null id has this text of nine words here"
    some = docs.unionByName(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("text"), *docs.columns[2:]))
    nulls = lambda df: sorted(r.text for r in df.where("doc_id is null").collect())
    assert nulls(mixing.mixed_rows(some)) == nulls(some) == [text, "one"]
    predicted = [r.predicted for r in classifier.classify(some, labels).where("doc_id is null").collect()]
    assert len(nulls(classifier.accepted(some, labels))) == sum(predicted) and nulls(classifier.accepted(some, labels)) == [text]
    assert nulls(line_dedup.without_repeats(some)) == nulls(minhash.first_of_class(some)) == nulls(some)
    assert packing.pack(some).where("doc_id is null").count() == 2


def test_pipeline(spark, tmp_path, docs, labels, rows):
    """run() gives what its stages give one after the other, each of which has been compared with brute force above; nothing but the last stage's tables stays."""
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    before = set(common._written)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = [x for x in common._written if x not in before]
    assert len(left) <= 2 and any("stage-4" in x for x in left)
    some = out[out.piece_words > 0]
    assert len(some) and some.groupby("bin_id").piece_words.sum().max() <= packing.CAPACITY
    read, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, read, str(tmp_path))
        assert kept.columns == read.columns
        read = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(read.count())
    last = corpus_pipeline.STAGES[-1][1](spark, read, str(tmp_path)).toPandas()
    order = ["doc_id", "source", "cluster", "piece", "piece_words", "start"]
    text = lambda df: sorted(map(str, df[order].itertuples(index=False)))
    assert text(out) == text(last) and sizes[0] < len(rows)


def test_pipeline_of_empty_tables(spark, tmp_path, empty, labels):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_tables_kept(spark):
    with common.cleaned_up(spark):
        a = common.kept(spark.range(3).toDF("k"), "a")
        b = common.settled(lambda: common.kept(a, "b").where("k > 0"), "c")
        assert [x for x in common._written if "-b-" in x] == [] and b.count() == 2
        common.forget(a)
    assert not any(x in common._written for x in (a.kept_at, b.kept_at))
    many = spark.createDataFrame([(k % 3 if k % 5 else 9, k) for k in range(60)], "key long, k long")
    one = spark.createDataFrame([(0, "a"), (9, "b"), (7, "c")], "key long, v string")
    assert sorted(map(tuple, common.spread_join(many, one, ["key"], ["k"], 4).collect())) == sorted(map(tuple, many.join(one, "key").collect()))
