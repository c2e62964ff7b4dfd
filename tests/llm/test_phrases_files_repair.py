"""Collocations, token files and repaired conversations against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.llm import collocations, common, repair, token_files
from starmill.llm.quotient import Packing, counted, read_filter, write_filter

DOCS = "doc_id long, text string, lang string, source string, shard string, n long, words string"


# phrases


@pytest.mark.parametrize("n,bits", [(1, 1), (1, 9), (2, 3), (2, 17), (3, 16), (4, 8), (4, 18), (4, 31)])
def test_filters_are_lossless(n, bits):
    r = np.random.default_rng(n * bits)
    packing = Packing(n, bits)
    for size in (0, 1, 7, 3000):
        ids = [np.concatenate([x, x[: size // 2]]) for x in (r.integers(0, 1 << bits, size) for _ in range(n))]
        keys = packing.pack(ids)
        assert all((a == b).all() for a, b in zip(ids, packing.unpack(keys), strict=True))
        weights = r.integers(1, 600, len(ids[0]))
        (high, low), counts = counted(keys, weights)
        want = Counter()
        for gram, w in zip(zip(*ids, strict=True), weights, strict=True):
            want[gram] += w
        for part_bits in (0, 4, 10):
            got, parts = Counter(), packing.part((high, low), part_bits)
            assert (np.diff(parts) >= 0).all()
            for part in np.unique(parts):
                at = parts == part
                back, n_back = read_filter(write_filter((high[at], low[at]), counts[at], packing, part_bits), packing, int(part), part_bits)
                assert (back[0] == high[at]).all() and (back[1] == low[at]).all()
                got.update(dict(zip(zip(*packing.unpack(back), strict=True), n_back, strict=True)))
            assert got == want


def phrases_of(rows, least, shown):
    """The contract, by plain loops."""
    f, total = {}, Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                for k in range(len(w) - n + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[k : k + n])] += 1
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in some.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    covered[p[k : k + n]] = max(covered.get(p[k : k + n], 0), a)
        scored = []
        for p, a in some.items():
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * covered.get(p, 0) < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:shown], 1)]
    return sorted(out)


def texts(seed=3, n=150):
    r = random.Random(seed)
    words = ["Ab", "cd", "é", "Éé", "x y", "zz", "a\x0bb", "the", "of"]
    out = [(i, " ".join(r.choice(words) + r.choice(["", "", "", ",", ". ", "\n", "\t"]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "en", "de", None, "und"]), "s", "x", 1, "w") for i in range(n)]
    out += [(5, "of the of the of the", "en", None, None, None, None)] * 40 + [(None, None, None, None, None, None, None), (900, "", "fr", "", "", 0, ""), (901, ".,;", "fr", "", "", 0, "")]
    return out + [(902, "the long zz, " * 4000, "en", "", "", 0, ""), (903, "nobreak " * 3000, "en", "", "", 0, "")]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300, "part_words": 64, "round_bits": 2}])
def test_collocations(spark, monkeypatch, sizes):
    monkeypatch.setattr(collocations, "FAN", 4)
    rows = texts()
    with common.cleaned_up(spark):
        got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least=6, shown=25, **sizes).collect()
    want = phrases_of(rows, 6, 25)
    assert sorted(map(tuple, got)) == want and len(want) > 60


def test_collocations_of_nothing(spark):
    with common.cleaned_up(spark):
        for rows in ([], [(1, None, None, None, None, None, None), (2, " . ", "en", None, None, None, None)]):
            assert collocations.collocations(spark.createDataFrame(rows, DOCS)).collect() == []


# files


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


ODD = ["", None, "one", "a\x0bb", "It's  <|endoftext|>x 12ab ́e ́ ＡΣΑΣ İ", "\x1c\x85é é", "'s'S don't", "tab\tline\r\nfeed\x0c!", "中文字" * 50, "x" * 5000, '"', "\x00 \x01", "👩‍👩‍👧 ñ ñ", "a,b.c-d don't.x 's.s <|a|> J̌.J̌,é x'.s,'s", "Word,word-Word.(word)"]


def test_runs_encode_as_whole_texts(vocabulary):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole, coder = Tokenizer.from_str(vocabulary), token_files.Encoder(vocabulary)
    r = random.Random(2)
    some = [t or "" for t in ODD] + ["".join(r.choice("aB'sé,.-\\ \t\n\x0b\x0c\r.!?1  <|>́Σ") for _ in range(r.randint(0, 80))) for _ in range(400)]
    ids, ends = zip(*coder.ids(pa.array(some), 1), strict=True)
    flat, stops = np.concatenate(ids), np.concatenate(ends)
    want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in some]
    assert flat.tolist() == [x for w in want for x in w]
    assert stops.tolist() == (np.cumsum([len(w) for w in want]) - 1).tolist()


@pytest.mark.parametrize("length,rows_of_file,cut", [(1024, 16384, 16 << 20), (8, 7, 200)])
def test_token_files(spark, monkeypatch, vocabulary, length, rows_of_file, cut):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SLICE", cut)
    r = random.Random(1)
    some = [(i, " ".join(r.choice(["the", "of", "Zyx", "um,"]) for _ in range(r.randint(0, 400))), "en", "s", "x", 1, "w") for i in r.sample(range(1000), 40)]
    some += [(2000 + k, t, "en", "s", "x", 1, "w") for k, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None)] + [(3000, "same", None, None, None, None, None)] * 30
    whole = Tokenizer.from_str(vocabulary)
    with common.cleaned_up(spark):
        files = token_files.write_token_files(spark.createDataFrame(some, DOCS).repartition(3), common.new_folder(spark, "tokens"), vocabulary, length=length, file_rows=rows_of_file)
        listed = files.orderBy("part").collect()
        got = sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda x: x[1])
        # any sequence by its number
        stream = []
        for f in listed:
            one = token_files.Sequences(f.path)
            assert one.ids(0).base is not None and len(one) == -(-f.tokens // length)
            ids, mask = np.concatenate([one.ids(k) for k in range(len(one))]), np.concatenate([one.mask(k).to_numpy(zero_copy_only=False) for k in range(len(one))])
            assert mask[: f.tokens].all() and not mask[f.tokens :].any()
            stream += ids[: f.tokens].tolist()
    order = sorted(some, key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for d, t, *_ in order:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want and len(stream) == start and (rows_of_file > 100 or len(listed) > 5)


def test_token_files_of_nothing(spark, vocabulary):
    with common.cleaned_up(spark):
        files = token_files.write_token_files(spark.createDataFrame([], DOCS), common.new_folder(spark, "tokens"), vocabulary)
        assert files.count() == 0 and token_files.read_token_files(files).count() == 0


# conversations


def cheapest(symbols):
    """Cost and letters by a search over all edits, least cost first and then least letters."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, text, k, state = heapq.heappop(heap)
        if k == len(symbols) and state in (0, 3):
            return cost, text
        if (k, state) in done:
            continue
        done.add((k, state))
        heapq.heappush(heap, (cost + 3, text + "I", k, 3 if state == 2 else 2))
        if k < len(symbols):
            x = symbols[k]
            heapq.heappush(heap, (cost + 4, text + "D", k + 1, state))
            if x != "X":
                more = 3 * x.isupper()
                fits = {"s": state == 0, "u": state != 2, "a": state == 2}.get(x.lower(), False)
                if fits:
                    heapq.heappush(heap, (cost + more, text + "K", k + 1, {"s": 1, "u": 2, "a": 3}[x.lower()]))
                heapq.heappush(heap, (cost + 3 + more, text + "R", k + 1, 3 if state == 2 else 2))


def test_edits_by_runs():
    r = random.Random(5)
    for _ in range(3000):
        symbols = "".join(r.choice("suaoXSUAO") * r.choice([1, 1, 1, 2, 5, 9]) for _ in range(r.randint(0, 7)))
        cost, want = cheapest(symbols)
        got, ends = repair.unrolled(symbols, repair.AT_END)
        assert repair.before(repair.advanced(symbols), repair.AT_END)[0] == cost
        assert got[0] + repair.LAST_EDITS[ends[0]] == want


CHATS = "conv_id long, turn long, role string, text string, conv string, pos string, segment string, fault string"


def repaired_by_hand(rows):
    out = {}
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " "))
        own = [(x[1], *[" " if c is None else c for c in x[2:4]]) for x in own]
        faults, seen = [], set()
        for _, role, text in own:
            cut = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else "")
            seen.add((role, text))
        symbol = [("X" if f in ("blank", "duplicate") else (b if f != "truncated" else b.upper())) for f, b in zip(faults, [x[1][:1] if x[1][:1] in ("s", "u", "a") else "o" for x in own], strict=True)]
        cost, letters = cheapest("".join(symbol))
        turns, k, last = [], 0, ""
        for e in letters:
            new = "assistant" if last == "u" else "user"
            if e == "I":
                turns.append(new + ":")
            else:
                if e != "D":
                    turns.append((own[k][1] if e == "K" else new) + ":" + own[k][2])
                k += 1
            last = turns[-1][:1] if turns else ""
        known = [x[0] for x in own if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True))
        out[conv] = (*[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, gaps, cost, letters, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [14, 1])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    r = random.Random(4)
    text = lambda: r.choice(["", " \n", None, "Yes.", "No", "Why?\t ", "é!", "a longer text that ends nowhere " * 3, "x." * 400])
    rows = [(c, r.choice([None, k, k, k, k + 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]), text(), "x", "y", "z", "w") for c in [*range(25), None] for k in range(r.randint(1, 12))]
    rows += [(100, k, "user", f"Row {k}.", "", "", "", "") for k in range(300)] + [(101, 1, "user", "Same.", "", "", "", "")] * 200 + [(102, 1, "user", " " * 100000 + "x", None, None, None, None)]
    with common.cleaned_up(spark):
        found, turns = repair.repair(spark.createDataFrame(rows, CHATS).repartition(5))
        got = {x.conv_id: (x.blank, x.duplicate, x.truncated, x.illegal, x.gaps, x.cost, x.audit, x.sha) for x in found.join(repair.turns_hash(turns), "conv").collect()}
    assert got == repaired_by_hand(rows)


def test_repair_of_nothing(spark):
    with common.cleaned_up(spark):
        found, turns = repair.repair(spark.createDataFrame([], CHATS))
        assert found.count() == 0 and turns.count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = Counter(map(tuple, repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            want[(c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)] += 2 if hit == 3 else 1
    assert got == want and {1, 2} <= set(want.values())
