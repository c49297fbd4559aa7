"""Operators over documents against brute force, on small tables that hold nulls,
empty and long texts, ties, repeated rows and columns with clashing names."""

import base64
import hashlib
import os
import random
import re
import string
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from boscage.llm import bpe, exact, jaccard, lines, packing, quality, suffix, tokenfile, tokens, words
from boscage.llm.store import Scratch

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, rk long, `group` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    long = "\n".join(text(rng.randint(5, 60)) for _ in range(120))
    out = []
    for i in range(70):
        out.append("\n".join(text(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))))
    for i in range(12):
        out.append(text(20) + "\n" + passage + "\n" + text(15))
        words = long.split(" ")
        words[rng.randrange(len(words))] = "X" * (i + 1)
        out.append(" ".join(words))
        line = text(20)
        out += [text(9) + "\n" + line + "\n" + text(8), text(7) + "\n" + line[:-1] + "Q" + "\n" + text(9)]
    out += [long, long, long.replace(" ", "\t "), long.upper(), "", "", " \n\t ", None, None, "one two", "One TWO", "a b c d e", "spam " * 400, "x", "\n".join([text(12)] * 5), passage]
    out += ["a b  c\n\nd", "<|endoftext|> it's 12 34", "日本語 text\r\nnext", "é" * 3000]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or ""), "ids", i, "g") for i, t in enumerate(out)]
    return [*rows, rows[3], rows[-1], (None, out[0], "en", "s0", 0, None, None, None), (None, passage, None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is None, x or 0)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        ids.sort(key=key)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("budget", [1 << 30, 3000, 200])
def test_patricia_owners_spill(budget):
    rng = random.Random(1)
    trie, want = exact.PatriciaOwners(budget), {}
    for i in range(3000):
        t = bytes(rng.choice(b"ab\n") for _ in range(rng.randint(0, 12)))
        trie.add(t, None if i % 50 == 0 else i)
        old = want.get(t, (None, 0))
        own = None if i % 50 == 0 else i
        want[t] = (exact._smaller(old[0], own), old[1] + 1)
    assert {t: (o, c) for t, o, c in trie.owners()} == want


def brute_spans(rows, least=50):
    texts = {(r[0], r[1]): WORD.findall(r[1] or "") for r in rows}
    order = sorted(texts, key=lambda x: (key(x[0]), str(x[1])))
    windows = defaultdict(list)
    for d in order:
        for j in range(len(texts[d]) - least + 1):
            windows[tuple(texts[d][j : j + least])].append((d, j))
    covered, first, later = defaultdict(set), defaultdict(set), defaultdict(set)
    for found in windows.values():
        if len(found) > 1:
            for k, (d, j) in enumerate(found):
                covered[d].update(range(j, j + least))
                (later if k else first)[d].update(range(j, j + least))
    return covered, {d: len(later[d] - first[d]) for d in covered}


def test_suffix_spans(docs, rows, empty):
    # ids of several texts are left out: their order rests on a hash
    ids = [r[0] for r in rows]
    covered, dropped = brute_spans(rows)
    for hot in (200_000, 1):
        got, gone = defaultdict(set), defaultdict(int)
        for r in suffix.repeated_spans(docs, hot=hot).collect():
            assert r.span_end - r.span_start == r.n_words >= 50
            got[r.doc_id].update(range(r.span_start, r.span_end))
            gone[r.doc_id] += r.n_dropped
        want = defaultdict(set)
        for d, x in covered.items():
            want[d[0]] |= x
        assert {d: x for d, x in got.items()} == {d: x for d, x in want.items() if x}
        for d, n in dropped.items():
            if d[0] is not None and ids.count(d[0]) == 1:
                assert gone[d[0]] == n, d[0]
    assert suffix.repeated_spans(empty).count() == 0


def test_suffix_windows_of_repeating_words_are_made_once():
    """A window that holds its least run many times belongs to the first of them."""
    text = " ".join(["a", "b"] * 200 + [f"w{i}" for i in range(100)])
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([5])], names=["text", "rk"])
    at = [r["pos"] for b in suffix._anchors(16, 35)([pa.RecordBatch.from_arrays([batch["rk"], batch["text"]], names=["rk", "text"])]) for r in b.to_pylist()]
    sent = pa.RecordBatch.from_arrays([pa.array([1]), batch["text"], batch["rk"], pa.array([at], pa.list_(pa.int32()))], names=["doc_id", "text", "rk", "positions"])
    starts = [c["pos"] - j for b in suffix._contexts(16, 50)([sent]) for c in b.to_pylist() for j in range(c["near"], c["far"] + 1)]
    assert sorted(starts) == list(range(500 - 50 + 1))


def test_suffix_compares_long_runs_in_little_memory():
    n, k, least = 30_000, 16, 50
    right = np.random.default_rng(1).integers(0, 3, (n, least), np.uint32)
    right[:, : k + 20] = 7
    right = right[np.lexsort(right.T[::-1])]
    left = np.full((n, least - k), 9, np.uint32)
    whole = [suffix._ragged(x, np.full(n, x.shape[1])) for x in (right, left)]
    ints = [pa.array(np.full(n, v, np.int32)) for v in (0, least - k)]
    run = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), *whole, pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.full(n, 40, np.int32)), *ints], schema=suffix._CONTEXTS)
    tracemalloc.start()
    try:
        marks = [m for b in suffix._compare(k, least)([run.slice(i, 10_000) for i in range(0, n, 10_000)]) for m in b.to_pylist() if m["drop"]]
        marks = len(marks)
        tracemalloc.clear_traces()
        tracemalloc.reset_peak()
        for _ in suffix._compare(k, least)([run.slice(i, 10_000) for i in range(0, n, 10_000)]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert marks == n - 1  # all but the first context share at least one window with an earlier one
    assert peak < 500 * n


def test_suffix_removal(docs, rows, empty):
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns
    got = [r.asDict() for r in out.collect()]
    covered, dropped = brute_spans(rows)
    clean = [r for r in rows if not dropped.get((r[0], r[1]))]
    kept = [(g["doc_id"], g["text"], g["source"]) for g in got]
    for r in clean:
        assert kept.count((r[0], r[1], r[3])) == sum(x == r for x in rows)
    assert all(g["n_chars"] == len(g["text"]) for g in got if g["text"])
    assert suffix.remove_repeats(empty).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_distance():
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(6, 30))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            what = rng.random()
            if what < 0.33:
                b.insert(k, rng.choice("abc"))
            elif what < 0.66 and len(b) > 4 and k < len(b):
                del b[k]
            elif k < len(b):
                b[k] = rng.choice("abc")
        pairs.append(sorted(("".join(a), "".join(b)), key=len))
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    for t in (1, 2, 3):
        use = [(x, y) for x, y in pairs if len(y) - len(x) <= t]
        got = lines.within([codes(x) for x, _ in use], [codes(y) for _, y in use], t)
        assert got.tolist() == [distance(x, y) <= t for x, y in use]


def brute_lines(rows):
    once = {(r[0], r[1]) for r in rows}
    places = defaultdict(list)
    for r in rows:
        for k, line in enumerate((r[1] or "").split("\n")):
            line = line.strip(" \t\n\x0b\f\r")
            if len(line) >= 15:
                places[line].append((key(r[0]), r[0], k))
    names = sorted(places, key=len)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [x for x in names if len(x) >= 40]
    for i, x in enumerate(long):
        for y in long[i + 1 :]:
            if len(y) - len(x) > 2:
                break
            if sum(a != b for a, b in zip(x, y)) < 3 or (x[: len(x) // 3] == y[: len(x) // 3] or x[-15:] == y[-15:] or x[5:20] in y) and distance(x, y) <= 2:
                parent[find(x)] = find(y)
    classes = defaultdict(list)
    for x, at in places.items():
        classes[find(x)] += at
    assert once
    return {(p[1], p[2]): (min(at)[1], min(at)[2], len(at)) for at in classes.values() if len(at) > 1 for p in at}


def test_line_keys_move_many_in_a_row(monkeypatch):
    """A row holds a range of keys, and the keys that lines share are those of brute force."""
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([12, 45, 330]))) for _ in range(60)]
    made += [x[:5] + "#" + x[6:] for x in made[:40]]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(made[i : i + 20]) for i in range(0, len(made), 20)])], names=["text"])
    dealt = list(lines._scan_keys(lines.BY_LENGTH, 16)([batch]))
    entries = [e for b in dealt for r in b.to_pylist() for e in zip(*(np.frombuffer(r[c], np.uint64).tolist() for c in ("keys", "lines")), strict=True)]
    assert sum(b.num_rows for b in dealt) <= 16 * len(dealt) and len(entries) > 500
    by = defaultdict(lambda: defaultdict(bool))
    for key, line in entries:
        by[key >> 1][line] |= bool(key & 1)
    want = {frozenset(x.items()) for x in by.values() if len(x) > 1 and any(x.values())}
    for at_once in (1, 1 << 18):
        monkeypatch.setattr(lines, "AT_ONCE", at_once)
        got = defaultdict(dict)
        for b in lines._shared(pa.Table.from_batches(dealt).sort_by("bucket").to_batches(max_chunksize=3)):
            for r in b.to_pylist():
                got[r["key"]][r["a"] % 2**64] = r["index"]
        assert {frozenset(x.items()) for x in got.values()} == want and want


@pytest.mark.parametrize("unit", [2000, 5])
def test_line_classes(docs, rows, empty, unit):
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.class_size) for r in lines.line_classes(docs, unit=unit).collect() if r.doc_id is not None}
    assert got == {k: v for k, v in brute_lines(rows).items() if k[0] is not None}
    assert lines.line_classes(empty).count() == 0


def near(a, b, t):
    """Whether the distance is at most t, in a band of the plain table."""
    far = t + 1
    p = {j: j for j in range(min(t, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        c = {}
        for j in range(max(0, i - t), min(len(b), i + t) + 1):
            c[j] = min(p.get(j, far) + 1, c.get(j - 1, far) + 1, p.get(j - 1, far) + (x != b[j - 1]) if j else far)
        p = c
    return p.get(len(b), far) <= t


def test_reach_is_the_edit_distance():
    rng = random.Random(13)
    codes = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(8, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append(sorted((a, "".join(b)), key=len))
    for t in (1, 3, 6):
        got = lines.reach([codes(x) for x, _ in pairs], [codes(y) for _, y in pairs], t)
        assert got.tolist() == [distance(x, y) <= t for x, y in pairs]


@pytest.mark.parametrize("unit", [2000, 5])
def test_lines_of_every_length(spark, unit):
    """Exact copies from one character on, and near copies by the share of the length."""
    rng = random.Random(11)
    made = []
    for size in (1, 4, 9, 10, 12, 14, 20, 38, 39, 40, 41, 150, 298, 299, 300, 302, 420, 600, 699, 1300):
        for _ in range(3 if size < 1000 else 1):
            a = "".join(rng.choice("abcdefghij") for _ in range(size))
            made += [a, a]
            for edits in sorted({1, 2, 3, max(1, size // 100), size // 100 + 1}):
                b = list(a)
                for k in rng.sample(range(size), min(edits, size)):
                    b[k] = rng.choice(["", "X", b[k] + "Y"])
                made.append("".join(b) or "Z")
    rng.shuffle(made)
    allowed = lambda n: max(n // 100, 2 if n >= 40 else 1 if n >= 10 else 0)
    bags = {x: Counter(x) for x in made}
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(made):
        for j, y in enumerate(made[:i]):
            t = allowed(min(len(x), len(y)))
            if x == y or t and abs(len(x) - len(y)) <= t and sum((bags[x] - bags[y]).values()) <= t and near(x, y, t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    sizes = Counter(find(i) for i in range(len(made)))
    want = {i: (find(i), sizes[find(i)]) for i in range(len(made)) if sizes[find(i)] > 1}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "doc_id long, text string").repartition(3)
    got = lines.line_classes(df, unit=unit, least_exact=1, rule=lines.BY_LENGTH)
    assert {r.doc_id: (r.class_doc_id, r.class_size) for r in got.collect()} == want


def test_line_removal(docs, rows):
    out = lines.remove_lines(docs)
    assert out.columns == docs.columns
    twins = brute_lines(rows)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        left = "\n".join(x for k, x in enumerate(r[1].split("\n")) if twins.get((r[0], k), (r[0], k))[:2] == (r[0], k))
        if left == r[1] or WORD.search(left):
            assert left in got[r[0]]
        else:
            assert r[0] not in got


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("unit", "meeting"), [(1_500_000, 20_000), (900, 3)])
def test_jaccard_groups(docs, rows, empty, unit, meeting):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, unit=unit, meeting=meeting).collect()), key=str)
    want = sorted(((r[0], len(shingles(r[1])), None if r[0] is None else find(r[0])) for r in rows), key=str)
    assert got == want
    assert jaccard.jaccard_groups(empty).count() == 0


def test_rtree_bound_keeps_all_links():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
    sets = []
    for i in range(150):
        keep = base[rng.random(len(base)) > 0.03 * (i % 8)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, i % 20).astype(np.uint64)])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 180 * o >= 80 * (len(sets[i]) + len(sets[j])):
                parent[find(i)] = find(j)
    want = {frozenset(x for x in range(len(sets)) if find(x) == r) for r in set(map(find, range(len(sets))))}
    edges = jaccard.link(sets, np.zeros(len(sets), int), 80)
    parent = list(range(len(sets)))
    for a, b in edges:
        parent[find(a)] = find(b)
    assert {frozenset(x for x in range(len(sets)) if find(x) == r) for r in set(map(find, range(len(sets))))} == want


def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_piece_cache_equals_whole_texts():
    import tiktoken

    whole = reference_ids()
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    rng = random.Random(1)
    parts = ["a", "B", "é", "ü", "ſ", "ß", "\n", " ", " ", "  ", "\t", ".", ",", "!", "'s", '"', "'", "’", "1", "２", "½", "日本", " ", " ", "\x1c", "_", "<|endoftext|>", "the", "ing", "\r\n", "🙂", "é", "´", "[", "]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    small = tokens.huggingface()
    limit, small.limit = small.limit, 400  # forgets often
    texts += ["a<|endoftext|>b", " <|endoftext|>", "<|endo", "ftext|>", "<|endoftext|><|endoftext|>", "don't", "x'll've", "a'", "é's!", "", None, "\n", " ", "\nA\nB\n", "w" * 5000]
    for i in range(0, len(texts), 100):
        own = texts[i : i + 100]
        ids, counts = small.encode(pa.array(own, pa.string()))
        more, n = bpe.ByteBpe.of(None).cache.encode(pa.array(own, pa.string()), 7)
        assert ids.tolist() == [x for t in own for x in whole(t)] and counts.tolist() == [len(whole(t)) for t in own]
        assert more.tolist() == [x for t in own for x in [*multi.encode_ordinary(t or ""), 7]] and n.sum() == len(more)
    small.limit = limit
    assert small.encode(pa.array([], pa.string()))[0].tolist() == []


def test_decompose_equals_lengths():
    counts = np.array([0, 1, 2, 3, 63, 64, 65, 200, 12345])
    row, size = packing.decompose(counts, 64)
    assert [size[row == i].tolist() for i in range(len(counts))] == [packing.lengths(int(n), 64) for n in counts]


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = []
    for r in rows:
        ids = multi.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(bpe.encode(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(bpe.encode(empty)).count() == 0


def test_packing(docs, rows, empty):
    whole = reference_ids()
    got = packing.pack(docs, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        assert r.length == 1 << r.bucket <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length
        by[r.doc_id, r.doc_tokens].append((r.sequence_id, r.start, bytes(r.ids)))
    want = sorted((str((r[0], len(whole(r[1])) + 1)), np.array([*whole(r[1]), 1], "<u4").tobytes()) for r in rows)
    out = []
    for k, x in by.items():
        x.sort()
        text, at = b"", 0
        for _, start, ids in x:
            if start == 0 and text:
                out.append((str(k), text))
                text, at = b"", 0
            assert start == at
            text, at = text + ids, at + len(ids) // 4
        out.append((str(k), text))
    assert sorted(out) == want
    assert packing.lengths(13, 8) == [8, 4, 1] and packing.lengths(0, 8) == [] and packing.lengths(17, 8) == [8, 8, 1]
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, longest=100)


def test_token_file(spark, docs, rows, empty):
    whole = reference_ids()
    path = Scratch(spark, "test").path("files")
    tokenfile.write(docs, path, segment=2000)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    # equal keys go by Spark's hash of the text, whose seed is 42
    hashed = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64(t.encode(), 42).digest(), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    start = 0
    for r, g in zip(order, got, strict=True):
        ids = [*whole(r[1]), 0]
        assert (g.doc_id, g.start, g.n_tokens, zlib.crc32(bytes(g.ids))) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [bytes(r.ids) for r in tokenfile.lookup(spark, path, 7).collect()] == [np.array([*whole(rows[7][1]), 0], "<u4").tobytes()]
    path = Scratch(spark, "test").path("none")
    tokenfile.write(empty, path)
    assert tokenfile.read(spark, path).count() == 0


def test_quality_statistics(docs, rows, empty):
    got = [tuple(r) for r in quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        own = [x for x in t.split("\n") if WORD.search(x)]
        windows = defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i : i + 5])].append(i)
        repeat = len({j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
        want.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality.quality_rules(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_outliers_in_one_dimension(spark):
    """A usual document but for its copied lines, and one but for its repeated passages, go; usual ones stay."""
    rng = random.Random(17)
    vocabulary = [f"{a}{b}xyz" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda: [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, "\n".join(" ".join(w[k : k + 20]) for k in range(0, 200, 20)), "en", "s") for i in range(80) for w in [text()]]
    some = [rng.choice(vocabulary[:30]) for _ in range(200)]
    rows.append((100, "\n".join(some), "en", "s"))
    w = text()
    w[150:185] = w[20:55]
    w[185:] = [f"q{i}xyz" for i in range(15)]
    w[100:103] = ["zaxyz", "zbxyz", "zcxyz"]
    rows.append((101, " ".join(w[:70] + w[80:150] + w[150:168] + w[185:] + text()[:27]), "en", "s"))
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[100].n_dup_lines > 150 and got[100].n_repeat_words == 0
    assert got[101].n_dup_lines == 0 and 30 <= got[101].n_repeat_words <= 40 and got[101].n_words == 200
    assert not any(got[i].base_failed for i in got)
    assert not got[100].kept and not got[101].kept
    assert all(got[i].kept for i in range(80))


def test_mcd_by_numpy(spark):
    """The estimate of a group against concentration steps in NumPy, and outliers against a plain mean."""
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([6, 1.6, 0.5, 0.2, 0.1], np.diag([0.5, 0.02, 0.1, 0.02, 0.01]), 400)
    bad = rng.multivariate_normal([3, 2.5, 4, 0.9, 0.9], np.eye(5) * 0.01, 60)
    x = np.round(np.concatenate([good, bad]) * quality.FIXED).astype(int)
    df = spark.createDataFrame([("g", *map(int, r), 1) for r in x], "`group` string, " + ", ".join(f"{c} long" for c in quality.DIMENSIONS) + ", n long")
    got = quality.mcd(df, Scratch(spark, "test"), steps=3).first()
    xf = x / quality.FIXED
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    inflate = 1 / quality._consistency(0.75, 5)

    def fit(rows_, scale):
        return rows_.mean(0), scale * np.cov(rows_.T, bias=True) + floors

    def half(d2):
        b = np.floor(np.log2(d2 + 2.0**-20) * quality.BINS_PER_OCTAVE)
        cut = next(v for v in np.unique(b) if (b <= v).sum() >= 0.75 * len(b))
        return xf[b <= cut]

    best = None
    med = np.median(np.round(xf * 16) / 16, axis=0)
    for start in (xf, half((((xf - med) / np.array(quality.FLOORS)) ** 2).sum(1))):
        m, c = fit(start, 1.0 if start is xf else inflate)
        for _ in range(3):
            d = xf - m
            m, c = fit(half(np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)), inflate)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    assert np.allclose(got["mean"], best[1], atol=1e-6)
    w = np.zeros((5, 5))
    w[np.tril_indices(5)] = got["white"]
    assert np.allclose(w.T @ w, np.linalg.inv(best[2]), rtol=1e-5)
    d2 = (((xf - best[1]) @ w.T) ** 2).sum(1)
    cut = quality._chi2_quantile(1 - 1e-5, 5)
    assert (d2[:400] <= cut).all() and (d2[400:] > cut).all()


def test_sentencepiece_model_is_plain():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    assert ranks[base64.b64decode("IQ==")] == 0
    own = bpe.ByteBpe.of(None)
    every = bytes(range(256)) * 2
    assert own.decode([i for b in every for i in [own.ranks[bytes([b])]]]) == every


def test_patterns_that_cancel_have_hashes_of_their_own():
    """Thue-Morse strings over two letters and their complements have equal polynomial hashes modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    codes = [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (one, two)]
    assert len({int(words.prefix_hash(c)[-1]) for c in codes}) == 1  # what candidates may be found by
    h = words.Words(pa.array([one, two])).hash
    assert h[0] != h[1]
    found = lines.Lines(pa.array([one, two]), 1)
    assert found.a[0] != found.a[1] and found.b[0] != found.b[1]
    assert not lines.reach([codes[0]], [codes[1]], 20)[0] and lines.reach([codes[0]], [codes[0]], 20)[0]
    padded = [np.concatenate([c, codes[0][:700]]) for c in codes]
    assert not lines.close([padded[0]], [padded[1]], lines.BY_LENGTH)[0]
    n, shingle = words.Words(pa.array([one + " w x y z", two + " w x y z"])).shingles(5)
    assert shingle[0] != shingle[1]


def test_join_groups_with_hot_ones(spark):
    from boscage.llm.store import join_groups

    rows = [(k, i) for i in range(120) for k in ([0] if i % 2 else [i % 40])] + [(999, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    groups = Scratch(spark, "test").save(df.where("k <> 999").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n"), "groups")
    got = sorted(tuple(r) for r in join_groups(df, groups, ["k"], "n", share=5).select("k", "v", "n").collect())
    sizes = Counter(k for k, _ in rows)
    assert max(sizes.values()) * 5 > sum(sizes.values()) and got == sorted((k, v, sizes[k]) for k, v in rows if k != 999)


def test_workers_give_freed_memory_back():
    code = """
import psutil
from boscage.llm import arrow
last = []
def run(arriving):
    held = [bytes(100_000) for _ in arriving]
    last.append(held[-1])
    del held
    yield 1
assert list(arrow.thrifty(run)(range(3000))) == [1]
assert psutil.Process().memory_info().rss < 250e6, psutil.Process().memory_info().rss
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": ROOT}, timeout=60)


def test_packing_holds_few_known_cuts():
    encoder = tokens.huggingface(None, packing.HELD)
    assert encoder.limit == packing.HELD <= 64 << 20
