"""Substring and suffix dedup, SimHash and decontamination against brute force."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from reelgraph.llm import common, decontaminate, simhash, skew, substring, suffix, warc

SCHEMA = "doc_id long, text string, key string, id string, n long"


def corpus(seed=3, n=40):
    """Texts with shared passages, copies, near copies, periodic runs, nulls and repeated rows; extra columns clash with inner names."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["é", "ü", "the", "The"]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "aaaa" * 60), (4, "x aaaa" + "aaaa" * 50), (5, "one"), (6, "ab " * 90), (6, "other row of the same id")]
    for i in range(10, 10 + n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        parts += rng.sample(passages, rng.randint(0, 2)) + [" ".join(rng.choices(words, k=rng.randint(0, 10)))]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100 + i, rows[12][1]) for i in range(4)]
    rows += [(None, passages[0]), rows[15], rows[15]]
    return [(a, b, "k", "i", 1) for a, b in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def brute_words(width):
    rows = [(a, (b or "").encode().split()) for a, b, *_ in corpus()]
    seen = Counter(tuple(w[i : i + width]) for _, w in rows for i in range(len(w) - width + 1))
    want = []
    for a, w in rows:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        want.append((a, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return want


def test_substring_matches_brute_force(spark, docs, max_keys=None):
    got = [tuple(r) for r in substring.remove_repeats(docs, width=8, max_keys=max_keys).collect()]
    assert ordered(got) == ordered(brute_words(8))


def test_joins_instead_of_filters(spark, docs):
    """What a Bloom filter thins out where sets are small a join does where they are not."""
    test_substring_matches_brute_force(spark, docs, 0)
    test_suffix_matches_brute_force(spark, docs, 30, 3, 0)
    test_decontamination_matches_brute_force(spark, docs, 0)
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "y"), (4, "u", None), (None, "u", "x")], "page_id long, url string, html string")
    got = warc.typed(pages, "page_id", "url", "html", 0, 0).select("id", "refers_to").collect()
    assert ordered(map(tuple, got)) == ordered([(1, None), (2, 1), (3, None), (4, None), (None, 1)])


def test_long_texts_come_in_segments(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 20)
    test_substring_matches_brute_force(spark, docs)
    test_suffix_matches_brute_force(spark, docs, 30, 3)
    test_decontamination_matches_brute_force(spark, docs)
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choices("abc \n\té", k=rng.randint(0, 300)))
        words = text.encode().split()
        runs = sorted(rng.sample(range(len(words) + 1), 2 * min(3, (len(words) + 1) // 2)))
        runs = list(zip(runs[::2], runs[1::2], strict=True))
        gone = {j for a, b in runs for j in range(a, b)}
        want = [[len(words), len(gone)], b" ".join(w for j, w in enumerate(words) if j not in gone).decode()]
        assert list(substring.remove_words(text, runs, rng.choice([1, 7, 50]))) == want
        assert simhash.fingerprint(text, 4, rng.choice([1, 7, 50])) == simhash.fingerprint(text) == brute_fingerprint(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        parts = [(base, piece.split()) for base, piece in common.word_cuts(3)(text.encode(), 11)]
        assert sorted((base + i, tuple(w[i : i + 3])) for base, w in parts for i in range(len(w) - 2)) == list(enumerate(windows))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words have equal polynomials modulo 2**64 for any odd base; they are different words."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.remove_repeats(docs).collect()} == {0}
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.find(docs, bench).collect()} == {1: True, 2: False}


def test_hashes_are_spread():
    """No equal hashes among many words, and windows that differ anywhere differ in both keys."""
    import numpy as np

    from reelgraph.llm import anchors

    words = list({"".join(random.Random(i).choices("ab", k=1 + i % 90)) for i in range(20_000)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    size = np.array([len(w) for w in words])
    hashes = anchors.run_hashes(data, np.cumsum(size + 1) - size - 1, np.cumsum(size + 1) - 1)
    assert len(set(hashes.tolist())) == len(words)
    keys = [anchors.window_keys(np.where(np.arange(35) == i, hashes[77], hashes[:35]), 35) for i in range(35)]
    assert len({(int(a[0]), int(b[0])) for a, b in keys}) == 35 and len({int(a[0]) for a, _ in keys}) == len({int(b[0]) for _, b in keys}) == 35


def test_frequent_keys_are_split(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 900), (2, 80), (3, 20), (4, 1)) for i in range(n)], "h long, pos int").repartition(3)
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = skew.join_counted(rows, counted.withColumn("x", F.col("h") * 10), ["h"], share=20).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["h"], r["pos"], r["h"] * 10) for r in rows.where("h < 4").collect())
    assert skew.join_counted(rows, counted.where("false"), ["h"]).count() == 0
    monkeypatch.setattr(skew, "SHARE", 200)  # many windows of the small table are split then
    test_substring_matches_brute_force(spark, docs)
    test_suffix_matches_brute_force(spark, docs, 30, 3)


def brute_bytes(rows, width):
    """Rows that share id and text count as one document; ids that repeat are ordered by their text's key."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first = {}
    for k, (_, _, t) in enumerate(docs):
        for i in range(len(t) - width + 1):
            first.setdefault(t[i : i + width], (k, i))
    out = {}
    for k, (a, key, t) in enumerate(docs):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] != (k, i):
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(a, key, t)] = (a, len(t), sum(gone), runs, bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return [out[r] for r in rows]


@pytest.mark.parametrize(("width", "hot"), [(30, 10**6), (30, 3), (7, 10**6), (100, 10**6)])
def test_suffix_matches_brute_force(spark, docs, width, hot, max_keys=None):
    from reelgraph.llm.cuts import keyed

    rows = [(r["id"], r["key"], (r["text"] or "").encode()) for r in keyed(docs, "doc_id", "text").collect()]
    got = [(r[0], *r[1:4], bytes(r[4])) for r in suffix.remove_repeats(docs, width=width, hot=hot, max_keys=max_keys).collect()]
    assert ordered(got) == ordered(brute_bytes(rows, width))


def test_maximal_repeats_list_all_occurrences(spark, docs):
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    byid = defaultdict(list)
    for a, b in texts:
        byid[a].append((b or "").encode())
    groups = defaultdict(set)
    for r in suffix.maximal_repeats(docs, width=30).collect():
        strings = [t[r["start"] : r["start"] + r["length"]] for t in byid[r["id"]] if len(t) >= r["start"] + r["length"]]
        assert any(xxhash.xxh64_intdigest(s) == r["repeat"] % 2**64 for s in strings)
        groups[r["repeat"]].add((r["id"], r["key"], r["start"], r["length"]))
    assert groups and min(map(len, groups.values())) >= 2


def brute_maximal(docs, width):
    """{string: occurrences (id, key, start)} of repeats that neither side extends; docs are distinct (id, key, bytes)."""
    found, alive, size = {}, [(d, i) for d in docs for i in range(len(d[2]) - width + 1)], width
    while alive:
        sets = defaultdict(list)
        for d, i in alive:
            if i + size <= len(d[2]):
                sets[d[2][i : i + size]].append((d, i))
        sets = {s: x for s, x in sets.items() if len(x) > 1}
        for s, x in sets.items():
            sides = [[d[2][i - 1 : i] if i else None for d, i in x], [d[2][i + size : i + size + 1] or None for d, i in x]]
            if all(None in side or len(set(side)) > 1 for side in sides):
                found[s] = {(d[0], d[1], i) for d, i in x}
        alive, size = [p for x in sets.values() for p in x], size + 1
    return found


@pytest.mark.parametrize("hot", [3, 10**6])
def test_maximal_repeats_match_brute_force(spark, docs, hot):
    from reelgraph.llm.cuts import keyed

    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    more = [(1000 + i, chr(73 + i) * 3 + passage + chr(83 + i) * 3) for i in range(6)] + [(1010, passage[:200] + "-" + passage[150:])]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_maximal({(r["id"], r["key"], (r["text"] or "").encode()) for r in keyed(docs, "doc_id", "text").collect()}, 30)
    assert want[passage.encode()] and any(len(s) not in (30, 400) for s in want)
    rows = suffix.maximal_repeats(docs, width=30, hot=hot).collect()
    got, first = defaultdict(set), defaultdict(list)
    for r in rows:
        got[r["repeat"] % 2**64, r["length"]].add((r["id"], r["key"], r["start"]))
        first[r["repeat"] % 2**64, r["length"]] += [(r["id"], r["key"], r["start"])] if r["first"] else []
    assert len(rows) == sum(map(len, got.values()))
    assert dict(got) == {(xxhash.xxh64_intdigest(s), len(s)): x for s, x in want.items()}
    assert dict(first) == {k: [min(x, key=lambda o: (o[0] is None, o[0] or 0, *o[1:]))] for k, x in got.items()}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_components(spark, docs, tile, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)} | {0})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = {f: f for f in fps}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, tile).collect():
        a, b = r["src"] % 2**64, r["dst"] % 2**64
        got[max(root(a), root(b))] = min(root(a), root(b))
    assert {frozenset(g for g in fps if find(g) == find(f)) for f in fps} == {frozenset(g for g in fps if root(g) == root(f)) for f in fps}


def test_near_duplicates_of_rows(spark, docs):
    rows = [(a, brute_fingerprint(b)) for a, b, *_ in corpus()]
    fps = {f for _, f in rows}
    reach = {f: {f} for f in fps}
    for _ in range(len(fps)):
        for f in fps:
            reach[f] |= {g for x in list(reach[f]) for g in fps if (x ^ g).bit_count() <= 4}
    name = {f: min((a for a, g in rows if g in reach[f] and a is not None), default=None) for f in fps}
    got = [(r["doc_id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()]
    assert ordered(got) == ordered([(a, f, name[f]) for a, f in rows])


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_matches_brute_force(spark, docs, max_keys=None):
    rows = corpus()
    items = [(1, rows[20][1]), (2, " ".join(rows[25][1].split()[:4])), (3, "ONE"), (4, "nothing of the kind in there"), (5, None), (6, "!!"), (7, rows[30][1]), (7, rows[20][1]), (None, "one"), (3, "ONE")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, pos string")
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(i)
    want = []
    for a, t, *_ in rows:
        w, hit, found = words_of(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    found |= ids
                    hit |= set(range(k, k + n))
        want.append((a, len(w), len(hit), ",".join(sorted(map(str, found))), bool(hit)))
    got = decontaminate.find(docs, bench, max_keys=max_keys).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    assert ordered(map(tuple, got)) == ordered(want)


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity(spark, slop):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 25)))) for i in range(40)] + [(100, None)]
    items = [(1, "a b"), (2, "f e d"), (3, "a a b"), (4, "c d e f a b c d e f a b"), (5, "zz a")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    count = Counter(w for _, t in rows for w in words_of(t))
    want = set()
    for i, t in rows:
        w = words_of(t)
        for item, x in items:
            x = words_of(x)
            for k in range(max(1, len(x) - 9)):
                window = list(enumerate(x))[k : k + 10]
                if all(count[v] for _, v in window):
                    n = min(count[v] for _, v in window)
                    rare = next(p for p, v in sorted(window, key=lambda s: s[0]) if count[v] == n)
                    for delta in (q - rare for q, v in enumerate(w) if v == x[rare]):
                        off = [min((abs(q - delta - p) for q, u in enumerate(w) if u == v), default=99) for p, v in window]
                        if max(off) <= slop and any(off):
                            want.add((i, item, k, delta, sum(o > 0 for o in off)))
    near = decontaminate.Index(docs, bench, "doc_id", "text", "item_id", "text", 10).proximity(slop)
    got = near.select("id", "item", "wpos", "delta", "moved").collect()
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring.remove_repeats(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert decontaminate.find(empty, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find(one, bench).first()["contaminated"] is False
    assert sha256(suffix.remove_repeats(one).first()["kept"]).hexdigest() == sha256(b"a b").hexdigest()
