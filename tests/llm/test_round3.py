"""Manifest, spelling variants and token counts, beyond their queries."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgraph.llm import manifest, queries, spelling, token_counts
from tests.llm import brute

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=300), st.lists(st.integers(0, 65535), min_size=1, max_size=20), st.booleans())
def test_ranks_of_bitmaps(ids, asked, dense):
    ids = np.array(sorted(ids | set(range(20_000, 30_000)) if dense else ids), np.int64)
    bits, directory = manifest.encode_bitmap(ids)
    assert bool(directory) == (len(ids) > 4096)
    got = manifest.rank(bits, directory, np.array(asked, np.int64))
    assert got.tolist() == [int((ids < x).sum()) for x in asked]


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest(spark, depth):
    """Blocks of 3, 9 and 6561 leaves, ids far apart and negative, ids that repeat with equal and with other texts, null ids, one hot group, many groups."""
    rng = random.Random(depth)
    rows = [(rng.choice([i, -i, i << 20, i << 40, -(i << 33)]), rng.choice(["hot", "hot", f"s{rng.randrange(30)}", None, "", "é"]), None, i, f"text\n{i}") for i in range(240)]
    rows += [(7, "hot", "en", 1, "same\nrow")] * 25 + [(7, "hot", "en", 1, f"other {i}") for i in range(25)] + [(None, "hot", None, None, None)] * 4 + [(None, "hot", "x", None, "a\n")] + [(5, "alone", "en", 2, None), (6, "=", "en", 2, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = manifest.build(docs, "doc_id", "source", queries.LEAF, changed, depth=depth)
    assert got.columns == COLUMNS
    assert brute.ordered(got.collect()) == brute.ordered(brute.op11(rows))
    if depth == 2:
        untouched = manifest.build(docs, "doc_id", "source", queries.LEAF, depth=depth)
        assert untouched.where("NOT verified").isEmpty() and {r["root"] for r in untouched.collect()} == {brute.op11(rows)[0][3]}


def test_variants_of_words(spark):
    """Every kind of edit at every place, chains, ties, words one edit of many, letters beyond ASCII."""
    rng = random.Random(4)
    words = {"abcdefgh": 5000, "wandered": 300, "aaaaaaa": 70, "aaaaaaaa": 700, "aaaaaaaaa": 7000, "aaaaaaaaaa": 70_000, "éèêëàâä": 40, "éèêëàâö": 3, "éèêëàâ÷": 3, "abc\U0001f600defg": 90, "abcdefg": 9}
    for base in ("abcdefgh", "wandered"):
        for i in range(len(base) + 1):
            for c in "xe":
                for w in (base[:i] + c + base[i:], base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :]):
                    if w != base and len(w) >= 2:
                        words.setdefault(w, rng.choice([2, 3, 20, 29, 30, 31, 500]))
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(frame.unionByName(spark.createDataFrame([(None, 4)], frame.schema)).repartition(3))
    assert brute.ordered(got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute.ordered(brute.variants(words))
    roots = {r["word"]: r["root"] for r in got.collect()}
    assert roots["aaaaaaa"] == "aaaaaaaaaa"
    with pytest.raises(ValueError):
        spelling.variants(frame, ratio=1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abeé", min_size=2, max_size=9), min_size=2, max_size=12, unique=True))
def test_signatures_are_exact(words):
    """Words one edit apart share a signature: that of their halves and classes."""

    def signed(word, same, longer=False):
        size = len(word) - longer
        half = size // 2
        classes = ["".join(sorted(c for c in word if ord(c) % spelling.PARTS == i)) for i in range(spelling.PARTS)]
        kept = spelling.combinations(range(spelling.PARTS), spelling.PARTS - (2 if same else 1))
        return {(side, k, size, text, *(classes[i] for i in k)) for k in kept for side, text in enumerate((word[:half], word[len(word) - (size - half) :]))}

    for a in words:
        for b in words:
            if a != b and brute.one_edit(a, b) and len(a) >= len(b):
                assert signed(a, True) & signed(b, True) if len(a) == len(b) else signed(a, False, True) & signed(b, False)


SPECIAL = ["hi <|endoftext|>There<|startoftext|> x", "ǰ J̌ İI", "it's 'STOP 're don't '''s", "ΣΑΣ.", "<|endoftext|>" * 3, "", None, "é Å ﬁ ẞ", "\x1c\x85  ​\t", "한국 日本語 \U0001f600\U0001f600"]


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    texts = [*SPECIAL, " ".join(f"word{rng.randrange(99)}'s {x or ''}" for x in SPECIAL * 9), "\n".join(map(str, SPECIAL))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "repeated"), (3, "repeated")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id int, text string, slice string, bucket int").repartition(3)
    definition = token_counts.Definition(spark, P.path(queries.COUNTED))
    for buckets, slice_rows in ((1, 1000), (7, 1)):
        got = token_counts.count(docs, definition, "doc_id", "text", buckets=buckets, slice_rows=slice_rows)
        assert dict(got.dtypes)["doc_id"] == "int"
        assert brute.ordered(got.collect()) == brute.ordered(r[:3] for r in brute.op13(rows))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pre_tokens_equal_the_librarys(text):
    P = pytest.importorskip("public_tokenizers")
    _SPLITTER.append(token_counts.Splitter(open(P.path(queries.COUNTED), encoding="utf-8").read())) if not _SPLITTER else None
    found, special = _SPLITTER[0].frequencies(text)
    sizes = dict(zip(found, _SPLITTER[0].pieces(list(found)), strict=True))
    assert sum(sizes[t] * n for t, n in found.items()) + special == len(_SPLITTER[0].tokenizer.encode(text, add_special_tokens=False).ids)


def test_long_texts_are_split_at_white_space(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    splitter = token_counts.Splitter(open(P.path(queries.COUNTED), encoding="utf-8").read())
    text = " ".join(f"word{i % 7}'s  {SPECIAL[i % len(SPECIAL)] or ''}" for i in range(200))
    whole = splitter.frequencies(text)
    for size in (1, 40, 1000):
        monkeypatch.setattr(token_counts, "_BLOCK", size)
        assert splitter.frequencies(text) == whole


_SPLITTER = []


def test_packed_numbers():
    sizes = np.array([3, 0, 2, 0, 1], np.int64)
    at = np.array([5, 6, 900_000, 0, 70_000, 3], np.int64)
    assert token_counts.unpack(token_counts.pack(at, sizes), sizes).tolist() == at.tolist()
    none = np.zeros(0, np.int64)
    assert token_counts.unpack(token_counts.pack(none, none), none).tolist() == []
    assert token_counts.unpack(token_counts.pack(none, np.array([0, 0])), np.array([0, 0])).tolist() == []
