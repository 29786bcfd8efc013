"""Every registered opN query and every pipeline stage, on the given tables, on hard rows and on empty tables."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelgraph.llm import queries, secrets
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages")
#: Names that operators use inside.
CLASH = "id key h h1 h2 n n1 start end spans seen hot base piece again fp component least name path blob content i k row host rule won short digest suffix _words __stop own kept ids".split()


def hard_documents():
    """Nulls in every column, repeated rows, ties, very long texts of several kinds and what operators look for."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t", None, None, None), (4, "123 .. !", "de", "s", 8), (5, "word", "fr", "s", 4),
        (6, "x" * 300_000, "en", "s", 1), (7, "ab " * 60_000, "en", "s", 1), (8, "\n".join(["same line of words"] * 4_000), "en", "s", 1),
        (9, " ".join(rng.choices(words, k=40_000)), "es", "s", 1), (10, "é" * 3_000 + " " + passage, "fr", "s", 1),
        (11, f"before {passage} after", "en", "s", 1), (12, f"{passage} after", "en", None, 1), (13, "password = hunter2hunter2 " + "ab12" * 10, "en", "s", 1),
        (14, "-----BEGIN PRIVATE KEY-----\nMIIEvQIBADANBgkq\n-----END PRIVATE KEY-----", "en", "s", 1), (None, passage + " unique", "en", "s", 1), (15, passage + " " + passage, "en", "s", 1),
    ]
    rows += [rows[10], rows[10], rows[4], rows[0]]
    return rows


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """(folder, documents, benchmark, pages)."""
    where = str(tmp_path_factory.mktemp("hard"))
    docs = hard_documents()
    items = [(1, " ".join(docs[10][1].split()[5:30])), (2, None), (3, ""), (4, "WORD"), (4, "word"), (None, "word"), (5, "no such thing anywhere")]
    pages = [(1, None, None), (2, "http://a.net/en/x", ""), (3, "no scheme", "<p>"), (4, "https://A.Example.NET/en/" + "y" * 50_000, "z" * 200_000), (5, "https://x.org/fr/?q", "z" * 200_000), (5, "https://x.org/fr/?q", "z" * 200_000), (None, "x://e.example.com/de/", "<p>"), (6, "x://net", "<p>")]
    extra = [F.lit(f"c-{c}").alias(c) for c in CLASH]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).select("*", *extra).repartition(3).write.parquet(f"{where}/{name}.parquet")
    put(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put(items, "item_id long, text string", "benchmark")
    put(pages, "page_id long, url string, html string", "pages")
    return where, docs, items, pages


@pytest.fixture(scope="module")
def empty(spark, hard, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{hard[0]}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return where


def rows_of(spark, where):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{where}/{name}.parquet").select(*cols).collect()]
    return read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), read("pages", "page_id", "url"), read("pages", "page_id", "html"), read("documents", *queries.LEAF)


def wanted(name, docs, items, urls, htmls, whole):
    """(columns, rows) of a query by brute force."""
    return {
        "op1_bpe": lambda: ("doc_id n_tokens ids_sha256 decoded_sha256", brute.op1(docs)),
        "op2_url_filter": lambda: ("page_id host path rule verdict", brute.op2(urls)),
        "op4_simhash": lambda: ("doc_id fingerprint component_id", brute.op4(docs)),
        "op5_secret_scan": lambda: ("doc_id n_assign n_access n_hex base_sha256", brute.op5(docs)),
        "op6_warc": lambda: ("page_id payload_bytes payload_digest record_type refers_to", brute.op6(htmls)),
        "op7_substring": lambda: ("doc_id n_words n_removed kept_sha256", brute.op7(docs)),
        "op8_decontaminate": lambda: ("doc_id n_words n_hit n_items items_sha256 contaminated", brute.op8(docs, items)),
        "op9_quality": lambda: ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", brute.op9(docs)),
        "op10_suffix": lambda: ("doc_id n_bytes n_removed n_spans kept_sha256", brute.op10(docs)),
        "op11_manifest": lambda: ("doc_id leaf subroot root proof_sha256 folded_root verified", brute.op11(whole)),
        "op12_spelling": lambda: ("word form root n n_near form_n", brute.op12(docs)),
        "op13_token_counts": lambda: ("doc_id n_bytes n_tokens over_limit", brute.op13(docs)),
    }[name]()


OPERATORS = [n for n in queries.QUERIES if n != "op3_language_id"]


@pytest.mark.parametrize("name", OPERATORS)
def test_query_on_hard_rows(spark, hard, name):
    if name in ("op1_bpe", "op13_token_counts"):
        pytest.importorskip("public_tokenizers")
    columns, want = wanted(name, *rows_of(spark, hard[0]))
    got = entry.queries()[name](spark, hard[0]).select(*columns.split()).collect()
    assert brute.ordered(got) == brute.ordered(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", OPERATORS)
def test_query_on_given_tables(spark, name):
    columns, want = wanted(name, *rows_of(spark, DATA))
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    assert brute.ordered([[r[c] for c in columns.split()] for r in got]) == brute.ordered(want)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        sql = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in sql.description]
        assert sorted(names) == sorted(df.columns)
        assert brute.ordered(sql.fetchall()) == brute.ordered([[r[c] for c in names] for r in got])


def test_spans_column(spark, hard):
    """op5's spans are the base spans and those of the added rule."""
    for r in entry.queries()["op5_secret_scan"](spark, hard[0]).collect():
        if r["doc_id"] == 14:
            assert r["spans"] == "pem:0:" + str(len(hard_documents()[13][1]))
        if r["doc_id"] == 13:
            assert [x.split(":")[0] for x in r["spans"].split(",")] == ["assign", "hex"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_language_query(spark, hard, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = entry.queries()["op3_language_id"](spark, DATA).collect()
    assert len(got) == docs.count() and all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    told = [(r["lang_pred"], lang[r["doc_id"]]) for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(told) > 20 and sum(a == b for a, b in told) >= 0.97 * len(told)
    text = dict(rows_of(spark, hard[0])[0])
    rows = entry.queries()["op3_language_id"](spark, hard[0]).collect()
    assert len(rows) == len(hard[1])
    for r in rows:
        assert r["held_out"] == brute.held_out(r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or "")))
    assert entry.queries()["op3_language_id"](spark, empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_query_on_empty_tables(spark, empty, hard, name):
    df = entry.queries()[name](spark, empty)
    assert df.count() == 0


def test_stages_on_hard_rows(spark, hard, empty):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    where, docs, items, _ = hard
    frame, none = (spark.read.parquet(f"{x}/documents.parquet") for x in (where, empty))
    stage = dict(p.STAGES)
    for name in stage:
        out = stage[name](spark, none, empty)
        assert out.count() == 0 and (name == "bpe" or out.columns == p.COLUMNS)
    as_rows = lambda df: brute.ordered(df.collect())

    kept = as_rows(stage["language_id"](spark, frame, where))
    letters = [d for d in docs if any(map(str.isalpha, d[1] or ""))]
    assert {(r[0], r[1]) for r in kept} <= {(d[0], d[1]) for d in letters} and len(kept) > len(letters) / 2 and all(r[2] for r in kept)

    reach, first = brute.components([d[:2] for d in docs]), {}
    for d in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(min(reach[brute.fingerprint(d[1])]), d)
    assert as_rows(stage["simhash"](spark, frame, where)) == brute.ordered(first.values())

    bad = {r[0] for r in brute.op8([d[:2] for d in docs], items) if r[-1]}
    assert bad and as_rows(stage["decontaminate"](spark, frame, where)) == brute.ordered(d for d in docs if d[0] not in bad)

    def masked(text):
        spans = sorted((a, b) for _, a, b in secrets.Scanner().spans(text))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        return (out + text[at:], True) if spans else (text, False)

    want = [(d[0], None, *d[2:]) if d[1] is None else (d[0], (m := masked(d[1]))[0], *d[2:4], len(m[0]) if m[1] else d[4]) for d in docs]
    assert as_rows(stage["secret_scan"](spark, frame, where)) == brute.ordered(want)

    coded = {(i, n, s) for i, n, s, _ in brute.op1([d[:2] for d in docs])}
    out = stage["bpe"](spark, frame, where).collect()
    assert len(out) == len(docs) and all(r["round_trip"] for r in out)
    assert {(r["doc_id"], r["n_tokens"], brute.sha(" ".join(map(str, r["ids"])))) for r in out} == coded
