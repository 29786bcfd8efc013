"""The registered queries of these operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.llm import bpe, decontaminate, language_id, manifest, quality, secrets, simhash, spelling, substring, suffix, token_counts, url_filter, warc

TOKENIZER, COUNTED = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
#: Rules (host, path, action) of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op1_bpe(spark, sf_dir):
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id, as text, divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_secret_scan(spark, sf_dir):
    found, _ = secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = [kind for kind, *_ in secrets.BASE_RULES]
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.getField("kind") == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in base]
    return found.select(
        F.col("path").alias("doc_id"), *counts,
        F.sha2(named(F.filter("spans", lambda s: s.getField("kind").isin(*base))), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def op6_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    directory = warc.new_directory(spark)
    index = warc.write(pages, directory)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, directory, index, payloads=False).select(
        F.col("record").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind).alias("refers_to")
    )


def op7_substring(spark, sf_dir):
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark, sf_dir):
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_quality(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.COLUMNS, "base_failed", "kept")


def op10_suffix(spark, sf_dir):
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Fields of a leaf, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_manifest(spark, sf_dir):
    """Every second document, by crc32 of its id, has lost its line feeds."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest.build(table(spark, sf_dir, "documents").select(*LEAF), "doc_id", "source", LEAF, changed)


def op12_spelling(spark, sf_dir):
    found = spelling.runs(table(spark, sf_dir, "documents"), "doc_id", "text", least=7)
    words = found.select(spelling.misspelt(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= 7)
    return spelling.variants(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))


def op13_token_counts(spark, sf_dir):
    import public_tokenizers

    out = token_counts.count(table(spark, sf_dir, "documents"), token_counts.Definition(spark, public_tokenizers.path(COUNTED)), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


_ALL = (op1_bpe, op2_url_filter, op3_language_id, op4_simhash, op5_secret_scan, op6_warc, op7_substring, op8_decontaminate, op9_quality, op10_suffix, op11_manifest, op12_spelling, op13_token_counts)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER
_SQL_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
_SP = "\\x20\\x09-\\x0D"



def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a text's UTF-8 bytes, a bit at a time."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    steps = f"list_concat([4294967295], flatten(list_transform({octets}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END), 4294967295)"


def _tree_sql(name: str, start: str, levels: int) -> str:
    """CTEs of a tree over start (s, i, c, h): {name}0.. its levels, {name}s0.. the siblings of their nodes, {name}_root (s, h)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        run = "OVER (PARTITION BY s, i // 3 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT s, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE c > 1)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT s, i // 3 AS i, (c + 2) // 3 AS c, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE c > 1 GROUP BY s, i // 3, c)")
    out.append(f"{name}_root AS MATERIALIZED ({' UNION ALL '.join(f'SELECT s, h FROM {name}{k} WHERE c = 1' for k in range(levels + 1))})")
    return ",\n".join(out)


def _fold_sql(name: str, tree: str, start: str, levels: int) -> str:
    """CTEs that lead start (rid, s, i, c, node, proof) to the roots of the tree: {name}_end (rid, s, node, proof)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT rid, f.s, f.i // 3 AS i, (c + 2) // 3 AS c, sha256(l || node || r) AS node, proof || l || r AS proof FROM {name}{k} f JOIN {tree}s{k} x ON f.s = x.s AND f.i = x.i WHERE c > 1)")
    out.append(f"{name}_end AS MATERIALIZED ({' UNION ALL '.join(f'SELECT rid, s, node, proof FROM {name}{k} WHERE c = 1' for k in range(levels + 1))})")
    return ",\n".join(out)


_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in LEAF) + ")"
#: Levels that SQL goes through: enough for 3 ** 15 rows of a source and 3 ** 9 sources.
_LOW, _HIGH = 15, 9

ORACLE_SQL = {
    "op11_manifest": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, coalesce('=' || source, '') AS s, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS chosen FROM documents),
e AS MATERIALIZED (SELECT rid, s, doc_id, {_LEAF_SQL.format(**{c: c for c in LEAF})} AS leaf,
    {_LEAF_SQL.format(**{c: c for c in LEAF} | {"text": "(CASE WHEN chosen THEN replace(text, chr(10), '') ELSE text END)"})} AS now FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS c FROM e),
{_tree_sql("a", "SELECT s, i, c, leaf AS h FROM p", _LOW)},
g AS MATERIALIZED (SELECT s AS of, h, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS c FROM a_root),
{_tree_sql("b", "SELECT '' AS s, i, c, h FROM g", _HIGH)},
{_fold_sql("f", "a", "SELECT rid, s, i, c, now AS node, '' AS proof FROM p", _LOW)},
{_fold_sql("u", "b", "SELECT rid, '' AS s, g.i, g.c, node, proof FROM f_end JOIN g ON f_end.s = g.of", _HIGH)}
SELECT doc_id, leaf, g.h AS subroot, b_root.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b_root.h AS verified
FROM p JOIN g ON p.s = g.of JOIN u_end ON p.rid = u_end.rid CROSS JOIN b_root""",
    "op12_spelling": f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT *, {_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM r),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
o AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM w, unnest(range(1, CAST(length(word) AS INT) + 1)) AS u(i)),
q AS MATERIALIZED (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT o.word, o.n, w.word, w.n FROM o JOIN w ON o.a || o.b = w.word
    UNION SELECT w.word, w.n, o.word, o.n FROM o JOIN w ON o.a || o.b = w.word),
f AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM q) WHERE k = 1 AND other_n >= 10 * n),
t AS (SELECT word, form AS goal, 1 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.goal = f.word),
c AS (SELECT word, count(*) AS n_near FROM q GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN f USING (word) LEFT JOIN c USING (word) LEFT JOIN (SELECT word, arg_max(goal, step) AS root FROM t GROUP BY word) USING (word)""",
    "op2_url_filter": f"""
WITH rules(rh, rp, action) AS (VALUES {_SQL_RULES}),
rest AS (SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, rid, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT rid, rh || rp AS rule, action,
    row_number() OVER (PARTITION BY rid ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, action = 'block' DESC) AS k
    FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)""",
    "op6_warc": """
WITH x AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
y AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM x),
z AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS v FROM y)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(v, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n >> 15 & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n >> 10 & 31 AS INT) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n >> 5 & 31 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(n & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM z""",
    "op7_substring": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^{_SP}]+') AS w FROM documents),
t AS (SELECT rid, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT d.rid, p AS pos, array_to_string(list_slice(w, p, p + 34), ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS u(p)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
c AS (SELECT t.rid, t.pos, t.word, max(CASE WHEN r.rid IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.rid ORDER BY t.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM t LEFT JOIN r ON t.rid = r.rid AND t.pos = r.pos),
s AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)""",
    "op9_quality": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SP}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SP}]')) AS ls FROM documents),
g AS (SELECT rid, p AS pos, array_to_string(list_slice(w, p, p + 2), ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(p)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(pos, pos + 3)) AS q FROM r) GROUP BY rid),
m AS (SELECT doc_id, t, w, len(ls) AS n_lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))}))) AS stops
    FROM d LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 1.5 AND 20 AND n_symbols / greatest(n_words, 1) <= 0.5
    AND stops / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND letters / greatest(word_chars, 1) >= 0.5 AS kept
FROM f""",
    "op8_decontaminate": f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
    FROM bw, unnest(range(1, CAST(greatest(len(w) - 8, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END) AS BIGINT))) AS u(p)),
ns AS (SELECT DISTINCT n FROM b),
g AS (SELECT rid, n, p AS pos, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dw, ns, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(p)),
h AS (SELECT g.rid, g.pos, b.n, b.item_id FROM g JOIN b ON g.g = b.g AND g.n = b.n),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS q FROM h) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
}
