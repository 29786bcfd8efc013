"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its bytes. Only blobs that a rule version has
not seen are scanned, once each, however many paths and versions hold them; the findings are kept
with (blob, rule_version) and joined back to all paths. A second run over the same ledger scans only
what is new, and a new rule version scans everything again.

Cases: a null text is the empty blob; repeated rows share a blob, which is scanned once, and are
reported each; a blob without findings stays in the ledger, so it is not scanned again. Spans are code
points, end exclusive, of the whole match; spans that begin alike come in the order of the rules. Very
long texts are scanned whole, in memory of a few times their length. Null paths are paths like others.
Other columns are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm.common import map_texts, materialize

#: Fixed values: (kind, pattern, group whose length counts, least length), in the order that settles ties of start.
BASE_RULES = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
_LINE = r"(?:[ \t]*(?:\r?\n|\r|\\r\\n|\\n))"
_PEM = (
    r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    rf"|(?:{_LINE}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_LINE}+[A-Za-z0-9+/=]++(?=[ \t]*(?:[\r\n]|\\[nr]|\Z)))*)"
)
#: What this operator adds to them: a PEM private key up to its END line, or where none comes before another BEGIN, its base64 lines.
ADDED_RULES = [("pem", _PEM, 0, 1)]
RULES = BASE_RULES + ADDED_RULES
RULE_VERSION = "1.1"
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", SPANS)])


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = []
        for rank, (kind, pattern, group, least) in enumerate(rules):
            # a run of one class that must be long: the engine may as well skip the short ones itself
            single = re.fullmatch(r"([A-Z]*)(\[[^\]]+\])\+", pattern)
            if group == 0 and single:
                pattern = f"{single[1]}{single[2]}{{{max(1, least - len(single[1]))},}}"
            self.rules.append((rank, kind, re.compile(pattern), group, least))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then in the order of the rules."""
        found = [(m.start(), rank, kind, m.end()) for rank, kind, rule, group, least in self.rules for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]
        return [(kind, a, b) for a, _, kind, b in sorted(found)]


def blob_id(content: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str, content: str, ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): findings has (path, blob, spans) for each row of versions; additions are the new rows of the ledger.

    The ids are written first (path and 32 bytes a row). A blob's text is fetched at one path that
    has it; that side of the join holds a blob once, so no group of copies travels together.
    """
    rows = versions.select(F.col(path).alias("path"), F.col(content).alias("content"))
    ids = materialize(rows.select("path", blob_id("content").alias("blob")), "blobs")
    unseen = ids.groupBy("blob").agg(F.min(F.struct("path")).alias("at")).select("blob", F.col("at.path").alias("at"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # by a hash of the path: join and removal of repeated rows then need one shuffle and one sort, and what paths of one hash hold is the same blob
    fetched = rows.withColumns({"blob": blob_id("content"), "at": F.xxhash64("path")}).join(
        unseen.select(F.col("blob").alias("_blob"), F.xxhash64("at").alias("_at")), (F.col("blob") == F.col("_blob")) & (F.col("at") == F.col("_at")), "left_semi"
    ).dropDuplicates(["blob", "at"])

    def run(part):
        scanner = Scanner(rules)
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(x or "")] for x in part.column("content").to_pylist()]
        return [part.column("blob"), pa.array([rule_version] * part.num_rows, pa.string()), spans]

    added = materialize(map_texts(fetched.select("blob", "content"), run, LEDGER, "content").dropDuplicates(["blob"]), "ledger")
    known = added if ledger is None else added.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version", "spans").dropDuplicates(["blob"]))
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    found = ids.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return found, added


def redact(text: str, spans: str, mask: str = "[secret]") -> F.Column:
    """The text with each union of overlapping spans replaced by the mask (native)."""
    step = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s.getField("end") <= acc.getField("at"), acc.getField("out"))
            .when((s.getField("start") < acc.getField("at")) & (acc.getField("at") > 0), acc.getField("out"))
            .otherwise(F.concat(acc.getField("out"), F.substring(F.col(text), (acc.getField("at") + 1).cast("int"), (s.getField("start") - acc.getField("at")).cast("int")), F.lit(mask)))
            .alias("out"),
            F.greatest(acc.getField("at"), s.getField("end")).alias("at"),
        ),
        lambda acc: F.concat(acc.getField("out"), F.substring(F.col(text), (acc.getField("at") + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(F.col(text))
