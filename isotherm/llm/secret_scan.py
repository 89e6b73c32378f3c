"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of the whole text).
The ledger holds a row for each (blob, rule, rule version) ever scanned, hits or
not; a scan takes only the pairs the ledger lacks, one representative path
per blob, appends them, and joins findings back to all paths.  The text is
shuffled once, by the unique path of its representative, so a blob that a third of all
paths hold is scanned once and is no hot key.

Positions come from built-in functions: the pieces between matches and the
matches themselves alternate, so running sums of their lengths give each start; a rule takes a
pass over the text, and another over texts with a match.  Work is linear in the text and the findings.

Null text counts as empty.  Rows that repeat a path and text give equal rows
again.  Extra columns are ignored, and pass through ``redact_secrets`` whatever their names; a null path is a path.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.chat_format import starts_of
from isotherm.llm.store import new_folder, small, stage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; with ``group``, that group must have ``least`` characters."""

    name: str
    version: str
    pattern: str
    group: int = 0
    least: int = 0


#: fixed values: kinds in the order of listing.  A run of hex digits or capitals
#: that is long enough is a match exactly if the unbounded run is one.
RULES = (
    Rule("assign", "1", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "1", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", "1", r"[0-9a-f]{24,}"),
)
LEDGER = "blob string, rule string, version string, spans array<struct<start:int,stop:int>>"
_SPANS = "array<struct<start:int,stop:int>>"
#: a row of unseen pairs counts as so many rows of ``store.BROADCAST_ROWS``
UNSEEN_WEIGHT = 50
#: scans of the query, one after another against one ledger
INCREMENTS = 2


def matched(text: Column, rule: Rule) -> Column:
    """The rule's matches, whole: one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


def lengths_around(text: Column, matches: str, rule: Rule) -> Column:
    """Per match: code points before it (since the last), its own, and those of what is judged; a second pass, where there is a match."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    # the group is found again in the match itself, not in the text
    judged = F.transform(matches, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.transform(matches, F.length)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("n"), judged.alias("judged"))
    return F.when(F.size(matches) > 0, rows).otherwise(F.array().cast("array<struct<gap:int,n:int,judged:int>>"))


def _at_least(n: int) -> Callable[[Column], Column]:
    return lambda p: p["z"]["judged"] >= n


def spans_of(texts: DataFrame, rules: tuple[Rule, ...], text_of: Callable[[Rule], Column]) -> DataFrame:
    """``texts`` and an array column of spans for each rule, named ``_0`` and so on: starts and exclusive ends in code points.

    ``text_of`` gives the text that a rule reads, null for none.  Each step is a column of its own, so that none is
    computed twice, and running sums go in pieces: linear in the matches.
    """
    out = texts
    for i, r in enumerate(rules):
        done = [*texts.columns, *[f"_{k}" for k in range(i)]]
        out = out.select(*done, matched(text_of(r), r).alias("_m"))
        out = out.select(*done, lengths_around(text_of(r), "_m", r).alias("_z"))
        out = out.select(*done, "_z", F.transform("_z", lambda z: z["gap"] + z["n"]).alias("_l"))
        out = out.select(*done, F.arrays_zip(F.col("_z").alias("z"), starts_of("_l").alias("at")).alias("_p"))
        kept = F.filter("_p", _at_least(r.least))
        start = lambda p: p["at"] + p["z"]["gap"]
        out = out.select(*done, F.transform(kept, lambda p: F.struct(start(p).alias("start"), (start(p) + p["z"]["n"]).alias("stop"))).alias(f"_{i}"))
    return out


class BlobLedger:
    """A Parquet table of scanned (blob, rule, version) pairs that only grows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_folder(spark, "ledger")
        self.filled = path is not None and self._exists()

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        if not self.filled:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen and appends it; returns ``path, blob`` of all versions given."""
        paths = versions.select(F.col(path_col).alias("path"), F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("blob"))
        wanted = paths.groupBy("blob").agg(F.min("path").alias("rep"))
        if self.filled:
            seen = self.read().groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
            wanted = wanted.join(seen, "blob", "left")
        else:
            wanted = wanted.withColumn("seen", F.lit(None).cast("array<string>"))
        names = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
        wanted = wanted.withColumn("unseen", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("unseen") > 0).drop("seen")
        wanted = stage(wanted, "unseen")
        # few new blobs: no text is shuffled
        wanted = small(wanted, wanted.count() * UNSEEN_WEIGHT)
        texts = versions.select(F.col(path_col).alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        blobs = texts.join(wanted.withColumnRenamed("rep", "r"), F.col("rep").eqNullSafe(F.col("r")))
        # the representative's path may have other versions
        own = blobs.where(F.sha2(F.encode("text", "UTF-8"), 256) == F.col("blob"))
        fresh = lambda r: F.array_contains("unseen", f"{r.name}@{r.version}")
        spans = spans_of(own.select("blob", "unseen", "text"), rules, lambda r: F.when(fresh(r), F.col("text")))
        found = F.array(*[F.when(fresh(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.col(f"_{i}").alias("spans"))) for i, r in enumerate(rules)])
        rows = spans.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
        rows.dropDuplicates(["blob", "rule", "version"]).write.mode("append").parquet(self.path)
        self.filled = True
        return paths

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, found`` (sorted structs start, order, kind, stop) of blobs with a finding."""
        current = F.concat_ws("@", "rule", "version").isin([f"{r.name}@{r.version}" for r in rules])
        order = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
        hits = self.read().where(current & (F.size("spans") > 0))
        spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("order"), F.col("rule").alias("kind"), s["stop"].alias("stop")))
        return hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("found"))


def scan_secrets(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob, found`` for every row of ``docs``; ``found`` is empty where nothing is."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = ledger.scan(docs, path_col, text_col, rules)
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int>>")
    return paths.join(ledger.findings(rules), "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))


def scan_in_increments(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text", increments: int = INCREMENTS, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_secrets`` of all rows, which arrive in ``increments`` parts: each scan takes what the ledger lacks by then."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    part = F.pmod(F.xxhash64(path_col), F.lit(increments))
    paths = [ledger.scan(docs.where(part == k), path_col, text_col, rules) for k in range(increments)]
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int>>")
    every = functools.reduce(DataFrame.unionByName, paths)
    return every.join(ledger.findings(rules), "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scan_in_increments(docs)
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(r.name) for r in RULES], joined.alias("spans")).withColumn("base_sha256", F.sha2(F.encode("spans", "UTF-8"), 256))


def redact_secrets(docs: DataFrame, text_col: str = "text", path_col: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of a text replaced by ``mask``; overlapping spans are replaced as one."""
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(docs, path_col, text_col)
    found = stage(ledger.findings(), "findings")
    size = found.agg(F.sum(F.size("found"))).first()[0] or 0
    # the row as a struct: no column of it can clash with what stands beside it
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256).alias("blob"))
    both = held.join(small(found, size), "blob", "left")
    runs = both.select("row", "text", F.when(F.col("found").isNotNull(), runs_between("found")).alias("runs"))
    masked = runs.select("row", F.when(F.col("runs").isNull(), F.col("text")).otherwise(without("text", "runs", mask)).alias("clean"))
    return masked.select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


#: spans that one cut of the text serves
PIECE = 256


def runs_between(found: str) -> Column:
    """Of sorted spans, per run of up to ``PIECE`` of them: where the text before them is read up to (``at``), and the spans (start, stop)."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int"))
    cut = F.transform(numbers, lambda k: F.transform(F.slice(found, k * PIECE + 1, PIECE), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,spans:{_SPANS}>>").alias("runs"))

    def step(a: Column, spans: Column) -> Column:
        far = F.greatest(a["at"], F.array_max(F.transform(spans, lambda s: s["stop"])))
        return F.struct(far.alias("at"), F.array_append(a["runs"], F.struct(a["at"].alias("at"), spans.alias("spans"))).alias("runs"))

    return F.aggregate(cut, zero, step, lambda a: a["runs"])


def without(text: str, runs: str, mask: str) -> Column:
    """The text with each span (or what overlapping spans cover together) replaced.

    Each run has its part of the text cut out once, and its spans are cut from that part; parts are joined once.
    """
    whole = F.col(text)
    end = lambda r: F.greatest(r["at"], F.array_max(F.transform(r["spans"], lambda s: s["stop"])))
    parts = F.transform(runs, lambda r: F.struct(r["at"].alias("at"), r["spans"].alias("spans"), whole.substr(r["at"] + 1, end(r) - r["at"]).alias("part")))

    def masked(r: Column) -> Column:
        zero = F.struct(r["at"].alias("at"), F.array().cast("array<string>").alias("done"))

        def step(a: Column, s: Column) -> Column:
            between = F.concat(r["part"].substr(a["at"] - r["at"] + 1, s["start"] - a["at"]), F.lit(mask))
            return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], F.array_append(a["done"], between)).otherwise(a["done"]).alias("done"))

        return F.array_join(F.aggregate(r["spans"], zero, step, lambda a: a["done"]), "")

    last = F.aggregate(runs, F.lit(0), lambda a, r: end(r))
    return F.concat(F.array_join(F.transform(parts, masked), ""), whole.substr(last + 1, F.length(whole)))
