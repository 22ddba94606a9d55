"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its bytes. A ledger in the shared folder records which rules, at
which version, have seen which blob, and what they found. A scan reduces the texts to distinct blobs, runs each rule only
on blobs that the ledger does not hold under the rule's version, appends what is new, and joins findings back to every path.

Places: a rule's matches and the gaps between them are cut by the same expression, so their lengths add up to code-point
offsets; the sums run over exploded matches, not over growing arrays.

Defined results: a null text is the empty blob, which has no findings; equal texts share one blob and one scan; a null id
is a path like any other; an empty table appends nothing; changing a rule's version rescans for that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import new_path

#: A finding names its rule by kind and version, so it outlives any change of the list of rules.
LEDGER = "blob binary, scanned array<string>, found array<struct<start:int,end:int,key:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, which group must have how many characters, and the rule's version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns and lengths, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _cut(rule: Rule, number: int, text: Column, wanted: Column) -> Column:
    """Of each match of a rule its gap before and its length, and whether it is long enough."""
    # a cheap test first: most texts hold no match that is long enough, and need no cutting
    likely = {"hex": f"[0-9a-f]{{{rule.least}}}", "access": "AKIA[A-Z0-9]"}.get(rule.kind, rule.pattern)
    found = F.when(wanted & text.rlike(likely), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    gaps = F.when(F.size(found) > 0, F.split(text, rule.pattern, -1))

    def one(m, gap):
        held = m if not rule.group else F.regexp_extract(m, rule.pattern, rule.group)
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), (F.length(held) >= rule.least).alias("fits"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), one)
    return F.struct(F.lit(number).alias("rule"), pairs.alias("cuts"))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of distinct blobs (blob, text, seen array<string>): findings of the rules that have not seen them."""
    wanted = {r: ~F.array_contains("seen", r.key) for r in rules}
    cuts = F.array(*(_cut(r, k, F.col("text"), wanted[r]) for k, r in enumerate(rules)))
    todo = F.array_compact(F.array(*(F.when(wanted[r], F.lit(r.key)) for r in rules)))
    by_rule = blobs.select("blob", todo.alias("scanned"), cuts.alias("cuts")).select("blob", "scanned", F.filter("cuts", lambda c: F.size(c["cuts"]) > 0).alias("cuts"))
    rows = by_rule.select("blob", "scanned", F.explode_outer("cuts").alias("c"))
    rows = rows.select("blob", "scanned", F.col("c.rule").alias("rule"), F.posexplode_outer("c.cuts").alias("at", "cut"))
    upto = F.sum(F.col("cut.gap") + F.col("cut.size")).over(W.partitionBy("blob", "rule").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("end", upto.cast("int"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    span = F.when(F.col("cut.fits"), F.struct((F.col("end") - F.col("cut.size")).alias("start"), "end", F.get(keys, F.col("rule")).alias("key")))
    return placed.groupBy("blob", "scanned").agg(F.sort_array(F.collect_list(span)).alias("found"))


def _known(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None before its first scan."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(ledger) if there else None


def update(texts: DataFrame, ledger: str, text: str = "text", rules=RULES) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return the ledger's rows."""
    spark = texts.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = texts.select(blob_of(F.col(text)).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = _known(spark, ledger)
    if known is None:
        todo = blobs.withColumn("seen", F.lit([]).cast("array<string>"))
    else:
        seen = known.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))  # as many as rules
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.lit([]).cast("array<string>")))
        todo = todo.where(~F.forall(F.array(*(F.lit(r.key) for r in rules)), lambda k: F.array_contains("seen", k)))
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, found): findings of the rules' present versions, of blobs that have any; found numbers rules by their place
    in `rules`, whatever list they were scanned with."""
    now = F.array(*(F.lit(r.key) for r in rules))
    rows = ledger.where(F.size("found") > 0).select("blob", F.explode(F.filter("found", lambda x: F.array_contains(now, x["key"]))).alias("f"))
    numbered = rows.distinct().select("blob", F.struct("f.start", (F.array_position(now, F.col("f.key")) - 1).cast("int").alias("rule"), "f.end").alias("f"))
    return numbered.groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("found"))


def scan(texts: DataFrame, text: str = "text", ledger: str | None = None, rules=RULES) -> DataFrame:
    """All rows of texts (every path of every version) with blob and found, an array of (start, rule, end) by start, then rule."""
    ledger = ledger or new_path(texts.sparkSession, "ledger")
    found = findings(update(texts, ledger, text, rules), rules)
    none = F.lit([]).cast("array<struct<start:int,rule:int,end:int>>")
    paths = texts.drop("blob", "found").withColumn("blob", blob_of(F.col(text)))
    kept = [c for c in paths.columns if c != text]
    return paths.select(*kept).join(found, "blob", "left").withColumn("found", F.coalesce("found", none))


def spans(found: Column, rules=RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kinds[x["rule"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(found: Column, rule: int) -> Column:
    return F.size(F.filter(found, lambda x: x["rule"] == rule)).cast("long")
