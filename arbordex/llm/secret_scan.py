"""Secret scans over an incremental blob ledger.

Every text version is addressed by the SHA-256 of its content. The ledger remembers which
(blob, rule) pairs have been scanned and what was found; a scan looks only at pairs that it does not
hold, and findings are joined back to every path that carries the blob. Copies of a text, old
versions and unchanged files of a later crawl therefore cost one look-up, and a new rule version
scans old blobs with that rule alone.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import drop_at_end, materialize, temporary_path


@dataclass(frozen=True)
class SecretRule:
    """A pattern, the group whose length counts (0: the match) and the least length.

    Matches are leftmost and do not overlap; those that are too short are dropped afterwards, so
    what they cover is not searched again. hint: a plain string without which nothing can match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1


#: Fixed kinds, in the order in which spans at one place are listed.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    SecretRule("hex", r"[0-9a-f]+", 0, 16),
)
#: Every run that a failing match may read again has a bound, so the time grows with the text alone.
EXTRA_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60, "PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{1,900}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    SecretRule("prefixed", r"(?:ghp_|gho_|ghs_|glpat-|xoxb-|xoxp-|sk_live_|AIza)[A-Za-z0-9_-]+", 0, 24),
    SecretRule("url_login", r"[a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,200}:([^\x00-\x20/@]{1,200})@", 1, 4, "://"),
)

#: Blobs with unseen pairs are broadcast up to this number (a hash and the rules' names each), else joined by a shuffle.
BROADCAST_BLOBS = 200_000
_LEDGER = "blob string, kind string, version int, spans array<struct<start:long,stop:long>>"


def _least_pattern(rule: SecretRule) -> str:
    """For rules without a group, a final run of least characters can stand in the pattern itself."""
    if rule.kind == "hex":
        return rf"[0-9a-f]{{{rule.least},}}"
    return rule.pattern


def _pieces(text: Column, rule: SecretRule) -> Column:
    """One struct per match: length of the gap before it, of the match, and of the group that counts."""
    pattern = F.lit(_least_pattern(rule))
    gaps = F.transform(F.split(text, _least_pattern(rule), -1), lambda x: F.length(x))
    match = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    counted = match if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x))
    found = F.zip_with(gaps, F.zip_with(match, counted, lambda a, n: F.struct(a.alias("len"), n.alias("n"))), lambda g, m: F.struct(g.alias("gap"), m["len"].alias("len"), m["n"].alias("n")))
    found = F.filter(found, lambda x: x["len"].isNotNull())  # the gap after the last match has none
    possible = text.rlike(_least_pattern(rule))
    if rule.hint:
        possible = F.contains(text, F.lit(rule.hint)) & possible
    return F.when(possible, found)


def _scan(blobs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob, kind, version, spans) with findings of the rules that each blob's kinds name (null: all), for pairs with findings only."""

    def asked(rule: SecretRule) -> Column:
        return F.col("kinds").isNull() | F.array_contains("kinds", rule.kind)

    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(asked(r), _pieces(F.col("text"), r)).alias("found")) for r in rules])
    hits = blobs.select("blob", F.explode(F.filter(kinds, lambda x: x["found"].isNotNull())).alias("k")).select("blob", "k.kind", "k.version", "k.least", F.posexplode("k.found").alias("i", "m"))
    # places are running sums of gaps and matches, within one blob and kind
    before = Window.partitionBy("blob", "kind", "version").orderBy("i")
    stop = F.sum(F.col("m.gap") + F.col("m.len")).over(before)
    spans = hits.withColumn("stop", stop.cast("long")).where(F.col("m.n") >= F.col("least"))
    span = F.struct((F.col("stop") - F.col("m.len")).cast("long").alias("start"), F.col("stop").alias("stop"))
    return spans.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))


class BlobLedger:
    """A folder of Parquet batches: findings per (blob, kind, version), and the scanned blobs per rule set.

    Without a path the ledger lasts as long as the application.

    Batches are only added. A batch written twice after a failure holds equal rows, which reading
    removes; findings are written before the blobs are marked as scanned, so a lost run is redone.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or temporary_path(spark, "ledger")
        self._temporary = path is None
        self._has = path is not None and self._exists()

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def scanned(self) -> DataFrame | None:
        """(blob, kind, version) pairs that need no scan."""
        return self.spark.read.schema("blob string, kind string, version int").parquet(f"{self.path}/scanned").distinct() if self._has else None

    def findings(self) -> DataFrame:
        return self.spark.read.schema(_LEDGER).parquet(f"{self.path}/findings").dropDuplicates(["blob", "kind", "version"])

    def update(self, versions: DataFrame, rules: tuple[SecretRule, ...]) -> None:
        """Scan what versions (blob, text) holds beyond the ledger.

        What is unseen is found over keys alone; then the texts of blobs with an unseen pair move
        once, whatever the number of rules.
        """
        known, every = self.scanned(), F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        if known is None:
            blobs = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("kinds", F.lit(None).cast("array<string>"))
            pairs = versions.select("blob").distinct().select("blob", F.explode(every).alias("p")).select("blob", "p.*")
        else:
            pairs = versions.select("blob").distinct().select("blob", F.explode(every).alias("p")).select("blob", "p.*")
            pairs = materialize(pairs.join(known, ["blob", "kind", "version"], "left_anti"), "unseen")
            todo = materialize(pairs.groupBy("blob").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), "todo")
            todo = F.broadcast(todo) if todo.count() <= BROADCAST_BLOBS else todo
            blobs = versions.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds"))
        _scan(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        pairs.write.mode("append").parquet(f"{self.path}/scanned")
        if self._temporary:
            drop_at_end(self.spark, self.path)
        self._has = True


def scan_versions(docs: DataFrame, rules: tuple[SecretRule, ...] = (*BASE_RULES, *EXTRA_RULES), ledger: BlobLedger | None = None) -> DataFrame:
    """docs (any columns, with text) plus blob and findings: array of (start, stop, kind), by start and rule order.

    A null text is empty and has no findings. Texts are scanned whole, whatever their length; a row
    without doc_id is scanned like any other, and an empty table gives an empty result. Equal texts share one scan whatever their number;
    repeated rows each come back. Columns named blob or findings in docs are replaced.
    """
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark)
    docs = docs.drop("blob", "findings").withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    ledger.update(docs.select("blob", F.coalesce("text", F.lit("")).alias("text")), rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    rows = ledger.findings().where(F.col("version") == current[F.col("kind")]).select("blob", "kind", F.explode("spans").alias("s"))
    span = F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("ord"), F.col("s.stop").alias("stop"), F.col("kind"))
    per_blob = rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("findings"))
    empty = F.array().cast("array<struct<start:long,ord:int,stop:long,kind:string>>")
    return docs.join(materialize(per_blob, "findings"), "blob", "left").withColumn("findings", F.coalesce("findings", empty))
