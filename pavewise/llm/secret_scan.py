"""Secret scans over a ledger of content-addressed blobs; DataFrame functions only.

Every version of every document is a blob named by the SHA-256 of its text. The ledger has, for each blob, the rule versions
it was scanned with and the spans they found. A run scans only pairs of blob and rule version that the ledger lacks, each
different text once, appends what it finds, and joins the ledger back to all paths that hold the blob.

Positions come from two lists of one expression: the matches and the gaps between them. Their lengths, in code points, are rows
of one text, and a match starts at the running sum of the lengths before it. Patterns never look at a character more than a
bounded number of times, so a text takes time in proportion to its length, however many matches it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pavewise.llm.common import pick, scratch, stored


@dataclass(frozen=True)
class Rule:
    """kind, version and a Java regular expression; a match counts if its group has at least ``least`` characters.

    Only texts that contain one of the hints (in lower case if folded) are scanned; every match must contain one.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    folded: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base rules in the order in which equal starts are listed (fixed patterns).
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds of credentials in public use (fixed patterns).
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("web_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1, ("eyJ",)),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
)
RULES = BASE + MORE
#: Code points of a chunk that redaction cuts from.
CHUNK = 512
SPAN = "struct<kind:string,rank:int,start:int,end:int>"
LEDGER = f"blob binary, rules array<string>, spans array<{SPAN}>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _hinted(rule: Rule, text: Column, low: Column) -> Column:
    where = low if rule.folded else text
    out = F.lit(not rule.hints)
    for h in rule.hints:
        out = out | F.contains(where, F.lit(h))
    return out


def _pieces(i: int, rule: Rule, matches: Column) -> Column:
    """(rule, place, gap, hit, part) of each match: lengths of the text before it, of itself and of its group, in code points."""
    parts = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), matches.alias("hit"), parts.alias("part"))
    lengths = lambda x, place: F.struct(F.lit(i).alias("rule"), place.alias("place"), *[F.coalesce(F.length(x[c]), F.lit(0)).alias(c) for c in ("gap", "hit", "part")])
    return F.when(F.size(matches) > 0, F.transform(zipped, lengths))


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of rows (blob, text, todo), one for each blob: the rules in todo applied to the text.

    The rows of a text's matches stay in the partition that its blob has been dealt to.
    """
    df = blobs.withColumn("low", F.lower("text"))
    for i, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.key) & _hinted(rule, F.col("text"), F.col("low"))
        df = df.withColumn(f"m{i}", F.when(wanted, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))))
    none = F.array().cast("array<struct<rule:int,place:int,gap:int,hit:int,part:int>>")
    pieces = F.flatten(F.array(*[F.coalesce(_pieces(i, rule, F.col(f"m{i}")), none) for i, rule in enumerate(rules)]))
    rows = df.select("blob", F.col("todo").alias("rules"), F.explode_outer(pieces).alias("p")).select("blob", "rules", "p.*")
    before = Window.partitionBy("blob", "rule").orderBy("place")  # the matches of one rule in one text
    end = F.sum(F.col("gap") + F.col("hit")).over(before).cast("int")
    least, kinds = F.array(*[F.lit(r.least) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    good = F.coalesce((F.col("hit") > 0) & (F.col("part") >= least[F.col("rule")]), F.lit(False))
    span = F.struct(kinds[F.col("rule")].alias("kind"), F.col("rule").alias("rank"), (F.col("end") - F.col("hit")).alias("start"), F.col("end"))
    spans = F.collect_set(F.when(good, span)).cast(f"array<{SPAN}>")  # spans of one text
    return rows.withColumn("end", end).groupBy("blob").agg(F.first("rules").alias("rules"), spans.alias("spans"))


def _ledger(spark, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None  # no ledger yet
    return spark.read.schema(LEDGER).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger (a folder that this function appends to) lacks of all rows' texts.

    Null texts are empty texts. Each different text is scanned once however many rows hold it: rows are combined by blob
    before the shuffle, so a text that a third of all rows hold is one row for each map task.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = pick(versions, text=text_col).select(blob_of(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    every = F.array(*[F.lit(r.key) for r in rules])
    if (old := _ledger(spark, ledger)) is not None:
        seen = old.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", every)
    _scanned(blobs, rules).write.mode("append").option("compression", "zstd").parquet(ledger)


def findings(df: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df's blobs that have spans under these rules: (blob, spans), spans by start, then the rules' order.

    Callers write it before they join it to paths: one row for each blob then meets all its paths through plain exchanges,
    and adaptive execution splits a blob that very many paths hold.

    A ledger row's spans count only for the rule versions that the row was scanned with, so what an older version of a
    rule found is left out. One call's rules have different kinds.
    """
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    old = df.sparkSession.read.schema(LEDGER).parquet(ledger)
    keys = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.key))])
    kept = F.filter(F.col("spans"), lambda s: F.coalesce(F.array_contains("rules", F.col("rule_keys")[s["kind"]]), F.lit(False)))
    rows = old.filter(F.size("spans") > 0).withColumns({"rule_kinds": kinds, "rule_keys": keys}).filter(F.exists("rules", lambda r: r.isin([x.key for x in rules])))
    ordered = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.col("rule_kinds")[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    per = rows.select("blob", F.explode(ordered).alias("s")).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))  # spans of one text
    return per


def scan_documents(df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) for each row of df; spans (start, rank, end, kind) by start, then rule; none: an empty list.

    Without a ledger path a new one is begun in the shared folder. Null and empty texts share one blob without spans;
    repeated rows get equal spans; an empty table gives none. Texts are scanned whole, however long, and extra columns,
    whatever their names, are not looked at.
    """
    spark = df.sparkSession
    ledger = ledger or scratch(spark, "secret-ledger")
    scan(df, ledger, rules, text_col)
    paths = pick(df, doc_id=id_col, text=text_col).select("doc_id", blob_of(F.col("text")).alias("blob"))
    found = stored(findings(df, ledger, rules), "secret-findings")
    none = F.array().cast(found.schema["spans"].dataType)
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts of base kinds, a digest of base spans and the list of all spans for rows of scan_documents."""
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def cuts(found: DataFrame) -> DataFrame:
    """(blob, keep, tail) of findings (blob, spans): the pieces (at, start) that stay before a mark, and where the rest begins.

    A span that begins before the end of an earlier one has no mark of its own.
    """
    rows = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end", "s.rank", "s.kind")
    earlier = Window.partitionBy("blob").orderBy("start", "rank", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)  # the spans of one text
    at = F.coalesce(F.max("end").over(earlier), F.lit(0))
    piece = F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))
    return rows.withColumn("at", at).groupBy("blob").agg(F.array_sort(F.collect_list(piece)).alias("keep"), F.max("end").alias("tail"))


def redacted(text: Column, keep: Column, tail: Column, mark: str = "[secret]") -> Column:
    """The text with a mark after each piece (at, start) of keep, and the rest from tail on.

    Pieces are cut out of chunks of CHUNK code points, so that a cut costs no walk through the whole text.
    """

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        head = F.substring(F.get(chunks, first), (start % CHUNK + 1).cast("int"), F.least(F.lit(CHUNK), end - first * CHUNK - start % CHUNK).cast("int"))
        body = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        foot = F.when(last > first, F.substring(F.get(chunks, last), F.lit(1), (end % CHUNK).cast("int"))).otherwise(F.lit(""))
        return F.concat(F.coalesce(head, F.lit("")), body, F.coalesce(foot, F.lit("")))

    def joined(chunks: Column) -> Column:
        pieces = F.transform(keep, lambda p: cut(chunks, p["at"], p["start"]))
        return F.array_join(F.concat(pieces, F.array(cut(chunks, tail, F.length(text)))), mark)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.get(F.transform(F.array(chunks), joined), F.lit(0))  # a variable of its own: the chunks are made once


def redact(df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with the spans in its texts replaced by a mark, and size_col set to the new length where a text changed.

    Runs of overlapping spans have one mark. Null and empty texts, and texts without spans, stay as they are; repeated rows are changed
    alike; texts of any length and with any number of spans take time in proportion to both. An empty table gives none.
    Columns, clashing names too, come out as they went in.
    """
    ledger = ledger or scratch(df.sparkSession, "secret-ledger")
    scan(df, ledger, rules, text_col)
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    found = stored(cuts(findings(df, ledger, rules)), "secret-cuts")
    out = flat.withColumn("_blob", blob_of(F.col(text))).join(found.withColumnRenamed("blob", "_blob"), "_blob", "left")
    out = out.withColumn(text, F.when(F.col("keep").isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col("keep"), F.col("tail"))))
    if size_col in names:
        n = f"c{names.index(size_col)}"
        out = out.withColumn(n, F.when(F.col("keep").isNull(), F.col(n)).otherwise(F.length(text).cast(flat.schema[n].dataType)))
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
