"""Problem 2: records that differ only in formatting, collapsed by an incremental ledger of canonical keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import runtime

HOT_SHARE = 1000  # a key with more than one HOT_SHARE-th of all records is hot: there are fewer than HOT_SHARE such keys

LINE_SCHEMA = "category STRING, conversations ARRAY<STRUCT<role: STRING, content: STRING>>, _bad STRING"


def record_key(category: Column, conversations: Column) -> Column:
    """128-bit key of category and the ordered (role, content) list up to formatting.

    Null content and null role are empty; a null message counts as an empty one; a null category differs from
    every text. Order of JSON fields can't matter, as fields are taken by name.
    """
    blank = F.lit("")
    turns = F.transform(
        conversations,
        lambda m: F.concat(
            F.coalesce(runtime.canonical_text(m["role"]), blank), F.lit("\x01"), F.coalesce(runtime.canonical_text(m["content"]), blank)
        ),
    )
    cat = F.coalesce(F.concat(F.lit("c"), runtime.canonical_text(category)), F.lit("n"))
    return F.unhex(F.md5(F.concat(cat, F.lit("\x02"), F.array_join(turns, "\x03"))))


def parse_lines(lines: DataFrame) -> DataFrame:
    """prompt_lines that parse as one JSON object, as (line_no, category, conversations); broken lines are left out.

    A parsed line without conversations counts as one with an empty list.
    """
    got = F.from_json("raw_line", LINE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = F.expr("try_parse_json(raw_line) IS NOT NULL")
    return (
        lines.filter(F.col("raw_line").isNotNull() & whole)
        .select("line_no", got.alias("r"))
        .filter("r IS NOT NULL AND r._bad IS NULL")
        .select("line_no", "r.category", F.coalesce("r.conversations", F.array().cast("array<struct<role:string,content:string>>")).alias("conversations"))
    )


def records(prompts: DataFrame, lines: DataFrame) -> DataFrame:
    """(delivery, line_no, key) of every record. Prompts without messages are no records; raw lines come last."""
    a = prompts.filter(F.size("conversations") > 0).select(
        F.coalesce("batch_no", F.lit(-1)).cast("int").alias("delivery"), "line_no", record_key(F.col("category"), F.col("conversations")).alias("key")
    )
    b = parse_lines(lines).select(F.lit(2**31 - 1).alias("delivery"), "line_no", record_key(F.col("category"), F.col("conversations")).alias("key"))
    return a.unionByName(b)


class DuplicateLedger:
    """Counts per canonical key over all deliveries so far: (bucket, key, n_copies, first_line, first_delivery).

    The ledger lies below one folder in a fixed number of buckets of the key's hash. An update joins the delivery with
    the buckets that it touches and writes these anew, as one version; its log entry says which version holds each bucket, so
    all others stay where they are. Rows read after an update last until the second update behind it. What a failed
    update left is written over by the next try, as without a log entry it doesn't count. A second ledger opened on the
    folder goes on from the last entry, in whatever session.
    """

    SCHEMA = "bucket INT, key BINARY, n_copies BIGINT, first_line BIGINT, first_delivery INT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or runtime.scratch(spark, "dup-ledger")
        self.entries = runtime.log_entries(spark, f"{self.path}/log")
        n = self.entries[-1]["buckets"] if self.entries else buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.store = runtime.Buckets(spark, f"{self.path}/rows", self.SCHEMA, "key", n)

    @property
    def deliveries(self) -> list[int]:
        return [e["delivery"] for e in self.entries]

    def _at(self, places: dict[str, int], buckets: Iterable[int]) -> DataFrame:
        """The rows of some buckets, each in the version that holds it."""
        by: dict[int, list[int]] = {}
        for b in buckets:
            if str(b) in places:
                by.setdefault(places[str(b)], []).append(b)
        if not by:
            return self.spark.createDataFrame([], self.SCHEMA)
        own = F.lit(False)
        for v, bs in by.items():
            own = own | ((F.col("version") == v) if len(bs) == self.store.n else (F.col("version") == v) & F.col("bucket").isin(bs))
        return self.store.read().filter(own).drop("version")

    @property
    def rows(self) -> DataFrame:
        """All counts so far; no rows before the first update."""
        return self._at(self.entries[-1]["places"] if self.entries else {}, range(self.store.n))

    def touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(self.store.bucket().alias("b")).distinct().collect()]

    def update(self, batch: DataFrame, delivery: int, touched: list[int] | None = None) -> None:
        """Adds one delivery (line_no, key); one that the ledger has is left as it is. The earliest line represents.

        The delivery is counted per key before it meets the ledger, so a key that fills a third of it is one row of
        the join. Neither side of the full outer join is exchanged but for that count.
        """
        if delivery in self.deliveries:
            return
        touched = self.touched(batch) if touched is None else touched
        version, places = len(self.entries), dict(self.entries[-1]["places"]) if self.entries else {}
        if touched:
            new = self.store.aligned(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line")))
            out = self._at(places, touched).drop("bucket").join(new, "key", "full_outer").select(
                self.store.bucket().cast("int").alias("bucket"),
                "key",
                (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_copies"),
                F.least("first_line", "line").alias("first_line"),
                F.coalesce("first_delivery", F.lit(delivery)).alias("first_delivery"),
            )
            self.store.write(out, version)
            places.update((str(b), version) for b in touched)
        entry = {"delivery": delivery, "buckets": self.store.n, "places": places}
        runtime.commit_entry(self.spark, f"{self.path}/log", version, entry)
        before = set(self.entries[-1]["places"].values()) if self.entries else set()
        older = set(self.entries[-2]["places"].values()) if len(self.entries) > 1 else set()
        self.entries.append(entry)
        for v in older - before - set(places.values()):
            self.store.drop(v)


def build_ledger(recs: DataFrame, path: str | None = None) -> tuple[DataFrame, DuplicateLedger]:
    """Canonical keys written once by delivery, then every delivery that the ledger lacks added in order. Returns (keys, ledger)."""
    spark = recs.sparkSession
    keys = runtime.materialize(recs, "dup-keys", ["delivery"])
    ledger = DuplicateLedger(spark, path)
    # buckets by delivery: as many numbers as the ledger has buckets for each
    touched = {r[0]: r[1] for r in keys.groupBy("delivery").agg(F.collect_set(ledger.store.bucket()).alias("b")).collect()}
    for d in sorted(touched):
        ledger.update(keys.filter(F.col("delivery") == d).select("line_no", "key"), d, touched[d])
    return keys, ledger


def collapse(prompts: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per distinct record: (line_no of the earliest copy, n_copies, first_delivery). No records: no rows."""
    _, ledger = build_ledger(records(prompts, lines))
    return ledger.rows.select(F.col("first_line").alias("line_no"), "n_copies", "first_delivery")


def duplicate_pairs(prompts: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_a, line_b): every record but the first of its group beside the group's first. Lone records give no row.

    Keys above a thousandth of all records, under a thousand of them, are looked up by broadcast, so no reducer gets
    such a group; all other keys go through a shuffle join on the key.
    """
    keys, ledger = build_ledger(records(prompts, lines))
    counts = ledger.rows
    many = counts.filter("n_copies > 1").select("key", "n_copies", "first_line")
    total = counts.agg(F.sum("n_copies")).first()[0] or 0
    bar = max(1, total // HOT_SHARE)
    hot = F.broadcast(many.filter(F.col("n_copies") > bar).select("key", "first_line"))
    rest = many.filter(F.col("n_copies") <= bar).select("key", "first_line")
    rows = keys.select("key", "line_no")
    both = rows.join(hot, "key", "inner").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(rest, "key", "inner"))
    return both.filter("line_no <> first_line").select(F.col("first_line").alias("line_a"), F.col("line_no").alias("line_b"))
