"""Problem 3: a sample that is the same in every run and layout and never loses a key as data grows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import runtime

SHARE = Fraction(1, 10)


class SelectionLedger:
    """Persisted ledger of keys and draws below one folder, in versions; a version is one update of one or more rounds.

    Keys first seen in a version lie in fixed hash buckets, with their hash priority and the delivery they came with. A
    version's log entry, written last, holds the growth quota filled then and the priority up to which its keys are drawn:
    `cutoff` for all of them, or `cuts` by delivery where there was more than one round. Versions are append-only, so nothing later
    can take a key away. Keys of a version without an entry, left by a failure, don't count and are written over by the next
    try. A second ledger opened on the folder goes on where the first one stopped.
    """

    SCHEMA = "id STRING, priority STRING, delivery INT"

    def __init__(self, spark: SparkSession, path: str | None = None, share: Fraction = SHARE):
        if not 0 <= share <= 1:
            raise ValueError("share must lie between 0 and 1")
        self.spark, self.share = spark, share
        self.path = path or runtime.scratch(spark, "selection-ledger")
        self.rounds = runtime.log_entries(spark, f"{self.path}/log")
        n = self.rounds[-1]["buckets"] if self.rounds else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.store = runtime.Buckets(spark, f"{self.path}/keys", self.SCHEMA, "id", n)

    @property
    def deliveries(self) -> set[int]:
        return {d for r in self.rounds for d in r["deliveries"]}

    def _keys(self) -> DataFrame:
        return self.store.read().filter(F.col("version") < len(self.rounds))

    def update(self, ids: DataFrame, deliveries: list[int]) -> None:
        """One round: adds (id, delivery) rows of one or more deliveries; null, blank and repeated ids don't count.

        Deliveries that the ledger knows are topped up: what came late is new in this round.
        """
        self.extend(ids.select(runtime.canonical_uuid(F.col("id")).alias("id"), "delivery").filter("id IS NOT NULL"), deliveries, [])

    def extend(self, ids: DataFrame, late: list[int], fresh: list[int]) -> None:
        """One version of (id, delivery) rows with canonical ids: a round of all late deliveries, then one of each fresh one in order.

        Keys already in the ledger are taken out by anti-join, bucket by bucket; a key of several rounds is new in the first.
        A round's quota is what the share of all keys up to it exceeds the draws so far by; it goes to its new keys of lowest
        priority, and they suffice, as the share is at most 1. All rounds are written, counted and cut together: the passes over
        the keys don't grow with the number of deliveries.
        """
        version, own, first, at = len(self.rounds), F.col("delivery"), F.min("delivery"), F.lit(0)
        order = [*late[:1], *sorted(fresh)] if fresh else [0]  # a round goes by its delivery, that of the late ones by their first
        if fresh:
            at = F.when(own.isin(late), late[0]).otherwise(own) if late else own
            first = F.coalesce(F.min(F.when(own.isin(late), own)), first) if late else first
        new = self.store.aligned(ids.groupBy("id").agg(first.alias("delivery")))
        if self.rounds:
            new = new.join(self._keys().select("id"), "id", "left_anti")
        self.store.write(new.select("id", F.concat(F.md5("id"), "id").alias("priority"), "delivery"), version)
        new = self.store.read().filter(F.col("version") == version).select(at.alias("round"), "priority")
        sizes = {r["round"]: r["n"] for r in new.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}
        known, drawn, quotas = sum(r["n_new"] for r in self.rounds), sum(r["quota"] for r in self.rounds), {}
        for k in order:
            known += sizes.get(k, 0)
            quotas[k] = int(self.share * known) - drawn
            drawn += quotas[k]
        cuts = runtime.kth_smallest_by(new, "round", "priority", quotas, sizes)
        entry = {"deliveries": sorted([*late, *fresh]), "buckets": self.store.n, "n_new": sum(sizes.values()), "quota": sum(quotas.values())}
        entry |= {"cuts": [(d, cuts.get(late[0] if d in {*late} else d)) for d in entry["deliveries"]]} if fresh else {"cutoff": cuts.get(0)}
        runtime.commit_entry(self.spark, f"{self.path}/log", version, entry)
        self.rounds.append(entry)

    def selected(self) -> DataFrame:
        """(id, delivery) of all keys drawn so far; delivery is the one the key first came with. One cut a round or delivery is broadcast."""
        cuts = [(k, str(d), c) for k, r in enumerate(self.rounds) for d, c in r.get("cuts") or [("", r["cutoff"])] if c is not None]
        cuts = self.spark.createDataFrame(cuts, "version INT, part STRING, cutoff STRING")
        part = F.when(F.col("version").isin([k for k, r in enumerate(self.rounds) if "cuts" in r]), F.col("delivery").cast("string")).otherwise("")
        return self._keys().withColumn("part", part).join(F.broadcast(cuts), ["version", "part"]).filter("priority <= cutoff").select("id", "delivery")


def stable_sample(rows: DataFrame, share: Fraction = SHARE, path: str | None = None) -> DataFrame:
    """(id, delivery): a share of the distinct ids of (id, batch_no) rows, delivery by delivery; null batches come first.

    The rows are read once. With a path, the ledger there is carried on: deliveries that it knows are topped up first, in
    one round, if they brought anything new. No data comes to the driver but a size, a quota and a cut for each delivery.
    """
    spark = rows.sparkSession
    ledger = SelectionLedger(spark, path, share)
    ids = rows.select(runtime.canonical_uuid(F.col("id")).alias("id"), F.coalesce("batch_no", F.lit(-1)).cast("int").alias("delivery")).filter("id IS NOT NULL")
    ids = runtime.materialize(ids, "selection-ids")
    there, known = sorted(r[0] for r in ids.select("delivery").distinct().collect()), ledger.deliveries
    late, fresh = [d for d in there if d in known], [d for d in there if d not in known]
    if fresh or (late and not ids.join(ledger._keys().select("id"), "id", "left_anti").isEmpty()):
        ledger.extend(ids, late, fresh)
    return ledger.selected()


SQL_SAMPLE = """
WITH u AS (SELECT lower(regexp_replace(id, '[\\s{}]', '', 'g')) AS t, coalesce(batch_no, -1) AS delivery FROM prompts WHERE id IS NOT NULL),
ids AS (
  SELECT CASE WHEN regexp_full_match(replace(t, '-', ''), '[0-9a-f]{32}') THEN replace(t, '-', '') ELSE t END AS id, min(delivery) AS delivery
  FROM u WHERE t <> '' GROUP BY 1),
n AS (SELECT delivery, count(*) AS c FROM ids GROUP BY 1),
q AS (SELECT delivery, c, sum(c) OVER (ORDER BY delivery) AS upto FROM n),
r AS (SELECT id, delivery, row_number() OVER (PARTITION BY delivery ORDER BY md5(id) || id) AS k FROM ids)
SELECT r.id, r.delivery FROM r JOIN q USING (delivery) WHERE r.k <= upto // 10 - (upto - c) // 10
"""
