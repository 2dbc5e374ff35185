"""The loop around the tagging stream: retries, dead letters, work in flight.

Everything is read from the messages and the stream's outcomes, so nothing is lost
when a driver stops: what was delivered and has no outcome is in flight. A delivery is
named by snippet, run (the round of queueing that it belongs to) and attempt.

``settle`` closes the books on the batches that are through: it writes their dead
letters, the retries still owed and the totals per run, and then a manifest row that
names both. From then on only later batches and the messages still in the folder are
read; with an archive for read messages that is what is left to do, however much went
through before. A stop between these writes changes nothing, as only the manifest counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.config import MESSAGE_PRIORITY
from tagloom.functions.errors import DEAD, RETRY
from tagloom.session import materialize
from tagloom.sources.messages import dead_letters, delivery_key
from tagloom.sources.schemas import MESSAGES
from tagloom.streaming.tagging import read_results

DELIVERY = ["snippet_id", "run", "attempts"]
MANIFEST = "version bigint, batch_id bigint"
OWED = "snippet_id string, run bigint, attempts int, next_at bigint"
SETTLED = "snippet_id string, run bigint, attempts int"
RUNS = (
    "run bigint, queued bigint, deliveries bigint, acknowledged bigint, "
    "dead_letters bigint, newest bigint"
)
DEAD_LETTERS = (
    "snippet_id string, run bigint, attempts int, error string, kind string, batch_id bigint"
)


@dataclass(frozen=True)
class Queue:
    """A file queue: messages, the stream's results and the dead letters."""

    spark: SparkSession
    messages: str
    results: str
    dead: str

    def _read(self, path: str, schema, fmt: str = "parquet") -> DataFrame:
        try:
            return self.spark.read.format(fmt).schema(schema).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @cached_property
    def _books(self) -> str:
        return f"{self.results}/ledger"

    def _mark(self) -> tuple[int, int]:
        """Number of the last settlement and the newest batch in it."""
        log = self._read(f"{self._books}/manifest", MANIFEST, "json")
        last = log.orderBy(F.desc("version")).limit(1).collect()
        return (last[0]["version"], last[0]["batch_id"]) if last else (0, -1)

    def _book(self, name: str, schema: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self._read(f"{self._books}/{name}/{version:08d}", schema)

    def delivered(self) -> DataFrame:
        """The messages in the folder; archived ones are through."""
        return self._read(self.messages, MESSAGES)

    def outcomes(self, behind: int = -1) -> DataFrame:
        """What became of deliveries in the batches behind ``behind``."""
        rows = read_results(self.spark, self.results, "outcomes")
        attempts = F.coalesce("attempts", F.lit(1))
        return rows.where(F.col("batch_id") > behind).withColumn("attempts", attempts)

    def _waiting(self) -> DataFrame:
        return self.delivered().select(*delivery_key()).distinct()

    def _settled(self, version: int, batch_id: int) -> DataFrame:
        """Deliveries with an outcome; before the mark only those still in the folder."""
        fresh = self.outcomes(batch_id).select(*DELIVERY)
        return self._book("settled", SETTLED, version).unionByName(fresh).distinct()

    def _owed(self, version: int, batch_id: int) -> DataFrame:
        """Retries to come: neither in the folder nor settled."""
        fresh = self.outcomes(batch_id).where(F.col("action") == RETRY)
        later = fresh.select(
            "snippet_id", "run", (F.col("attempts") + 1).alias("attempts"), "next_at"
        )
        return (
            self._book("owed", OWED, version).unionByName(later)
            .groupBy(*DELIVERY).agg(F.min("next_at").alias("next_at"))
            .join(self._waiting(), DELIVERY, "left_anti")
            .join(self._settled(version, batch_id), DELIVERY, "left_anti")
        )

    def in_flight(self) -> DataFrame:
        """``snippet_id`` of messages without an outcome and of retries to come."""
        mark = self._mark()
        unsettled = self._waiting().join(self._settled(*mark), DELIVERY, "left_anti")
        # a retry that is not in the queue yet is as good as queued
        owed = self._owed(*mark)
        return unsettled.select("snippet_id").unionByName(owed.select("snippet_id")).distinct()

    def feed_retries(self, now_ms: int) -> int:
        """Queue every retry due by ``now_ms`` that is not queued yet; how many."""
        due = materialize(
            self._owed(*self._mark()).where(F.col("next_at") <= now_ms).select(
                "snippet_id",
                F.lit(now_ms).cast("bigint").alias("timestamp"),
                F.lit(MESSAGE_PRIORITY).alias("priority"),
                "attempts", "run",
            ),
            "due",
        )
        count = due.count()
        if count:
            due.select(*MESSAGES.names).write.mode("append").parquet(self.messages)
        return count

    def settle(self) -> bool:
        """Close the books on all finished batches; True if there were any new ones."""
        version, batch_id = self._mark()
        fresh = self.outcomes(batch_id)
        newest = fresh.agg(F.max("batch_id")).first()[0]
        if newest is None:
            return False
        following = version + 1

        def write(df: DataFrame, name: str, schema: str) -> None:
            columns = [part.split()[0] for part in schema.split(", ")]
            path = f"{self._books}/{name}/{following:08d}"
            df.select(*columns).write.mode("overwrite").parquet(path)

        # a stream that goes on meanwhile only adds batches behind ``newest``
        fresh = materialize(fresh.where(F.col("batch_id") <= newest), "fresh")
        dead_letters(fresh).dropDuplicates(DELIVERY).select(
            *(part.split()[0] for part in DEAD_LETTERS.split(", "))
        ).write.mode("overwrite").parquet(f"{self.dead}/settled={following}")
        write(self._owed(version, batch_id), "owed", OWED)
        still_there = self._settled(version, batch_id).join(self._waiting(), DELIVERY, "left_semi")
        write(still_there, "settled", SETTLED)
        totals = self._book("runs", RUNS, version).unionByName(_run_totals(fresh))
        write(
            totals.groupBy("run").agg(
                *(F.sum(c).alias(c) for c in ("queued", "deliveries", "acknowledged", "dead_letters")),
                F.max("newest").alias("newest"),
            ),
            "runs", RUNS,
        )
        self.spark.createDataFrame([(following, newest)], MANIFEST).coalesce(1).write.mode(
            "append"
        ).json(f"{self._books}/manifest")
        return True

    def write_dead_letters(self) -> None:
        """The dead letters so far, each delivery once."""
        self.settle()

    def read_dead_letters(self) -> DataFrame:
        """Dead letters of all settled batches."""
        version, _ = self._mark()
        rows = self._read(self.dead, f"{DEAD_LETTERS}, settled bigint")
        return rows.where(F.col("settled") <= version).drop("settled")

    def runs(self) -> DataFrame:
        """Totals per round: messages, deliveries with an outcome, and how they ended."""
        version, batch_id = self._mark()
        return (
            self._book("runs", RUNS, version)
            .unionByName(_run_totals(self.outcomes(batch_id)))
            .groupBy("run").agg(
                *(F.sum(c).alias(c) for c in ("queued", "deliveries", "acknowledged", "dead_letters")),
                F.max("newest").alias("newest"),
            )
        )

    def state(self) -> DataFrame:
        """One row: messages in flight, acknowledged, dead, and the state.

        ``idle`` before the first message, ``processing`` while any is in flight,
        then ``completed`` with the time of the newest message.
        """
        mark = self._mark()
        unsettled = self._waiting().join(self._settled(*mark), DELIVERY, "left_anti")
        flying = self.in_flight().agg(F.count("*").alias("in_flight"))
        final = self.runs().agg(
            F.sum("deliveries").alias("queued"), F.sum("acknowledged").alias("acknowledged"),
            F.sum("dead_letters").alias("dead_letters"), F.max("newest").alias("newest"),
        )
        queued = unsettled.agg(F.count("*").alias("queued"))
        newest = self.delivered().agg(F.max("timestamp").alias("newest"))
        state = F.when(F.col("queued") == 0, "idle").when(
            F.col("in_flight") > 0, "processing"
        ).otherwise("completed")
        one_row = reduce(
            lambda x, y: x.unionByName(y, allowMissingColumns=True),
            (queued, flying, final, newest),
        ).agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(c)
              for c in ("queued", "in_flight", "acknowledged", "dead_letters")),
            F.max("newest").alias("newest"),
        )
        return one_row.select(
            "queued", "in_flight", "acknowledged", "dead_letters", state.alias("status"),
            F.when(state == "completed", F.timestamp_millis("newest")).alias("completed_at"),
        )

    def check_idle(self) -> None:
        """Refuses to queue a backlog again while messages are in flight."""
        waiting = self.in_flight().count()
        if waiting:
            raise RuntimeError(f"{waiting} snippets are in flight; resume or wait for them")


def _run_totals(outcomes: DataFrame) -> DataFrame:
    """``RUNS`` of some batches; a delivery that was tried twice counts once."""
    once = outcomes.groupBy(*DELIVERY).agg(
        F.min("failed").alias("failed"), F.max(F.col("action") == DEAD).alias("dead"),
        F.max("queued_at").alias("queued_at"),
    )
    return once.groupBy("run").agg(
        F.count_if(F.col("attempts") == 1).alias("queued"),
        F.count("*").alias("deliveries"),
        F.count_if(~F.col("failed")).alias("acknowledged"),
        F.count_if("dead").alias("dead_letters"),
        F.max("queued_at").alias("newest"),
    )
