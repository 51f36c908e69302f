"""The data model of point processes: events, end times, nodes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ship, table


@dataclass(frozen=True)
class EventData:
    """Realizations of a multivariate point process.

    events: r BIGINT (realization), node INT from 0, t DOUBLE, eid BIGINT (unique), optionally
    mark DOUBLE. ends: r, end_time DOUBLE; a realization without events has its row there.
    n_nodes counts nodes without events too. Events with a null r, node or t are left out.
    """

    events: DataFrame
    ends: DataFrame
    n_nodes: int

    @cached_property
    def total_time(self) -> float:
        return float(self.ends.agg(F.sum("end_time")).first()[0] or 0.0)

    @cached_property
    def node_counts(self) -> list[int]:
        """Events per node over all realizations."""
        found = {r["node"]: r["count"] for r in self.events.groupBy("node").count().collect()}
        return [found.get(i, 0) for i in range(self.n_nodes)]

    @property
    def n_jumps(self) -> int:
        return sum(self.node_counts)

    @cached_property
    def n_realizations(self) -> int:
        return self.ends.count()

    def nodes(self) -> DataFrame:
        return self.events.sparkSession.range(self.n_nodes).select(F.col("id").cast("int").alias("node"))

    def violations(self) -> dict[str, int]:
        """Counts of what makes the data invalid, in one pass: negative or non-finite times,
        nodes outside the range, events after their end time, events without realization row."""
        joined = self.events.join(self.ends, "r", "left")
        bad = joined.agg(
            F.count_if((F.col("t") < 0) | F.isnan("t") | (F.col("t") == float("inf"))).alias("bad_time"),
            F.count_if((F.col("node") < 0) | (F.col("node") >= self.n_nodes)).alias("bad_node"),
            F.count_if(F.col("t") > F.col("end_time")).alias("after_end"),
            F.count_if(F.col("end_time").isNull()).alias("no_realization"),
        ).first()
        return bad.asDict()

    def checked(self) -> EventData:
        found = {k: v for k, v in self.violations().items() if v}
        if found:
            raise ValueError(f"invalid events: {found}")
        return self

    def with_realizations(self, other: EventData) -> EventData:
        """Both sets of realizations together; keys must differ. Appending realizations and
        evaluating again is how fits are extended."""
        if other.n_nodes != self.n_nodes:
            raise ValueError("both must have the same nodes")
        return EventData(self.events.unionByName(other.events), self.ends.unionByName(other.ends), self.n_nodes)


def event_data(events: DataFrame, n_nodes: int | None = None, end_time: float | DataFrame | None = None) -> EventData:
    """Bring events (r, node, t, optionally mark and eid) into the model.

    end_time is one number for all, a table of r and end_time, or by default the largest time
    of each realization.
    """
    ship(events.sparkSession)
    kept = events.where("r is not null and node is not null and t is not null")
    cols = [F.col("r").cast("bigint").alias("r"), F.col("node").cast("int").alias("node"), F.col("t").cast("double").alias("t")]
    cols.append(F.col("eid").cast("bigint").alias("eid") if "eid" in events.columns else F.monotonically_increasing_id().alias("eid"))
    if "mark" in events.columns:
        cols.append(F.col("mark").cast("double").alias("mark"))
    kept = kept.select(*cols)
    if n_nodes is None:
        n_nodes = (kept.agg(F.max("node")).first()[0] or 0) + 1
    if isinstance(end_time, DataFrame):
        ends = end_time.select(F.col("r").cast("bigint").alias("r"), F.col("end_time").cast("double").alias("end_time"))
    elif end_time is None:
        ends = kept.groupBy("r").agg(F.max("t").alias("end_time"))
    else:
        ends = kept.select("r").distinct().withColumn("end_time", F.lit(float(end_time)))
    return EventData(kept, ends, n_nodes)


def from_lists(spark: SparkSession, realizations: list[list[list[float]]], end_times: float | list[float] | None = None) -> EventData:
    """Small data given as lists: for each realization a list of times per node."""
    ship(spark)
    rows = [(r, i, float(t)) for r, nodes in enumerate(realizations) for i, ts in enumerate(nodes) for t in ts]
    events = spark.createDataFrame([(*x, e) for e, x in enumerate(rows)], "r bigint, node int, t double, eid bigint")
    if end_times is None:
        end_times = [max((t for ts in nodes for t in ts), default=0.0) for nodes in realizations]
    elif not isinstance(end_times, (list, tuple)):
        end_times = [end_times] * len(realizations)
    ends = spark.createDataFrame([(r, float(t)) for r, t in enumerate(end_times)], "r bigint, end_time double")
    n_nodes = {len(nodes) for nodes in realizations}
    if len(n_nodes) > 1:
        raise ValueError("realizations must have the same number of nodes")
    return EventData(events, ends, n_nodes.pop() if n_nodes else 0)


# The event types of the test table, in alphabetical order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HOURS = 720.0


def test_events(spark: SparkSession, folder: str) -> EventData:
    """The events table: users are realizations, types are nodes, time is in hours."""
    e = table(spark, folder, "events")
    node = F.array_position(F.array(*(F.lit(x) for x in EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9
    return event_data(e.select(F.col("user_id").alias("r"), node.alias("node"), t.alias("t"), F.col("value").alias("mark"), F.col("event_id").alias("eid")), len(EVENT_TYPES), HOURS)
