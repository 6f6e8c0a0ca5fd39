"""Journey planning as joins: earliest arrivals by rounds of boardings, for many queries at once.

Round k extends every query's labels (station, arrival) by one ride: board the trips that leave a reached station in
time, ride on, keep the earliest arrival per station, then walk. Each round is two shuffles keyed by query and
station or trip; the timetable is read once per round and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelora.operators.graph import written

CHANGE_SECONDS = 60


def earliest_arrivals(queries: DataFrame, stops: DataFrame, walks: DataFrame | None, rounds: int, max_wait: int = 3600) -> DataFrame:
    """(query, station, arrival, rides): the earliest arrival with at most ``rounds`` rides.

    ``queries``: query, station, depart. ``stops``: trip, seq, station, time, run (risk-priced seconds added to each
    later stop of the trip; 0 for the timetable). ``walks``: a, b, seconds. A change of vehicle takes CHANGE_SECONDS;
    the first departure is at most ``max_wait`` after the query's time.
    """
    stops = written(stops)  # read twice a round
    labels = queries.select("query", "station", F.col("depart").alias("arrival"), F.lit(0).alias("rides"))
    board = stops.select(F.col("trip"), F.col("seq").alias("from_seq"), "station", F.col("time").alias("leave"))
    later = stops.select("trip", "seq", F.col("station").alias("to"), F.col("time").alias("reach"), "run")
    for k in range(1, rounds + 1):
        frontier = labels.where(F.col("rides") == k - 1)
        ready = F.col("arrival") + (CHANGE_SECONDS if k > 1 else 0)
        caught = frontier.join(board, "station").where(F.col("leave") >= ready)
        if k == 1:
            caught = caught.where(F.col("leave") <= F.col("arrival") + max_wait)
        on = caught.groupBy("query", "trip").agg(F.min("from_seq").alias("from_seq"))  # boarding earliest dominates on one trip
        rode = on.join(later, "trip").where(F.col("seq") > F.col("from_seq")).select("query", F.col("to").alias("station"), (F.col("reach") + F.col("run")).alias("arrival"))
        if walks is not None:
            rode = rode.unionByName(rode.join(walks, F.col("station") == F.col("a")).select("query", F.col("b").alias("station"), (F.col("arrival") + F.col("seconds")).alias("arrival")))
        new = rode.groupBy("query", "station").agg(F.min("arrival").alias("arrival")).withColumn("rides", F.lit(k))
        labels = labels.unionByName(new).groupBy("query", "station").agg(F.min(F.struct("arrival", "rides")).alias("l")).select("query", "station", "l.arrival", "l.rides")
        labels = written(labels) if k < rounds else labels  # read twice in the next round
    return labels


def journeys(queries: DataFrame, stops: DataFrame, rounds: int, max_wait: int = 3600, banned: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(query, station, arrival, trips): the earliest arrival and the trips ridden; ties go to fewer, then smaller trips.

    ``queries``: query, station, depart. ``stops``: trip, seq, station, time, line; a written table, since a round reads it
    twice. ``banned``: query, line; a query never boards a line that is banned for it. ``ends``: query, station; only what
    arrives there is told, so the last round looks at no trips but those that call there. ``query`` may be of any type, so
    one run serves many plans.
    """
    labels = queries.select("query", "station", F.col("depart").alias("arrival"), F.expr("cast(array() as array<bigint>)").alias("trips"))
    board = stops.select("trip", "line", F.col("seq").alias("from_seq"), "station", F.col("time").alias("leave"))
    later = stops.select("trip", "seq", F.col("station").alias("to"), F.col("time").alias("reach"))
    allowed = lambda caught: caught if banned is None else caught.join(banned, ["query", "line"], "left_anti")
    for k in range(1, rounds + 1):
        frontier = labels.where(F.size("trips") == k - 1)
        in_time = (F.col("leave") >= F.col("arrival") + CHANGE_SECONDS) if k > 1 else F.col("leave").between(F.col("arrival"), F.col("arrival") + max_wait)
        if ends is None or k < rounds:
            caught = allowed(frontier.join(board, "station").where(in_time))
            on = caught.groupBy("query", "trip").agg(F.min(F.struct("from_seq", "trips")).alias("b"))
            rode = on.join(later, "trip").where(F.col("seq") > F.col("b.from_seq"))
        else:  # backwards from the ends: the stops of their trips before they call there, then the labels at these stops
            calls = allowed(ends.select("query", F.col("station").alias("to")).join(stops.select("trip", "line", "seq", F.col("station").alias("to"), F.col("time").alias("reach")), "to"))
            before = calls.drop("line").join(board.drop("line"), "trip").where(F.col("from_seq") < F.col("seq"))
            caught = before.join(frontier, ["query", "station"]).where(in_time)
            rode = caught.groupBy("query", "trip", "seq", "to", "reach").agg(F.min(F.struct("from_seq", "trips")).alias("b"))
        rode = rode.select("query", F.col("to").alias("station"), F.col("reach").alias("arrival"), F.concat("b.trips", F.array("trip")).alias("trips"))
        best = F.min(F.struct("arrival", F.size("trips").alias("rides"), "trips")).alias("l")
        labels = labels.unionByName(rode).groupBy("query", "station").agg(best).select("query", "station", "l.arrival", "l.trips")
        labels = written(labels) if k < rounds else labels  # read twice in the next round
    return labels if ends is None else labels.join(ends, ["query", "station"], "left_semi")


def diverse(queries: DataFrame, stops: DataFrame, rounds: int, most: int = 6) -> DataFrame:
    """(query, arrival, trips, rank): the fastest journey of each query and those that avoid one of its lines.

    ``queries``: query, station, depart, dest. Each line of the fastest journey makes one plan that bans it; all plans
    are rows of one second run. Journeys with the same trips count once, and the ``most`` earliest stay.
    """
    queries = written(queries)  # few rows, read by every step
    if rounds <= 2:  # the first ride leaves an origin and the last one ends at a destination: no other trip is ridden
        places = queries.select("station").union(queries.select("dest")).distinct()
        stops = stops.join(stops.join(places, "station").select("trip").distinct(), "trip", "left_semi")
    stops = written(stops)  # both runs read it
    at = lambda rows: rows.select("query", F.col("dest").alias("station"))
    fastest = journeys(queries, stops, rounds, ends=at(queries)).where(F.size("trips") > 0)
    fastest = written(fastest.select("query", "arrival", "trips"))  # read twice below
    used = fastest.select("query", F.explode("trips").alias("trip")).join(stops, "trip").select("query", "line").distinct()
    plans = written(queries.join(used, "query").select(F.struct("query", "line").alias("plan"), "line", "station", "depart", "dest").withColumnRenamed("plan", "query"))
    other = journeys(plans, stops, rounds, banned=plans.select("query", "line"), ends=at(plans)).where(F.size("trips") > 0)
    found = fastest.unionByName(other.select("query.query", "arrival", "trips")).groupBy("query", "trips").agg(F.min("arrival").alias("arrival"))
    place = F.row_number().over(W.partitionBy("query").orderBy("arrival", F.size("trips"), "trips"))
    return found.withColumn("rank", place).where(F.col("rank") <= most).select("query", "arrival", "trips", "rank")
