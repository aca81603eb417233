"""The driver's tables seen as trips, stations, daily series and availability polls.

Consecutive events of a user are paired into trips and rendered as the raw text a monthly
trip file holds, with all its defects, so the whole chain from text to panel is exercised.
Products are built once per session and input folder, as written tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import day_of, hour_floor, minutes_between
from ..operators import cleaning, dedup, demand, forecast, moves, panel, stations
from ..operators.chunked import chained
from ..runtime import stage, staging_path
from ..sources import trip_files
from ..streaming import snapshots as live

# Fixed values of the test instantiation; the SQL twin uses the same.
CONTROL_WORD = "error"
THRESHOLDS = dict(control_keyword=CONTROL_WORD, cancel_min=60, cancel_km=1.0, max_min=1440, max_km=20.0)
MISSING = (("2024-01-10", "2024-01-13"),)
TYPE_RULES = dict(control_keyword=CONTROL_WORD, temp_pattern="signup_1|purchase_9", new_days=5, closed_days=5,
                  temp_span=10, temp_tail=2, low_ratio=0.5, low_events=20)
MIN_MONTHLY = 5
DEMAND = 0.2
HOLDOUT_DAYS, SEASONAL_DAYS = 7, 14
GRAINS = {"coarse": 4, "fine": 100}

_SHARED: dict[tuple, "Tables"] = {}


def _state(spark: SparkSession, sf_dir: str) -> int | None:
    """Names, sizes and times of the input files, so that changed data is not answered from older products."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in ("events", "orders", "lineitem")])
    return files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]


def tables_for(spark: SparkSession, sf_dir: str, grain: str) -> "Tables":
    key = (spark.sparkContext.applicationId, sf_dir, grain, _state(spark, sf_dir))
    if key not in _SHARED:
        _SHARED[key] = Tables(spark, sf_dir, grain)
    return _SHARED[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "coarse"):
        self.spark, self.sf_dir, self.grain = spark, sf_dir, grain
        self.stations_per_type = GRAINS[grain]
        self.control_ids = [f"{CONTROL_WORD}_{i}" for i in range(self.stations_per_type)]
        self.move_rules = dict(control_ids=self.control_ids, missing_windows=MISSING)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumns({
            "ts": F.col("ts").cast("timestamp_ntz"),
            "k": F.get_json_object("props", "$.k").cast("int")})

    @property
    def event_pairs(self) -> DataFrame:
        """Events 1 and 2, 3 and 4, ... of each user, as columns a.* and b.*."""
        parts = ["ts", "event_type", "value", "k"]
        linked = chained(self.events.select("user_id", "event_id", *parts), ["user_id"], ["ts", "event_id"],
                         parts, "a_", "seq")
        return linked.where(F.col("seq") % 2 == 0).select(
            "user_id", F.struct(*[F.col(f"a_{c}").alias(c) for c in parts]).alias("a"), F.struct(*parts).alias("b"))

    @property
    def raw_trips(self) -> DataFrame:
        """Text trips under the source's column names, plus ``src_month``."""
        def text(c):
            return F.substring(F.col(c).cast("string"), 1, 19)

        def side(e, prefix):
            kind, k, value = F.col(f"{e}.event_type"), F.col(f"{e}.k"), F.col(f"{e}.value")
            station = F.concat(kind, F.lit("_"), (k % self.stations_per_type).cast("string"))
            name = F.concat(F.lit("Station "), station, F.when(value > 30, " (new)").otherwise(""))
            step = (k % 40) / F.lit(100.0)
            return {
                f"{prefix}_st": station,
                f"{prefix}_name": F.when(value >= 1, name),
                f"{prefix}_lat": (36.0 + step).cast("string"),
                f"{prefix}_lon": (127.0 + step).cast("string"),
                f"{prefix}_gu": kind,
                f"{prefix}_dong": F.concat(kind, F.lit("-"), (k % 2).cast("string")),
                f"{prefix}_addr": F.when(value > 5, F.concat(F.lit("Addr, "), k.cast("string"))),
            }

        first, second = F.col("a.event_type"), F.col("b.event_type")
        swapped = (first == "purchase") & (second == "error")
        rent = (F.when(swapped, text("b.ts"))
                .when(first == "view", F.substring(text("a.ts"), 1, 16))
                .when((first == "signup") & (second == "view"), "n/a")
                .otherwise(text("a.ts")))
        month = F.when(F.dayofmonth(day_of("a.ts")) <= 15, "202401").otherwise("202402")
        # Some trips stand twice in their file, some again in the next one.
        none = F.expr("CAST(array() AS array<string>)")
        files = F.concat(F.array(month), F.when(F.col("b.k") % 11 == 0, F.array(month)).otherwise(none),
                         F.when((F.col("b.k") % 13 == 0) & (month == "202401"), F.array(F.lit("202402"))).otherwise(none))
        trips = (self.event_pairs
                 .select(
                     F.col("user_id").cast("string").alias("bike_id"),
                     rent.alias("rent_dt"),
                     F.when(swapped, text("a.ts")).otherwise(text("b.ts")).alias("ret_dt"),
                     F.when((first == "purchase") & (second == "purchase"), "x")
                     .otherwise(minutes_between("a.ts", "b.ts").cast("string")).alias("dur_min"),
                     (F.rint("b.value") / 10).cast("string").alias("dist_km"),
                     files.alias("_files"),
                     *[c.alias(n) for n, c in {**side("a", "rent"), **side("b", "ret")}.items()]))
        # Exploded last: the text is rendered once a pair, and not again in each expression that parses it.
        trips = trips.withColumn("src_month", F.explode("_files"))
        back = {v: k for k, v in cleaning.RENAME.items()}
        return trips.select(*[F.col(v).alias(back[v]) for v in cleaning.RENAME.values()], "src_month")

    @cached_property
    def clean(self) -> DataFrame:
        return stage(cleaning.clean_trips(cleaning.rename_source(self.raw_trips), **THRESHOLDS), "clean")

    @cached_property
    def trips(self) -> DataFrame:
        return stage(dedup.dedup_trips(cleaning.trip_columns(self.clean)), "trips")

    @cached_property
    def links(self) -> DataFrame:
        return moves.links(self.trips)

    @cached_property
    def moves(self) -> DataFrame:
        return stage(moves.moves(self.trips, **self.move_rules), "moves")

    @cached_property
    def panel(self) -> DataFrame:
        return stage(panel.station_hourly(self.trips, self.moves), "panel")

    @cached_property
    def attributes(self) -> DataFrame:
        return dedup.latest_attributes(dedup.station_sides(self.clean))

    @cached_property
    def current_ids(self) -> DataFrame:
        """A list of operated stations, written as a cp949 CSV and read back."""
        listed = (self.clean.select(F.inline(F.array(F.struct(F.col("rent_st").alias("s")),
                                                     F.struct(F.col("ret_st").alias("s")))))
                  .distinct().where(F.col("s").rlike("^(click|view)_")))
        path = staging_path(self.spark, "current")
        with trip_files.java_charsets(self.spark):
            (listed.select(F.concat(F.lit(" "), "s", F.lit(" ")).alias("대여소ID"), F.lit("x").alias("비고"))
             .write.option("header", "true").option("encoding", "MS949").csv(path))
        return trip_files.read_station_list(self.spark, path)

    @cached_property
    def master(self) -> DataFrame:
        return stage(stations.station_master(self.panel, self.attributes, self.current_ids,
                                             stations.last_day(self.trips), **TYPE_RULES), "master")

    @cached_property
    def city(self) -> DataFrame:
        return stage(panel.city_days(self.panel, self.master), "city")

    @cached_property
    def days(self) -> DataFrame:
        return panel.observed_days(self.city)

    @cached_property
    def metrics(self) -> DataFrame:
        return stage(stations.station_metrics(self.panel, self.master, self.days, min_monthly=MIN_MONTHLY),
                     "metrics")

    @cached_property
    def candidates(self) -> DataFrame:
        return demand.candidates(self.metrics, self.master, MIN_MONTHLY)

    @cached_property
    def dense(self) -> DataFrame:
        return stage(panel.dense_panel(self.panel, self.candidates, panel.activity_index(self.city)), "dense")

    @property
    def expected(self) -> DataFrame:
        return demand.expected_demand(demand.by_station(self.dense), DEMAND)

    @property
    def flagged(self) -> DataFrame:
        return demand.zero_runs(self.expected)

    @cached_property
    def features(self) -> DataFrame:
        axis = panel.continuous_panel(self.panel, self.candidates, self.days)
        return stage(forecast.with_split(forecast.add_features(axis), HOLDOUT_DAYS), "features")

    # Daily series of orders.
    @cached_property
    def order_days(self) -> DataFrame:
        finished = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
        return stage(self.read("orders").groupBy(
            F.col("o_orderpriority").alias("series_key"), day_of("o_orderdate").alias("d")
        ).agg(F.sum(finished).alias("n")), "order_days")

    # Files and polls derived from the events.
    @cached_property
    def trip_folder(self) -> str:
        """The raw trips as CSV, one folder per month file; the second one is cp949. Addresses hold line breaks."""
        root = staging_path(self.spark, "raw")
        back = {v: k for k, v in cleaning.RENAME.items()}
        written = self.raw_trips.withColumns({back[c]: F.replace(F.col(back[c]), F.lit("Addr, "), F.lit("Addr,\n")) for c in ("rent_addr", "ret_addr")})
        with trip_files.java_charsets(self.spark):
            for month, name, charset in (("202401", "trips(24년01월).csv", "UTF-8"), ("202402", "trips(24년02월).csv", "MS949")):
                (written.where(F.col("src_month") == month).drop("src_month")
                 .write.option("header", "true").option("encoding", charset).option("escape", '"')
                 .option("nullValue", "").option("emptyValue", "").csv(f"{root}/{name}"))
        return root

    @cached_property
    def station_hours(self) -> DataFrame:
        # Written: the polls, their correction and the landing folders read it again.
        return stage(self.events.groupBy(
            hour_floor("ts").alias("hour"), "event_type", (F.col("k") % 4).alias("slot")
        ).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum")), "station_hours")

    def _poll_lines(self) -> DataFrame:
        """One JSON line per hour; every wrapper shape, repeated, id-less and swapped entries occur."""
        station = F.concat("event_type", F.lit("_"), F.col("slot").cast("string"))
        bikes = F.col("k_sum") % 13
        lat, lon = 36.0 + F.col("slot") / 10, 127.0 + F.col("slot") / 10
        swap = F.col("slot") == 3
        count = (F.when(bikes == 12, "null").when(bikes == 5, F.lit('"5"')).otherwise(bikes.cast("string")))

        def item(number, ident=station):
            return F.concat(
                F.lit('{"id":"'), ident, F.lit('","name":"Station '), station, F.lit('","x_pos":'),
                F.when(swap, lon).otherwise(lat).cast("string"), F.lit(',"y_pos":'),
                F.when(swap, lat).otherwise(lon).cast("string"), F.lit(',"address":"'),
                F.when(F.col("slot") == 1, "").otherwise("Addr"), F.lit('","'),
                F.when(F.col("slot") == 2, "available").otherwise("parking_count"), F.lit('":'), number, F.lit("}"))

        rendered = F.concat_ws(",", F.when(F.col("n") > 1, item(F.lit("99"))), item(count),
                               F.when(F.col("n") > 2, item(F.lit("1"), F.lit(""))))
        polls = (self.station_hours.withColumn("item", F.struct("event_type", "slot", rendered.alias("json")))
                 .groupBy("hour").agg(F.array_sort(F.collect_list("item")).alias("items")))
        listing = F.concat(F.lit("["), F.concat_ws(",", F.col("items.json")), F.lit("]"))
        shape = F.hour("hour") % 4
        body = (F.when(F.hour("hour") == 23, F.concat(F.lit('{"a":'), listing, F.lit(',"b":[]}')))
                .when(shape == 0, listing)
                .when(shape == 1, F.concat(F.lit('{"results":'), listing, F.lit("}")))
                .when(shape == 2, F.concat(F.lit('{"meta":{"n":1},"rows":'), listing, F.lit("}")))
                .otherwise(F.concat(F.lit('{"results":"none","data":'), listing, F.lit("}"))))
        stamp = F.concat(F.translate(F.substring(F.col("hour").cast("string"), 1, 19), " ", "T"), F.lit("+09:00"))
        return polls.select("hour", F.concat(F.lit('{"collected_at":"'), stamp, F.lit('","body":'), body,
                                             F.lit("}")).alias("value"))

    @property
    def landing(self) -> str:
        """A new landing folder with the polls."""
        path = staging_path(self.spark, "landing")
        self._poll_lines().select("value").write.text(path)
        return path

    @property
    def corrected_polls(self) -> DataFrame:
        """The noon polls again, with other counts."""
        noon = self._poll_lines().where(F.hour("hour") == 12)
        corrected = F.regexp_replace("value", '"(parking_count|available)":(null|"5"|[0-9]+)', '"$1":7')
        return noon.select(corrected.alias("value"))

    @cached_property
    def sink(self) -> str:
        """Two runs of the ingest stream; the second sees the noon polls again, corrected."""
        landing, sink, checkpoint = (staging_path(self.spark, n) for n in ("polls", "sink", "progress"))
        self._poll_lines().select("value").write.text(landing)
        broken = self.events.where(F.col("k") == 0).select(F.concat(F.lit("broken line "), F.col("event_id").cast("string")).alias("value"))
        broken.write.mode("append").text(landing)
        live.ingest(self.spark, landing, sink, checkpoint).awaitTermination()
        self.corrected_polls.write.mode("append").text(landing)
        live.ingest(self.spark, landing, sink, checkpoint).awaitTermination()
        return sink

    @cached_property
    def status(self) -> DataFrame:
        return stage(live.read_status(self.spark, self.sink), "status")
