"""Vehicle trajectories: inferred relocations, control chains, trajectory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.timecols import midpoint, minutes_between, overlaps_any
from .chunked import HOT_ROWS, first_rows, previous_row, sequence_number

# Control nodes, and the periods without data.
CONTROL_IDS = ("ST0001", "ST1220")
MISSING_WINDOWS = (("2025-02-26", "2025-03-04"), ("2025-12-01", "2026-01-01"))
HIGH_CONFIDENCE_MIN = 24 * 60

# Two trips of one vehicle may start in the same minute; without the later keys their
# order, and with it the number of breaks, would change from run to run.
TRIP_ORDER = ["rent_dt", "ret_dt", "rent_st", "ret_st", "dur_min"]
MOVE_COLUMNS = ["bike_id", "from_st", "to_st", "gap_start", "gap_end", "gap_min", "reloc_ts",
                "spans_gap", "move_type", "confidence"]


def links(trips: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Consecutive trips of each vehicle: where and when the last one ended, the next began."""
    chained = previous_row(trips.select("bike_id", *TRIP_ORDER), ["bike_id"], TRIP_ORDER,
                           ["ret_st", "ret_dt"], hot_rows=hot_rows)
    return (chained.where(F.col("prev_ret_st").isNotNull())
            .select("bike_id", F.col("prev_ret_st").alias("from_st"), F.col("rent_st").alias("to_st"),
                    F.col("prev_ret_dt").alias("gap_start"), F.col("rent_dt").alias("gap_end")))


def classify_moves(breaks: DataFrame, control_ids=CONTROL_IDS, missing_windows=MISSING_WINDOWS,
                   high_confidence_min: int = HIGH_CONFIDENCE_MIN) -> DataFrame:
    from_control = F.col("from_st").isin(*control_ids)
    to_control = F.col("to_st").isin(*control_ids)
    return (breaks
            .withColumn("gap_min", minutes_between("gap_start", "gap_end"))
            .withColumns({
                "reloc_ts": midpoint("gap_start", "gap_end"),
                "spans_gap": overlaps_any("gap_start", "gap_end", missing_windows),
                "move_type": F.when(from_control & to_control, "CONTROL_INTERNAL")
                .when(from_control, "CONTROL_OUT").when(to_control, "CONTROL_IN")
                .otherwise("RELOCATION"),
                "confidence": F.when(F.col("gap_min") <= high_confidence_min, "high").otherwise("low"),
            }).select(*MOVE_COLUMNS))


def moves(trips: DataFrame, hot_rows: int = HOT_ROWS, **rules) -> DataFrame:
    """Breaks in a trajectory: returned at one station, next rented at another."""
    broken = links(trips, hot_rows).where(F.col("from_st") != F.col("to_st"))
    return classify_moves(broken, **rules)


def moves_by_position(trips: DataFrame, **rules) -> DataFrame:
    """The same breaks found another way: trip n joined to trip n - 1 of the vehicle."""
    numbered = sequence_number(trips.select("bike_id", *TRIP_ORDER), ["bike_id"], TRIP_ORDER)
    before = numbered.select("bike_id", (F.col("seq") + 1).alias("seq"),
                             F.col("ret_st").alias("from_st"), F.col("ret_dt").alias("gap_start"))
    now = numbered.select("bike_id", "seq", F.col("rent_st").alias("to_st"),
                          F.col("rent_dt").alias("gap_end"))
    broken = now.join(before, ["bike_id", "seq"]).where(F.col("from_st") != F.col("to_st"))
    return classify_moves(broken, **rules)


def move_counts(moved: DataFrame) -> DataFrame:
    return moved.groupBy("move_type", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("spans_gap").alias("n_spans_gap"))


def link_breaks(linked: DataFrame, missing_windows=MISSING_WINDOWS) -> DataFrame:
    """One row: links, breaks, breaks over a period without data, share of broken links."""
    broken = F.col("from_st") != F.col("to_st")
    counted = linked.agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(broken).alias("n_moves"),
        F.count_if(broken & overlaps_any("gap_start", "gap_end", missing_windows)).alias("n_spans_gap"))
    return counted.withColumn("break_pct", 100 * ratio("n_moves", "n_links"))


def control_chain(linked: DataFrame, control_ids=CONTROL_IDS) -> DataFrame:
    """Share of returns at a control node whose next rental is at a control node too."""
    chained = linked.where(F.col("from_st").isin(*control_ids)).agg(
        F.count(F.lit(1)).alias("control_returns"),
        F.count_if(F.col("to_st").isin(*control_ids)).alias("next_at_control"))
    return chained.withColumn("chain_pct", 100 * ratio("next_at_control", "control_returns"))


def physical_moves_per_day(moved: DataFrame, days: DataFrame) -> DataFrame:
    """Trustworthy truck relocations divided by the number of observed days."""
    n = moved.agg(F.count_if((F.col("move_type") == "RELOCATION") & ~F.col("spans_gap")).alias("n_physical"))
    d = days.agg(F.count(F.lit(1)).alias("n_days"))
    return n.crossJoin(F.broadcast(d)).withColumn("per_day", ratio("n_physical", "n_days"))


def most_relocated(moved: DataFrame, k: int, move_type: str = "RELOCATION",
                   confidence: str | None = None) -> DataFrame:
    """Top-k vehicles by number of moves of one type; ties by id."""
    chosen = moved.where(F.col("move_type") == move_type)
    if confidence:
        chosen = chosen.where(F.col("confidence") == confidence)
    return (chosen.groupBy("bike_id").agg(F.count(F.lit(1)).alias("n_moves"))
            .orderBy(F.desc("n_moves"), "bike_id").limit(k))


def trajectory_listing(trips: DataFrame, moved: DataFrame, bikes: DataFrame, n: int = 12) -> DataFrame:
    """First ``n`` trips of the chosen vehicles, each with the break that precedes it.

    ``bikes`` is a top-k result, so it and the k * n listed trips are small by definition.
    """
    chosen = trips.join(F.broadcast(bikes.select("bike_id")), "bike_id", "left_semi")
    listed = previous_row(
        first_rows(chosen.select("bike_id", *TRIP_ORDER), ["bike_id"], TRIP_ORDER, n),
        ["bike_id"], TRIP_ORDER, ["ret_st"])
    first_hit = (moved.join(F.broadcast(bikes.select("bike_id")), "bike_id", "left_semi")
                 .groupBy("bike_id", F.col("from_st").alias("prev_ret_st"), F.col("to_st").alias("rent_st"))
                 .agg(F.min_by(F.struct("move_type", "confidence"),
                               F.struct("gap_start", "gap_end")).alias("_hit")))
    broken = F.col("prev_ret_st") != F.col("rent_st")
    tagged = listed.join(first_hit, ["bike_id", "prev_ret_st", "rent_st"], "left")
    return tagged.select(
        "bike_id", "pos", "rent_dt", "rent_st", "ret_dt", "ret_st",
        F.when(broken, F.coalesce("_hit.move_type", F.lit("undetected"))).alias("break_type"),
        F.when(broken, F.col("_hit.confidence")).alias("break_confidence"))
