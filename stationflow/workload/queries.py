"""Every operator on the driver's tables. The SQL next to each is its independent twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation
from ..functions.timecols import day_of, midpoint, month_key
from ..operators import (asof, chunked, cleaning, dedup, demand, export, forecast, intervals, matching, moves, panel, quality, ranks,
                         robustness, series, sketches, snapshots, stations, stl, verify)
from ..runtime import stage, staging_path
from ..sources import tables as product
from ..sources import trip_files
from ..streaming import hourly_state
from ..streaming import snapshots as live
from .registry import query
from .views import DEMAND, MISSING, MIN_MONTHLY, SEASONAL_DAYS, THRESHOLDS, Tables

CLEAN = ("bike_id:s rent_dt:s rent_st:s ret_dt:s ret_st:s dur_min:i dist_km:f f_ctrl_rent:b f_ctrl_ret:b "
         "f_cancel:b f_dur_out:b f_dist_out:b f_time_bad:b src_month:s")
PANEL = ("station_id:s ts:s rentals:i returns:i rentals_real:i returns_real:i rentals_to_ctrl:i returns_from_ctrl:i "
         "reloc_in:i reloc_out:i reloc_in_phys:i reloc_out_phys:i net_out:i net_flow:i")
METRICS = ("station_id:s name:s gu:s rentals:i returns_n:i rentals_real:i net_out:i reloc_in:i reloc_out:i ctrl_events:i "
           "wd_rent:i wd_peak:i we_rent:i total_events:i net_out_per_day:f CPI:f WR:f ctrl_pct:f reloc_net_in:i unmet:i "
           "monthly_rentals:f use_type:s")
MASTER = ("station_id:s first_seen:s last_seen:s active_days:i rent_events:i ret_events:i span_days:i activity_ratio:f "
          "total_events:i name:s lat:f lon:f gu:s dong:s addr:s in_current_list:b station_type:s")
MOVES = ("bike_id:s from_st:s to_st:s gap_start:s gap_end:s gap_min:i reloc_ts:s spans_gap:b move_type:s confidence:s")
ITEM_KEY = ["l_orderkey", "l_linenumber"]


# --- sources and cleaning -------------------------------------------------------------

@query("src_month:s encoding:s has_files:b", """
    SELECT src_month, CASE WHEN src_month = '202402' THEN 'cp949' ELSE 'utf-8' END AS encoding, count(*) > 0 AS has_files FROM raw_text GROUP BY 1""")
def file_manifest(t: Tables):
    found = trip_files.file_manifest(t.spark, t.trip_folder)
    return found.groupBy("src_month", "encoding").agg((F.sum("length") > 0).alias("has_files"))


@query(CLEAN, "SELECT * FROM clean")
def csv_trips_clean(t: Tables):
    rows = trip_files.read_trips(t.spark, trip_files.file_manifest(t.spark, t.trip_folder))
    return cleaning.trip_columns(cleaning.clean_trips(rows, **THRESHOLDS))


@query("src_month:s address:s n:i", """
    SELECT src_month, replace(address, ', ', ',' || chr(10)) AS address, count(*) AS n
    FROM (SELECT src_month, unnest([rent_addr, ret_addr]) AS address FROM raw_text) GROUP BY 1, 2""")
def csv_line_breaks(t: Tables):
    """Values with line breaks, read from the text files."""
    rows = trip_files.read_trips(t.spark, trip_files.file_manifest(t.spark, t.trip_folder))
    return rows.select("src_month", F.explode(F.array("rent_addr", "ret_addr")).alias("address")).groupBy("src_month", "address").agg(F.count(F.lit(1)).alias("n"))


@query("src_month:s source_rows:i parsed_rows:i complete:b",
       "SELECT src_month, count(*) AS source_rows, count(*) AS parsed_rows, true AS complete FROM clean GROUP BY 1")
def load_completeness(t: Tables):
    manifest = trip_files.file_manifest(t.spark, t.trip_folder)
    files = quality.load_completeness(trip_files.read_lines(t.spark, manifest),
                                      trip_files.read_trips(t.spark, manifest, malformed="malformed"), "malformed")
    return files.groupBy(trip_files.month_from_path(F.col("file")).alias("src_month")).agg(
        F.sum("source_rows").alias("source_rows"), F.sum("parsed_rows").alias("parsed_rows"),
        F.every("complete").alias("complete"))


@query("station_id:s", """SELECT DISTINCT s AS station_id FROM (SELECT rent_st AS s FROM clean UNION ALL SELECT ret_st FROM clean)
       WHERE regexp_matches(s, '^(click|view)_')""")
def current_station_list(t: Tables):
    return t.current_ids


@query(CLEAN, "SELECT * FROM clean")
def clean_trips(t: Tables):
    return cleaning.trip_columns(t.clean)


@query("src_month:s rows:i data_month_main:s data_days:i rows_off_month:i f_ctrl_rent:i f_ctrl_ret:i f_cancel:i f_dur_out:i "
       "f_dist_out:i f_time_bad:i f_dup:i f_cancel_pct:f f_time_bad_pct:f", """
    SELECT src_month, count(*) AS rows, any_value(data_month_main) AS data_month_main, count(DISTINCT rent_dt::DATE) AS data_days,
           count(*) FILTER (WHERE strftime(rent_dt, '%Y%m') IS DISTINCT FROM src_month) AS rows_off_month,
           sum(f_ctrl_rent::INT) AS f_ctrl_rent, sum(f_ctrl_ret::INT) AS f_ctrl_ret, sum(f_cancel::INT) AS f_cancel,
           sum(f_dur_out::INT) AS f_dur_out, sum(f_dist_out::INT) AS f_dist_out, sum(f_time_bad::INT) AS f_time_bad,
           sum((copy_no > 1)::INT) AS f_dup, round_even(sum(f_cancel::INT) / count(*)::DOUBLE * 100 * 100, 0) / 100 AS f_cancel_pct,
           round_even(sum(f_time_bad::INT) / count(*)::DOUBLE * 100 * 100, 0) / 100 AS f_time_bad_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY src_month, bike_id, rent_dt, ret_dt, rent_st, ret_st ORDER BY dur_min) AS copy_no
          FROM clean)
    JOIN (SELECT src_month, m AS data_month_main FROM (SELECT src_month, strftime(rent_dt, '%Y%m') AS m,
             row_number() OVER (PARTITION BY src_month ORDER BY count(*) DESC, m) AS pos
          FROM clean WHERE rent_dt IS NOT NULL GROUP BY 1, 2) WHERE pos = 1) USING (src_month) GROUP BY src_month""")
def file_quality(t: Tables):
    return quality.file_stats(cleaning.trip_columns(t.clean))


@query("flag:s n:i pct:f", " UNION ALL ".join(
    f"SELECT '{f}' AS flag, sum({f}::INT) AS n, round_even(sum({f}::INT) / count(*)::DOUBLE * 100 * 100, 0) / 100 AS pct FROM clean"
    for f in cleaning.FLAGS) + """ UNION ALL SELECT 'f_dup', sum((copy_no > 1)::INT), round_even(sum((copy_no > 1)::INT) / count(*)::DOUBLE * 100 * 100, 0) / 100
    FROM (SELECT row_number() OVER (PARTITION BY src_month, bike_id, rent_dt, ret_dt, rent_st, ret_st ORDER BY dur_min) AS copy_no FROM clean)""")
def flag_totals(t: Tables):
    return quality.flag_totals(quality.file_stats(cleaning.trip_columns(t.clean)))


def _items(t: Tables):
    shipped = F.col("l_shipdate").cast("timestamp_ntz")
    quarter = F.trunc(day_of(shipped), "QUARTER")
    return t.read("lineitem").withColumn("l_shipdate", shipped).withColumn("src_month", month_key(quarter))


@query("src_month:s rows:i data_month_main:s data_days:i rows_off_month:i f_dup:i f_dup_pct:f", """
    SELECT src_month, rows, data_month_main, data_days, rows_off_month, f_dup,
           round_even(f_dup / rows::DOUBLE * 100 * 100, 0) / 100 AS f_dup_pct
    FROM (SELECT src_month, count(*) AS rows, count(DISTINCT l_shipdate::DATE) AS data_days,
                 count(*) FILTER (WHERE data_month <> src_month) AS rows_off_month,
                 count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS f_dup FROM item_days GROUP BY 1)
    JOIN (SELECT src_month, data_month AS data_month_main FROM (SELECT src_month, data_month,
             row_number() OVER (PARTITION BY src_month ORDER BY count(*) DESC, data_month) AS pos
          FROM item_days GROUP BY 1, 2) WHERE pos = 1) USING (src_month)""")
def file_quality_items(t: Tables):
    return quality.file_stats(_items(t), key=ITEM_KEY, time_column="l_shipdate", flags=[])


@query("src_month:s rows:i duplicates:i", """
    SELECT src_month, count(*) AS rows, sum((copy_no > 1)::INT) AS duplicates
    FROM (SELECT *, row_number() OVER (PARTITION BY src_month, l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy_no FROM items) GROUP BY 1""")
def duplicate_flags(t: Tables):
    flagged = cleaning.flag_duplicates(_items(t), key=ITEM_KEY)
    return flagged.groupBy("src_month").agg(F.count(F.lit(1)).alias("rows"), F.count_if("f_dup").alias("duplicates"))


_FIRST_ITEM = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src_month, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy_no FROM items) WHERE copy_no = 1"""


@query("l_orderkey:i l_linenumber:i src_month:s l_partkey:i l_suppkey:i l_quantity:f l_extendedprice:f l_shipdate:s", _FIRST_ITEM)
def dedup_items(t: Tables):
    return dedup.first_copy(_items(t), ITEM_KEY)


@query("src_month:s rows_read:i rows_kept:i rows_removed:i", f"""
    SELECT src_month, rows_read, coalesce(rows_kept, 0) AS rows_kept, rows_read - coalesce(rows_kept, 0) AS rows_removed
    FROM (SELECT src_month, count(*) AS rows_read FROM items GROUP BY 1)
    LEFT JOIN (SELECT src_month, count(*) AS rows_kept FROM ({_FIRST_ITEM}) GROUP BY 1) USING (src_month)""")
def dedup_removed(t: Tables):
    items = _items(t)
    return dedup.rows_removed(items, dedup.first_copy(items, ITEM_KEY))


@query("file_a:s file_b:s keys_a:i keys_shared:i match_pct:f", """
    WITH k AS (SELECT DISTINCT src_month, l_orderkey, l_linenumber FROM items),
         s AS (SELECT src_month AS file_a, data_month AS file_b FROM (SELECT src_month, data_month,
                  row_number() OVER (PARTITION BY src_month ORDER BY count(*) DESC, data_month) AS pos FROM item_days GROUP BY 1, 2)
               WHERE pos = 1 AND src_month <> data_month)
    SELECT file_a, file_b, count(*) AS keys_a, count(o.l_orderkey) AS keys_shared, 100.0::DOUBLE * count(o.l_orderkey) / count(*) AS match_pct
    FROM k JOIN s ON src_month = file_a LEFT JOIN k o ON o.src_month = file_b AND o.l_orderkey = k.l_orderkey
         AND o.l_linenumber = k.l_linenumber GROUP BY ALL""")
def republished_files(t: Tables):
    items = _items(t)
    stats = quality.file_stats(items, key=ITEM_KEY, time_column="l_shipdate", flags=[])
    return dedup.republished_files(stats, items, ITEM_KEY)


@query("bike_id:s rent_dt:s rent_st:s ret_dt:s ret_st:s dur_min:i dist_km:f f_cancel:b src_month:s", "SELECT * FROM trips")
def trips_dedup(t: Tables):
    return t.trips


@query("station_id:s name:s lat:f lon:f gu:s dong:s addr:s", "SELECT * FROM attrs", grain="fine")
def latest_attributes(t: Tables):
    return t.attributes


@query("station_id:s date:s rent_events:i ret_events:i", """
    SELECT station_id, date, sum(r) AS rent_events, sum(b) AS ret_events FROM (
        SELECT rent_st AS station_id, rent_dt::DATE AS date, 1 AS r, 0 AS b FROM clean
        UNION ALL SELECT ret_st, ret_dt::DATE, 0, 1 FROM clean) WHERE date IS NOT NULL GROUP BY 1, 2""")
def station_daily_events(t: Tables):
    return quality.station_daily_events(t.clean)


@query("station_id:s first_seen:s last_seen:s active_days:i rent_events:i ret_events:i span_days:i activity_ratio:f total_events:i", """
    SELECT *, datediff('day', first_seen, last_seen) + 1 AS span_days, rent_events + ret_events AS total_events,
           round_even(active_days / (datediff('day', first_seen, last_seen) + 1)::DOUBLE * 10000, 0) / 10000 AS activity_ratio
    FROM (SELECT station_id, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT date) AS active_days,
                 sum(r) AS rent_events, sum(b) AS ret_events
          FROM (SELECT rent_st AS station_id, rent_dt::DATE AS date, 1 AS r, 0 AS b FROM clean
                UNION ALL SELECT ret_st, ret_dt::DATE, 0, 1 FROM clean) WHERE date IS NOT NULL GROUP BY 1)""", grain="fine")
def station_life_events(t: Tables):
    return stations.life_from_events(quality.station_daily_events(t.clean))


# --- trajectories ---------------------------------------------------------------------

@query(MOVES, "SELECT * FROM moves")
def bike_moves(t: Tables):
    return moves.moves(t.trips, **t.move_rules)


@query("user_id:i gap_start:s gap_end:s middle:s", """
    SELECT user_id, gap_start, ts AS gap_end, gap_start + (ts - gap_start) / 2 AS middle
    FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_start FROM events)
    WHERE gap_start IS NOT NULL""")
def gap_midpoints(t: Tables):
    linked = chunked.previous_row(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], ["ts"])
    return (linked.where(F.col("prev_ts").isNotNull())
            .select("user_id", F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"),
                    midpoint("prev_ts", "ts").alias("middle")))


@query("move_type:s confidence:s n:i n_spans_gap:i",
       "SELECT move_type, confidence, count(*) AS n, count(*) FILTER (WHERE spans_gap) AS n_spans_gap FROM moves GROUP BY 1, 2")
def move_counts(t: Tables):
    return moves.move_counts(t.moves)


@query("n_links:i n_moves:i n_spans_gap:i break_pct:f", """
    SELECT n_links, n_moves, n_spans_gap, 100 * (n_moves / n_links::DOUBLE) AS break_pct
    FROM (SELECT count(*) AS n_links FROM links),
         (SELECT count(*) AS n_moves, count(*) FILTER (WHERE spans_gap) AS n_spans_gap FROM moves)""")
def link_breaks(t: Tables):
    return moves.link_breaks(t.links, MISSING)


@query("control_returns:i next_at_control:i chain_pct:f", """
    SELECT *, 100 * (next_at_control / nullif(control_returns, 0)::DOUBLE) AS chain_pct
    FROM (SELECT count(*) AS control_returns, count(*) FILTER (WHERE regexp_matches(to_st, '^error_')) AS next_at_control
          FROM links WHERE regexp_matches(from_st, '^error_'))""")
def control_chain(t: Tables):
    return moves.control_chain(t.links, t.control_ids)


@query("n_physical:i n_days:i per_day:f", """
    SELECT *, n_physical / n_days::DOUBLE AS per_day
    FROM (SELECT count(*) AS n_physical FROM moves WHERE move_type = 'RELOCATION' AND NOT spans_gap), (SELECT count(*) AS n_days FROM obs)""")
def physical_moves_per_day(t: Tables):
    return moves.physical_moves_per_day(t.moves, t.days)


_MOST = """SELECT bike_id, count(*) AS n_moves FROM moves WHERE move_type = 'RELOCATION' AND confidence = 'high'
    GROUP BY 1 ORDER BY n_moves DESC, bike_id LIMIT 3"""


@query("bike_id:s n_moves:i", _MOST)
def most_relocated(t: Tables):
    return moves.most_relocated(t.moves, 3, confidence="high")


@query("bike_id:s pos:i rent_dt:s rent_st:s ret_dt:s ret_st:s break_type:s break_confidence:s", f"""
    WITH listed AS (SELECT *, lag(ret_st) OVER w AS before, row_number() OVER w AS pos FROM trips
                    WHERE bike_id IN (SELECT bike_id FROM ({_MOST}))
                    WINDOW w AS (PARTITION BY bike_id ORDER BY rent_dt, ret_dt, rent_st, ret_st, dur_min)),
         hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bike_id, from_st, to_st ORDER BY gap_start, gap_end) AS nr FROM moves)
                 WHERE nr = 1)
    SELECT l.*, CASE WHEN before <> rent_st THEN coalesce(move_type, 'undetected') END AS break_type,
           CASE WHEN before <> rent_st THEN confidence END AS break_confidence
    FROM listed l LEFT JOIN hit h ON h.bike_id = l.bike_id AND h.from_st = before AND h.to_st = rent_st WHERE pos <= 12""")
def trajectory_listing(t: Tables):
    return moves.trajectory_listing(t.trips, t.moves, moves.most_relocated(t.moves, 3, confidence="high"))


# --- panel and checks -----------------------------------------------------------------

@query(PANEL, "SELECT * FROM panel")
def station_hourly(t: Tables):
    return panel.station_hourly(t.trips, t.moves)


@query("rentals:i returns:i reloc_in:i reloc_out:i net_flow:i trips_balance:b relocations_balance:b net_flow_is_zero:b", """
    SELECT *, rentals = returns AS trips_balance, reloc_in = reloc_out AS relocations_balance, net_flow = 0 AS net_flow_is_zero
    FROM (SELECT sum(rentals) AS rentals, sum(returns) AS returns, sum(reloc_in) AS reloc_in, sum(reloc_out) AS reloc_out,
                 sum(net_flow) AS net_flow FROM panel)""")
def conservation(t: Tables):
    return verify.conservation(t.panel)


@query("compared:i differing:i", "SELECT count(*) AS compared, 0 AS differing FROM (SELECT DISTINCT * FROM moves)")
def moves_by_position(t: Tables):
    return verify.difference_summary(t.moves, moves.moves_by_position(t.trips, **t.move_rules))


@query("station_days:i mismatches:i", """
    SELECT count(*) AS station_days, 0 AS mismatches FROM (SELECT DISTINCT station_id, ts::DATE AS d FROM panel)""")
def panel_recount(t: Tables):
    return verify.panel_recount(t.panel, t.trips)


@query("d:s n:i", "SELECT d, n FROM city")
def city_days(t: Tables):
    return panel.city_days(t.panel, t.master)


@query("d:s", "SELECT d FROM obs")
def observed_days(t: Tables):
    return t.days


@query("d:s day_index:f", "SELECT * FROM idx")
def activity_index(t: Tables):
    return panel.activity_index(t.city)


# --- stations -------------------------------------------------------------------------

@query(MASTER, "SELECT * FROM master", grain="fine")
def station_master(t: Tables):
    return t.master


@query("station_type:s n:i", "SELECT station_type, count(*) AS n FROM master GROUP BY 1", grain="fine")
def station_types(t: Tables):
    return t.master.groupBy("station_type").agg(F.count(F.lit(1)).alias("n"))


@query(METRICS, "SELECT * FROM metrics", grain="fine")
def station_metrics(t: Tables):
    return t.metrics


@query("station_id:s net_out:i net_out_per_day:f reloc_net_in:i unmet:i CPI:f WR:f use_type:s",
       "SELECT * FROM metrics ORDER BY net_out_per_day DESC NULLS LAST, station_id LIMIT 10")
def net_outflow_top(t: Tables):
    return stations.top_stations(t.metrics, 10)


@query("station_id:s net_out_per_day:f", "SELECT * FROM metrics ORDER BY net_out_per_day NULLS LAST, station_id LIMIT 15", grain="fine")
def net_outflow_bottom(t: Tables):
    return stations.top_stations(t.metrics, 15, lowest=True)


@query("trip_class:s n:i mean_min:f same_share:f share:f median_min:f median_km:f", """
    SELECT trip_class, count(*) AS n, avg(dur_min) AS mean_min, avg((rent_st = ret_st)::INT) AS same_share,
           count(*) / (SELECT count(*) FROM trips)::DOUBLE AS share, quantile_cont(dur_min, 0.5) AS median_min,
           quantile_cont(dist_km::DOUBLE, 0.5) AS median_km
    FROM (SELECT *, CASE WHEN f_ctrl_rent THEN 'control' ELSE 'general' END || '->'
                    || CASE WHEN f_ctrl_ret THEN 'control' ELSE 'general' END AS trip_class FROM trips) GROUP BY 1""")
def trip_classes(t: Tables):
    return stations.trip_classes(t.trips)


@query("gu:s stations:i net_out:i per_station_day:f", """
    SELECT gu, count(*) AS stations, sum(net_out) AS net_out, sum(net_out) / (count(*) * (SELECT count(*) FROM obs))::DOUBLE AS per_station_day
    FROM metrics GROUP BY gu""", grain="fine")
def district_totals(t: Tables):
    return stations.district_totals(t.metrics, t.days)


@query("station_id:s net_out:i reloc_net_in:i unmet:i fulfilment_pct:f", """
    SELECT station_id, net_out, reloc_net_in, unmet,
           round_even(100 * (reloc_net_in / nullif(net_out, 0)::DOUBLE) * 10, 0) / 10 AS fulfilment_pct FROM metrics""")
def relocation_fulfilment(t: Tables):
    return stations.fulfilment(t.metrics)


@query("use_type:s stations:i in_top:i mean_net_out:f", """
    SELECT use_type, count(*) AS stations, count(*) FILTER (WHERE pos <= 30) AS in_top, avg(net_out_per_day) AS mean_net_out
    FROM (SELECT *, row_number() OVER (ORDER BY net_out_per_day DESC NULLS LAST, station_id) AS pos FROM metrics) GROUP BY 1""", grain="fine")
def use_type_mix(t: Tables):
    return stations.use_type_mix(t.metrics)


@query("end:s reloc_in:i reloc_out:i against_flow:b", """
    SELECT "end", sum(reloc_in) AS reloc_in, sum(reloc_out) AS reloc_out,
           CASE WHEN "end" = 'top' THEN sum(reloc_in) > sum(reloc_out) ELSE sum(reloc_out) > sum(reloc_in) END AS against_flow
    FROM (SELECT * FROM (SELECT 'top' AS "end", * FROM metrics ORDER BY net_out_per_day DESC NULLS LAST, station_id LIMIT 3)
          UNION ALL SELECT * FROM (SELECT 'bottom' AS "end", * FROM metrics ORDER BY net_out_per_day NULLS LAST, station_id LIMIT 3))
    GROUP BY 1""")
def direction_symmetry(t: Tables):
    return stations.direction_symmetry(t.metrics)


def _bins(column: str, source: str, bins: int, share: float | None = None) -> str:
    shown = column if share is None else f"least({column}, (SELECT quantile_cont({column}, {share}) FROM {source}))"
    return f"""WITH v AS (SELECT {shown} AS v FROM {source} WHERE {column} IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
    SELECT CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {bins}.0::DOUBLE)), {bins - 1}) ELSE 0 END AS bin, count(*) AS n
    FROM v, e GROUP BY 1"""


@query("bin:i n:i", _bins("CPI", "metrics", 55, 0.995), grain="fine")
def cpi_histogram(t: Tables):
    return stations.histogram(t.metrics, "CPI", 55, 0.995)


@query("bin:i n:i", _bins("WR", "metrics", 55, 0.995), grain="fine")
def wr_histogram(t: Tables):
    return stations.histogram(t.metrics, "WR", 55, 0.995)


@query("station_id:s lat:f lon:f shown:f size:f", """
    SELECT station_id, lat, lon, greatest(least(net_out_per_day, lim), -lim) AS shown, sqrt(total_events) * 0.28::DOUBLE AS size
    FROM metrics, (SELECT quantile_cont(abs(net_out_per_day), 0.98) AS lim FROM metrics WHERE lat IS NOT NULL AND lon IS NOT NULL)
    WHERE lat IS NOT NULL AND lon IS NOT NULL""", grain="fine")
def net_outflow_map(t: Tables):
    return stations.map_points(t.metrics)


# --- series ---------------------------------------------------------------------------

_WEEK = """SELECT isodow(ts) - 1 AS dow, hour(ts) AS hh, sum(rentals_real)::BIGINT AS n FROM seen
    WHERE station_id IN (SELECT station_id FROM master WHERE station_type <> 'CONTROL') GROUP BY 1, 2"""
_MATRIX = f"""SELECT w.w AS dow, c.hh, coalesce(n, 0) / n_days::DOUBLE AS mean_rentals
    FROM (SELECT unnest(range(7)) AS w) w CROSS JOIN clock c LEFT JOIN ({_WEEK}) s ON s.dow = w.w AND s.hh = c.hh
    LEFT JOIN (SELECT isodow(d) - 1 AS dw, count(*) AS n_days FROM obs GROUP BY 1) ON dw = w.w"""


def _week_sums(t: Tables):
    return series.dow_hour_sums(t.panel, t.master, t.days)


@query("dow:i hh:i mean_rentals:f", _MATRIX)
def dow_hour_matrix(t: Tables):
    return series.dow_hour_matrix(_week_sums(t), t.days)


@query("dow:i peak_hour:i peak_mean:f", f"""
    SELECT dow, hh AS peak_hour, mean_rentals AS peak_mean
    FROM (SELECT *, row_number() OVER (PARTITION BY dow ORDER BY mean_rentals DESC, hh) AS pos FROM ({_MATRIX})) WHERE pos = 1""")
def peak_hours(t: Tables):
    return series.peak_hours(series.dow_hour_matrix(_week_sums(t), t.days))


_SHARES = f"""SELECT dow >= 5 AS weekend, hh, sum(n)::BIGINT AS n, 100 * (sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY dow >= 5)) AS share_pct
    FROM ({_WEEK}) GROUP BY 1, 2"""


@query("weekend:b hh:i n:i share_pct:f", _SHARES)
def hour_shares(t: Tables):
    return series.hour_shares(_week_sums(t))


@query("weekend:b band_7_9_pct:f band_17_19_pct:f peak_hour:i peak_pct:f", f"""
    SELECT weekend, sum(CASE WHEN hh BETWEEN 7 AND 9 THEN share_pct ELSE 0 END) AS band_7_9_pct,
           sum(CASE WHEN hh BETWEEN 17 AND 19 THEN share_pct ELSE 0 END) AS band_17_19_pct,
           first(hh ORDER BY n DESC, hh) AS peak_hour, max(share_pct) AS peak_pct FROM ({_SHARES}) GROUP BY 1""")
def hour_bands(t: Tables):
    return series.hour_bands(series.hour_shares(_week_sums(t)))


_PROFILE = """SELECT station_id, hh, raw_flow, all_flow,
    sum(raw_flow) OVER w / n_weekday::DOUBLE AS cum_raw, sum(all_flow) OVER w / n_weekday::DOUBLE AS cum_all
    FROM (SELECT s.station_id, c.hh, coalesce(raw_flow, 0) AS raw_flow, coalesce(all_flow, 0) AS all_flow
          FROM (SELECT DISTINCT station_id FROM seen WHERE isodow(ts) <= 5) s CROSS JOIN clock c
          LEFT JOIN (SELECT station_id, hour(ts) AS hh, sum(returns - rentals)::BIGINT AS raw_flow, sum(net_flow)::BIGINT AS all_flow
                     FROM seen WHERE isodow(ts) <= 5 GROUP BY 1, 2) f ON f.station_id = s.station_id AND f.hh = c.hh), day_n
    WINDOW w AS (PARTITION BY station_id ORDER BY hh)"""


@query("station_id:s hh:i raw_flow:i all_flow:i cum_raw:f cum_all:f", _PROFILE)
def daily_profile(t: Tables):
    return series.daily_profile(t.panel, t.days)


@query("station_id:s low_hour:i low:f",
       f"SELECT station_id, first(hh ORDER BY cum_raw, hh) AS low_hour, min(cum_raw) AS low FROM ({_PROFILE}) GROUP BY 1")
def profile_minimum(t: Tables):
    return series.profile_minimum(series.daily_profile(t.panel, t.days))


def _order_series(t: Tables):
    return series.full_calendar(t.order_days)


@query("series_key:s d:s n:f", "SELECT * FROM order_cal")
def daily_series(t: Tables):
    return _order_series(t)


@query("series_key:s d:s n:f ma7:f ma30:f", """
    SELECT *, CASE WHEN count(n) OVER a = 7 THEN avg(n) OVER a END AS ma7, CASE WHEN count(n) OVER b = 30 THEN avg(n) OVER b END AS ma30
    FROM order_cal WINDOW a AS (PARTITION BY series_key ORDER BY d ROWS 6 PRECEDING), b AS (PARTITION BY series_key ORDER BY d ROWS 29 PRECEDING)""")
def moving_averages(t: Tables):
    return series.moving_average(series.moving_average(_order_series(t), 7), 30)


@query("series_key:s d:s n:f filled:f", "SELECT * FROM order_filled")
def interpolated_series(t: Tables):
    return series.interpolate(_order_series(t))


@query("series_key:s d:s filled:f trend:f seasonal:f resid:f", "SELECT * FROM order_parts")
def seasonal_decomposition(t: Tables):
    return series.decompose(series.interpolate(_order_series(t)))


@query("series_key:s d:s pos:i resid:f", """
    SELECT * FROM (SELECT series_key, d, resid, row_number() OVER (PARTITION BY series_key ORDER BY round_even(resid * 1e9, 0), d) AS pos
                   FROM order_parts WHERE resid IS NOT NULL) WHERE pos <= 3""")
def lowest_residuals(t: Tables):
    parts = series.decompose(series.interpolate(_order_series(t)))
    # Equal residuals differ in the last bits with the order of summation.
    return series.lowest_residuals(parts.withColumn("resid", F.rint(F.col("resid") * 1e9) / 1e9))


@query("series_key:s d:s filled:f trend:f seasonal:f resid:f")
def robust_stl(t: Tables):
    return stl.stl(series.interpolate(_order_series(t)))


@query("series_key:s n:i parts_add_up:b", "SELECT series_key, count(*) AS n, true AS parts_add_up FROM order_filled GROUP BY 1")
def robust_stl_parts(t: Tables):
    """Every day has a trend, a seasonal part and a rest that add up to its value."""
    parts = stl.stl(series.interpolate(_order_series(t)))
    gap = F.abs(F.col("filled") - F.col("trend") - F.col("seasonal") - F.col("resid"))
    return parts.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce(gap < 1e-6, F.lit(False))).alias("parts_add_up"))


@query("series_key:s month:s days:i per_day:f", "SELECT * FROM order_months")
def monthly_means(t: Tables):
    return series.monthly_means(_order_series(t))


@query("series_key:s month:s per_day:f year_before:f change_pct:f", """
    SELECT m.*, p.per_day AS year_before, round_even((m.per_day / nullif(p.per_day, 0) - 1) * 100 * 10, 0) / 10 AS change_pct
    FROM order_months m JOIN order_months p ON p.series_key = m.series_key AND p.month = (m.month - INTERVAL 12 MONTH)::DATE""")
def year_on_year(t: Tables):
    return series.year_on_year(series.monthly_means(_order_series(t)))


@query("series_key:s low:f high:f amplitude:f", """
    SELECT series_key, min(per_day) AS low, max(per_day) AS high, max(per_day) / nullif(min(per_day), 0) AS amplitude FROM order_months GROUP BY 1""")
def seasonal_amplitude(t: Tables):
    return series.seasonal_amplitude(series.monthly_means(_order_series(t)))


# --- demand and stock-outs ------------------------------------------------------------

@query("station_id:s ts:s rentals:i net_flow:i day_index:f", "SELECT * FROM dense")
def dense_panel(t: Tables):
    return panel.dense_panel(t.panel, t.candidates, panel.activity_index(t.city))


@query("station_id:s ts:s rentals:i base_lam:f lam:f demand_slot:b zero_hit:b run_len:i", "SELECT * FROM flagged")
def zero_runs(t: Tables):
    return t.flagged


@query("station_id:s name:s gu:s demand_hours:i zero_hours:i expected_zero_hours:f long_run_hours:i longest_run:f excess_zero_rate:f "
       "zero_ratio:f naive_rate:f net_out_per_day:f rankable:b", "SELECT * FROM stock")
def stockout_by_station(t: Tables):
    return demand.stockout_by_station(t.flagged, t.candidates, min_hours=50)


@query("stations:i median_excess:f median_naive:f corr_net_out:f corr_naive:f corr_reloc:f", """
    SELECT count(*) AS stations, quantile_cont(excess_zero_rate, 0.5) AS median_excess, quantile_cont(naive_rate, 0.5) AS median_naive,
           corr(excess_zero_rate, net_out_per_day) AS corr_net_out, corr(naive_rate, net_out_per_day) AS corr_naive,
           corr(excess_zero_rate, reloc_net_in) AS corr_reloc FROM stock WHERE rankable""")
def stockout_summary(t: Tables):
    return demand.stockout_summary(demand.stockout_by_station(t.flagged, t.candidates, min_hours=50))


@query("hh:i zero_hours:i demand_hours:i excess_rate:f", """
    SELECT hour(ts) AS hh, count(*) FILTER (WHERE zero_hit) AS zero_hours, count(*) FILTER (WHERE demand_slot) AS demand_hours,
           100 * ((count(*) FILTER (WHERE zero_hit) - sum(CASE WHEN demand_slot THEN exp(-lam) ELSE 0 END))
                  / nullif(count(*) FILTER (WHERE demand_slot), 0)) AS excess_rate FROM flagged GROUP BY 1""")
def stockout_by_hour(t: Tables):
    return demand.stockout_by_hour(t.flagged)


@query("station_id:s ts:s inv:i inv_dev:f", "SELECT * FROM inventory")
def inventory_deviation(t: Tables):
    return demand.inventory_deviation(demand.by_station(t.dense))


def _response(paired: str) -> str:
    """Deciles by position: the first ``n % 10`` groups of a station hold one row more."""
    return f"""SELECT decile, sum(rentals)::BIGINT AS actual, sum(lam) AS expected, sum(rentals)::DOUBLE / sum(lam) AS ratio, count(*) AS n,
        avg(inv_dev_prev) AS mean_dev
    FROM (SELECT *, CASE WHEN place < big THEN place // (n // 10 + 1) ELSE n % 10 + (place - big) // (n // 10) END + 1 AS decile
          FROM (SELECT *, (n % 10) * (n // 10 + 1) AS big
                FROM (SELECT *, count(*) OVER (PARTITION BY station_id) AS n,
                             row_number() OVER (PARTITION BY station_id ORDER BY inv_dev_prev, ts) - 1 AS place
                      FROM ({paired}) WHERE inv_dev_prev IS NOT NULL)))
    GROUP BY 1"""


_AFTER_FILTER = """SELECT a.station_id, a.ts, a.rentals, a.lam, b.inv_dev AS inv_dev_prev
    FROM (SELECT *, count(*) OVER (PARTITION BY station_id ORDER BY ts) AS nth FROM inventory WHERE demand_slot) a
    LEFT JOIN (SELECT station_id, inv_dev, count(*) OVER (PARTITION BY station_id ORDER BY ts) AS nth FROM inventory WHERE demand_slot) b
         ON b.station_id = a.station_id AND b.nth = a.nth - 1"""
_HOUR_BEFORE = """SELECT i.station_id, i.ts, i.rentals, i.lam, p.inv_dev AS inv_dev_prev
    FROM inventory i LEFT JOIN inventory p ON p.station_id = i.station_id AND p.ts = i.ts - INTERVAL 1 HOUR WHERE i.demand_slot"""
_CURVE = "decile:i actual:i expected:f ratio:f n:i mean_dev:f"


@query(_CURVE, _response(_AFTER_FILTER))
def inventory_response(t: Tables):
    return demand.inventory_response(t.dense, DEMAND)


@query(_CURVE, _response(_HOUR_BEFORE))
def inventory_response_hour(t: Tables):
    return demand.inventory_response(t.dense, DEMAND, mode="hour")


@query("lowest:f highest:f low_over_high:f", f"""
    SELECT first(ratio ORDER BY decile) AS lowest, first(ratio ORDER BY decile DESC) AS highest,
           first(ratio ORDER BY decile) / nullif(first(ratio ORDER BY decile DESC), 0) AS low_over_high FROM ({_response(_AFTER_FILTER)})""")
def response_gap(t: Tables):
    return demand.response_gap(demand.inventory_response(t.dense, DEMAND))


# --- forecast -------------------------------------------------------------------------

@query("station_id:s ts:s net_out:f", "SELECT * FROM axis")
def continuous_panel(t: Tables):
    return panel.continuous_panel(t.panel, t.candidates, t.days)


@query("station_id:s ts:s net_out:f lag_1:f lag_2:f lag_3:f lag_24:f lag_168:f roll_mean_3:f roll_std_3:f roll_mean_24:f roll_std_24:f "
       "roll_mean_168:f roll_std_168:f hour_sin:f hour_cos:f dow_sin:f dow_cos:f is_weekend:i", """
    SELECT *, sin(2 * pi() * hh / 24) AS hour_sin, cos(2 * pi() * hh / 24) AS hour_cos, sin(2 * pi() * dw / 7) AS dow_sin,
           cos(2 * pi() * dw / 7) AS dow_cos, dw >= 5 AS is_weekend FROM feats""")
def forecast_features(t: Tables):
    return forecast.add_features(panel.continuous_panel(t.panel, t.candidates, t.days))


@query("station_id:s ts:s net_out:i b0_pred:f b1_pred:f", "SELECT * FROM tested")
def forecast_baselines(t: Tables):
    return forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS))


_SCORES = "SELECT model, n, mae, rmse, round_even((base - mae) / nullif(base, 0) * 100 * 10, 0) / 10 AS improvement_pct FROM (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, count({c}) AS n, round_even(avg(abs(net_out - {c})) * 1e4, 0) / 1e4 AS mae,
    round_even(sqrt(avg((net_out - {c}) * (net_out - {c}))) * 1e4, 0) / 1e4 AS rmse FROM tested WHERE {c} IS NOT NULL"""
    for m, c in (("B0", "b0_pred"), ("B1", "b1_pred"), ("zero", "zero_pred"))
) + "), (SELECT round_even(avg(abs(net_out - b0_pred)) * 1e4, 0) / 1e4 AS base FROM tested) WHERE n > 0"


@query("model:s n:i mae:f rmse:f improvement_pct:f", _SCORES)
def forecast_scores(t: Tables):
    tested = forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS))
    return forecast.score(tested, {"B0": "b0_pred", "B1": "b1_pred", "zero": "zero_pred"}, base="B0")


@query("model:s n:i mae:f rmse:f improvement_pct:f")
def forecast_trees(t: Tables):
    model = forecast.fit_trees(t.features)
    tested = forecast.predict_trees(model, forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS)))
    return forecast.score(tested, {"B0": "b0_pred", "B1": "b1_pred", "B2": "b2_pred"}, base="B0")


@query("n:i beats_week_ago:b every_row_predicted:b",
       "SELECT count(*) AS n, true AS beats_week_ago, true AS every_row_predicted FROM tested")
def forecast_trees_quality(t: Tables):
    """The boosted trees predict every test row and beat the value of a week ago."""
    model = forecast.fit_trees(t.features)
    tested = forecast.predict_trees(model, forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS)))
    error = {c: F.avg(F.abs(F.col("net_out") - F.col(c))) for c in ("b0_pred", "b2_pred")}
    return tested.agg(F.count(F.lit(1)).alias("n"), (error["b2_pred"] < error["b0_pred"]).alias("beats_week_ago"),
                      F.every(F.col("b2_pred").isNotNull()).alias("every_row_predicted"))


@query("station_id:s ts:s net_out:i b0_pred:f b1_pred:f", """
    SELECT * FROM tested WHERE station_id = (SELECT station_id FROM targets LIMIT 1)
      AND ts >= (SELECT max(ts) FROM tested WHERE station_id = (SELECT station_id FROM targets LIMIT 1)) - INTERVAL 7 DAY""")
def forecast_last_days(t: Tables):
    tested = forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS))
    return forecast.last_days(tested, stations.top_stations(t.candidates, 1), 7)


@query("station_id:s ts:s b0_pred:f b2_there:b", """
    SELECT station_id, ts, b0_pred, true AS b2_there FROM tested WHERE station_id = (SELECT station_id FROM targets LIMIT 1)
      AND ts >= (SELECT max(ts) FROM tested WHERE station_id = (SELECT station_id FROM targets LIMIT 1)) - INTERVAL 7 DAY""")
def forecast_last_days_trees(t: Tables):
    """The last days with the boosted trees beside the other forecasts."""
    tested = forecast.predict_trees(forecast.fit_trees(t.features), forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS)))
    shown = forecast.last_days(tested, stations.top_stations(t.candidates, 1), 7)
    return shown.withColumn("b2_there", F.col("b2_pred").isNotNull() & ~F.isnan("b2_pred"))


# --- robustness -----------------------------------------------------------------------

HALVES = {"first": ("2024-01-01", "2024-01-15"), "second": ("2024-01-16", "2024-01-31")}


def _flow(t: Tables, name: str | None = None):
    return stage(robustness.period_flow(t.panel, t.master, t.days, HALVES.get(name), 2), "flow")


def _period_sql(name: str) -> str:
    return f"""SELECT '{name}' AS period, count(*) AS common_stations, round_even(corr(ra, rb) * 1000, 0) / 1000 AS rank_corr,
        count(*) FILTER (WHERE pa <= 10 AND pb <= 10) AS top_overlap, count(*) FILTER (WHERE (a > 0) <> (b > 0)) AS sign_flips,
        round_even(count(*) FILTER (WHERE (a > 0) <> (b > 0)) / count(*)::DOUBLE * 100 * 10, 0) / 10 AS flip_pct
    FROM (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb,
                 row_number() OVER (ORDER BY a DESC, station_id) AS pa, row_number() OVER (ORDER BY b DESC, station_id) AS pb
          FROM (SELECT f.station_id, f.npd AS a, p.npd AS b FROM flows_full f JOIN flows_{name} p USING (station_id)))"""


@query("period:s common_stations:i rank_corr:f top_overlap:i sign_flips:i flip_pct:f",
       _period_sql("first") + " UNION ALL " + _period_sql("second"), grain="fine")
def period_robustness(t: Tables):
    full = _flow(t)
    return robustness.union_all([robustness.compare_periods(full, _flow(t, name), name) for name in HALVES])


@query("station_id:s net_out:i rent:i days:i npd:f", "SELECT * FROM flows_first", grain="fine")
def period_flow(t: Tables):
    return robustness.period_flow(t.panel, t.master, t.days, HALVES["first"], 2)


@query("stations:i flips:i flip_pct:f", """
    SELECT *, round_even(flips / nullif(stations, 0)::DOUBLE * 100 * 10, 0) / 10 AS flip_pct
    FROM (SELECT count(*) AS stations, count(*) FILTER (WHERE a.npd * b.npd < 0) AS flips FROM flows_first a JOIN flows_second b USING (station_id))""",
       grain="fine")
def seasonal_flips(t: Tables):
    return robustness.seasonal_flips(_flow(t, "first"), _flow(t, "second"))


@query("lim:f", """
    SELECT quantile_cont(v, 0.99) AS lim FROM (SELECT abs(a.npd) AS v FROM flows_first a JOIN flows_second b USING (station_id)
           UNION ALL SELECT abs(b.npd) FROM flows_first a JOIN flows_second b USING (station_id))""", grain="fine")
def period_scatter_limit(t: Tables):
    both = _flow(t, "first").select("station_id", F.col("npd").alias("a")).join(
        _flow(t, "second").select("station_id", F.col("npd").alias("b")), "station_id")
    return stations.magnitude_limit(both, ["a", "b"], 0.99)


_ASSUMED = """SELECT station_id, assumption, hh, count(*) AS n, 100 * (count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY station_id, assumption)) AS share_pct
    FROM (SELECT to_st AS station_id, unnest(['midpoint', 'start', 'end']) AS assumption, unnest([hour(reloc_ts), hour(gap_start), hour(gap_end)]) AS hh
          FROM moves WHERE move_type = 'RELOCATION' AND NOT spans_gap) GROUP BY 1, 2, 3"""


@query("station_id:s assumption:s hh:i n:i share_pct:f", _ASSUMED)
def relocation_time_sensitivity(t: Tables):
    return robustness.relocation_time_sensitivity(t.moves)


@query("station_id:s assumption:s n:i peak_hour:i night_pct:f", f"""
    SELECT station_id, assumption, sum(n) AS n, first(hh ORDER BY n DESC, hh) AS peak_hour,
           sum(CASE WHEN hh <= 5 THEN share_pct ELSE 0 END) AS night_pct FROM ({_ASSUMED}) GROUP BY 1, 2""")
def relocation_time_summary(t: Tables):
    return robustness.relocation_time_summary(robustness.relocation_time_sensitivity(t.moves))


_JUDGED = "SELECT * FROM metrics WHERE monthly_rentals >= 5 AND CPI IS NOT NULL AND WR IS NOT NULL"


def _distribution(column: str, source: str) -> str:
    q = ", ".join(f"quantile_cont({column}, {s}) AS q{round(s * 100)}" for s in (0.1, 0.25, 0.5, 0.75, 0.9))
    return f"""SELECT '{column}' AS "column", count({column}) AS n, {q}, min({column}) AS min, max({column}) AS max,
        avg({column}) AS mean, stddev_samp({column}) AS std FROM ({source})"""


@query('column:s n:i q10:f q25:f q50:f q75:f q90:f min:f max:f mean:f std:f',
       _distribution("CPI", _JUDGED) + " UNION ALL " + _distribution("WR", _JUDGED), grain="fine")
def metric_distribution(t: Tables):
    base = robustness.judged(t.metrics, MIN_MONTHLY)
    return robustness.distribution(base, "CPI").unionByName(robustness.distribution(base, "WR"))


@query("above_uniform_pct:f above_cut_pct:f below_wr_cut_pct:f", f"""
    SELECT 100 * avg((CPI > 0.25)::INT) AS above_uniform_pct, 100 * avg((CPI >= 0.40)::INT) AS above_cut_pct,
           100 * avg((WR <= 0.80)::INT) AS below_wr_cut_pct FROM ({_JUDGED})""", grain="fine")
def metric_shares(t: Tables):
    return robustness.share_beyond(robustness.judged(t.metrics, MIN_MONTHLY), {
        "above_uniform_pct": F.col("CPI") > 0.25, "above_cut_pct": F.col("CPI") >= 0.40,
        "below_wr_cut_pct": F.col("WR") <= 0.80})


@query("q50:f q75:f q99:f q99_99:f", """
    SELECT quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.99) AS q99, quantile_cont(x, 0.9999) AS q99_99
    FROM (SELECT dist_km::DOUBLE AS x FROM trips)""")
def trip_distance_tail(t: Tables):
    return ranks.quantiles(t.trips, "dist_km", {"q50": 0.5, "q75": 0.75, "q99": 0.99, "q99_99": 0.9999})


@query("bike_id:s rent_dt:s dist_km:f rank:f", """
    SELECT bike_id, rent_dt, dist_km, CASE WHEN dist_km IS NOT NULL THEN
           rank() OVER (ORDER BY dist_km NULLS LAST) + (count(*) OVER (PARTITION BY dist_km) - 1) / 2.0::DOUBLE END AS rank FROM trips""")
def trip_distance_rank(t: Tables):
    return ranks.average_rank(t.trips.select("bike_id", "rent_dt", "dist_km"), "dist_km")


@query("n:i spearman:f", """
    SELECT count(*) AS n, corr(ra, rb) AS spearman
    FROM (SELECT rank() OVER (ORDER BY dur_min) + (count(*) OVER (PARTITION BY dur_min) - 1) / 2.0::DOUBLE AS ra,
                 rank() OVER (ORDER BY dist_km) + (count(*) OVER (PARTITION BY dist_km) - 1) / 2.0::DOUBLE AS rb
          FROM trips WHERE dur_min IS NOT NULL AND dist_km IS NOT NULL)""")
def duration_distance_spearman(t: Tables):
    return ranks.spearman(t.trips, "dur_min", "dist_km")


@query("rentals:f cpi:f wr:f", """
    SELECT corr(rentals, net_out_per_day) AS rentals, corr(CPI, net_out_per_day) AS cpi, corr(WR, net_out_per_day) AS wr FROM metrics""", grain="fine")
def outflow_correlations(t: Tables):
    return robustness.correlations(t.metrics, {"rentals": ("rentals", "net_out_per_day"), "cpi": ("CPI", "net_out_per_day"),
                                               "wr": ("WR", "net_out_per_day")})


def _q(column: str, share: float) -> str:
    return f"(SELECT round_even(quantile_cont({column}, {share}) * 1000, 0) / 1000 FROM j)"


@query("scenario:s cpi_commute:f wr_commute:f cpi_leisure:f wr_leisure:f commute:i leisure:i mixed:i insufficient:i commute_in_top:i "
       "overall_pct:f top_pct:f multiple:f cpi_corr:f", f"""
    WITH j AS ({_JUDGED}),
         g AS (SELECT 'adopted' AS scenario, 0.40::DOUBLE AS cc, 0.80::DOUBLE AS wc, 0.30::DOUBLE AS cl, 1.10::DOUBLE AS wl
               UNION ALL SELECT 'quartiles', {_q('CPI', 0.75)}, {_q('WR', 0.25)}, {_q('CPI', 0.25)}, {_q('WR', 0.75)}
               UNION ALL SELECT 'uniform', 0.25, 0.80, 0.30, 1.10 UNION ALL SELECT 'loose', 0.35, 0.85, 0.32, 1.05
               UNION ALL SELECT 'strict', 0.45, 0.75, 0.28, 1.15
               UNION ALL SELECT 'top_tenth', {_q('CPI', 0.9)}, {_q('WR', 0.1)}, {_q('CPI', 0.1)}, {_q('WR', 0.9)}),
         p AS (SELECT *, row_number() OVER (ORDER BY net_out_per_day DESC NULLS LAST, station_id) AS pos FROM metrics),
         u AS (SELECT scenario, cc, wc, cl, wl, pos, CASE WHEN coalesce(monthly_rentals, 0) < 5 THEN 'insufficient'
                   WHEN CPI >= cc AND WR <= wc THEN 'commute' WHEN WR >= wl AND CPI <= cl THEN 'leisure' ELSE 'mixed' END AS kind FROM p, g),
         c AS (SELECT scenario, cc AS cpi_commute, wc AS wr_commute, cl AS cpi_leisure, wl AS wr_leisure,
                   count(*) FILTER (WHERE kind = 'commute') AS commute, count(*) FILTER (WHERE kind = 'leisure') AS leisure,
                   count(*) FILTER (WHERE kind = 'mixed') AS mixed, count(*) FILTER (WHERE kind = 'insufficient') AS insufficient,
                   count(*) FILTER (WHERE kind = 'commute' AND pos <= 30) AS commute_in_top FROM u GROUP BY ALL)
    SELECT *, round_even(top_pct / nullif(overall_pct, 0) * 100, 0) / 100 AS multiple
    FROM (SELECT c.*, round_even(commute / nullif((SELECT count(*) FROM j), 0)::DOUBLE * 100 * 10, 0) / 10 AS overall_pct,
                 round_even(commute_in_top / 30::DOUBLE * 100 * 10, 0) / 10 AS top_pct,
                 (SELECT round_even(corr(CPI, net_out_per_day) * 1000, 0) / 1000 FROM j) AS cpi_corr FROM c)""", grain="fine")
def threshold_sensitivity(t: Tables):
    return robustness.threshold_sensitivity(t.metrics, MIN_MONTHLY)


# --- snapshots ------------------------------------------------------------------------

@query("collected_at:s ts:s station_id:s station_name:s bikes_available:f lat:f lon:f address:s", "SELECT * FROM status")
def snapshot_status(t: Tables):
    return live.read_status(t.spark, t.sink)


@query("collected_at:s n_rows:i status:s message_given:b", """
    SELECT collected_at, CASE WHEN hour(hour) = 23 THEN 0 ELSE n_rows END AS n_rows,
           CASE WHEN hour(hour) = 23 THEN 'FAIL' ELSE 'OK' END AS status, hour(hour) = 23 AS message_given
    FROM polls JOIN (SELECT hour, sum(CASE WHEN n > 1 THEN 2 ELSE 1 END) AS n_rows FROM polled GROUP BY 1) USING (hour)
    UNION ALL SELECT NULL, 0, 'FAIL', true FROM ev WHERE k = 0""")
def snapshot_log(t: Tables):
    return live.read_log(t.spark, t.sink).withColumn("message_given", F.col("message") != "")


@query("collected_at:s message_given:b", """SELECT collected_at, true AS message_given FROM polls WHERE hour(hour) = 23
       UNION ALL SELECT NULL, true FROM ev WHERE k = 0""")
def snapshot_quarantine(t: Tables):
    return live.read_quarantine(t.spark, t.sink).withColumn("message_given", F.length("message") > 0)


@query("station_id:s hour:s inv_act:f",
       "SELECT station_id, ts AS hour, avg(bikes_available) AS inv_act FROM status GROUP BY ALL HAVING count(bikes_available) > 0")
def hourly_stream(t: Tables):
    """The polls as they land, then the corrected noon polls: hours are brought up to date."""
    sink, out, progress = (staging_path(t.spark, n) for n in ("hourly_sink", "hourly", "progress"))
    landing = t.landing
    live.hourly_stream(t.spark, landing, sink, out, progress, max_files=4).awaitTermination()
    t.corrected_polls.write.mode("append").text(landing)
    live.hourly_stream(t.spark, landing, sink, out, progress).awaitTermination()
    return live.read_hourly(t.spark, out)


@query("rows:i stations:i snapshots:i first:s last:s days:f", """
    SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, count(DISTINCT collected_at) AS snapshots, min(collected_at) AS first,
           max(collected_at) AS last, count(DISTINCT collected_at) * 5 / 60 / 24 AS days FROM status""")
def collection_summary(t: Tables):
    return snapshots.collection_summary(t.status)


@query("collected_at:s stations:i bikes:i", """
    SELECT collected_at, count(*) AS stations, sum(coalesce(bikes_available, 0)) AS bikes FROM status GROUP BY 1""")
def bikes_per_snapshot(t: Tables):
    return snapshots.bikes_per_snapshot(t.status)


@query("snapshots:i enough:b", "SELECT count(DISTINCT collected_at) AS snapshots, count(DISTINCT collected_at) >= 200 AS enough FROM status")
def snapshot_gate(t: Tables):
    return snapshots.enough_snapshots(t.status)


@query("api_ids:i matched:i match_pct:f warn:b", """
    SELECT *, 100 * (matched / api_ids::DOUBLE) AS match_pct, 100 * (matched / api_ids::DOUBLE) < 90 AS warn
    FROM (SELECT count(*) AS api_ids, count(*) FILTER (WHERE station_id IN (SELECT station_id FROM master)) AS matched
          FROM (SELECT DISTINCT station_id FROM status))""")
def id_coverage(t: Tables):
    return snapshots.id_coverage(t.status, t.master)


@query("station_id:s ts:s inv_est:i inv_act:f", "SELECT * FROM paired")
def estimate_and_measure(t: Tables):
    return snapshots.estimate_and_measure(t.panel, t.status)


@query("station_id:s pairs:i corr:f", "SELECT * FROM change_corr")
def change_correlation(t: Tables):
    return snapshots.change_correlation(snapshots.estimate_and_measure(t.panel, t.status))


@query("stations:i median:f q25:f q75:f at_least_half_pct:f", """
    SELECT count(*) AS stations, quantile_cont(corr, 0.5) AS median, quantile_cont(corr, 0.25) AS q25, quantile_cont(corr, 0.75) AS q75,
           100 * avg((corr >= 0.5)::INT) AS at_least_half_pct FROM change_corr""")
def change_correlation_summary(t: Tables):
    return snapshots.correlation_summary(snapshots.change_correlation(
        snapshots.estimate_and_measure(t.panel, t.status)))


@query("bin:i n:i", _bins("corr", "change_corr", 24))
def change_correlation_histogram(t: Tables):
    return stations.histogram(snapshots.change_correlation(snapshots.estimate_and_measure(t.panel, t.status)), "corr", 24)


_ZERO = "SELECT station_id, 100 * avg(coalesce(bikes_available = 0, false)::INT) AS zero_pct FROM status GROUP BY 1"


@query("station_id:s zero_pct:f", _ZERO)
def zero_share(t: Tables):
    return snapshots.zero_share(t.status)


@query("stations:i corr:f high_pct:f low_pct:f", f"""
    WITH z AS (SELECT zero_pct, net_out_per_day AS x FROM ({_ZERO}) JOIN metrics USING (station_id) WHERE net_out_per_day IS NOT NULL)
    SELECT count(*) AS stations, corr(zero_pct, x) AS corr, avg(zero_pct) FILTER (WHERE x > (SELECT quantile_cont(x, 0.75) FROM z)) AS high_pct,
           avg(zero_pct) FILTER (WHERE x < (SELECT quantile_cont(x, 0.25) FROM z)) AS low_pct FROM z""")
def zero_share_contrast(t: Tables):
    return snapshots.zero_share_contrast(snapshots.zero_share(t.status), t.metrics)


@query("rows:i mean_bikes:f verdict:s", """
    SELECT count(*) AS rows, avg(bikes_available) AS mean_bikes, CASE WHEN count(*) > 0 THEN 'present' ELSE 'absent' END AS verdict
    FROM status WHERE station_id IN (SELECT station_id FROM master WHERE station_type = 'CONTROL')""")
def control_presence(t: Tables):
    return snapshots.control_presence(t.status, t.master)


_OFFSET = 'SELECT station_id, avg(inv_act) - avg(inv_est) AS "offset" FROM paired GROUP BY 1'


@query("station_id:s offset:f", _OFFSET)
def inventory_offset(t: Tables):
    return snapshots.inventory_offset(snapshots.estimate_and_measure(t.panel, t.status))


@query("stations:i median:f", f'SELECT count(*) AS stations, quantile_cont("offset", 0.5) AS median FROM ({_OFFSET})')
def offset_summary(t: Tables):
    return snapshots.offset_summary(snapshots.inventory_offset(snapshots.estimate_and_measure(t.panel, t.status)))


# --- reconciliation and export --------------------------------------------------------

# metric, claimed value, tolerance, and the same number in SQL.
CLAIMS = [
    ("rows read", 4960.0, 5000.0, "SELECT count(*) FROM clean"),
    ("rows kept", 4500.0, 0.0, "SELECT count(*) FROM trips"),
    ("bad times", 300.0, 5000.0, "SELECT count(*) FILTER (WHERE f_time_bad) FROM clean"),
    ("vehicles", 100.0, 0.0, "SELECT count(DISTINCT bike_id) FROM trips"),
    ("observed days", 27.0, 0.0, "SELECT count(*) FROM obs"),
    ("missing days", 0.0, 0.0, "SELECT datediff('day', min(d), max(d)) + 1 - count(*) FROM obs"),
    ("stations", 20.0, 0.0, "SELECT count(*) FROM master"),
    ("active stations", 16.0, 4.0, "SELECT count(*) FILTER (WHERE station_type = 'ACTIVE') FROM master"),
    ("control stations", 4.0, 0.0, "SELECT count(*) FILTER (WHERE station_type = 'CONTROL') FROM master"),
    ("moves", 4000.0, 100.0, "SELECT count(*) FROM moves"),
    ("physical moves", 2500.0, 100.0, "SELECT count(*) FILTER (WHERE move_type = 'RELOCATION' AND NOT spans_gap) FROM moves"),
    ("moves per link pct", 95.0, 5.0, "SELECT 100.0 * count(*) FILTER (WHERE from_st <> to_st) / count(*) FROM links"),
    ("net flow", 0.0, 0.0, "SELECT sum(net_flow) FROM panel"),
    ("rentals", 4500.0, 0.0, "SELECT sum(rentals) FROM panel"),
    ("relocations in", 4000.0, 0.0, "SELECT sum(reloc_in) FROM panel"),
    ("strongest outflow per day", 2.76, 0.005, "SELECT max(net_out_per_day) FROM metrics"),
    ("strongest inflow per day", 2.19, 0.005, "SELECT max(-net_out_per_day) FROM metrics"),
    ("net outflow of the strongest", 1580.0, 0.0, "SELECT first(net_out ORDER BY net_out_per_day DESC NULLS LAST, station_id) FROM metrics"),
    ("relocations to the strongest", 1160.0, 0.0, "SELECT first(reloc_net_in ORDER BY net_out_per_day DESC NULLS LAST, station_id) FROM metrics"),
    ("commuter stations", 0.0, 2.0, "SELECT count(*) FILTER (WHERE use_type = 'commute') FROM metrics"),
    ("outflow of view", 0.0, 500.0, "SELECT sum(net_out) FILTER (WHERE gu = 'view') FROM metrics"),
    ("rentals and outflow", -0.172, 0.001, "SELECT corr(rentals, net_out_per_day) FROM metrics"),
    ("peak share and outflow", -0.06, 0.005, "SELECT corr(CPI, net_out_per_day) FROM metrics"),
    ("judged stations", 16.0, 4.0, "SELECT count(*) FILTER (WHERE CPI IS NOT NULL AND WR IS NOT NULL) FROM metrics"),
    ("above uniform pct", 98.1, 50.0, "SELECT 100 * avg((CPI > 0.25)::INT) FROM metrics"),
    ("live rows", 1000.0, 10000.0, "SELECT count(*) FROM status"),
    ("live mean bikes", 6.0, 2.0, "SELECT avg(bikes_available) FROM status"),
    ("forecast hours", 3000.0, 1000.0, "SELECT count(*) FROM tested"),
    ("zero forecast MAE", 0.56, 0.5, "SELECT avg(abs(net_out)) FROM tested"),
    ("week-ago MAE", 0.82, 0.5, "SELECT avg(abs(net_out - b0_pred)) FROM tested"),
]


@query("metric:s claim:f value:f ok:b", "SELECT metric, claim, value, coalesce(abs(claim - value) <= tol, false) AS ok FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {c}::DOUBLE AS claim, {tol}::DOUBLE AS tol, CAST(({q}) AS DOUBLE) AS value" for m, c, tol, q in CLAIMS) + ")")
def claim_reconciliation(t: Tables):
    """Published numbers against recomputed ones: one aggregate per table, whatever the number of claims."""
    n, x = F.count(F.lit(1)), F.col
    ranked = t.metrics.select("*", F.struct(F.coalesce(-x("net_out_per_day"), F.lit(float("inf"))), "station_id").alias("place"))
    tested = forecast.test_rows(forecast.add_baselines(t.features, SEASONAL_DAYS))
    claims = t.spark.createDataFrame([(m, c, tol) for m, c, tol, _ in CLAIMS], "metric string, claim double, tol double")
    return verify.reconcile(claims, verify.long_metrics([
        (t.clean, {"rows read": n, "bad times": F.count_if("f_time_bad")}),
        (t.trips, {"rows kept": n, "vehicles": F.count_distinct("bike_id")}),
        (t.days, {"observed days": n, "missing days": F.datediff(F.max("d"), F.min("d")) + 1 - n}),
        (t.master, {"stations": n, "active stations": F.count_if(x("station_type") == "ACTIVE"),
                    "control stations": F.count_if(x("station_type") == "CONTROL")}),
        (t.moves, {"moves": n, "physical moves": F.count_if((x("move_type") == "RELOCATION") & ~x("spans_gap"))}),
        (moves.link_breaks(t.links, MISSING), {"moves per link pct": F.max("break_pct")}),
        (t.panel, {"net flow": F.sum("net_flow"), "rentals": F.sum("rentals"), "relocations in": F.sum("reloc_in")}),
        (ranked, {"strongest outflow per day": F.max("net_out_per_day"), "strongest inflow per day": F.max(-x("net_out_per_day")),
                  "net outflow of the strongest": F.min_by("net_out", "place"), "relocations to the strongest": F.min_by("reloc_net_in", "place"),
                  "commuter stations": F.count_if(x("use_type") == "commute"), "outflow of view": F.sum(F.when(x("gu") == "view", x("net_out"))),
                  "rentals and outflow": correlation("rentals", "net_out_per_day"), "peak share and outflow": correlation("CPI", "net_out_per_day"),
                  "judged stations": F.count_if(x("CPI").isNotNull() & x("WR").isNotNull()),
                  "above uniform pct": 100 * F.avg((x("CPI") > 0.25).cast("int"))}),
        (t.status, {"live rows": n, "live mean bikes": F.avg("bikes_available")}),
        (tested, {"forecast hours": n, "zero forecast MAE": F.avg(F.abs("net_out")), "week-ago MAE": F.avg(F.abs(x("net_out") - x("b0_pred")))}),
    ]))


_ACTIVE = "seen WHERE station_id IN (SELECT station_id FROM master WHERE station_type = 'ACTIVE')"


@query("station_id:s months:a rentals:a returns:a", f"""
    SELECT station_id, list(ym ORDER BY ym) AS months, list(r ORDER BY ym) AS rentals, list(b ORDER BY ym) AS returns
    FROM (SELECT s.station_id, m.ym, coalesce(r, 0) AS r, coalesce(b, 0) AS b
          FROM (SELECT DISTINCT station_id FROM {_ACTIVE}) s CROSS JOIN (SELECT DISTINCT strftime(ts, '%Y-%m') AS ym FROM {_ACTIVE}) m
          LEFT JOIN (SELECT station_id, strftime(ts, '%Y-%m') AS ym, sum(rentals)::BIGINT AS r, sum(returns)::BIGINT AS b FROM {_ACTIVE} GROUP BY 1, 2) v
               ON v.station_id = s.station_id AND v.ym = m.ym) GROUP BY 1""", grain="fine")
def monthly_arrays(t: Tables):
    return export.monthly_arrays(t.panel, t.master, t.days)


_SLOTS = f"""SELECT station_id, list(r ORDER BY k) AS rentals, list(b ORDER BY k) AS returns
    FROM (SELECT s.station_id, q.k, coalesce(r, 0) AS r, coalesce(b, 0) AS b
          FROM (SELECT DISTINCT station_id FROM {_ACTIVE}) s CROSS JOIN (SELECT unnest(range(168)) AS k) q
          LEFT JOIN (SELECT station_id, (isodow(ts) - 1) * 24 + hour(ts) AS k, sum(rentals_real)::BIGINT AS r, sum(returns_real)::BIGINT AS b
                     FROM {_ACTIVE} GROUP BY 1, 2) v ON v.station_id = s.station_id AND v.k = q.k) GROUP BY 1"""


@query("station_id:s rentals:a returns:a", _SLOTS)
def profile_arrays(t: Tables):
    return export.profile_arrays(t.panel, t.master, t.days)


@query("dow:i n_days:i", "SELECT isodow(d) - 1 AS dow, count(*) AS n_days FROM obs GROUP BY 1")
def days_per_dow(t: Tables):
    return export.days_per_dow(t.days)


@query("months:a days_per_month:a", """
    SELECT list(ym ORDER BY ym) AS months, list(n ORDER BY ym) AS days_per_month FROM (SELECT strftime(d, '%Y-%m') AS ym, count(*) AS n FROM obs GROUP BY 1)""")
def observed_months(t: Tables):
    return export.observed_months(t.days)


@query("id:s n:s la:f cpi:f wr:f t:s ri:i ro:i rentals:a", f"""
    SELECT m.station_id AS id, name AS n, round_even(lat * 1e5, 0) / 1e5 AS la, round_even(CPI * 1e3, 0) / 1e3 AS cpi,
           round_even(WR * 1e3, 0) / 1e3 AS wr, use_type AS t, reloc_in AS ri, reloc_out AS ro, p.rentals
    FROM metrics m LEFT JOIN ({_SLOTS}) p ON p.station_id = m.station_id""")
def station_documents(t: Tables):
    """Written as JSON lines and read back."""
    path = staging_path(t.spark, "documents")
    documents = export.station_documents(t.metrics, export.monthly_arrays(t.panel, t.master, t.days),
                                         export.profile_arrays(t.panel, t.master, t.days))
    product.write_documents(documents, path)
    return t.spark.read.schema(documents.schema).json(path).withColumn("rentals", F.col("profile")[0])


@query("first:s last:s obs_days:i missing_days:i weekday_days:i total_trips:i", """
    SELECT min(d) AS first, max(d) AS last, (SELECT count(*) FROM obs) AS obs_days,
           datediff('day', min(d), max(d)) + 1 - (SELECT count(*) FROM obs) AS missing_days, (SELECT n_weekday FROM day_n) AS weekday_days,
           (SELECT count(*) FROM trips) AS total_trips FROM city""")
def dashboard_meta(t: Tables):
    return export.dashboard_meta(series.full_calendar(series.city_series(t.city)), t.days, t.trips)


@query("position:i station_id:s net_out:i net_out_per_day:f use_type:s",
       "SELECT *, row_number() OVER (ORDER BY net_out_per_day DESC NULLS LAST, station_id) AS position FROM metrics", grain="fine")
def report_csv(t: Tables):
    """Ordered CSV report, written and read back; a row's position is where it stands in the files."""
    path = staging_path(t.spark, "report")
    report = t.metrics.select("station_id", "net_out", "net_out_per_day", "use_type")
    product.write_report(report, path, [F.desc_nulls_last("net_out_per_day"), "station_id"])
    read = product.read_report(t.spark, path, report.schema).select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return read.withColumn("position", F.row_number().over(Window.orderBy("_file", "_at")))  # one row per station


@query("src_month:s rows:i duplicates:i", """
    SELECT src_month, count(*) AS rows, count(*) - count(DISTINCT (bike_id, rent_dt, ret_dt, rent_st, ret_st)) AS duplicates FROM clean GROUP BY 1""")
def trips_by_month(t: Tables):
    """Flagged trips written in month folders and read back."""
    path = staging_path(t.spark, "trips_by_month")
    product.write_by_month(cleaning.flag_duplicates(cleaning.trip_columns(t.clean)), path)
    return product.read_by_month(t.spark, path).groupBy("src_month").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("f_dup").alias("duplicates"))


# --- range, sketch, as-of and matching operators -----------------------------------------

def _outages(t: Tables):
    """Each error event opens a window of up to two hours."""
    return t.events.where(F.col("event_type") == "error").select(
        F.col("ts").alias("begin"), F.timestamp_add("MINUTE", F.col("k") % 120, F.col("ts")).alias("stop"))


@query("bike_id:s gap_start:s gap_end:s spans_outage:b", """
    SELECT bike_id, gap_start, gap_end, EXISTS (SELECT 1 FROM ev WHERE event_type = 'error' AND k % 120 > 0 AND ts < gap_end
           AND ts + to_minutes(k % 120) > gap_start) AS spans_outage FROM links""")
def gaps_over_outages(t: Tables):
    """Which gaps between trips overlap any of many windows."""
    linked = t.links.select("bike_id", "gap_start", "gap_end")
    return intervals.overlaps_windows(linked, "gap_start", "gap_end", _outages(t), "begin", "stop", "spans_outage")


@query("kind:s n:i rank_within_bound:b count_within_bound:b", """
    SELECT l_returnflag AS kind, count(*) AS n, true AS rank_within_bound, true AS count_within_bound FROM lineitem
    WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate <= DATE '1996-06-30' GROUP BY 1""")
def sketched_prices(t: Tables):
    """Quartiles and distinct parts from daily sketches over a range of days, held against the exact ranks and counts."""
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("kind"), day_of(F.col("l_shipdate").cast("timestamp_ntz")).alias("d"),
                                     F.col("l_extendedprice").cast("double").alias("price"), F.col("l_partkey").cast("long").alias("part"))
    daily = stage(sketches.daily_sketches(rows, ["kind"], F.col("d"), F.col("price"), F.col("part")), "sketches")
    quarters = (0.25, 0.5, 0.75)
    found = stage(sketches.over_days(daily, ["kind"], "1994-01-01", "1996-06-30", quarters), "sketched")
    exact = rows.where(F.col("d").between(F.lit("1994-01-01").cast("date"), F.lit("1996-06-30").cast("date"))).join(F.broadcast(found), "kind")
    ranks_of = [F.count_if(F.col("price") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(3)]
    ranks_of += [F.count_if(F.col("price") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)]
    counted = exact.groupBy("kind", "n", "n_distinct").agg(*ranks_of, F.count_distinct("part").alias("parts"))
    # Twice the published rank error, five standard errors of the count.
    near = F.lit(True)
    for i, q in enumerate(quarters):
        near = near & (F.col(f"below{i}") <= (q + 0.033) * F.col("n")) & (F.col(f"upto{i}") >= (q - 0.033) * F.col("n"))
    return counted.select("kind", "n", near.alias("rank_within_bound"), (F.abs(F.col("n_distinct") - F.col("parts")) <= 0.081 * F.col("parts")).alias("count_within_bound"))


@query("event_id:i slot:i observed_at:s observed:f", """
    SELECT e.event_id, e.slot, CASE WHEN e.ts <= o.ts + INTERVAL 45 MINUTE THEN o.ts END AS observed_at,
           CASE WHEN e.ts <= o.ts + INTERVAL 45 MINUTE THEN o.value END AS observed
    FROM (SELECT event_id, k % 4 AS slot, ts FROM ev WHERE event_type = 'purchase') e ASOF LEFT JOIN
         (SELECT k % 4 AS slot, ts, max(value) AS value FROM ev WHERE event_type = 'view' GROUP BY 1, 2) o ON e.slot = o.slot AND e.ts >= o.ts""")
def observations_asof(t: Tables):
    """Each purchase with the newest view of its slot in the 45 minutes before, as hours are joined with the weather."""
    slotted = t.events.withColumn("slot", F.col("k") % 4)
    found = asof.join_asof(slotted.where(F.col("event_type") == "purchase").select("event_id", "slot", "ts"),
                           slotted.where(F.col("event_type") == "view").select("slot", F.col("ts").alias("seen"), "value"), "ts", "seen", ["slot"], ["value"], 45)
    return found.withColumnsRenamed({"obs_value": "observed", "obs_at": "observed_at"})


_DAWN = """dawn AS (SELECT station_id, ts, sum(net_flow) OVER (PARTITION BY station_id ORDER BY ts) AS inv FROM dense),
    anchors AS (SELECT station_id, min(inv) AS inv, arg_min(ts, (inv, ts)) AS ts FROM dawn WHERE hour(ts) IN (3, 4, 5) GROUP BY station_id, ts::DATE)"""


@query("station_id:s ts:s inv:i is_anchor:b level:i inv_abs:i", f"""
    WITH {_DAWN} SELECT d.station_id, d.ts, d.inv, coalesce(a.ts = d.ts, false) AS is_anchor, d.inv - a.inv AS level, d.inv - l.low AS inv_abs
    FROM dawn d ASOF LEFT JOIN anchors a ON d.station_id = a.station_id AND d.ts >= a.ts
    LEFT JOIN (SELECT station_id, min(inv) AS low FROM anchors GROUP BY 1) l ON l.station_id = d.station_id""")
def dawn_levels(t: Tables):
    return demand.dawn_anchored(t.dense)


@query("station_id:s hours:i drift_per_day:f r2:f", """
    SELECT station_id, count(*) AS hours, regr_slope(raw, day) AS drift_per_day, regr_r2(raw, day) AS r2
    FROM (SELECT station_id, sum(-net_out) OVER (PARTITION BY station_id ORDER BY ts) AS raw,
                 (epoch(date_trunc('minute', ts)) - epoch(date_trunc('minute', min(ts) OVER (PARTITION BY station_id)))) / 86400 AS day FROM panel)
    GROUP BY station_id HAVING count(*) > 1""", grain="fine")
def drift_slopes(t: Tables):
    return demand.drift_slope(t.panel)


def _renamed(t: Tables):
    """The stations as another source has them: other ids, places a few metres off, names written another way."""
    moved = (F.length("station_id") % 3 - 1) * F.lit(0.0002)
    return t.master.select(F.concat(F.lit("R-"), F.reverse("station_id")).alias("station_id"), F.concat(F.upper("name"), F.lit(" #")).alias("name"),
                           (F.col("lat") + moved).alias("lat"), (F.col("lon") - moved).alias("lon"))


@query("left_id:s right_id:s metres:f", """
    WITH sides AS (SELECT station_id AS l, 'R-' || reverse(station_id) AS r, regexp_replace(lower(coalesce(name, '')), '[\\s[:punct:]]+', '', 'g') AS ln,
            regexp_replace(lower(coalesce(upper(name) || ' #', '')), '[\\s[:punct:]]+', '', 'g') AS rn, lat, lon, (length(station_id) % 3 - 1) * CAST(0.0002 AS DOUBLE) AS moved FROM master
          WHERE lat IS NOT NULL AND lon IS NOT NULL),
    pairs AS (SELECT a.l AS left_id, b.r AS right_id, round(sqrt(power(a.lat * 111320 - (b.lat + b.moved) * 111320, 2)
            + power(a.lon * 111320 * CAST(0.8054 AS DOUBLE) - (b.lon - b.moved) * 111320 * CAST(0.8054 AS DOUBLE), 2)), 3) AS metres,
            round(levenshtein(a.ln, b.rn) / greatest(length(a.ln), length(b.rn), 1)::DOUBLE, 6) AS edits FROM sides a, sides b),
    costs AS (SELECT *, round(metres / 150 + edits, 6) AS cost FROM pairs WHERE metres <= 150 AND edits <= 0.5)
    SELECT left_id, right_id, metres FROM costs
    QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY cost, metres, left_id, right_id) = 1
        AND row_number() OVER (PARTITION BY right_id ORDER BY cost, metres, left_id, right_id) = 1""", grain="fine")
def matched_stations(t: Tables):
    """Ids of another source, found again by place and name."""
    return matching.match_stations(t.master, _renamed(t))


@query("station_id:s hour:s inv_act:f",
       "SELECT station_id, ts AS hour, avg(bikes_available) AS inv_act FROM status GROUP BY ALL HAVING count(bikes_available) > 0")
def hourly_state_stream(t: Tables):
    """Hourly means from keyed state: the polls as they land, then the corrected noon polls."""
    out, progress, landing = staging_path(t.spark, "hourly_state"), staging_path(t.spark, "progress"), t.landing
    hourly_state.hourly_state_stream(t.spark, landing, out, progress, delay="60 days", max_files=8).awaitTermination()
    t.corrected_polls.write.mode("append").text(landing)
    hourly_state.hourly_state_stream(t.spark, landing, out, progress, delay="60 days").awaitTermination()
    return live.read_hourly(t.spark, out)
