"""Ingestion, calendar and format queries (S1, S5-S14, P1, P5-P10, P15, P19,
J1-J6, X2, X3, X7-X13, A26, A27)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lineup.functions import calendar as C
from lineup.functions import text as T
from lineup.operators import filters as FL
from lineup.operators import games as G
from lineup.operators import markets as M
from lineup.operators import quality as Q
from lineup.operators.staking import daily_totals
from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.oracle import cte_team_games
from lineup.plans.q_features import FEAT_SQL, features_final
from lineup.session import shared_dir
from lineup.sources import files as FS
from lineup.sources.odds_json import flatten_odds
from lineup.sources.schedule_json import flatten_events, flatten_scoreboard

ODDS_COLS = ["game_id", "commence_time", "home_team", "away_team", "bookmaker", "home_odds", "away_odds",
             "home_prob", "away_prob"]


@register("odds_flatten", "with " + derive.cte_odds_rows() + " select *, case when home_odds > 0 then 100e0 / "
          "(home_odds + 100) end as home_prob, case when away_odds > 0 then 100e0 / (away_odds + 100) end as "
          "away_prob from odds_rows", doubles=["home_odds", "away_odds", "home_prob", "away_prob"])
def odds_flatten(spark, sf_dir):
    """S6 + J1-J3 + J6 + P15 + X2: tolerant odds feed flatten (one row per game and bookmaker)."""
    out = flatten_odds(derive.odds_documents(spark, sf_dir)).select(*ODDS_COLS)
    # UTC wall-clock time without a zone, as the oracle's TIMESTAMP
    return out.withColumn("commence_time", F.col("commence_time").cast("timestamp_ntz"))


@register("odds_flatten_whitelist", "with " + derive.cte_odds_rows() + " select game_id, bookmaker from odds_rows "
          "where bookmaker in ('draftkings', 'betmgm')")
def odds_flatten_whitelist(spark, sf_dir):
    """Bookmaker whitelist (blank entries ignored)."""
    return flatten_odds(derive.odds_documents(spark, sf_dir), bookmakers=["draftkings", "", "betmgm"]) \
        .select("game_id", "bookmaker")


SCHED = ["game_id", "game_date", "home_team", "away_team", "game_time", "game_status", "arena"]


def _sched_sql() -> str:
    t = ("strftime(cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(16 + o_orderkey % 12 as integer)), "
         "'%Y-%m-%dT%H:%M:%SZ')")
    ts = "cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(16 + o_orderkey % 12 as integer))"
    home = derive.team_abbr_sql(derive.HOME_ID, "duckdb")
    away = derive.team_abbr_sql(derive.AWAY_ID, "duckdb")
    return (
        "select cast(o_orderkey as varchar) as game_id, case when o_orderkey % 2 = 0 then cast(" + ts +
        " - interval 5 hours as date) else cast(" + ts + " as date) end as game_date, " + home + " as home_team, "
        + away + " as away_team, " + t + " as game_time, case when o_orderkey % 2 = 0 then cast(1 + o_orderkey % 3 "
        "as varchar) else 'STATUS_' || cast(1 + o_orderkey % 3 as varchar) end as game_status, case when "
        "o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then '' else 'Arena ' || " + home + " end as arena from orders")


@register("schedule_flatten", _sched_sql())
def schedule_flatten(spark, sf_dir):
    """S8 + S9 + J5 + X7: two scoreboard shapes flattened to one schedule schema."""
    docs = derive.scoreboard_documents(spark, sf_dir)
    a = flatten_scoreboard(docs.where("shape_a"))
    b = flatten_events(docs.where("not shape_a"))
    return a.unionByName(b).select(*SCHED)


CT = "cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(16 + o_orderkey % 12 as integer))"


@register("local_game_date", "select o_orderkey as game_id, cast(" + CT + " - interval 5 hours as date) as "
          "date_as_run, cast(timezone('America/New_York', (" + CT + ")::timestamptz) as date) as date_fixed, "
          "cast(" + CT + " as date) as date_utc from orders")
def local_game_date(spark, sf_dir):
    """X7 (Q9): local game date by a fixed -5 h (as-run) and by the real zone (fixed)."""
    o = derive.read(spark, sf_dir, "orders").selectExpr("o_orderkey as game_id", f"{derive.COMMENCE_TS} as ts")
    return o.select("game_id", C.local_game_date("ts").alias("date_as_run"),
                    C.local_game_date("ts", fixed=True).alias("date_fixed"), F.to_date("ts").alias("date_utc"))


@register("season_calendar", "with d as (select o_orderkey, cast(o_orderdate as date) as d from orders) select "
          "o_orderkey, d, cast(case when month(d) <= 6 then year(d) - 1 else year(d) end as int) as season_start, "
          "cast(case when month(d) <= 6 then year(d) else year(d) + 1 end as int) as season_end, month(d) >= 10 "
          "or month(d) <= 6 as in_season, isodow(d) in (2, 3) as refresh_day from d")
def season_calendar(spark, sf_dir):
    """X8 + X9 + X11: season years, in-season flag, refresh weekday."""
    o = derive.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = C.season_years("d")
    return o.select("o_orderkey", "d", s["season_start"].alias("season_start"),
                    s["season_end"].alias("season_end"), C.in_season("d").alias("in_season"),
                    C.is_refresh_day("d").alias("refresh_day"))


@register("estimated_game_number", "with d as (select o_orderkey, cast(o_orderdate as date) as d from orders), "
          "s as (select *, make_date(cast(case when month(d) <= 6 then year(d) - 1 else year(d) end as bigint), "
          "10, 15) as start from d) select o_orderkey, d, cast(case when d >= start then least(82, greatest(1, "
          "floor(date_diff('day', start, d) * 82 / 170))) else 41 end as int) as estimated_game_number from s")
def estimated_game_number(spark, sf_dir):
    """Game number estimated from days since the season start (Oct 15)."""
    o = derive.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    start = F.make_date(C.season_start_year("d"), F.lit(10), F.lit(15))
    return o.select("o_orderkey", "d", C.estimated_game_number("d", start).alias("estimated_game_number"))


@register("format_report", "with " + derive.cte_bets() + ", d as (select bet_date, sum(bet_amount) as wagered, "
          "sum(profit_loss) as pnl, avg(case when profit_loss > 0 then 1e0 else 0e0 end) as win_rate from bets "
          "group by 1) select bet_date, '$' || format('{:,.2f}', pnl) as pnl_text, '$' || format('{:,.2f}', "
          "wagered) as wagered_text, printf('%.2f', win_rate * 100) || '%' as win_rate_text from d")
def format_report(spark, sf_dir):
    """Currency and percentage text of each day's betting totals."""
    b = derive.bets(spark, sf_dir).groupBy("bet_date").agg(
        F.sum("bet_amount").alias("wagered"), F.sum("profit_loss").alias("pnl"),
        F.avg((F.col("profit_loss") > 0).cast("double")).alias("win_rate"))
    return b.select("bet_date", T.currency("pnl").alias("pnl_text"), T.currency("wagered").alias("wagered_text"),
                    T.percentage("win_rate").alias("win_rate_text"))


# A games table with a season text column and a date text column with defects.
SEASON_TEXT = ("case when o_orderkey % 41 = 0 then 'n/a' else cast(year(o_orderdate) as string) || '-' || "
               "lpad(cast((year(o_orderdate) + 1) % 100 as string), 2, '0') end")
DATE_TEXT = ("case when o_orderkey % 43 = 0 then 'bad-date' else cast(cast(o_orderdate as date) as string) end")


def _year_src(spark, sf_dir):
    return derive.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as game_id", f"{SEASON_TEXT} as season", f"{DATE_TEXT} as game_date_text",
        "cast(o_orderdate as date) as game_date", "cast(year(o_orderdate) as int) as season_year")


YEAR_SRC_SQL = ("with ys as (select o_orderkey as game_id, " + SEASON_TEXT + " as season, " + DATE_TEXT +
                " as game_date_text, cast(o_orderdate as date) as game_date, cast(year(o_orderdate) as int) as "
                "season_year from orders) ")


@register("year_filter_numeric", YEAR_SRC_SQL + "select game_id, season_year from ys where season_year between "
          "1996 and 1998")
def year_filter_numeric(spark, sf_dir):
    """Numeric year column within a range."""
    return _year_src(spark, sf_dir).where(FL.numeric_year("season_year", 1996, 1998)).select("game_id", "season_year")


@register("year_filter_season", YEAR_SRC_SQL + "select game_id, season from ys where try_cast(split_part(season, "
          "'-', 1) as int) between 1996 and 1998")
def year_filter_season(spark, sf_dir):
    """P8: '1996-97' season text; unparsable text dropped."""
    return _year_src(spark, sf_dir).where(FL.season_text_year("season", 1996, 1998)).select("game_id", "season")


@register("year_filter_date", YEAR_SRC_SQL + "select game_id, game_date, game_date_text from ys where "
          "game_date >= date '1996-01-01' and game_date < date '1999-01-01' and year(try_cast(game_date_text as "
          "date)) between 1996 and 1998")
def year_filter_date(spark, sf_dir):
    """Date column as a pushed-down range, and date text parsed (bad text dropped)."""
    src = _year_src(spark, sf_dir)
    return src.where(FL.date_year(src, "game_date", 1996, 1998) & FL.date_year(src, "game_date_text", 1996, 1998)) \
              .select("game_id", "game_date", "game_date_text")


# The first date-like column, ``season``, mostly holds season text and is used.
@register("year_filter_auto", YEAR_SRC_SQL + "select game_id, season, game_date_text from ys where "
          "try_cast(split_part(season, '-', 1) as int) between 1996 and 1998")
def year_filter_auto(spark, sf_dir):
    """P5 + P6 + P10: first date-like column (by name, then kind) whose filter is non-empty."""
    src = _year_src(spark, sf_dir).select("game_id", "season", "game_date_text")
    return FL.filter_by_year_range(src, 1996, 1998)


GAMES_SCHEMA = ("game_id string, game_date date, season_id int, team_name_home string, team_name_away string, "
                "pts_home int, pts_away int")


@register("scan_csv_roundtrip", "with " + derive.cte_games() + " select cast(game_id as varchar) as game_id, "
          "game_date, season_id, team_name_home, team_name_away, pts_home, pts_away, pts_home > pts_away as "
          "home_win from games")
def scan_csv_roundtrip(spark, sf_dir):
    """S1 + S5 + S10 + P1: games written as CSV (one folder per season) and read back with an explicit schema."""
    g = G.clean_games(derive.games(spark, sf_dir))
    path = shared_dir(spark, "games_csv")
    FS.write_csv(g.select(*[c.split()[0] for c in GAMES_SCHEMA.split(", ")]), path, partition_by="season_id")
    back = FS.read_csv(spark, path, GAMES_SCHEMA.replace("season_id int, ", "") + ", season_id int")
    return G.clean_games(back).select("game_id", "game_date", "season_id", "team_name_home", "team_name_away",
                                      "pts_home", "pts_away", "home_win")


@register("parquet_partition_roundtrip", "with " + derive.cte_games() + " select game_id, game_date, season_id, "
          "pts_home, pts_away from games where season_id between 1996 and 1997")
def parquet_partition_roundtrip(spark, sf_dir):
    """Features-style Parquet sink partitioned by season; read back with partition pruning."""
    g = derive.games(spark, sf_dir).select("game_id", "game_date", "season_id", "pts_home", "pts_away")
    path = shared_dir(spark, "games_parquet")
    FS.write_parquet(g, path, partition_by="season_id")
    return spark.read.parquet(path).where(F.col("season_id").between(1996, 1997)) \
        .select("game_id", "game_date", "season_id", "pts_home", "pts_away")


TEAM_SEASON_SQL = ("with " + cte_team_games() +
                   " select team_name, season_id, count(*) as games, cast(sum(cast(win as int)) as bigint) as wins, "
                   "cast(sum(pts_for) as bigint) as points from tg group by team_name, season_id")


@register("multi_file_union", "select * from (" + TEAM_SEASON_SQL + ") where season_id in (1996, 1997, 1999)")
def multi_file_union(spark, sf_dir):
    """S12 + U2: one stats file set per season.  A season with reordered and differently written columns is
    read by name, one without a needed column and one that does not exist are set aside."""
    tg = G.team_games(derive.games(spark, sf_dir))
    stats = tg.groupBy("team_name", "season_id").agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.col("win").cast("int")).alias("wins"),
        F.sum("pts_for").alias("points"))
    base = shared_dir(spark, "team_stats")
    layouts = {1996: ["team_name", "games", "wins", "points"], 1997: ["points", " Team Name", "WINS", "other", "games"],
               1998: ["team_name", "games", "points"], 1999: ["wins", "points", "games", "team_name"]}
    for season, names in layouts.items():
        rows = stats.where(F.col("season_id") == season).withColumn("other", F.lit("x, y"))
        rows = rows.select(*[F.col(FS.normalize_headers([n])[0]).alias(n) for n in names])
        FS.write_csv(rows, f"{base}/season_id={season}")
    paths = [f"{base}/season_id={s}" for s in (1996, 1997, 1998, 1999, 2030)]  # 1998 lacks the wins, 2030 does not exist
    back = FS.read_many(spark, paths, "team_name string, games long, wins long, points long")
    season = F.regexp_extract(F.col("source_file"), r"season_id=(\d+)", 1).cast("int")
    return back.withColumn("season_id", season).select("team_name", "season_id", "games", "wins", "points")


@register("season_upsert", "with " + derive.cte_games() + " select game_id, season_id, cast(case when season_id = 1997 then "
          "pts_home + 1000 else pts_home end as int) as pts_home, pts_away from games where season_id <> 1997 or game_id % 3 <> 0")
def season_upsert(spark, sf_dir):
    """S10 + S11: all seasons are written, then a corrected 1997 (other points, fewer games) twice: it
    replaces itself, and the other seasons stay."""
    g = derive.games(spark, sf_dir).select("game_id", "season_id", "pts_home", "pts_away")
    path = shared_dir(spark, "games_upsert")
    FS.write_parquet(g, path, partition_by="season_id")
    again = g.where("season_id = 1997 and game_id % 3 <> 0").withColumn("pts_home", F.col("pts_home") + 1000)
    for _ in range(2):
        FS.write_parquet(again, path, partition_by="season_id")
    return spark.read.parquet(path).select("game_id", "season_id", "pts_home", "pts_away")


@register("fresh_files", "with " + derive.cte_bets() + " select 'now' as seen_from, bet_id, bet_date from bets")
def fresh_files(spark, sf_dir):
    """Only rows of files modified within the last 7 days: all of them seen from
    now, none seen from a month ahead."""
    path = shared_dir(spark, "bets_parquet")
    FS.write_parquet(derive.bets(spark, sf_dir).select("bet_id", "bet_date"), path)
    written = spark.read.parquet(path)
    ahead = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=30)
    seen = FS.fresh_only(written, 7).select(F.lit("now").alias("seen_from"), "bet_id", "bet_date")
    return seen.unionByName(FS.fresh_only(written, 7, ahead).select(F.lit("ahead").alias("seen_from"), "bet_id", "bet_date"))


@register("dataset_metadata", "with " + derive.cte_games() + " select count(*) as rows, cast(min(game_date) as "
          "varchar) as min_game_date, cast(max(game_date) as varchar) as max_game_date, 25 as n_columns from games")
def dataset_metadata(spark, sf_dir):
    """Row count, date range and column count of the games table."""
    m = FS.dataset_metadata(derive.games(spark, sf_dir), ["game_date"])
    return m.select("rows", "min_game_date", "max_game_date", "n_columns")


def _quality_sql() -> str:
    from lineup.constants import TEAM_ABBREVIATIONS
    teams = ", ".join(f"('{a}')" for _, a in TEAM_ABBREVIATIONS)
    return (
        FEAT_SQL + ", " + derive.cte_predictions() + ", feats as (select count(*) as n, max(game_date) as hi "
        "from feat where games_played >= 3), odd as (select count(distinct team_abbreviation_home) as n from games "
        "where game_id % 101 = 0), teams(team) as (values " + teams + "), "
        "g as (select count(*) as n, min(game_date) as lo, max(game_date) as hi from games), "
        "dup as (select count(*) as n from (select game_id from games group by 1 having count(*) > 1)), "
        "seen as (select distinct unnest([team_abbreviation_home, team_abbreviation_away]) as team from games), "
        "miss as (select count(*) as n from teams where team not in (select team from seen)), "
        "bad as (select count(*) filter (where home_odds < 1.01 or home_odds > 50 or away_odds < 1.01 or "
        "away_odds > 50) as n, count(*) filter (where home_odds is null or away_odds is null) as m from preds) "
        "select 'games_records' as \"check\", cast(n as varchar) as value, case when n > 0 then 'ok' else 'empty' "
        "end as status from g union all select 'games_date_range', cast(lo as varchar) || ' .. ' || cast(hi as "
        "varchar), 'ok' from g union all select 'duplicate_games', cast(n as varchar), case when n = 0 then 'ok' "
        "else 'warn' end from dup union all select 'teams_missing', cast(n as varchar), case when n = 0 then 'ok' "
        "else 'warn' end from miss union all select 'team_names_inconsistent', "
        "cast(n as varchar), case when n = 0 then 'ok' else 'warn' end from odd union all select 'feature_records', "
        "cast(n as varchar), 'ok' from feats union all select 'latest_date', cast(feats.hi as varchar), case when feats.hi >= "
        "g.hi then 'ok' else 'warn' end from feats, g union all select 'odds_out_of_range', cast(n as varchar), case when "
        "n = 0 then 'ok' else 'warn' end from bad union all select 'odds_missing', cast(m as varchar), case when "
        "m = 0 then 'ok' else 'warn' end from bad")


@register("data_quality", _quality_sql())
def data_quality(spark, sf_dir):
    """A26 + A27: counts, date range, duplicates, missing participants, names that do not
    fit their abbreviation (some are planted), features, price range and gaps."""
    teams = M.team_dimension(spark).select(F.col("team_abbr").alias("team"))
    games = derive.games(spark, sf_dir).withColumn("team_name_home", F.when(
        F.col("game_id") % 101 == 0, F.upper("team_name_home")).otherwise(F.col("team_name_home")))
    return Q.data_quality(games, features_final(spark, sf_dir), derive.predictions(spark, sf_dir), teams)


#: Planted holes: a team without games in a month of a season, and one without any in another season.
HOLES = ("season_id = 1996 and month(game_date) = 3 and 'LAL' in (team_abbreviation_home, team_abbreviation_away) or "
         "season_id = 1997 and 'BOS' in (team_abbreviation_home, team_abbreviation_away)")
MIN_MISSING = 9


def _gaps_sql() -> str:
    from lineup.constants import TEAM_ABBREVIATIONS
    teams = ", ".join(f"('{a}')" for _, a in TEAM_ABBREVIATIONS)
    return (
        "with " + derive.cte_games() + ", kept as (select * from games where not (" + HOLES + ")), teams(team) as (values "
        + teams + "), days as (select season_id as season, game_date as day, row_number() over (partition by season_id "
        "order by game_date) as i from (select distinct season_id, game_date from kept)), played as (select distinct "
        "season_id as season, game_date as day, unnest([team_abbreviation_home, team_abbreviation_away]) as team from kept), "
        "spine as (select team, season, day, i from teams, days), absent as (select *, i - row_number() over (partition by "
        "team, season order by i) as run from spine s where not exists (select 1 from played p where p.team = s.team and "
        "p.season = s.season and p.day = s.day)) select team, season, min(day) as gap_start, max(day) as gap_end, "
        f"cast(count(*) as int) as missing_days from absent group by team, season, run having count(*) >= {MIN_MISSING}")


@register("calendar_gaps", _gaps_sql())
def calendar_gaps(spark, sf_dir):
    """Missing spans of every team on the season's game days, planted holes and a team absent all season among them."""
    from lineup.constants import TEAM_ABBREVIATIONS
    games = derive.games(spark, sf_dir).where(F.expr(f"not ({HOLES})"))
    rows = games.select("season_id", "game_date", F.explode(F.array(
        "team_abbreviation_home", "team_abbreviation_away")).alias("team_name"))
    return Q.calendar_gaps(rows, MIN_MISSING, teams=[a for _, a in TEAM_ABBREVIATIONS])


@register("file_metadata", "with " + derive.cte_games() + " select count(*) as rows, cast(min(game_date) as varchar) as "
          "min_game_date, cast(max(game_date) as varchar) as max_game_date, 5 as n_columns, count(distinct season_id) as "
          "files, true as has_size from games")
def file_metadata(spark, sf_dir):
    """Rows, date range, files and size of a written table, one file a season, from footers and listing."""
    g = derive.games(spark, sf_dir).select("game_id", "game_date", "season_id", "pts_home", "pts_away")
    path = shared_dir(spark, "games_footers")
    FS.write_parquet(g.repartition("season_id"), path, partition_by="season_id")
    return FS.file_metadata(spark, path, ["game_date"]).select(
        "rows", "min_game_date", "max_game_date", "n_columns", "files", (F.col("bytes") > 0).alias("has_size"))


@register("normalized_headers", "select o_orderkey as game_id, o_custkey as offense__pts_per_g, o_totalprice as rk from orders",
          doubles=["rk"])
def normalized_headers(spark, sf_dir):
    """Columns of a table with untidy headers under their plain names."""
    o = derive.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return FS.with_normalized_headers(o.toDF("Game ID", " Offense_ Pts Per G ", "RK "))


@register("iso_prefix_date", "select o_orderkey as game_id, case when o_orderkey % 43 = 0 then null else "
          "cast(cast(o_orderdate as date) as timestamp) end as day from orders")
def iso_prefix_date(spark, sf_dir):
    """The date in front of an ISO text; text that is none gives NULL."""
    o = derive.read(spark, sf_dir, "orders").selectExpr("o_orderkey as game_id", f"{DATE_TEXT} || 'T19:30:00Z' as text")
    return o.select("game_id", C.date_from_iso_prefix("text").cast("timestamp_ntz").alias("day"))
