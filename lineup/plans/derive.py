"""Sports-shaped tables derived from the driver tables.

The driver data has no games, odds or bets, so each query derives them with
integer arithmetic that Spark and DuckDB evaluate alike.  Every derivation
keeps all input rows (no sampling, no id subsets); the modulo arithmetic only
assigns values.  The same SQL expression text feeds ``selectExpr`` on the
Spark side and the DuckDB oracle, so the two sides cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineup.constants import TEAM_ABBREVIATIONS

N_TEAMS = len(TEAM_ABBREVIATIONS)


def read(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    """A driver table.  ``spread_rows`` deals the rows out once over the session's shuffle
    partitions, for a scan that heavy work on each row follows."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if spread_rows else df


def documents(spark: SparkSession, sf_dir: str, *exprs: str, tasks: int | None = None, first=()) -> DataFrame:
    """``orders`` dealt out over ``tasks`` (without it the session's shuffle partitions), as documents that the
    ``exprs`` build.  ``first`` are columns that they use again and again, made beforehand.  The coalesce moves no
    row: it ends the generated code, as the text building and the parsing that follows make together one method
    too long (over 8,000 bytes) for the JVM to compile, which then interprets every row."""
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read(spark, sf_dir, "orders").repartition(tasks)
    rows = rows.selectExpr("*", *first).coalesce(tasks) if first else rows
    return rows.selectExpr(*exprs).coalesce(tasks)


def _pick(values, index_sql: str, dialect: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    if dialect == "spark":
        return f"element_at(array({items}), {index_sql} + 1)"
    return f"([{items}])[{index_sql} + 1]"


def team_name_sql(index_sql: str, dialect: str) -> str:
    return _pick([n for n, _ in TEAM_ABBREVIATIONS], index_sql, dialect)


def team_abbr_sql(index_sql: str, dialect: str) -> str:
    return _pick([a for _, a in TEAM_ABBREVIATIONS], index_sql, dialect)


HOME_ID = f"cast(o_custkey % {N_TEAMS} as int)"
AWAY_ID = f"cast((o_custkey % {N_TEAMS} + 1 + o_orderkey % {N_TEAMS - 1}) % {N_TEAMS} as int)"

# Box-score measures of the wide games table: (column, SQL over orders).
GAME_MEASURES = [
    ("pts_home", "cast(80 + (o_orderkey * 7919) % 61 as int)"),
    ("pts_away", "cast(80 + (o_custkey * 10473 + o_orderkey) % 61 as int)"),
    ("fg_pct_home", "(400 + (o_orderkey * 131) % 150) / 1000e0"),
    ("fg_pct_away", "(400 + (o_custkey * 137 + o_orderkey * 3) % 150) / 1000e0"),
    ("fg3_pct_home", "case when o_orderkey % 97 = 0 then null "
                     "else (300 + (o_orderkey * 151) % 150) / 1000e0 end"),
    ("fg3_pct_away", "(300 + (o_custkey * 157 + o_orderkey * 5) % 150) / 1000e0"),
    ("ft_pct_home", "(650 + (o_orderkey * 173) % 250) / 1000e0"),
    ("ft_pct_away", "(650 + (o_custkey * 179 + o_orderkey * 7) % 250) / 1000e0"),
    ("reb_home", "cast(30 + (o_orderkey * 191) % 25 as int)"),
    ("reb_away", "cast(30 + (o_custkey * 193 + o_orderkey * 11) % 25 as int)"),
    ("ast_home", "cast(15 + (o_orderkey * 197) % 20 as int)"),
    ("ast_away", "cast(15 + (o_custkey * 199 + o_orderkey * 13) % 20 as int)"),
    ("stl_home", "cast(4 + (o_orderkey * 211) % 10 as int)"),
    ("stl_away", "cast(4 + (o_custkey * 223 + o_orderkey * 17) % 10 as int)"),
    ("blk_home", "cast(2 + (o_orderkey * 227) % 8 as int)"),
    ("blk_away", "cast(2 + (o_custkey * 229 + o_orderkey * 19) % 8 as int)"),
    ("tov_home", "cast(8 + (o_orderkey * 233) % 12 as int)"),
    ("tov_away", "cast(8 + (o_custkey * 239 + o_orderkey * 23) % 12 as int)"),
]


def games_exprs(dialect: str) -> list[str]:
    """Select list turning ``orders`` into the wide games table (one row per game)."""
    return [
        "o_orderkey as game_id",
        "cast(o_orderdate as date) as game_date",
        "cast(year(o_orderdate) as int) as season_id",
        f"{team_name_sql(HOME_ID, dialect)} as team_name_home",
        f"{team_name_sql(AWAY_ID, dialect)} as team_name_away",
        f"{team_abbr_sql(HOME_ID, dialect)} as team_abbreviation_home",
        f"{team_abbr_sql(AWAY_ID, dialect)} as team_abbreviation_away",
    ] + [f"{sql} as {name}" for name, sql in GAME_MEASURES]


HOME_PROB = "(0.2e0 + ((o_orderkey * 7919) % 601) / 1000e0)"


def predictions_exprs(dialect: str) -> list[str]:
    """Select list turning ``orders`` into a game-level prediction table."""
    return [
        "o_orderkey as game_id",
        "cast(o_orderdate as date) as game_date",
        f"{team_abbr_sql(HOME_ID, dialect)} as home_team",
        f"{team_abbr_sql(AWAY_ID, dialect)} as away_team",
        f"{HOME_PROB} as home_prob",
        f"1e0 - {HOME_PROB} as away_prob",
        "case when o_orderkey % 17 = 0 then null "
        "else 1.2e0 + ((o_custkey * 10473) % 300) / 100e0 end as home_odds",
        "1.2e0 + ((o_orderkey * 31) % 300) / 100e0 as away_odds",
    ]


BETS_EXPRS = [
    "event_id as bet_id",
    "cast(ts as date) as bet_date",
    "value as bet_amount",
    # a winning bet returns 0.9 of the stake, in whole cents
    "case when (event_id * 7919) % 100 < 52 then round(value * 0.9e0 * 100e0) / 100e0 else -value end "
    "as profit_loss",
]

# Prediction log: a game-level prediction joined to its actual result.
PREDICTION_LOG_EXPRS = [
    "game_id",
    "game_date as date",
    "predicted_winner",
    "actual_winner",
    "confidence",
    "home_prob as predicted_prob",
    "coalesce(predicted_winner = actual_winner, false) as correct_prediction",
]


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*games_exprs("spark"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*predictions_exprs("spark"))


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*BETS_EXPRS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual winner per game (NULL on a tie) from the games table."""
    return games(spark, sf_dir).selectExpr(
        "game_id",
        "case when pts_home > pts_away then team_abbreviation_home "
        "when pts_away > pts_home then team_abbreviation_away end as winner",
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside the actual winners, from one scan (``prediction_outcomes``
    has the join of two tables)."""
    from lineup.operators.markets import pick_winner
    measures = dict(GAME_MEASURES)
    both = read(spark, sf_dir, "orders").selectExpr(
        *predictions_exprs("spark"), f"{measures['pts_home']} as pts_home", f"{measures['pts_away']} as pts_away")
    both = both.selectExpr("*", "case when pts_home > pts_away then home_team "
                           "when pts_away > pts_home then away_team end as actual_winner")
    return pick_winner(both).selectExpr(*PREDICTION_LOG_EXPRS)


# ---- DuckDB side: the same derivations as CTE text -------------------------

def cte_games() -> str:
    return "games as (select " + ", ".join(games_exprs("duckdb")) + " from orders)"


def cte_predictions() -> str:
    return "preds as (select " + ", ".join(predictions_exprs("duckdb")) + " from orders)"


def cte_bets() -> str:
    return "bets as (select " + ", ".join(BETS_EXPRS) + " from events)"


def cte_prediction_log() -> str:
    return (
        cte_games() + ", " + cte_predictions() + ", "
        "picked as (select *, case when home_prob > away_prob then home_team else away_team end "
        "as predicted_winner, greatest(home_prob, away_prob) as confidence from preds), "
        "res as (select game_id, case when pts_home > pts_away then team_abbreviation_home "
        "when pts_away > pts_home then team_abbreviation_away end as actual_winner from games), "
        "plog as (select " + ", ".join(PREDICTION_LOG_EXPRS) +
        " from picked left join res using (game_id))"
    )


# ---- odds feed documents (one JSON array per game, with planted defects) ----

BOOKS = ["draftkings", "fanduel", "betmgm"]
G = "o_orderkey"


def home_price_sql(k: int, move: int = 0) -> str:
    return (f"case when ({G} + {k}) % 2 = 0 then -(100 + ({G} * 7 + {13 * k + move}) % 200) "
            f"else 100 + ({G} * 11 + {17 * k + move}) % 200 end")


def away_price_sql(k: int, move: int = 0) -> str:
    return (f"case when ({G} + {k}) % 2 = 1 then -(100 + ({G} * 3 + {19 * k + move}) % 200) "
            f"else 100 + ({G} * 5 + {23 * k + move}) % 200 end")


# Defects, by game id g and book number k (1..3); each is skipped on its own.
DEFECT_JUNK_ELEMENT = f"{G} % 7 = 0"          # extra non-object array element
DEFECT_NO_AWAY = f"{G} % 13 = 0"              # game without away team -> game dropped
DEFECT_BOOK_NOT_OBJECT = (3, f"{G} % 5 = 0")  # bookmaker is a string
DEFECT_BOOK_NO_KEY = (2, f"{G} % 11 = 0")     # bookmaker without key
DEFECT_NO_H2H = (1, f"{G} % 17 = 0")          # only a spreads market
DEFECT_OUTCOMES_OBJECT = (2, f"{G} % 19 = 0")  # outcomes is an object
DEFECT_PRICE_TEXT = (1, f"{G} % 23 = 0")      # home price is text
DEFECT_PRICE_NULL = (3, f"{G} % 29 = 0")      # home price is null
DEFECT_DUPLICATE = (1, f"{G} % 31 = 0")       # home outcome repeated, +5 (last wins)
DEFECT_ONE_SIDED = (3, f"{G} % 41 = 0")       # the book quotes the home side only
DEFECT_NO_OUTCOMES = (2, f"{G} % 43 = 0")     # outcomes is an empty list
DEFECT_BAD_TIME = f"{G} % 37 = 0"             # commence_time is not a time


def _book_json(k: int, home: str, away: str, move: int = 0) -> str:
    hp = home_price_sql(k, move)
    hp_json = f"cast({hp} as string)"
    if k == DEFECT_PRICE_TEXT[0]:
        hp_json = f"case when {DEFECT_PRICE_TEXT[1]} then '\"even\"' else {hp_json} end"
    if k == DEFECT_PRICE_NULL[0]:
        hp_json = f"case when {DEFECT_PRICE_NULL[1]} then 'null' else {hp_json} end"
    dup = "''"
    if k == DEFECT_DUPLICATE[0]:
        dup = (f"case when {DEFECT_DUPLICATE[1]} then concat(',{{\"name\":\"', {home}, "
               f"'\",\"price\":', cast({hp} + 5 as string), '}}') else '' end")
    other = (f"concat(',{{\"name\":\"', {away}, '\",\"price\":', cast({away_price_sql(k, move)} as string), '}}')")
    if k == DEFECT_ONE_SIDED[0]:
        other = f"case when {DEFECT_ONE_SIDED[1]} then '' else {other} end"
    outcomes = f"concat('[{{\"name\":\"', {home}, '\",\"price\":', {hp_json}, '}}', {other}, {dup}, ']')"
    if k == DEFECT_NO_OUTCOMES[0]:
        outcomes = f"case when {DEFECT_NO_OUTCOMES[1]} then '[]' else {outcomes} end"
    if k == DEFECT_OUTCOMES_OBJECT[0]:
        outcomes = f"case when {DEFECT_OUTCOMES_OBJECT[1]} then '{{\"name\":\"x\"}}' else {outcomes} end"
    market_key = "'h2h'"
    if k == DEFECT_NO_H2H[0]:
        market_key = f"case when {DEFECT_NO_H2H[1]} then 'spreads' else 'h2h' end"
    key = f"'\"key\":\"{BOOKS[k - 1]}\",'"
    if k == DEFECT_BOOK_NO_KEY[0]:
        key = f"case when {DEFECT_BOOK_NO_KEY[1]} then '' else {key} end"
    book = (f"concat('{{', {key}, '\"markets\":[{{\"key\":\"totals\",\"outcomes\":[]}},{{\"key\":\"', "
            f"{market_key}, '\",\"outcomes\":', {outcomes}, '}}]}}')")
    if k == DEFECT_BOOK_NOT_OBJECT[0]:
        book = f"case when {DEFECT_BOOK_NOT_OBJECT[1]} then '\"oops\"' else {book} end"
    return book


COMMENCE_TS = f"timestampadd(HOUR, 16 + {G} % 12, cast(cast(o_orderdate as date) as timestamp))"


#: In later snapshots of the feed these games start a day later.
MOVED_START = f"{G} % 9 = 0"


#: The names of a game's sides as columns of their own, for ``odds_doc_sql``.
SIDES = [f"{team_name_sql(HOME_ID, 'spark')} as _home", f"{team_name_sql(AWAY_ID, 'spark')} as _away"]


def odds_doc_sql(move: int = 0, home: str = team_name_sql(HOME_ID, "spark"),
                 away: str = team_name_sql(AWAY_ID, "spark")) -> str:
    """JSON text of a game's feed document; ``move`` shifts all prices and, if not 0, some starts."""
    start = f"case when {MOVED_START} then {COMMENCE_TS} + interval 1 day else {COMMENCE_TS} end" if move else COMMENCE_TS
    ct = (f"case when {DEFECT_BAD_TIME} then 'not-a-date' else "
          f"date_format({start}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end")
    away_field = f"case when {DEFECT_NO_AWAY} then '' else concat('\"away_team\":\"', {away}, '\",') end"
    books = ", ',', ".join(_book_json(k, home, away, move) for k in (1, 2, 3))
    game = (f"concat('{{\"id\":\"', cast({G} as string), '\",\"commence_time\":\"', {ct}, "
            f"'\",\"home_team\":\"', {home}, '\",', {away_field}, '\"bookmakers\":[', {books}, ']}}')")
    return f"concat('[', {game}, case when {DEFECT_JUNK_ELEMENT} then ',17' else '' end, ']')"


def odds_documents(spark: SparkSession, sf_dir: str, move: int = 0, tasks: int | None = None) -> DataFrame:
    """One odds feed document per game (JSON text) built from ``orders``.  Each name stands in it many times;
    looked up in place, they make the text's method too long for the JVM to compile."""
    return documents(spark, sf_dir, f"{G} as doc_id", f"{odds_doc_sql(move, '_home', '_away')} as doc", tasks=tasks, first=SIDES)


#: Documents of a snapshot that lie in one file of the feed.
DOCS_PER_FILE = 250_000


def feed_files(spark: SparkSession, sf_dir: str) -> int:
    """Into how many files a snapshot of the feed is cut: as many as the cores, and more when they would hold more than
    ``DOCS_PER_FILE`` documents.  The session's shuffle partitions would make hundreds of small ones."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "orders").count() // DOCS_PER_FILE))


def cte_odds_rows(move: int = 0) -> str:
    """DuckDB: the (game, book) rows the flatten must produce, from the same rules."""
    conds = []
    for (k, c) in (DEFECT_BOOK_NOT_OBJECT, DEFECT_BOOK_NO_KEY, DEFECT_NO_H2H, DEFECT_OUTCOMES_OBJECT):
        conds.append(f"not (k = {k} and {c})")
    hp = "case " + " ".join(f"when k = {k} then {home_price_sql(k, move)}" for k in (1, 2, 3)) + " end"
    ap = "case " + " ".join(f"when k = {k} then {away_price_sql(k, move)}" for k in (1, 2, 3)) + " end"
    empty = f"k = {DEFECT_NO_OUTCOMES[0]} and {DEFECT_NO_OUTCOMES[1]}"
    ap = f"case when {empty} or k = {DEFECT_ONE_SIDED[0]} and {DEFECT_ONE_SIDED[1]} then null else {ap} end"
    days = f"case when {MOVED_START} then 1 else 0 end" if move else "0"
    # the appended duplicate is the last outcome, so it wins over a text price
    home_odds = (f"case when {empty} then null when k = {DEFECT_DUPLICATE[0]} and {DEFECT_DUPLICATE[1]} then {hp} + 5 "
                 f"when k = {DEFECT_PRICE_TEXT[0]} and {DEFECT_PRICE_TEXT[1]} then null "
                 f"when k = {DEFECT_PRICE_NULL[0]} and {DEFECT_PRICE_NULL[1]} then null else {hp} end")
    books = ", ".join(f"'{b}'" for b in BOOKS)
    return (
        "ob as (select o.*, k from orders o, (values (1), (2), (3)) b(k) where not (" + DEFECT_NO_AWAY + ") and "
        + " and ".join(conds) + "), "
        "odds_rows as (select cast(" + G + " as varchar) as game_id, "
        "case when " + DEFECT_BAD_TIME + " then null else cast(cast(o_orderdate as date) as timestamp) "
        "+ to_hours(cast(16 + " + G + " % 12 + 24 * (" + days + ") as integer)) end as commence_time, "
        + team_name_sql(HOME_ID, "duckdb") + " as home_team, " + team_name_sql(AWAY_ID, "duckdb") +
        " as away_team, ([" + books + "])[k] as bookmaker, cast(" + home_odds + " as double) as home_odds, "
        "cast(" + ap + " as double) as away_odds from ob)"
    )


# ---- scoreboard documents: shape A for even game ids, shape B for odd ------

def scoreboard_doc_sql() -> str:
    home = team_abbr_sql(HOME_ID, "spark")
    away = team_abbr_sql(AWAY_ID, "spark")
    t = f"date_format({COMMENCE_TS}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    arena = f"case when {G} % 3 = 0 then '' else concat(',\"arenaName\":\"Arena ', {home}, '\"') end"
    shape_a = (f"concat('{{\"scoreboard\":{{\"games\":[{{\"gameId\":\"', cast({G} as string), "
               f"'\",\"gameTimeUTC\":\"', {t}, '\",\"homeTeam\":{{\"teamTricode\":\"', {home}, "
               f"'\"}},\"awayTeam\":{{\"teamTricode\":\"', {away}, '\"}},\"gameStatus\":', "
               f"cast(1 + {G} % 3 as string), {arena}, '}}]}}}}')")
    comp_home = f"concat('{{\"homeAway\":\"home\",\"team\":{{\"abbreviation\":\"', {home}, '\"}}}}')"
    comp_away = f"concat('{{\"homeAway\":\"away\",\"team\":{{\"abbreviation\":\"', {away}, '\"}}}}')"
    comps = (f"case when {G} % 4 = 1 then concat({comp_away}, ',', {comp_home}) "
             f"else concat({comp_home}, ',', {comp_away}) end")
    shape_b = (f"concat('{{\"events\":[{{\"id\":\"', cast({G} as string), '\",\"date\":\"', {t}, "
               f"'\",\"competitions\":[{{\"competitors\":[', {comps}, '],\"status\":{{\"type\":{{\"name\":\"STATUS_', "
               f"cast(1 + {G} % 3 as string), '\"}}}},\"venue\":{{\"fullName\":\"Arena ', {home}, '\"}}}}]}}]}}')")
    return f"case when {G} % 2 = 0 then {shape_a} else {shape_b} end"


def scoreboard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, f"{G} as doc_id", f"{G} % 2 = 0 as shape_a", f"{scoreboard_doc_sql()} as doc")
