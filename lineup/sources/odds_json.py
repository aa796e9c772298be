"""Odds feed documents -> (game, bookmaker) rows.

Each input row holds one feed document: a JSON array of games, each game
with bookmakers -> markets -> outcomes.  Parsing goes through ``VARIANT`` so a
malformed element is skipped on its own instead of voiding its whole array
(a fixed ``from_json`` schema returns NULL for the entire array).  The VARIANT is cast once to the
nested type that is read; a lookup for every field would walk and copy its parts again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineup.functions.odds import american_to_prob


#: What is read of a document, as one type: a VARIANT is cast to it in one walk, and a part that does not fit
#: (an element that is no object, a price that is text) becomes NULL on its own.
GAMES_TYPE = ("array<struct<id string, commence_time string, home_team string, away_team string, bookmakers array<struct<"
              "key string, markets array<struct<key string, outcomes array<struct<name string, price double>>>>>>>>")


def _price(outcomes: str, team: str) -> Column:
    # last outcome with the team's name wins (a dict built in order would keep the last)
    # a side that the book does not quote is NULL
    return F.expr(f"try_element_at(filter({outcomes}, o -> o.name = {team}), -1).price")


def parse_documents(docs: DataFrame, doc_col: str = "doc", strict: bool = False) -> DataFrame:
    """One row per document with its array of game elements (``_games``,
    NULL when the document is not a JSON array).  ``strict=True`` fails the job
    on a non-array document (the reference raises); otherwise such documents
    are only flagged (``_is_array``)."""
    v = docs.withColumn("_games", F.expr(f"try_variant_get(try_parse_json({doc_col}), '$', '{GAMES_TYPE}')"))
    is_array = F.col("_games").isNotNull()
    if strict:
        return v.withColumn("_is_array", F.when(is_array, F.lit(True))
                            .otherwise(F.raise_error(F.lit("odds document is not a list"))))
    return v.withColumn("_is_array", is_array)


# Filtered inside the arrays, before they are exploded.
_GAMES = "filter(_games, x -> x.home_team <> '' and x.away_team <> '')"
_BOOKS = (
    "filter(transform(_g.bookmakers, b -> named_struct('bookmaker', b.key, "
    "'outcomes', get(filter(b.markets, m -> m.key = 'h2h'), 0).outcomes)), "
    "x -> x.bookmaker <> '' and x.outcomes is not null)"
)


def flatten_odds(docs: DataFrame, doc_col: str = "doc", bookmakers=None,
                 strict: bool = False, fixed_prob: bool = False, keep=()) -> DataFrame:
    """Tolerant flatten of odds documents to (game, bookmaker) rows.

    Skipped, each on its own: a game element that is not an object, a game
    without both team names, a bookmaker that is not an object or has no key,
    a bookmaker without an ``h2h`` market, ``outcomes`` that is not a list.
    A price that is NULL, text or not positive gives a NULL probability, a side
    that is not quoted (or an empty list) a NULL price; of duplicate outcome names
    the last wins.  ``bookmakers`` keeps only the
    listed keys (blank entries ignored); ``keep`` carries document columns.
    """
    v = parse_documents(docs, doc_col, strict)
    if strict:
        v = v.where("_is_array")
    games = v.select(*keep, F.explode(F.expr(_GAMES)).alias("_g"))
    # carry only the scalar game fields past the second explode (not the books array)
    books = games.select(*keep, F.col("_g.id").alias("game_id"), F.col("_g.commence_time").alias("ct"), "_g.home_team", "_g.away_team",
                         F.explode(F.expr(_BOOKS)).alias("_b"))
    if bookmakers:
        allowed = [b for b in bookmakers if b]
        if allowed:
            books = books.where(F.col("_b.bookmaker").isin(allowed))
    rows = books.select(
        *keep, "game_id", F.try_to_timestamp(F.col("ct")).alias("commence_time"),
        "home_team", "away_team", F.col("_b.bookmaker").alias("bookmaker"),
        _price("_b.outcomes", "home_team").alias("home_odds"),
        _price("_b.outcomes", "away_team").alias("away_odds"),
    )
    return rows.withColumns({"home_prob": american_to_prob("home_odds", fixed_prob),
                             "away_prob": american_to_prob("away_odds", fixed_prob)})


def dropped_documents(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Quality metric: documents that are not a JSON array."""
    v = parse_documents(docs, doc_col)
    return v.agg(F.count(F.lit(1)).alias("documents"),
                 F.sum((~F.col("_is_array")).cast("int")).alias("not_a_list"))
