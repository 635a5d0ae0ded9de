"""One query for each operator over the derived domain, and SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting, rounding, scoring, text
from ..operators import constants, edits, enrich, features, filters, incremental, model, model_store, panel, requests, search, select, squad, stats, suggest
from ..operators.constants import DEFAULT_WEIGHTS, PRESETS, STRATEGIES
from ..sources import gameweeks, landed, mock, readers, versions
from ..sources.versions import shared_folder as _shared
from ..sources.versions import temporary as _temporary
from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of its rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# SQL of the derived relations

PLAYERS = """players AS (
    SELECT p_partkey AS id, p_name AS name, CAST(p_partkey % 27 AS INTEGER) AS team, CAST(p_partkey % 4 + 1 AS INTEGER) AS element_type,
           ['GK', 'DEF', 'MID', 'FWD'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS pos, 40 + 2 * p_size AS now_cost,
           CAST(p_partkey % 11 AS DOUBLE) / CAST(2 AS DOUBLE) AS form,
           CASE p_partkey % 7 WHEN 0 THEN 'i' WHEN 1 THEN 'd' WHEN 2 THEN 's' ELSE 'a' END AS status FROM part
)"""
FIXTURES = """fixtures AS (
    SELECT o_orderkey AS ord, CAST(o_orderkey % 38 + 1 AS INTEGER) AS event, CAST(o_custkey % 20 + 1 AS INTEGER) AS team_h,
           CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 + 1 AS INTEGER) AS team_a,
           CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) % 5 + 1 AS INTEGER) AS team_h_difficulty,
           CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 5 + 1 AS INTEGER) AS team_a_difficulty FROM orders
), sides AS (
    SELECT ord, event, team_h AS team, team_a AS opponent, team_h_difficulty AS difficulty, true AS is_home FROM fixtures
    UNION ALL SELECT ord, event, team_a, team_h, team_a_difficulty, false FROM fixtures
)"""
EASE = """ease AS (
    SELECT team, CAST(sum(difficulty) AS DOUBLE) / count(*) AS next3_ease FROM (
        SELECT *, row_number() OVER (PARTITION BY team ORDER BY ord) AS nth FROM sides WHERE event >= {gameweek}
    ) WHERE nth <= 3 GROUP BY team
)"""
ADVANCED = """advanced AS (
    SELECT l_partkey AS id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 8 AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS xg90,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) * 8 AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS xa90,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS exp_min, CAST(count(*) AS DOUBLE) / 2 AS avg_points,
           CAST(count(*) AS DOUBLE) / 10 AS value, CAST(sum(CAST(l_quantity AS BIGINT)) % 100 AS DOUBLE) AS ownership FROM lineitem GROUP BY l_partkey
)"""
ENRICHED = """enriched AS (
    SELECT p.id, p.id AS ord, p.name, p.team AS team_id, coalesce(substr(n_name, 1, 3), 'UNK') AS team_short, p.pos, CAST(now_cost AS DOUBLE) / 10 AS price, form, status,
           coalesce(xg90, 0) AS xg90, coalesce(xa90, 0) AS xa90, coalesce(exp_min, 0) AS exp_min, coalesce(next3_ease, 3) AS next3_ease,
           coalesce(avg_points, 0) AS avg_points, coalesce(value, 0) AS value, coalesce(ownership, 0) AS ownership
    FROM players p LEFT JOIN nation ON team = n_nationkey LEFT JOIN ease ON ease.team = p.team LEFT JOIN advanced a ON a.id = p.id
)"""
LIVE = """live AS (
    SELECT player_id, gameweek, CAST(q AS DOUBLE) AS points, CAST(n * 30 AS DOUBLE) AS minutes, CAST(r AS DOUBLE) AS goals_scored, CAST(a AS DOUBLE) AS assists,
           CAST(q AS DOUBLE) / 10 AS ict_index, CAST(d AS DOUBLE) / 100 AS expected_goals, CAST(t AS DOUBLE) / 100 AS expected_assists,
           CAST(q % 2 AS DOUBLE) AS clean_sheets, CAST(n % 3 AS DOUBLE) AS goals_conceded, CAST(q % 11 // 10 AS DOUBLE) AS own_goals, CAST(q % 13 // 12 AS DOUBLE) AS penalties_saved,
           CAST(q % 17 // 16 AS DOUBLE) AS penalties_missed, CAST(d % 3 AS DOUBLE) AS yellow_cards, CAST(d % 7 // 6 AS DOUBLE) AS red_cards, CAST(t % 6 AS DOUBLE) AS saves,
           CAST(q % 4 AS DOUBLE) AS bonus, CAST(q + d AS DOUBLE) AS bps, CAST(3 * d AS DOUBLE) / 10 AS influence, CAST(7 * t AS DOUBLE) / 10 AS creativity, CAST(q % 50 AS DOUBLE) / 2 AS threat,
           CAST(1 AS DOUBLE) AS starts, CAST(d + t AS DOUBLE) / 100 AS expected_goal_involvements, CAST(5 * n + d AS DOUBLE) / 100 AS expected_goals_conceded,
           CAST(40 + q % 60 AS DOUBLE) / 10 AS price, CAST(q % 100 AS DOUBLE) AS selected_by_percent
    FROM (SELECT l_partkey AS player_id, CAST((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) AS INTEGER) AS gameweek, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
                 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t FROM lineitem GROUP BY 1, 2)
)"""
PANEL = """panel AS (
    SELECT l.*, p.name, p.element_type AS position, p.team, CAST(p.id % 90 AS DOUBLE) / 10 AS value_form, CAST(p.id % 70 AS DOUBLE) / 7 AS value_season, coalesce(f.difficulty, 3) AS fixture_difficulty, coalesce(f.is_home, true) AS is_home
    FROM live l JOIN players p ON l.player_id = p.id
    LEFT JOIN (SELECT event, team, arg_max(difficulty, ord) AS difficulty, arg_max(is_home, ord) AS is_home FROM sides GROUP BY event, team) f ON f.event = l.gameweek AND f.team = p.team
)"""
PREDICTIONS = """predictions AS (
    SELECT player_id, max(points) / 10 AS predicted_points, any_value(element_type) AS position, CAST(any_value(now_cost) AS DOUBLE) / 10 AS price, any_value(team) AS team, any_value(pos) AS pos
    FROM live JOIN players ON player_id = id GROUP BY player_id
)"""
SLOTS = """slots AS (
    SELECT squad_id, CASE WHEN k < starts THEN 'xi' ELSE 'bench' END AS section,
           CAST(CASE WHEN k < starts THEN CASE pos WHEN 'GK' THEN 1 WHEN 'DEF' THEN 2 + k WHEN 'MID' THEN 6 + k ELSE 10 + k END
                ELSE CASE pos WHEN 'GK' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END END AS INTEGER) AS slot_no,
           CASE WHEN squad_id % 10 = 3 AND k = 1 THEN id - 4 ELSE id END AS id, pos, CAST(now_cost AS DOUBLE) / 20 AS price,
           CAST(CASE WHEN squad_id % 10 = 2 THEN 90.0 ELSE 0.5 END AS DOUBLE) AS bank
    FROM (SELECT *, id // 20 AS squad_id, id // 4 % 5 AS k, CASE pos WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END AS per,
                 CASE pos WHEN 'GK' THEN 1 WHEN 'FWD' THEN 2 ELSE 4 END AS starts FROM players)
    WHERE k < per AND NOT (squad_id % 10 = 1 AND pos = 'FWD')
)"""
ORDER = "OVER (PARTITION BY player_id ORDER BY gameweek)"


def with_(*parts: str, gameweek: int = 1) -> str:
    return "WITH " + ", ".join(p.replace("{gameweek}", str(gameweek)) for p in parts) + "\n"


def enriched_sql(gameweek: int = 1) -> list[str]:
    return [PLAYERS, FIXTURES, EASE.replace("{gameweek}", str(gameweek)), ADVANCED, ENRICHED]


METRIC_SQL = {
    "form": "least(form * 2, 10)", "xg90": "least(xg90 * 20, 10)", "xa90": "least(xa90 * 25, 10)", "exp_min": "exp_min / 90 * 10", "next3_ease": "(6 - next3_ease) * 2",
    "avg_points": "least(avg_points * CAST(0.5 AS DOUBLE), 10)", "value": "least(value * 2, 10)", "ownership": "ownership / 10",
}


def score_sql(w: dict[str, float] | None = None) -> str:
    """The score of weights, or of the columns w_<metric>."""
    total = " + ".join(f"{expr} * " + (f"CAST({w.get(m, 0.0)!r} AS DOUBLE)" if w is not None else f"w_{m}") for m, expr in METRIC_SQL.items())
    return f"floor(({total}) * 100 + CAST(0.5 AS DOUBLE)) / 100"


def half_up_sql(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * CAST({10**digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**digits} AS DOUBLE))"


LABEL = "CASE WHEN status IN ('i', 's', 'd') THEN 'not-playing' WHEN score >= 8 THEN 'perfect' WHEN score >= 6 THEN 'good' WHEN score >= 4 THEN 'poor' ELSE 'urgent' END"
SCORED = f"scored AS (SELECT *, {LABEL} AS label FROM (SELECT *, {score_sql(DEFAULT_WEIGHTS)} AS score FROM enriched))"


def sets_sql(sets: dict[str, dict[str, float]], name: str) -> str:
    rows = ", ".join("('" + k.replace("'", "''") + "', " + ", ".join(f"CAST({w[m]!r} AS DOUBLE)" for m in scoring.METRICS) + ")" for k, w in sets.items())
    return f"sets({name}, " + ", ".join(f"w_{m}" for m in scoring.METRICS) + f") AS (VALUES {rows})"


W_COLUMNS = ", ".join(f"w_{m}" for m in scoring.METRICS)


def literal_sql(rows: str, name: str = "name", more: str = "") -> str:
    """Sets of weights as written here, in hundredths."""
    weights = ", ".join(f"CAST(w_{m} AS DOUBLE) / 100 AS w_{m}" for m in scoring.METRICS)
    return f"SELECT {name}{more}, {weights} FROM (VALUES {rows}) t({name}{more}, {W_COLUMNS})"


STRATEGY_ROWS = """
    ('balanced', 15, 15, 15, 20, 15, 15, 5, 0), ('premium', 15, 25, 25, 20, 5, 5, 0, 5), ('value', 15, 15, 15, 15, 10, 10, 20, 0), ('differential', 20, 20, 15, 15, 15, 10, 3, 2),
    ('form', 25, 15, 10, 15, 25, 5, 3, 2), ('template', 10, 10, 10, 25, 10, 20, 5, 10), ('setforget', 5, 15, 15, 30, 5, 25, 3, 2), ('wildcard', 30, 20, 15, 10, 20, 2, 2, 1)"""
STRATEGY_SETS = f"sets(strategy, {W_COLUMNS}) AS ({literal_sql(STRATEGY_ROWS, 'strategy')})"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best players by score."""
    top = stats.scored(domain.enriched(spark, sf_dir)).orderBy(F.desc("score"), "id").limit(15)
    return top.select("id", "name", "team_short", "pos", "price", "score", "label")


@query(with_(*enriched_sql(), SCORED) + "SELECT id, name, team_short, pos, price, score, label FROM scored ORDER BY score DESC, id LIMIT 15")
def top_scores(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(with_(*enriched_sql()) + "SELECT * FROM enriched")
def players_enriched(spark, sf_dir):
    return domain.enriched(spark, sf_dir)


@query(with_(*enriched_sql(20)) + "SELECT * FROM enriched")
def players_enriched_gameweek20(spark, sf_dir):
    return domain.enriched(spark, sf_dir, 20)


@query(with_(*enriched_sql()) + "SELECT count(*) AS count FROM enriched")
def players_count(spark, sf_dir):
    return domain.enriched(spark, sf_dir).agg(F.count("*").alias("count"))


@query(with_(*enriched_sql()) + "SELECT * FROM enriched WHERE id = 17")
def player_by_id(spark, sf_dir):
    return filters.by_id(domain.enriched(spark, sf_dir), " 17th")


@query(with_(*enriched_sql()) + "SELECT * FROM enriched WHERE pos = 'DEF'")
def players_by_position(spark, sf_dir):
    return filters.by_position(domain.enriched(spark, sf_dir), "def")


@query(with_(*enriched_sql()) + "SELECT * FROM enriched WHERE status = 'a'")
def players_available(spark, sf_dir):
    return filters.available(domain.enriched(spark, sf_dir))


# the statistics that the whole-number columns of the view are derived from, in its order
VIEW_NUMBERS = [
    "points_per_game", "selected_by_percent", "transfers_in", "transfers_out", "value_form", "value_season", "influence", "creativity", "threat", "ict_index", "starts",
    "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded", "goals_scored", "assists", "clean_sheets", "goals_conceded", "own_goals",
    "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus", "bps", "influence_rank", "creativity_rank", "threat_rank", "ict_index_rank",
]
VIEW = """stats AS (
    SELECT p.*, CAST(p_size AS INTEGER) AS total_points, {numbers},
           CASE WHEN id % 5 = 0 THEN CAST(id % 3 AS INTEGER) END AS corners_and_indirect_freekicks_order, CASE WHEN id % 6 = 0 THEN CAST(id % 3 AS INTEGER) END AS direct_freekicks_order,
           CASE WHEN id % 7 = 0 THEN CAST(id % 3 AS INTEGER) END AS penalties_order
    FROM players p JOIN part ON id = p_partkey
)""".replace("{numbers}", ", ".join(f"CAST(id * {k} % 97 AS INTEGER) AS {c}" for k, c in enumerate(VIEW_NUMBERS, 3)))


@query(with_(PLAYERS, VIEW) + f"SELECT id, name, element_type AS position, team, coalesce(n_name, 'Unknown') AS team_name, CAST(now_cost AS DOUBLE) / 10 AS price, printf('%.1f', form) AS form, total_points, {', '.join(VIEW_NUMBERS)}, corners_and_indirect_freekicks_order, direct_freekicks_order, penalties_order FROM stats LEFT JOIN nation ON team = n_nationkey")
def current_players(spark, sf_dir):
    return enrich.current_players(domain.player_statistics(spark, sf_dir), domain.teams(spark, sf_dir))


@query(with_(PLAYERS, VIEW) + "SELECT id AS player_id, name, element_type AS position, team, CAST(now_cost AS DOUBLE) / 10 AS price, selected_by_percent, transfers_in, transfers_out, value_form, value_season FROM stats")
def static_attributes(spark, sf_dir):
    return enrich.static_attributes(domain.player_statistics(spark, sf_dir))


@query(with_(FIXTURES) + "SELECT ord, ord AS id, event, team_h, team_a, team_h_difficulty, team_a_difficulty FROM fixtures")
def fixtures_all(spark, sf_dir):
    return domain.fixtures(spark, sf_dir)


@query(with_(FIXTURES) + "SELECT ord, ord AS id, event, team_h, team_a, team_h_difficulty, team_a_difficulty FROM fixtures WHERE event = 5")
def fixtures_by_gameweek(spark, sf_dir):
    return filters.by_gameweek(domain.fixtures(spark, sf_dir), 5)


@query(with_(FIXTURES) + "SELECT ord, ord AS id, event, team_h, team_a, team_h_difficulty, team_a_difficulty FROM fixtures WHERE team_h = 7 OR team_a = 7")
def fixtures_by_team(spark, sf_dir):
    return filters.by_team(domain.fixtures(spark, sf_dir), 7)


@query(with_(FIXTURES) + "SELECT * FROM sides")
def fixture_team_view(spark, sf_dir):
    return enrich.fixture_sides(domain.fixtures(spark, sf_dir))


@query(with_(FIXTURES, EASE, gameweek=30) + "SELECT * FROM ease")
def next3_ease(spark, sf_dir):
    return enrich.next3_ease(domain.fixtures(spark, sf_dir), 30)


@query("SELECT CAST(coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), max(o_orderkey), 1) AS INTEGER) AS gameweek FROM orders")
def current_gameweek(spark, sf_dir):
    events = domain.table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS int) AS id", "o_orderkey AS ord", "o_orderstatus = 'O' AS is_current")
    return readers.current_gameweek(events)


@query(with_(*enriched_sql(), SCORED) + "SELECT id, score, label FROM scored")
def player_scores(spark, sf_dir):
    return stats.scored(domain.enriched(spark, sf_dir)).select("id", "score", "label")


@query(with_(*enriched_sql(), STRATEGY_SETS) + f"SELECT id, strategy, {score_sql()} AS score FROM enriched, sets")
def strategy_scores(spark, sf_dir):
    return stats.scored_by_sets(domain.enriched(spark, sf_dir), STRATEGIES).select("id", "strategy", "score")


@query(with_(*enriched_sql(), sets_sql(PRESETS, "preset")) + f"SELECT id, preset, {score_sql()} AS score FROM enriched, sets")
def preset_scores(spark, sf_dir):
    return stats.scored_by_sets(domain.enriched(spark, sf_dir), PRESETS, "preset").select("id", "preset", "score")


PRESET_ROWS = """
    ('Balanced Approach', 'Well-rounded team focusing on consistent performers across all positions', 15, 15, 15, 20, 15, 15, 5, 0),
    ('Premium Heavy', 'Invest heavily in proven premium players with guaranteed minutes', 10, 20, 20, 25, 10, 10, 2, 3),
    ('Value Optimized', 'Maximum points per million - focus on budget enablers and differentials', 15, 15, 15, 15, 10, 10, 20, 0),
    ('Form & Fixtures', 'Players in hot form with favorable upcoming fixture runs', 25, 15, 10, 15, 25, 5, 3, 2),
    ('Set & Forget', 'Stable team with minimal transfers - focus on season-long consistency', 5, 15, 15, 30, 5, 25, 3, 2)"""


@query(with_(*enriched_sql(), f"sets AS ({literal_sql(PRESET_ROWS, more=', description')})") + f"""SELECT name, any_value(description) AS description, {', '.join(f'any_value(w_{m}) AS w_{m}' for m in scoring.METRICS)},
    count(*) AS n_players, count(*) FILTER (WHERE score >= 6) AS n_good, max(score) AS best_score FROM (SELECT sets.*, {score_sql()} AS score FROM enriched, sets) GROUP BY name""")
def presets(spark, sf_dir):
    """The presets, and how all players fare under each."""
    return constants.presets_frame(spark).join(stats.summed_up(domain.enriched(spark, sf_dir), PRESETS, "preset").withColumnRenamed("preset", "name"), "name")


@query(with_(*enriched_sql(), "sets AS (" + literal_sql("('default', 20, 15, 15, 15, 10, 15, 5, 5), ('ai', 25, 20, 20, 15, 10, 5, 3, 2)") + ")") + f"SELECT enriched.id, sets.name AS weights, {score_sql()} AS score FROM enriched, sets")
def default_weights(spark, sf_dir):
    """All players by the default and by the model's weights."""
    sets = {"default": DEFAULT_WEIGHTS, "ai": constants.AI_WEIGHTS}
    return stats.scored_by_sets(domain.enriched(spark, sf_dir), sets, "weights").select("id", "weights", "score")


@query(with_(*enriched_sql(), STRATEGY_SETS, "sums AS (SELECT " + ", ".join(f"CAST(sum(CAST(floor(({expr}) * 10000 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS s_{m}" for m, expr in METRIC_SQL.items()) + " FROM enriched)") + "SELECT strategy, CAST(rank AS INTEGER) AS rank, metric, weight, contribution FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY contribution DESC, place) AS rank FROM (" + " UNION ALL ".join(f"SELECT strategy, {i} AS place, '{m}' AS metric, w_{m} AS weight, s_{m} * w_{m} / 10000 AS contribution FROM sets, sums" for i, m in enumerate(scoring.METRICS)) + ")) WHERE rank <= 3")
def top_weights(spark, sf_dir):
    """The three metrics of each strategy that add most to all players' scores."""
    return stats.top_contributions(domain.enriched(spark, sf_dir), STRATEGIES)


@query(with_(PLAYERS) + """SELECT formation, f.pos AS pos, CAST(substr(places, i, 1) AS INTEGER) AS starting, [2, 5, 5, 3][i] AS total, coalesce(n_available, 0) AS n_available
FROM (SELECT * FROM (VALUES ('3-4-3', '1343'), ('3-5-2', '1352'), ('4-3-3', '1433'), ('4-4-2', '1442'), ('4-5-1', '1451'), ('5-3-2', '1532'), ('5-4-1', '1541')) f(formation, places),
     (VALUES (1, 'GK'), (2, 'DEF'), (3, 'MID'), (4, 'FWD')) p(i, pos)) f LEFT JOIN (SELECT pos, count(*) AS n_available FROM players WHERE status = 'a' GROUP BY pos) a ON a.pos = f.pos""")
def formations(spark, sf_dir):
    """The places of each formation, and how many available players there are for them."""
    rows = domain.players(spark, sf_dir).where("status = 'a'").groupBy(enrich.position("element_type").alias("pos")).agg(F.count("*").alias("n_available"))
    return constants.formations_frame(spark).join(rows, "pos", "left").withColumn("n_available", F.coalesce("n_available", F.lit(0)))


CUSTOM = dict(zip(scoring.METRICS, (0.6, 0.2, 0.2, 0.4, 0.1, 0.3, 0.1, 0.1), strict=True))


@query(with_(*enriched_sql()) + f"SELECT id, {score_sql(scoring.normalised_weights(CUSTOM))} AS score FROM enriched")
def custom_weights_normalised(spark, sf_dir):
    return domain.enriched(spark, sf_dir).select("id", scoring.score(scoring.normalised_weights(CUSTOM)).alias("score"))


@query(with_(*enriched_sql(), SCORED) + "SELECT pos, floor(coalesce(avg(score), 0) * 1000000 + CAST(0.5 AS DOUBLE)) / 1000000 AS average_score FROM (VALUES ('GK'), ('DEF'), ('MID'), ('FWD')) t(pos) LEFT JOIN scored USING (pos) GROUP BY pos")
def position_averages(spark, sf_dir):
    return stats.position_averages(stats.scored(domain.enriched(spark, sf_dir))).select("pos", rounding.half_up(F.col("average_score"), 6).alias("average_score"))


@query(with_(*enriched_sql(), SCORED) + "SELECT label, count(id) AS n FROM (VALUES ('perfect'), ('good'), ('poor'), ('urgent'), ('not-playing')) t(label) LEFT JOIN scored USING (label) GROUP BY label")
def label_counts(spark, sf_dir):
    return stats.label_counts(stats.scored(domain.enriched(spark, sf_dir)))


@query(with_(*enriched_sql(), SCORED) + "SELECT floor(coalesce(sum(score), 0) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS total_score, floor(coalesce(avg(score), 0) * 1000000 + CAST(0.5 AS DOUBLE)) / 1000000 AS average_score, count(*) AS n FROM scored")
def total_average_score(spark, sf_dir):
    return stats.totals(stats.scored(domain.enriched(spark, sf_dir))).select(rounding.half_up(F.col("total_score"), 3).alias("total_score"), rounding.half_up(F.col("average_score"), 6).alias("average_score"), "n")


@query(with_(*enriched_sql(), SCORED) + "SELECT id, score, CASE WHEN score >= 8 THEN 'Excellent' WHEN score >= 6 THEN 'Good' WHEN score >= 4 THEN 'Average' ELSE 'Poor' END AS level FROM scored")
def score_levels(spark, sf_dir):
    return stats.scored(domain.enriched(spark, sf_dir)).select("id", "score", scoring.level(F.col("score")).alias("level"))


@query("SELECT doc_id, regexp_replace(regexp_replace(strip_accents(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g') AS name FROM documents")
def name_normalise(spark, sf_dir):
    return domain.table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("name"))


def search_sql(name: str, limit: int = 5) -> str:
    norm = lambda x: f"regexp_replace(regexp_replace(strip_accents(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"
    return with_(*enriched_sql(), f"q AS (SELECT {norm(repr(name))} AS q)", f"n AS (SELECT e.*, q, {norm('name')} AS n FROM enriched e, q)", "w AS (SELECT *, len(list_filter(string_split(q, ' '), lambda a: len(list_filter(string_split(n, ' '), lambda b: contains(b, a))) > 0)) AS shared, greatest(length(q), length(n)) AS longest FROM n)", "s AS (SELECT *, CAST(CASE WHEN n = q THEN 100 WHEN contains(n, q) THEN 80 WHEN shared > 0 THEN CAST(shared AS DOUBLE) / len(string_split(q, ' ')) * 60 WHEN CAST(longest - levenshtein(q, n) AS DOUBLE) / longest * 40 > 20 THEN CAST(longest - levenshtein(q, n) AS DOUBLE) / longest * 40 ELSE 0 END AS DOUBLE) AS similarity FROM w)") + f"SELECT id, name, similarity FROM s WHERE similarity > 0 ORDER BY similarity DESC, ord, id LIMIT {limit}"


def _search(name: str, limit: int = 5):
    return lambda spark, sf_dir: search.search(domain.enriched(spark, sf_dir), name, limit).select("id", "name", "similarity")


SEARCHES = {"search_exact": ("small gear", 5), "search_contains": ("giz", 8), "search_words": ("Red zzz", 5), "search_fuzzy": ("lrage bolk", 5), "search_accents": ("  SMÁLL  GÉÄR! ", 5), "search_first": ("large", 1)}
for _name, (_asked, _limit) in SEARCHES.items():
    QUERIES[_name], SQL[_name] = _search(_asked, _limit), search_sql(_asked, _limit)


NORMAL = "regexp_replace(regexp_replace(strip_accents(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"


def search_many_sql(asked: str, names: str, limit: int) -> str:
    """asked: asked_id, name; names: id, ord, name."""
    return f"""q AS (SELECT asked_id, {NORMAL.replace('{x}', 'name')} AS q FROM ({asked}) WHERE length(name) BETWEEN 1 AND 100),
n AS (SELECT id, ord, name, {NORMAL.replace('{x}', 'name')} AS n FROM ({names})),
w AS (SELECT q, n, len(list_filter(string_split(q, ' '), lambda a: len(list_filter(string_split(n, ' '), lambda b: contains(b, a))) > 0)) AS shared,
             greatest(length(q), length(n)) AS longest FROM (SELECT DISTINCT q FROM q), (SELECT DISTINCT n FROM n)),
s AS (SELECT q, n, CAST(CASE WHEN n = q THEN 100 WHEN contains(n, q) THEN 80 WHEN shared > 0 THEN CAST(shared AS DOUBLE) / len(string_split(q, ' ')) * 60
             WHEN CAST(longest - levenshtein(q, n) AS DOUBLE) / longest * 40 > 20 THEN CAST(longest - levenshtein(q, n) AS DOUBLE) / longest * 40 ELSE 0 END AS DOUBLE) AS similarity FROM w),
r AS (SELECT q, id, name, similarity, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, ord, id) AS rank FROM s JOIN n USING (n) WHERE similarity > 0)
SELECT asked_id, CAST(rank AS INTEGER) AS rank, id, name, similarity FROM q JOIN r USING (q) WHERE rank <= {limit}"""


@query(with_(*enriched_sql(), search_many_sql("SELECT c_custkey AS asked_id, left(p_name, c_custkey % 5 + 1) || substr(p_name, CAST(c_custkey % 5 + 3 AS INTEGER)) AS name FROM customer JOIN part ON p_partkey = c_custkey % 200", "SELECT id, ord, name FROM enriched", 5)))
def search_many(spark, sf_dir):
    """Every customer asks for a part's name and leaves out a letter."""
    customers = domain.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asked_id"), (F.col("c_custkey") % 200).alias("p_partkey"))
    garbled = F.expr("concat(left(p_name, cast(asked_id % 5 AS int) + 1), substr(p_name, cast(asked_id % 5 AS int) + 3))")
    asked = customers.join(domain.table(spark, sf_dir, "part"), "p_partkey").select("asked_id", garbled.alias("name"))
    return search.search_many(domain.enriched(spark, sf_dir), asked)


@query("WITH " + search_many_sql("SELECT doc_id AS asked_id, substr(text, CAST(doc_id % 17 + 2 AS INTEGER), 24) AS name FROM documents", "SELECT doc_id AS id, doc_id AS ord, left(text, 30) AS name FROM documents", 3))
def search_many_heads(spark, sf_dir):
    """Every document asks for part of its beginning among the beginnings of all documents."""
    docs = domain.table(spark, sf_dir, "documents")
    heads = docs.selectExpr("doc_id AS id", "doc_id AS ord", "left(text, 30) AS name")
    return search.search_many(heads, docs.selectExpr("doc_id AS asked_id", "substr(text, cast(doc_id % 17 AS int) + 2, 24) AS name"), 3)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every player: own position, up to 2 more than the own price, without the next of the position."""
    rows = domain.players(spark, sf_dir).withColumn("position", enrich.position("element_type"))
    return rows.selectExpr("id AS request_id", "id AS player_id", "position", "now_cost / 10 + 2 AS max_price", "array(id + 4) AS exclude_ids")


def suggest_sql(w: dict[str, float], limit: int) -> str:
    return with_(*enriched_sql(), f"scored AS (SELECT *, {score_sql(w)} AS score FROM enriched)") + f"SELECT request_id, player_id, CAST(rank AS INTEGER) AS rank, id, name, team_short, price, score, {half_up_sql('score - current_score')} AS delta FROM (SELECT c.id AS request_id, c.id AS player_id, s.id, s.name, s.team_short, s.price, s.score, c.score AS current_score, row_number() OVER (PARTITION BY c.id ORDER BY s.score DESC, s.ord, s.id) AS rank FROM scored c JOIN scored s ON s.pos = c.pos AND s.price <= c.price + 2 AND s.id <> c.id AND s.id <> c.id + 4 AND s.status = 'a') WHERE rank <= {limit}"


BULK_WEIGHTS = {"form": 0.3, "xg90": 0.2, "xa90": 0.2, "exp_min": 0.2, "next3_ease": 0.1}


@query(suggest_sql(DEFAULT_WEIGHTS, 5))
def suggest_one(spark, sf_dir):
    return suggest.suggest(domain.enriched(spark, sf_dir), _requests(spark, sf_dir))


@query(suggest_sql(BULK_WEIGHTS, 3))
def suggest_bulk(spark, sf_dir):
    return suggest.suggest(domain.enriched(spark, sf_dir), _requests(spark, sf_dir), BULK_WEIGHTS, 3)


SLOT_SUGGESTIONS = f"""found AS (
    SELECT squad_id, slot_no, current_id, CAST(rank AS INTEGER) AS rank, id, name, price, {half_up_sql('score - now_score')} AS delta FROM (
        SELECT l.squad_id, l.slot_no, l.id AS current_id, n.score AS now_score, s.id, s.name, s.price, s.score,
               row_number() OVER (PARTITION BY l.squad_id, l.slot_no ORDER BY abs(s.score - n.score) DESC, s.ord, s.id) AS rank
        FROM slots l JOIN scored n ON n.id = l.id JOIN scored s ON s.pos = n.pos AND round(s.price * 10) <= round(l.price * 10) + round(l.bank * 10) AND s.status = 'a' AND s.id <> l.id AND abs(s.score - n.score) <= 1.5
        WHERE l.section = 'xi' AND NOT EXISTS (SELECT 1 FROM slots x WHERE x.squad_id = l.squad_id AND x.id = s.id)
    ) WHERE rank <= 5
)"""
TOTALS = f"""totals AS (
    SELECT squad_id, total_score, {half_up_sql('total_score / n')} AS average_score, flagged, bank_left FROM (
        SELECT squad_id, CAST(sum(CASE WHEN section = 'xi' THEN CAST(round(score * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS total_score,
               count(*) FILTER (WHERE section = 'xi' AND label <> 'perfect') AS flagged, count(*) AS n, max(bank) AS bank_left
        FROM slots l JOIN scored s ON s.id = l.id GROUP BY squad_id)
)"""


@query(with_(*enriched_sql(), SCORED, SLOTS, SLOT_SUGGESTIONS) + "SELECT * FROM found")
def squad_suggestions(spark, sf_dir):
    return suggest.slot_suggestions(domain.squad_slots(spark, sf_dir), domain.enriched(spark, sf_dir))


@query(with_(*enriched_sql(), SCORED, SLOTS, TOTALS) + "SELECT * FROM totals")
def squad_totals(spark, sf_dir):
    return squad.totals(domain.squad_slots(spark, sf_dir), domain.enriched(spark, sf_dir))


@query(with_(*enriched_sql(), SCORED, SLOTS, SLOT_SUGGESTIONS, TOTALS) + "SELECT squad_id, total_score, average_score, flagged, bank_left, section, slot_no, id, score, label, n_suggestions FROM totals JOIN (SELECT l.squad_id, l.section, l.slot_no, l.id, s.score, s.label, CASE WHEN l.section = 'xi' THEN (SELECT count(*) FROM found f WHERE f.squad_id = l.squad_id AND f.slot_no = l.slot_no) ELSE 0 END AS n_suggestions FROM slots l JOIN scored s ON s.id = l.id) USING (squad_id)")
def squad_analysis(spark, sf_dir):
    rows = squad.analyse(domain.squad_slots(spark, sf_dir), domain.enriched(spark, sf_dir))
    flat = rows.select("squad_id", "total_score", "average_score", "flagged", "bank_left", F.explode("results").alias("r"))
    return flat.select("squad_id", "total_score", "average_score", "flagged", "bank_left", "r.section", "r.slot_no", "r.id", "r.score", "r.label", F.size("r.suggestions").cast("long").alias("n_suggestions"))


COUNTS = """counts AS (
    SELECT squad_id, count(*) FILTER (WHERE section = 'xi') AS n_xi, count(*) FILTER (WHERE section = 'bench') AS n_bench,
           count(*) FILTER (WHERE section = 'xi' AND pos = 'GK') AS n_gk, count(*) FILTER (WHERE section = 'xi' AND pos = 'DEF') AS n_def,
           count(*) FILTER (WHERE section = 'xi' AND pos = 'MID') AS n_mid, count(*) FILTER (WHERE section = 'xi' AND pos = 'FWD') AS n_fwd,
           sum(round(price * 10)) AS cost, max(round(bank * 10)) AS bank, count(id) AS n_ids, count(DISTINCT id) AS n_distinct FROM slots GROUP BY squad_id
)"""
LEGAL = " OR ".join(f"(n_gk = {a} AND n_def = {b} AND n_mid = {c} AND n_fwd = {d})" for a, b, c, d in constants.FORMATIONS.values())


@query(with_(PLAYERS, SLOTS, COUNTS) + f"SELECT squad_id, errors = '' AS valid, errors FROM (SELECT squad_id, concat_ws('; ', CASE WHEN n_xi <> 11 THEN 'Starting XI must have exactly 11 players' END, CASE WHEN n_bench <> 4 THEN 'Bench must have exactly 4 players' END, CASE WHEN NOT ({LEGAL}) THEN 'Invalid formation - must have 1 GK and valid DEF/MID/FWD distribution' END, CASE WHEN cost + bank > 1000 THEN 'Total squad value cannot exceed 100.0' END, CASE WHEN n_ids <> n_distinct THEN 'Cannot have duplicate players in squad' END) AS errors FROM counts)")
def squad_validate(spark, sf_dir):
    return squad.validate(domain.squad_slots(spark, sf_dir)).select("squad_id", "valid", F.concat_ws("; ", "errors").alias("errors"))


@query(with_(PLAYERS, SLOTS, COUNTS) + "SELECT squad_id, n_xi, n_bench, n_gk, n_def, n_mid, n_fwd FROM counts")
def squad_position_counts(spark, sf_dir):
    return squad.position_counts(domain.squad_slots(spark, sf_dir))


@query(with_(PLAYERS, SLOTS, COUNTS) + "SELECT squad_id, CASE WHEN n_xi = 11 AND n_gk = 1 AND n_def BETWEEN 3 AND 5 AND n_mid BETWEEN 3 AND 5 AND n_fwd BETWEEN 1 AND 3 THEN n_def || '-' || n_mid || '-' || n_fwd ELSE 'Invalid' END AS formation FROM counts")
def formation_string(spark, sf_dir):
    return squad.formations(domain.squad_slots(spark, sf_dir))


@query(with_(PLAYERS, SLOTS) + "SELECT squad_id, value_ex_bank, round((value_ex_bank + bank) * 10) / 10 AS value_inc_bank, value_ex_bank AS budget_used_percent, 100 - bank AS spent FROM (SELECT squad_id, sum(round(price * 10)) / 10 AS value_ex_bank, max(bank) AS bank FROM slots GROUP BY squad_id)")
def squad_value(spark, sf_dir):
    return squad.values(domain.squad_slots(spark, sf_dir))


@query(with_(PLAYERS, SLOTS) + "SELECT squad_id, count(DISTINCT team) AS n_teams FROM slots JOIN players USING (id) GROUP BY squad_id")
def squad_teams(spark, sf_dir):
    return squad.team_counts(domain.squad_slots(spark, sf_dir), domain.enriched(spark, sf_dir))


@query(with_(PLAYERS, SLOTS) + "SELECT * FROM slots WHERE squad_id % 10 NOT IN (1, 3)")
def squad_json(spark, sf_dir):
    """Slots to nested squads, to JSON, back, and to slots again, without the squads that break rules on slots."""
    slots = domain.squad_slots(spark, sf_dir).where("squad_id % 10 NOT IN (1, 3)")
    written = readers.squads_to_json(squad.nested(slots)).select("squad_id", "json")
    return squad.slots_of(readers.parse_squads(written).where("problem IS NULL"))


PANEL_SQL = [PLAYERS, FIXTURES, LIVE, PANEL]


@query(with_(*PANEL_SQL) + "SELECT * FROM panel")
def panel_joined(spark, sf_dir):
    return domain.panel(spark, sf_dir)


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, points FROM panel WHERE gameweek BETWEEN 14 AND 17")
def panel_range(spark, sf_dir):
    return panel.between(domain.panel(spark, sf_dir), 14, 17).select("player_id", "gameweek", "points")


def uniform_sql(salt: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(id || ':{salt}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296)"


@query(with_(PLAYERS) + f"SELECT id, {uniform_sql('xg90')} * CAST(0.8 AS DOUBLE) AS xg90, {uniform_sql('xa90')} * CAST(0.6 AS DOUBLE) AS xa90, CAST(floor({uniform_sql('exp_min')} * 90) AS DOUBLE) AS exp_min, {uniform_sql('avg_points')} * 15 + 2 AS avg_points, ({uniform_sql('avg_points')} * 15 + 2) / ({uniform_sql('price')} * 10 + 4) AS value, {uniform_sql('ownership')} * 100 AS ownership FROM players")
def mock_advanced(spark, sf_dir):
    return mock.advanced(domain.players(spark, sf_dir))


@query(with_(*PANEL_SQL) + "SELECT count(*) AS n_rows, min(gameweek) AS first_gameweek, max(gameweek) AS last_gameweek, count(DISTINCT player_id) AS n_players FROM panel")
def panel_summary(spark, sf_dir):
    return panel.summary(domain.panel(spark, sf_dir))


def rolling_sql() -> str:
    means = [f"floor(avg({c}) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) * 1000000 + CAST(0.5 AS DOUBLE)) / 1000000 AS {short}_avg_{n}" for c, short in features.ROLLED.items() for n in features.SPANS]
    return with_(*PANEL_SQL) + f"SELECT player_id, gameweek, {', '.join(means)} FROM panel"


@query(rolling_sql())
def rolling_means(spark, sf_dir):
    rows = features.time_features(domain.panel(spark, sf_dir))
    return rows.select("player_id", "gameweek", *[rounding.half_up(F.col(f"{short}_avg_{n}"), 6).alias(f"{short}_avg_{n}") for short in features.ROLLED.values() for n in features.SPANS])


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, avg(points) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS form_3gw, avg(points) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS form_5gw FROM panel")
def form_columns(spark, sf_dir):
    return features.time_features(domain.panel(spark, sf_dir)).select("player_id", "gameweek", "form_3gw", "form_5gw")


def trend_sql(c: str) -> str:
    return f"coalesce(({c} - lag({c}, 2) {ORDER}) / 2, {c} - lag({c}, 1) {ORDER}, 0) AS {c}_trend"


@query(with_(*PANEL_SQL) + f"SELECT player_id, gameweek, {trend_sql('points')}, {trend_sql('minutes')} FROM panel")
def trends(spark, sf_dir):
    return features.time_features(domain.panel(spark, sf_dir)).select("player_id", "gameweek", "points_trend", "minutes_trend")


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, " + ", ".join(f"floor(coalesce(stddev_samp({c}) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS {c}_std_5" for c in ("points", "minutes")) + " FROM panel")
def rolling_std(spark, sf_dir):
    rows = features.time_features(domain.panel(spark, sf_dir))
    return rows.select("player_id", "gameweek", *[rounding.half_up(F.col(f"{c}_std_5"), 3).alias(f"{c}_std_5") for c in ("points", "minutes")])


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, price - first_value(price) OVER w AS price_change_3gw, selected_by_percent - first_value(selected_by_percent) OVER w AS ownership_change_3gw FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def changes(spark, sf_dir):
    return features.time_features(domain.panel(spark, sf_dir)).select("player_id", "gameweek", "price_change_3gw", "ownership_change_3gw")


@query(with_(*PANEL_SQL) + f"SELECT player_id, gameweek, lead(points, 1) {ORDER} AS next_gameweek_points FROM panel")
def next_target(spark, sf_dir):
    return features.target(domain.panel(spark, sf_dir)).select("player_id", "gameweek", "next_gameweek_points")


@query(with_(*PANEL_SQL) + f"SELECT player_id, gameweek, lead(points, 3) {ORDER} + lead(points, 1) {ORDER} + lead(points, 2) {ORDER} AS fixed, lead(points, 3) {ORDER} + lead(points, 2) {ORDER} + lead(points, 3) {ORDER} AS compat FROM panel")
def horizon_target(spark, sf_dir):
    rows = domain.panel(spark, sf_dir)
    fixed = features.target(rows, 3).withColumnRenamed("next_gameweek_points", "fixed")
    return features.target(fixed, 3, compat=True).select("player_id", "gameweek", "fixed", F.col("next_gameweek_points").alias("compat"))


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, CASE WHEN goals_scored = 0 THEN CAST(0 AS DOUBLE) ELSE points / goals_scored END AS a, CAST(0 AS DOUBLE) AS b, CASE WHEN gameweek % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE points END AS c FROM panel")
def feature_fill(spark, sf_dir):
    rows = domain.panel(spark, sf_dir).selectExpr("player_id", "gameweek", "CASE WHEN goals_scored = 0 THEN double('inf') ELSE points / goals_scored END AS a", "double('nan') AS b", "CASE WHEN gameweek % 3 <> 0 THEN points END AS c")
    return features.filled(rows, ["a", "b", "c"])


@query(with_(*PANEL_SQL) + "SELECT gameweek, CAST(place AS INTEGER) AS place, place <= floor(n * 0.8) AS train FROM (SELECT gameweek, row_number() OVER (ORDER BY gameweek) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT gameweek FROM panel))")
def train_test_split(spark, sf_dir):
    return panel.split_gameweeks(domain.panel(spark, sf_dir))


PREDICTION_SQL = [PLAYERS, LIVE, PREDICTIONS]
CONFIDENCE = "least(greatest(CAST(0.8 AS DOUBLE) - predicted_points * CAST(0.02 AS DOUBLE), CAST(0.3 AS DOUBLE)), CAST(0.95 AS DOUBLE))"


@query(with_(*PREDICTION_SQL) + f"SELECT player_id, position, predicted_points, CAST(rank AS INTEGER) AS rank, {CONFIDENCE} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY predicted_points DESC, player_id) AS rank FROM predictions) WHERE rank <= 5")
def top_by_position(spark, sf_dir):
    return select.top_by_position(domain.predictions(spark, sf_dir)).select("player_id", "position", "predicted_points", "rank", "confidence")


@query(with_(*PREDICTION_SQL) + "SELECT player_id, position, predicted_points FROM predictions ORDER BY predicted_points DESC, player_id LIMIT 10")
def top_overall(spark, sf_dir):
    return select.top_overall(domain.predictions(spark, sf_dir)).select("player_id", "position", "predicted_points")


@query(with_(*PREDICTION_SQL) + """, tops AS (
    SELECT *, row_number() OVER (PARTITION BY position ORDER BY predicted_points DESC, player_id) AS rank, row_number() OVER (ORDER BY predicted_points DESC, player_id) AS place FROM predictions
)
SELECT section, CAST(n AS INTEGER) AS rank, n || '. player ' || player_id || ', ' || printf('%.2f', predicted_points) || ' points' AS line
FROM (SELECT 'position ' || position AS section, rank AS n, * FROM tops WHERE rank <= 5 UNION ALL SELECT 'all' AS section, place AS n, * FROM tops WHERE place <= 10)""")
def prediction_report(spark, sf_dir):
    return select.report(domain.predictions(spark, sf_dir))


@query("SELECT line, count(*) AS n FROM (" + SQL["prediction_report"] + ") GROUP BY line")
def report_file(spark, sf_dir):
    """The lines of the report as a text file has them."""
    path = _temporary(spark, "report")
    readers.save_report(select.report(domain.predictions(spark, sf_dir)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(with_(*PREDICTION_SQL) + "SELECT player_id + 1000000 * (player_id % 2) AS player_id, predicted_points, CASE WHEN player_id % 2 = 1 THEN 'Player ' || (player_id + 1000000) ELSE p.name END AS name, CASE WHEN player_id % 2 = 1 THEN 'Unknown' ELSE coalesce(n_name, 'Unknown') END AS team_name FROM predictions r JOIN players p ON p.id = player_id LEFT JOIN nation ON p.team = n_nationkey")
def predictions_named(spark, sf_dir):
    rows = domain.predictions(spark, sf_dir).selectExpr("player_id + 1000000 * (player_id % 2) AS player_id", "predicted_points")
    return select.name_predictions(rows, enrich.current_players(domain.players(spark, sf_dir), domain.teams(spark, sf_dir), []))


@query(with_(*PREDICTION_SQL) + "SELECT player_id, price, predicted_points FROM predictions WHERE price <= 9.5 AND player_id NOT IN (3, 5, 8)")
def predictions_affordable(spark, sf_dir):
    return filters.affordable(domain.predictions(spark, sf_dir), 9.5, [3, 5, 8]).select("player_id", "price", "predicted_points")


def formation_sql(formation: str) -> str:
    start = dict(zip(constants.POSITIONS.values(), constants.FORMATIONS[formation], strict=True))
    total = dict(zip(constants.POSITIONS.values(), constants.SQUAD_PLACES, strict=True))
    case = lambda d: "CASE pos " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in d.items()) + " END"
    return f"team AS (SELECT player_id, pos, price, predicted_points, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= {case(start)} THEN 'xi' ELSE 'bench' END AS section FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY predicted_points DESC, player_id) AS rank FROM predictions) WHERE rank <= {case(total)})"


for _formation in constants.FORMATIONS:
    _name = f"formation_select_{_formation.replace('-', '')}"
    QUERIES[_name] = lambda spark, sf_dir, f=_formation: select.by_formation(domain.predictions(spark, sf_dir), f).select("player_id", "pos", "price", "predicted_points", "rank", "section")
    SQL[_name] = with_(*PREDICTION_SQL, formation_sql(_formation)) + "SELECT * FROM team"


@query(with_(*PREDICTION_SQL, formation_sql("3-4-3")) + "SELECT sum(round(price * 10)) / 10 AS total_cost, floor(sum(predicted_points) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS expected_points, count(*) AS n_players FROM team")
def formation_totals(spark, sf_dir):
    sums = select.formation_totals(select.by_formation(domain.predictions(spark, sf_dir)))
    return sums.withColumn("expected_points", rounding.half_up(F.col("expected_points"), 3))


@query(with_(*PREDICTION_SQL, formation_sql("3-4-3")) + "SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY predicted_points DESC, player_id) AS INTEGER) AS slot_no, player_id AS id, p.name, coalesce(substr(n_name, 1, 3), 'UNK') AS team_short, t.pos, t.price, 100 - sum(round(t.price * 10)) OVER () / 10 AS bank FROM team t JOIN players p ON p.id = player_id LEFT JOIN nation ON p.team = n_nationkey")
def ai_squad(spark, sf_dir):
    return select.ai_squad(select.by_formation(domain.predictions(spark, sf_dir)), domain.enriched(spark, sf_dir))


@query(with_(*PREDICTION_SQL) + "SELECT player_id, position, predicted_points, CAST(row_number() OVER (ORDER BY predicted_points DESC, player_id) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY predicted_points DESC, player_id) AS rank FROM predictions) WHERE rank <= 5")
def top_all_positions(spark, sf_dir):
    """The positions' best in one list."""
    return select.merged(select.top_by_position(domain.predictions(spark, sf_dir))).select("player_id", "position", "predicted_points", "place")


@query(with_(*PREDICTION_SQL, formation_sql("3-4-3")) + "SELECT section, player_id AS id, false AS fallback FROM team")
def ai_or_balanced(spark, sf_dir):
    return select.ai_or_balanced(domain.predictions(spark, sf_dir), domain.enriched(spark, sf_dir)).select("section", "id", "fallback")


@query(with_(*PREDICTION_SQL) + "SELECT squad_id, section, CAST(row_number() OVER (PARTITION BY squad_id, section ORDER BY list_position(['GK', 'DEF', 'MID', 'FWD'], pos), slot_no) AS INTEGER) AS slot_no, id FROM (" + with_(PLAYERS, SLOTS) + "SELECT * FROM slots)")
def squad_order(spark, sf_dir):
    return squad.in_order(domain.squad_slots(spark, sf_dir)).select("squad_id", "section", "slot_no", "id")


MOVES = """open_ AS (SELECT * FROM slots WHERE squad_id % 10 <> 3 AND NOT (section = 'bench' AND slot_no = 4 AND squad_id % 3 > 0)),
n AS (SELECT squad_id, count(*) FILTER (WHERE section = 'xi') AS n_xi, count(*) FILTER (WHERE section = 'bench') AS n_bench FROM open_ GROUP BY squad_id),
moved AS (
    SELECT o.squad_id, id, pos, price, bank,
           CASE WHEN section = 'xi' AND slot_no = o.squad_id % 11 + 1 AND n_bench < 4 THEN 'bench' ELSE section END AS section,
           CASE WHEN section = 'xi' AND slot_no = o.squad_id % 11 + 1 AND n_bench < 4 THEN 100 ELSE slot_no END AS slot_no FROM open_ o JOIN n ON n.squad_id = o.squad_id
)"""


@query(with_(PLAYERS, SLOTS, MOVES) + "SELECT squad_id, section, CAST(row_number() OVER (PARTITION BY squad_id, section ORDER BY list_position(['GK', 'DEF', 'MID', 'FWD'], pos), slot_no) AS INTEGER) AS slot_no, id FROM moved")
def squad_moves(spark, sf_dir):
    """Of every squad that holds no player twice one starting player goes to the bench; every third bench is full, so nothing moves there."""
    slots = domain.squad_slots(spark, sf_dir).where("squad_id % 10 <> 3 AND NOT (section = 'bench' AND slot_no = 4 AND squad_id % 3 > 0)")
    moves = slots.where("section = 'xi' AND slot_no = squad_id % 11 + 1").select("squad_id", "id", F.lit(True).alias("from_starting"))
    return squad.move_slots(slots, moves).select("squad_id", "section", "slot_no", "id")


@query(with_(PLAYERS, SLOTS) + "SELECT squad_id, CASE WHEN k < 11 THEN 'xi' ELSE 'bench' END AS section, CAST(CASE WHEN k < 11 THEN k + 1 ELSE k - 10 END AS INTEGER) AS slot_no, id FROM (SELECT *, row_number() OVER (PARTITION BY squad_id ORDER BY price DESC, id, section, slot_no) - 1 AS k FROM slots)")
def squad_split(spark, sf_dir):
    """Squads as lists by falling price: the first eleven start."""
    dearest = F.sort_array(F.collect_list(F.struct((-F.col("price")).alias("k"), "id", "section", "slot_no", "pos", "price")))
    picks = domain.squad_slots(spark, sf_dir).groupBy("squad_id").agg(F.transform(dearest, lambda x: F.struct(x["id"], x["pos"], x["price"])).alias("picks"))
    return squad.split_by_index(picks).select("squad_id", "section", "slot_no", "id")


PLACES = """places(step, section, positions, free) AS (VALUES
    (0, 'xi', ['GK'], -1), (1, 'xi', ['DEF'], -1), (2, 'xi', ['DEF'], -1), (3, 'xi', ['DEF'], -1), (4, 'xi', ['MID'], -1), (5, 'xi', ['MID'], -1), (6, 'xi', ['MID'], -1), (7, 'xi', ['FWD'], -1),
    {free},
    (19, 'bench', ['GK'], -1), (20, 'bench', ['DEF'], -1), (21, 'bench', ['MID'], -1), (22, 'bench', ['FWD'], -1)
)""".replace("{free}", ", ".join(f"({8 + k}, 'xi', ['DEF', 'MID', 'FWD'], {k})" for k in range(11)))
POOL = """pool AS (
    SELECT *, CASE strategy WHEN 'premium' THEN premium WHEN 'value' THEN score / price ELSE score END AS key, CASE strategy WHEN 'premium' THEN premium ELSE score END AS raw_key
    FROM (SELECT *, score * (1 + price * CAST(0.1 AS DOUBLE)) AS premium FROM (SELECT *, CAST(tenths AS DOUBLE) / 10 AS price FROM (
        SELECT strategy, id, ord, pos, CAST(round(price * 10) AS INTEGER) AS tenths, {score} AS score FROM enriched, sets WHERE status = 'a' AND strategy IN ({strategies}))))
)"""
# one place a turn: the best affordable unused candidate of each of its positions, of these the one with the highest score
WALK = """walk AS (
    SELECT DISTINCT strategy, 0 AS step, {budget} AS bank, CAST([] AS BIGINT[]) AS used, 0 AS required,
           CAST([] AS STRUCT(section VARCHAR, slot_no INTEGER, id BIGINT, pos VARCHAR, tenths INTEGER, score DOUBLE)[]) AS picks FROM pool
    UNION ALL
    SELECT strategy, step + 1, CASE WHEN id IS NULL THEN bank ELSE bank - tenths END, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END,
           CASE WHEN id IS NOT NULL AND free < 0 AND section = 'xi' THEN required + 1 ELSE required END,
           CASE WHEN id IS NULL THEN picks ELSE list_append(picks, struct_pack(section := section, slot_no := CAST(len(list_filter(picks, lambda x: x.section = section)) + 1 AS INTEGER), id := id, pos := pos, tenths := tenths, score := score)) END
    FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC NULLS LAST, list_position(positions, pos)) AS n FROM (
        SELECT w.*, p.section, p.positions, p.free, c.id, c.pos, c.tenths, c.score, row_number() OVER (PARTITION BY w.strategy, c.pos ORDER BY c.key DESC, c.score DESC, c.ord, c.id) AS m
        FROM walk w JOIN places p ON p.step = w.step
        LEFT JOIN pool c ON c.strategy = w.strategy AND list_contains(p.positions, c.pos) AND c.tenths <= w.bank AND NOT list_contains(w.used, c.id) AND (p.free < 0 OR p.free < 11 - w.required)
    ) WHERE m = 1) WHERE n = 1
), team AS (SELECT * FROM walk WHERE step = 23)"""
# one starting player a turn: a dearer unused one of the position with a better score takes the place, while over 2.0 are left at first
UPGRADE = """better AS (
    SELECT strategy, 1 AS step, bank, used, picks, picks[1:0] AS done FROM team WHERE bank > 20
    UNION ALL
    SELECT strategy, step + 1, CASE WHEN up THEN bank + old.tenths - tenths ELSE bank END, CASE WHEN up THEN list_append(list_filter(used, lambda u: u <> old.id), id) ELSE used END, picks,
           list_append(done, CASE WHEN up THEN struct_pack(section := old.section, slot_no := old.slot_no, id := id, pos := pos, tenths := tenths, score := score) ELSE old END)
    FROM (SELECT b.*, b.picks[b.step] AS old, c.id, c.pos, c.tenths, c.score, b.picks[b.step].section = 'xi' AND coalesce(c.score > b.picks[b.step].score, false) AS up,
                 row_number() OVER (PARTITION BY b.strategy ORDER BY c.raw_key DESC NULLS LAST, c.score DESC, c.ord, c.id) AS n
          FROM better b LEFT JOIN pool c ON c.strategy = b.strategy AND c.pos = b.picks[b.step].pos AND c.tenths <= b.bank + b.picks[b.step].tenths AND c.tenths > b.picks[b.step].tenths AND NOT list_contains(b.used, c.id)
          WHERE b.step <= len(b.picks)) WHERE n = 1
)"""


def generate_sql(strategies: list[str], tenths: int, upgrade: bool = True) -> str:
    pool = POOL.replace("{score}", score_sql()).replace("{strategies}", ", ".join(f"'{s}'" for s in strategies))
    parts = with_(*enriched_sql(), STRATEGY_SETS, pool, PLACES, WALK.replace("{budget}", str(tenths)), *([UPGRADE] if upgrade else []))
    done = "SELECT strategy, bank, picks FROM team" + (" WHERE bank <= 20 UNION ALL SELECT strategy, bank, done FROM better WHERE step = len(picks) + 1" if upgrade else "")
    return parts.replace("WITH ", "WITH RECURSIVE ", 1) + (
        f"SELECT strategy, p.section AS section, p.slot_no AS slot_no, p.id AS id, p.pos AS pos, CAST(p.tenths AS DOUBLE) / 10 AS price, p.score AS score, CAST(bank AS DOUBLE) / 10 AS bank FROM (SELECT strategy, bank, unnest(picks) AS p FROM ({done}))"
    )


for _strategy in STRATEGIES:
    QUERIES[f"generate_{_strategy}"] = lambda spark, sf_dir, s=_strategy: select.generate(domain.enriched(spark, sf_dir), 100.0, {s: STRATEGIES[s]})
    SQL[f"generate_{_strategy}"] = generate_sql([_strategy], 1000)


@query("SELECT section, slot_no, id, price, bank, true AS fallback FROM (" + generate_sql(["balanced"], 1000) + ")")
def ai_fallback(spark, sf_dir):
    """A model that predicts nothing: the balanced squad takes its place."""
    none = domain.predictions(spark, sf_dir).where("predicted_points < 0")
    return select.ai_or_balanced(none, domain.enriched(spark, sf_dir)).select("section", "slot_no", "id", "price", "bank", "fallback")


@query(generate_sql(list(STRATEGIES), 900))
def generate_all(spark, sf_dir):
    return select.generate(domain.enriched(spark, sf_dir), 90.0)


@query(generate_sql(list(STRATEGIES), 1000, upgrade=False))
def generate_without_upgrade(spark, sf_dir):
    return select.generate(domain.enriched(spark, sf_dir), 100.0, upgrade=False)


@query(with_(PLAYERS) + """SELECT id, CASE WHEN r10 = floor(r10) THEN '£' || CAST(CAST(r10 AS BIGINT) AS VARCHAR) || 'm' ELSE '£' || printf('%.1f', r10) || 'm' END AS price, printf('%.1f', form) AS form, printf('%.2f', form / 7) AS xg, CAST(id % 90 AS VARCHAR) || 'min' AS minutes,
       CASE WHEN d >= 0 THEN '+' ELSE '' END || CASE WHEN d10 = floor(d10) THEN CAST(CAST(d10 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', d10) END AS delta, CASE WHEN id % 5 + 1 <= 2 THEN 'Easy' WHEN id % 5 + 1 <= 3 THEN 'Medium' ELSE 'Hard' END AS difficulty
FROM (SELECT *, floor(CAST(now_cost AS DOUBLE) / 10 * 10 + CAST(0.5 AS DOUBLE)) / 10 AS r10, form - CAST(2.5 AS DOUBLE) AS d, floor((form - CAST(2.5 AS DOUBLE)) * 10 + CAST(0.5 AS DOUBLE)) / 10 AS d10 FROM players)""")
def format_values(spark, sf_dir):
    rows = domain.enriched(spark, sf_dir)
    form = F.col("form")
    return rows.select("id", formatting.price(F.col("price")).alias("price"), formatting.fixed(form, 1).alias("form"), formatting.fixed(form / 7, 2).alias("xg"), formatting.minutes(F.col("id") % 90).alias("minutes"), formatting.delta(form - 2.5).alias("delta"), formatting.difficulty(F.col("id") % 5 + 1).alias("difficulty"))


@query(with_(*enriched_sql(), SCORED) + "SELECT id, CASE label WHEN 'perfect' THEN 'Perfect' WHEN 'good' THEN 'Good' WHEN 'poor' THEN 'Poor' WHEN 'urgent' THEN 'Urgent' ELSE 'Not Playing' END AS label FROM scored")
def label_texts(spark, sf_dir):
    return stats.scored(domain.enriched(spark, sf_dir)).select("id", formatting.label_text(F.col("label")).alias("label"))


@query(with_(PLAYERS) + "SELECT id, floor((form - 5) * CAST(12.345 AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS rounded, least(greatest(form - 2, 0), 1) AS clamped, form AS parsed FROM players")
def rounding_values(spark, sf_dir):
    rows = domain.players(spark, sf_dir).withColumn("x", rounding.number(F.concat(F.col("form"), F.lit("x"))))
    return rows.select("id", rounding.half_up((F.col("x") - 5) * 12.345).alias("rounded"), rounding.clamp(F.col("x") - 2).alias("clamped"), F.col("x").alias("parsed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, 'panel_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv' AS name FROM events")
def event_times(spark, sf_dir):
    """Moments in ISO form, and names of files written then."""
    ts = F.col("ts")
    return domain.table(spark, sf_dir, "events").select("event_id", formatting.iso_time(ts).alias("time"), formatting.stamped_name("panel", ts).alias("name"))


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, points, minutes, name, price, is_home FROM panel")
def csv_roundtrip(spark, sf_dir):
    rows = domain.panel(spark, sf_dir).select("player_id", "gameweek", "points", "minutes", "name", "price", "is_home")
    path = readers.save_panel(rows, _temporary(spark, "panels"))
    return readers.read_panel_csv(spark, path, "player_id long, gameweek int, points double, minutes double, name string, price double, is_home boolean")


@query(with_(*PANEL_SQL) + "SELECT player_id, gameweek, points, price FROM panel WHERE gameweek = 20")
def panel_parquet_pruned(spark, sf_dir):
    path = _temporary(spark, "panel")
    readers.write_panel(domain.panel(spark, sf_dir), path)
    return spark.read.parquet(path).where("gameweek = 20").select("player_id", F.col("gameweek").cast("int").alias("gameweek"), "points", "price")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def snapshot_latest(spark, sf_dir):
    """Of three snapshots the one of the teams whose name sorts last."""
    path = _temporary(spark, "snapshots")
    teams = domain.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    for name, rows in (("teams_20240101", teams.limit(3)), ("teams_20240301", teams), ("zones_20250101", teams.limit(1))):
        rows.write.parquet(f"{path}/{name}")
    return spark.read.parquet(readers.latest_snapshot(spark, path, "teams_")).select("id", "name")


@query("SELECT CAST(s_suppkey AS INTEGER) AS id, s_name || ' of ' || s_nationkey AS name, s_nationkey AS team, n_name AS team_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def bootstrap_json(spark, sf_dir):
    """Upstream documents of suppliers as players, in pages, and of nations as teams: landed, read as variants and joined again."""
    path = _temporary(spark, "bootstrap")
    elements = domain.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS first_name", "concat('of ', s_nationkey) AS second_name", "s_nationkey AS team")
    landed.write_pages(elements, f"{path}/elements", "elements", F.expr("id div 50"))
    landed.write_pages(domain.teams(spark, sf_dir), f"{path}/teams", "teams", F.expr("id div 10"))
    documents = landed.documents(spark, f"{path}/*")
    rows = landed.players(documents).join(landed.teams(documents).select(F.col("id").alias("team"), F.col("name").alias("team_name")), "team")
    return rows.select(F.col("id").cast("int").alias("id"), F.concat_ws(" ", "first_name", "second_name").alias("name"), "team", "team_name")


@query(with_(FIXTURES) + "SELECT ord AS id, event, team_h, team_a, team_h_difficulty, team_a_difficulty FROM fixtures")
def fixtures_json(spark, sf_dir):
    """Landed pages of fixtures in folders by gameweek, read back as variants."""
    path = _temporary(spark, "fixtures")
    rows = domain.fixtures(spark, sf_dir).selectExpr("id", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty", "event", "event AS week")
    landed.write_pages(rows, path, "fixtures", F.expr("id div 8000"), ["week"])
    return landed.fixtures(landed.documents(spark, path)).select("id", "event", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty")


@query("""SELECT CAST(coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 1) AS INTEGER) AS current_event,
       CAST(coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), max(o_orderkey), 1) AS INTEGER) AS gameweek, count(*) AS n_events FROM orders""")
def landed_current_event(spark, sf_dir):
    """Pages of events, of which each names its first current one: the first page's counts, and so does the first current event."""
    path = _temporary(spark, "events")
    rows = domain.table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS int) AS id", "o_orderstatus = 'O' AS is_current")
    landed.write_pages(rows, path, "events", F.expr("id div 500"), current_event=F.min(F.when(F.col("is_current"), F.col("id"))))
    documents = landed.documents(spark, path)
    events = landed.events(documents)
    found = landed.current_event(documents).withColumnRenamed("gameweek", "current_event")
    return found.join(readers.current_gameweek(events)).join(events.agg(F.count("*").alias("n_events")))  # one row each


LIVE_COLUMNS = ", ".join(gameweeks.NAMES)


def _landed_weeks(spark: SparkSession, sf_dir: str) -> str:
    """Live statistics as documents of at most 500 players in folders by gameweek."""
    path = _temporary(spark, "live")
    stats = F.struct(*[F.col("points" if c == "total_points" else c).alias(c) for c in gameweeks.STATISTICS])
    rows = domain.live(spark, sf_dir).select("gameweek", F.col("player_id").alias("id"), stats.alias("stats"), F.col("gameweek").alias("week"))
    landed.write_pages(rows.select("id", "stats", "gameweek"), path, "elements", F.expr("id div 500"), ["gameweek"])
    return path


@query(with_(LIVE) + f"SELECT player_id, gameweek, {LIVE_COLUMNS} FROM live WHERE gameweek BETWEEN 10 AND 12 OR gameweek = 20")
def live_gameweeks(spark, sf_dir):
    """All 25 columns of four landed gameweeks; the files of the others aren't opened."""
    path = _landed_weeks(spark, sf_dir)
    return gameweeks.read_weeks(spark, path, "gameweek BETWEEN 10 AND 12").unionByName(gameweeks.read_weeks(spark, path, "gameweek = 20"))


@query(with_(LIVE) + f"SELECT player_id, gameweek, {LIVE_COLUMNS} FROM live")
def live_documents(spark, sf_dir):
    """All 25 columns of all landed gameweeks, from documents that name their week."""
    path = _temporary(spark, "live")
    stats = F.struct(*[F.col("points" if c == "total_points" else c).alias(c) for c in gameweeks.STATISTICS])
    rows = domain.live(spark, sf_dir).select(F.col("player_id").alias("id"), stats.alias("stats"), "gameweek", F.col("gameweek").alias("week"))
    landed.write_pages(rows, path, "elements", F.expr("id div 500"), ["week"], gameweek=F.first("gameweek"))
    return landed.live(landed.documents(spark, path))


INCREMENTAL = ["points_avg_3", "points_avg_10", "form_5gw", "points_trend", "minutes_std_5", "price_change_3gw"]


@query(with_(*PANEL_SQL) + f"""SELECT player_id, gameweek, {half_up_sql('avg(points) OVER w3', 6)} AS points_avg_3, {half_up_sql('avg(points) OVER w10', 6)} AS points_avg_10, {half_up_sql('avg(points) OVER w5', 6)} AS form_5gw,
    {trend_sql('points')}, {half_up_sql('coalesce(stddev_samp(minutes) OVER w5, 0)', 3)} AS minutes_std_5, {half_up_sql('price - first_value(price) OVER w3', 6)} AS price_change_3gw FROM panel
    WINDOW w3 AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
           w10 AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def panel_incremental(spark, sf_dir):
    """Features of the panel stored in three increments, the last of one gameweek: those of one build."""
    path = _temporary(spark, "incremental")
    rows = domain.panel(spark, sf_dir)
    for part in ("gameweek <= 12", "gameweek BETWEEN 13 AND 27", "gameweek > 27"):
        incremental.add_weeks(rows.where(part), path)
    found = incremental.read_features(spark, path)
    digits = {"points_trend": None, "minutes_std_5": 3}
    return found.select("player_id", "gameweek", *[(F.col(c) if c in digits and digits[c] is None else rounding.half_up(F.col(c), digits.get(c, 6))).alias(c) for c in INCREMENTAL])


# the bodies of requests made of events: each rule is broken by some
BODIES = """bodies AS (
    SELECT event_id, kind, CASE kind
        WHEN 'analyze' THEN '{"squad": {"startingXI": [' || array_to_string(list_transform(range(0, 11 - CAST(e % 3 = 0 AS INTEGER)), lambda i: '{"id": ' || (e + i) % 7 || ', "pos": "' || ['GK', 'DEF', 'MID', 'FWD', 'XX'][CAST((e + i) % 5 + 1 AS INTEGER)] || '", "price": ' || (3 * e + i) % 170 // 10 || '.' || (3 * e + i) % 10 || '}'), ', ')
            || '], "bench": [' || array_to_string(list_transform(range(0, 4 - CAST(e % 4 = 0 AS INTEGER)), lambda i: '{"id": ' || e % 5 + i || ', "pos": "MID", "price": 5}'), ', ') || '], "bank": ' || e % 120 || '}, "weights": {"form": ' || e % 13 // 10 || '.' || e % 13 % 10 || '}}'
        WHEN 'suggestion' THEN '{"playerId": ' || CASE WHEN e % 11 = 0 THEN '"7"' ELSE e % 4 || '.' || e % 2 * 5 END || ', "position": "' || ['GK', 'def'][CAST(e % 2 + 1 AS INTEGER)] || '", "maxPrice": ' || e % 17 || ', "excludeIds": [' || e % 3 || ', ' || (e + 1) % 3 || ']' || CASE WHEN e % 7 > 0 THEN ', "limit": ' || e % 12 ELSE '' END || '}'
        WHEN 'generate' THEN '{' || CASE WHEN e % 6 > 0 THEN '"strategy": "' || ['ai', 'value', 'best'][CAST(e % 3 + 1 AS INTEGER)] || '", ' ELSE '' END || '"budget": ' || 70 + e % 40 || '}'
        WHEN 'search' THEN '{"name": "' || repeat('x', CAST(e % 110 AS INTEGER)) || '"}' ELSE '[]' END AS body
    FROM (SELECT event_id, event_id // 5 AS e, ['analyze', 'suggestion', 'generate', 'search', 'none'][CAST(event_id % 5 + 1 AS INTEGER)] AS kind FROM events)
)"""


@query("WITH " + BODIES + """, b AS (SELECT event_id, kind, CAST(body AS JSON) AS j FROM bodies),
slots AS (
    SELECT event_id, 'squad.' || part || '.' || i AS path, json_extract(j, '$.squad.' || part || '[' || i || ']') AS v
    FROM b, (VALUES ('startingXI'), ('bench')) p(part), range(11) r(i) WHERE kind = 'analyze' AND i < json_array_length(j, '$.squad.' || part)
), numbers AS (
    SELECT event_id, path || '.id' AS path, v->'id' AS v, 0 AS above, NULL AS low, NULL AS high, true AS whole, false AS optional FROM slots
    UNION ALL SELECT event_id, path || '.price', v->'price', 0, NULL, 15, false, false FROM slots
    UNION ALL SELECT event_id, 'squad.bank', j->'squad'->'bank', NULL, 0, 100, false, false FROM b WHERE kind = 'analyze'
    UNION ALL SELECT event_id, 'weights.form', j->'weights'->'form', NULL, 0, 1, false, true FROM b WHERE kind = 'analyze'
    UNION ALL SELECT event_id, 'playerId', j->'playerId', 0, NULL, NULL, true, false FROM b WHERE kind = 'suggestion'
    UNION ALL SELECT event_id, 'maxPrice', j->'maxPrice', 0, NULL, 15, false, false FROM b WHERE kind = 'suggestion'
    UNION ALL SELECT event_id, 'excludeIds.' || i, json_extract(j, '$.excludeIds[' || i || ']'), 0, NULL, NULL, true, false FROM b, range(2) r(i) WHERE kind = 'suggestion'
    UNION ALL SELECT event_id, 'limit', j->'limit', NULL, 1, 10, true, true FROM b WHERE kind = 'suggestion'
    UNION ALL SELECT event_id, 'budget', j->'budget', NULL, 80, 100, false, true FROM b WHERE kind = 'generate'
), typed AS (
    SELECT *, CASE WHEN v IS NULL AND NOT optional THEN 'required' WHEN json_type(v) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'not a number' END AS wrong FROM numbers
), valued AS (SELECT *, CAST(v AS DOUBLE) AS x FROM typed WHERE wrong IS NULL AND v IS NOT NULL),
known AS (
    SELECT event_id, path || '.pos' AS path, v->>'pos' AS v, ['GK', 'DEF', 'MID', 'FWD'] AS allowed FROM slots
    UNION ALL SELECT event_id, 'position', j->>'position', ['GK', 'DEF', 'MID', 'FWD'] FROM b WHERE kind = 'suggestion'
    UNION ALL SELECT event_id, 'strategy', j->>'strategy', ['balanced', 'premium', 'value', 'differential', 'form', 'template', 'setforget', 'wildcard', 'ai'] FROM b WHERE kind = 'generate'
)
SELECT event_id, path, wrong AS error FROM typed WHERE wrong IS NOT NULL
UNION ALL SELECT event_id, path, 'not whole' FROM valued WHERE whole AND x <> floor(x)
UNION ALL SELECT event_id, path, 'not over ' || above FROM valued WHERE x <= above
UNION ALL SELECT event_id, path, 'under ' || low FROM valued WHERE x < low
UNION ALL SELECT event_id, path, 'over ' || high FROM valued WHERE x > high
UNION ALL SELECT event_id, path, CASE WHEN v IS NULL THEN 'required' ELSE 'unknown' END FROM known WHERE v IS NULL OR NOT list_contains(allowed, v)
UNION ALL SELECT event_id, 'squad.' || part, 'not ' || n || ' entries' FROM b, (VALUES ('startingXI', 11), ('bench', 4)) p(part, n) WHERE kind = 'analyze' AND json_array_length(j, '$.squad.' || part) <> n
UNION ALL SELECT event_id, 'name', CASE WHEN length(j->>'name') = 0 THEN 'under 1 characters' ELSE 'over 100 characters' END FROM b WHERE kind = 'search' AND length(j->>'name') NOT BETWEEN 1 AND 100
UNION ALL SELECT event_id, '', 'not an object' FROM b WHERE kind = 'none'""")
def request_errors(spark, sf_dir):
    """What is wrong with the requests that events stand for."""
    price = "concat((3 * e + i) % 170 div 10, '.', (3 * e + i) % 10)"
    slot = f"""concat('{{"id": ', (e + i) % 7, ', "pos": "', element_at(array('GK', 'DEF', 'MID', 'FWD', 'XX'), cast((e + i) % 5 AS int) + 1), '", "price": ', {price}, '}}')"""
    place = """concat('{"id": ', e % 5 + i, ', "pos": "MID", "price": 5}')"""
    listed = lambda entry, n: f"array_join(transform(sequence(0, {n} - 1), i -> {entry}), ', ')"
    made = {
        "analyze": f"""concat('{{"squad": {{"startingXI": [', {listed(slot, 'if(e % 3 = 0, 10, 11)')}, '], "bench": [', {listed(place, 'if(e % 4 = 0, 3, 4)')}, '], "bank": ', e % 120, '}}, "weights": {{"form": ', e % 13 div 10, '.', e % 13 % 10, '}}}}')""",
        "suggestion": """concat('{"playerId": ', if(e % 11 = 0, '"7"', concat(e % 4, '.', e % 2 * 5)), ', "position": "', if(e % 2 = 0, 'GK', 'def'), '", "maxPrice": ', e % 17, ', "excludeIds": [', e % 3, ', ', (e + 1) % 3, ']', if(e % 7 > 0, concat(', "limit": ', e % 12), ''), '}')""",
        "generate": """concat('{', if(e % 6 > 0, concat('"strategy": "', element_at(array('ai', 'value', 'best'), cast(e % 3 AS int) + 1), '", '), ''), '"budget": ', 70 + e % 40, '}')""",
        "search": """concat('{"name": "', repeat('x', cast(e % 110 AS int)), '"}')""",
    }
    kinds = "element_at(array('analyze', 'suggestion', 'generate', 'search', 'none'), cast(event_id % 5 AS int) + 1)"
    parts = 4 * spark.sparkContext.defaultParallelism  # a small file of events stands for much work
    rows = domain.table(spark, sf_dir, "events").select("event_id").repartition(parts).selectExpr("event_id", "event_id div 5 AS e", f"{kinds} AS kind")
    rows = rows.selectExpr("event_id", "kind", "CASE " + " ".join(f"WHEN kind = '{k}' THEN {body}" for k, body in made.items()) + " ELSE '[]' END AS body")
    # of a plain explode Spark infers a filter by the number of errors, which makes all checks twice, the first time in the tasks of the scan
    return requests.request_errors(rows).select("event_id", F.explode_outer("errors").alias("e")).where("e IS NOT NULL").select("event_id", "e.path", "e.error")


# adds to the starting eleven and to the bench, removals, moves to the bench and back, by the type of event
EDITS = """edits AS (
    SELECT user_id AS squad_id, event_id AS edit_id, CASE event_type WHEN 'signup' THEN 'add_xi' WHEN 'purchase' THEN 'add_bench' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'to_bench' ELSE 'to_xi' END AS kind,
           event_id % 23 + 1 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
)"""


@query("WITH RECURSIVE " + EDITS + """, walk AS (
    SELECT DISTINCT squad_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS edit_id, CAST([] AS BIGINT[]) AS xi, CAST([] AS BIGINT[]) AS bench, '' AS outcome FROM edits
    UNION ALL
    SELECT squad_id, n, edit_id,
           CASE WHEN outcome <> 'done' THEN xi WHEN kind IN ('add_xi', 'to_xi') THEN list_append(xi, id) WHEN kind IN ('remove', 'to_bench') THEN list_filter(xi, lambda x: x <> id) ELSE xi END,
           CASE WHEN outcome <> 'done' THEN bench WHEN kind IN ('add_bench', 'to_bench') THEN list_append(bench, id) WHEN kind IN ('remove', 'to_xi') THEN list_filter(bench, lambda x: x <> id) ELSE bench END, outcome
    FROM (SELECT w.squad_id, e.n, e.edit_id, e.kind, e.id, xi, bench, CASE
              WHEN kind = 'to_bench' AND NOT list_contains(xi, id) OR kind = 'to_xi' AND NOT list_contains(bench, id) OR kind = 'remove' AND NOT list_contains(xi, id) AND NOT list_contains(bench, id) THEN 'not there'
              WHEN kind IN ('add_xi', 'to_xi') AND len(xi) >= 11 OR kind IN ('add_bench', 'to_bench') AND len(bench) >= 4 THEN 'full'
              WHEN kind IN ('add_xi', 'add_bench') AND (list_contains(xi, id) OR list_contains(bench, id)) THEN 'already in' ELSE 'done' END AS outcome
          FROM walk w JOIN edits e ON e.squad_id = w.squad_id AND e.n = w.n + 1)
)
SELECT squad_id, edit_id, outcome FROM walk WHERE n > 0""")
def squad_edits(spark, sf_dir):
    """What becomes of each edit of every user's log."""
    logs, _ = _edited(spark, sf_dir)
    return logs.select("squad_id", "edit_id", "outcome")


@query(SQL["squad_edits"].rsplit("SELECT squad_id, edit_id, outcome", 1)[0] + """, last AS (SELECT squad_id, xi, bench FROM walk QUALIFY row_number() OVER (PARTITION BY squad_id ORDER BY n DESC) = 1),
held AS (
    SELECT squad_id, 'xi' AS section, unnest(xi) AS id, generate_subscripts(xi, 1) AS place FROM last UNION ALL SELECT squad_id, 'bench', unnest(bench), generate_subscripts(bench, 1) FROM last
)
SELECT squad_id, section, CAST(row_number() OVER (PARTITION BY squad_id, section ORDER BY id % 4, place) AS INTEGER) AS slot_no, id FROM held""")
def squads_after_edits(spark, sf_dir):
    """Every user's squad after all edits of the log, in the order of positions."""
    _, slots = _edited(spark, sf_dir)
    return slots.select("squad_id", "section", "slot_no", "id")


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kinds = "element_at(map('signup', 'add_xi', 'purchase', 'add_bench', 'error', 'remove', 'click', 'to_bench', 'view', 'to_xi'), event_type) AS kind"
    rows = domain.table(spark, sf_dir, "events").selectExpr("user_id AS squad_id", "event_id AS edit_id", kinds, "event_id % 23 + 1 AS id")
    return edits.apply_edits(rows.withColumn("pos", enrich.position(F.col("id") % 4 + 1)).withColumn("price", F.lit(5.0)))


@query(with_(*enriched_sql()) + "SELECT * FROM enriched")
def players_published(spark, sf_dir):
    """The enriched players kept as a table: the second read finds what the first one built."""
    kept = versions.PublishedTable(spark, _temporary(spark, "players"))
    inputs = [domain.table(spark, sf_dir, name) for name in ("part", "nation", "orders", "lineitem")]
    kept.read(inputs, lambda: domain.enriched(spark, sf_dir))

    def again():
        raise AssertionError("nothing has changed")

    return kept.read(inputs, again)


def _forest(spark: SparkSession, sf_dir: str):
    """The full forest and its features, from the store; fitted and published where there is none of these tables as they are now."""
    inputs = [domain.table(spark, sf_dir, name) for name in ("part", "orders", "lineitem")]
    made_of = versions.fingerprint(*inputs)
    path = f"{_shared(spark)}/forests-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    found = model_store.load(spark, path, made_of=made_of)
    if not found:
        rows = domain.panel(spark, sf_dir)
        fitted, names = model.train(rows)[0], features.feature_columns(features.time_features(rows))
        found = model_store.Loaded(fitted, names, model_store.publish(spark, path, fitted, names, made_of))
    return found


@query()
def rf_predict(spark, sf_dir):
    return model.predict(_forest(spark, sf_dir).model, domain.panel(spark, sf_dir), 20)


@query()
def rf_metrics(spark, sf_dir):
    return model.metrics(_forest(spark, sf_dir).model.transform(model.training_rows(domain.panel(spark, sf_dir)).where("NOT train")))


@query()
def rf_importance(spark, sf_dir):
    found = _forest(spark, sf_dir)
    return model.importance(found.model, found.features, spark)


@query(with_(*PANEL_SQL) + """, rows_ AS (SELECT gameweek FROM (SELECT gameweek, lead(points) OVER (PARTITION BY player_id ORDER BY gameweek) AS y FROM panel) WHERE y IS NOT NULL),
weeks AS (SELECT gameweek, row_number() OVER (ORDER BY gameweek) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT gameweek FROM rows_))
SELECT CAST(fold AS INTEGER) AS fold, gameweek, place <= n - (6 - fold) * (n // 6) AS train FROM weeks, range(1, 6) f(fold) WHERE place <= n - (5 - fold) * (n // 6)""")
def time_folds(spark, sf_dir):
    """Five expanding folds over the gameweeks that have a target."""
    return panel.time_folds(features.target(domain.panel(spark, sf_dir)).where("next_gameweek_points IS NOT NULL"))


@query()
def rf_folds(spark, sf_dir):
    """Metrics of five expanding folds, by forests of 20 trees of depth 6."""
    return model.fold_metrics(domain.panel(spark, sf_dir), trees=20, depth=6)


@query(with_(*PREDICTION_SQL) + f"SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, {half_up_sql('1 - avg(e * e) / var_pop(y)', 6)} AS r2 FROM (SELECT y, y - CAST(now_cost AS BIGINT) AS e FROM (SELECT *, CAST(round(predicted_points * 10) AS BIGINT) AS y FROM predictions) JOIN players ON id = player_id)")
def metric_formulas(spark, sf_dir):
    rows = domain.predictions(spark, sf_dir).select(F.round(F.col("predicted_points") * 10).cast("long").alias("y"), F.round(F.col("price") * 10).cast("long").alias("p"))
    return model.metrics(rows, "y", "p").select("mse", "mae", "rmse", rounding.half_up(F.col("r2"), 6).alias("r2"))
