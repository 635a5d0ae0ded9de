"""Players, teams, fixtures, statistics, panels and squads derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as enriching
from ..operators import panel as panels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_partkey AS ord", "split_part(p_name, ' ', 1) AS first_name", "substr(p_name, instr(p_name, ' ') + 1) AS second_name", "cast(p_partkey % 27 AS int) AS team",
        "cast(p_partkey % 4 + 1 AS int) AS element_type", "cast(40 + 2 * p_size AS int) AS now_cost", "cast((p_partkey % 11) / 2.0D AS string) AS form",
        "CASE p_partkey % 7 WHEN 0 THEN 'i' WHEN 1 THEN 'd' WHEN 2 THEN 's' ELSE 'a' END AS status", "p_size AS total_points",
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "substr(n_name, 1, 3) AS short_name")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS ord", "o_orderkey AS id", "cast(o_orderkey % 38 + 1 AS int) AS event", "cast(o_custkey % 20 + 1 AS int) AS team_h", "cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 + 1 AS int) AS team_a",
        "cast(floor(o_totalprice / 100000) % 5 + 1 AS int) AS team_h_difficulty", "cast(floor(o_totalprice / 1000) % 5 + 1 AS int) AS team_a_difficulty",
    )


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from whole-number sums, so that every engine gets the same doubles."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"),
    )
    return sums.selectExpr("id", "d * 8 / (n * 100.0D) AS xg90", "t * 8 / (n * 100.0D) AS xa90", "q / (n * 1.0D) AS exp_min", "n / 2.0D AS avg_points", "n / 10.0D AS value", "cast(q % 100 AS double) AS ownership")


def enriched(spark: SparkSession, sf_dir: str, gameweek: int = 1) -> DataFrame:
    return enriching.enrich(players(spark, sf_dir), teams(spark, sf_dir), fixtures(spark, sf_dir), advanced(spark, sf_dir), gameweek)


#: Rows of lineitem in a partition by player.
LINES = 1_000_000


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's rows of all gameweeks lie in one partition, so neither the windows nor the join with the players shuffle them again.

    The partitions' number follows the rows' (counted from the files' footers), so that no task's memory grows with the table.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    rows = lines.repartition(parts, "l_partkey").withColumn("gameweek", ((F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate")).cast("int"))
    sums = rows.groupBy(F.col("l_partkey").alias("player_id"), "gameweek").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t"),
    )
    return rows_of_live(sums)


#: The other statistics of a gameweek, from its sums.
MORE_LIVE = [
    "(q % 2) * 1.0D AS clean_sheets", "(n % 3) * 1.0D AS goals_conceded", "(q % 11 div 10) * 1.0D AS own_goals", "(q % 13 div 12) * 1.0D AS penalties_saved", "(q % 17 div 16) * 1.0D AS penalties_missed",
    "(d % 3) * 1.0D AS yellow_cards", "(d % 7 div 6) * 1.0D AS red_cards", "(t % 6) * 1.0D AS saves", "(q % 4) * 1.0D AS bonus", "(q + d) * 1.0D AS bps",
    "d * 3 / 10.0D AS influence", "t * 7 / 10.0D AS creativity", "(q % 50) / 2.0D AS threat", "least(n, 1) * 1.0D AS starts", "(d + t) / 100.0D AS expected_goal_involvements", "(n * 5 + d) / 100.0D AS expected_goals_conceded",
]


def rows_of_live(sums: DataFrame) -> DataFrame:
    return sums.selectExpr(
        "player_id", "gameweek", "cast(q AS double) AS points", "n * 30.0D AS minutes", "cast(r AS double) AS goals_scored", "cast(a AS double) AS assists", "q / 10.0D AS ict_index", "d / 100.0D AS expected_goals",
        "t / 100.0D AS expected_assists", *MORE_LIVE, "(40 + q % 60) / 10.0D AS price", "(q % 100) / 1.0D AS selected_by_percent",
    )


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players(spark, sf_dir).selectExpr("id AS player_id", "concat_ws(' ', first_name, second_name) AS name", "element_type AS position", "team", "(id % 90) / 10.0D AS value_form", "(id % 70) / 7.0D AS value_season")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel(live(spark, sf_dir), static(spark, sf_dir), fixtures(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted points for every player, without a model: a tenth of those of the best gameweek."""
    best = live(spark, sf_dir).groupBy("player_id").agg((F.max("points") / 10).alias("predicted_points"))
    rows = players(spark, sf_dir).selectExpr("id AS player_id", "element_type AS position", "now_cost / 10 AS price", "team")
    return best.join(rows, "player_id").withColumn("pos", enriching.position("position"))


def squad_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A squad for every twenty consecutive players, who are five of each position: the first 2, 5, 5 and 3 of them.

    Every tenth squad breaks a rule of its own: those that end in 1 have no forwards, in 2 are too dear, in 3 a player twice.
    """
    rows = players(spark, sf_dir).withColumn("pos", enriching.position("element_type"))
    squad = F.expr("id div 20")
    per = F.when(F.col("pos") == "GK", 2).when(F.col("pos") == "FWD", 3).otherwise(5)
    placed = rows.withColumn("squad_id", squad.cast("long")).withColumn("k", F.expr("cast(id div 4 % 5 as int)")).where(F.col("k") < per)
    kind = F.col("squad_id") % 10
    starts = F.when(F.col("pos") == "GK", 1).when(F.col("pos") == "FWD", 2).otherwise(4)
    xi = F.col("k") < starts
    slot = F.when(F.col("pos") == "GK", 1).when(F.col("pos") == "DEF", 1 + F.col("k") + 1).when(F.col("pos") == "MID", 5 + F.col("k") + 1).otherwise(9 + F.col("k") + 1)
    bench = F.when(F.col("pos") == "GK", 1).when(F.col("pos") == "DEF", 2).when(F.col("pos") == "MID", 3).otherwise(4)
    shown = placed.where(~((kind == 1) & (F.col("pos") == "FWD"))).select(
        "squad_id", F.when(xi, "xi").otherwise("bench").alias("section"), F.when(xi, slot).otherwise(bench).cast("int").alias("slot_no"),
        F.when((kind == 3) & (F.col("k") == 1), F.col("id") - 4).otherwise(F.col("id")).alias("id"), "pos", (F.col("now_cost") / 20).alias("price"), F.when(kind == 2, 90.0).otherwise(0.5).alias("bank"),
    )
    return shown


def player_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with all the statistics of the current-player view, whole numbers from the key; the set-piece orders are null for most."""
    numbers = [f"cast(id * {k} % 97 AS int) AS {c}" for k, c in enumerate(enriching.STATISTICS, 1) if c not in ("form", "total_points")]
    orders = [f"CASE WHEN id % {k} = 0 THEN cast(id % 3 AS int) END AS {c}" for k, c in enumerate(enriching.SET_PIECES, 5)]
    return players(spark, sf_dir).selectExpr("*", *numbers, *orders)
