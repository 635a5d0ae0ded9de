"""Replacement suggestions for slots and requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.rounding import half_up
from .constants import DEFAULT_WEIGHTS

#: Parts that the requests or slots of one key are dealt over when they get its list.
KEY_PARTS = 8
REQUEST = "request_id long, player_id long, position string, max_price double, exclude_ids array<long>"


def suggest(players: DataFrame, requests: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, limit: int = 5) -> DataFrame:
    """For each request its best available candidates of the position within the price, and their gain in score.

    Requests of equal position and price have one list: the best candidates, so many more than `limit` as a request may have to
    pass over (its own player and the excluded ones). So a list is made once for each position and price that is asked for, of
    candidates of which no price has more than a list holds: tables bounded by prices, however many players or requests there
    are. Requests then take from their list. A request for an unknown player has no rows.
    """
    if not 1 <= limit <= 10:
        raise ValueError("a limit is 1 to 10")
    scored = players.withColumn("score", scoring.score(weights))
    current = scored.select(F.col("id").alias("player_id"), F.col("score").alias("current_score"))
    asked = requests.withColumn("exclude_ids", F.coalesce("exclude_ids", F.array().cast("array<long>"))).join(current, "player_id")
    excluded = requests.agg(F.max(F.size(F.coalesce("exclude_ids", F.array().cast("array<long>"))))).first()[0] or 0
    k = limit + excluded + 1
    best_first = [F.desc("score"), F.col("ord"), F.col("id")]
    in_price = F.row_number().over(Window.partitionBy("pos", "price").orderBy(*best_first))
    best = scored.where("status = 'a'").withColumn("in_price", in_price).where(F.col("in_price") <= k).select("id", "ord", "name", "team_short", "pos", "price", "score")
    keys = ["position", "max_price"]
    met = requests.select(*keys).distinct().join(best, (F.col("position") == F.col("pos")) & (F.col("price") <= F.col("max_price")))
    listed = met.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where(F.col("place") <= k)
    lists = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "id", "name", "team_short", "price", "score"))).alias("found"))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(KEY_PARTS)).cast("int"))
    given = dealt.join(lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1)))), [*keys, "part"])
    open_ = F.filter("found", lambda c: (c["id"] != F.col("player_id")) & ~F.array_contains("exclude_ids", c["id"]))
    top = given.select("request_id", "player_id", "current_score", F.posexplode(F.slice(open_, 1, limit)).alias("at", "c"))
    return top.select("request_id", "player_id", (F.col("at") + 1).alias("rank"), "c.id", "c.name", "c.team_short", "c.price", "c.score", half_up(F.col("c.score") - F.col("current_score")).alias("delta"))


#: Prices in tenths have so many bits (up to 6553.5).
PRICE_BITS = 16


def slot_suggestions(slots: DataFrame, players: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, band: float = 1.5, limit: int = 5) -> DataFrame:
    """For each starting slot of each squad the available candidates outside the squad that its money buys and whose
    score lies within `band` of the current one, those farthest from it first.

    slots: squad_id, section (xi or bench), slot_no, id, pos, price and bank. What a slot gets depends on its player's position and
    score, the price it may pay, and its squad. So the farthest candidates are found once for each (position, price limit,
    score) by `farthest`, some more than asked for, and a slot takes the first of them that its squad hasn't got.
    """
    scored = players.withColumn("score", scoring.score(weights)).withColumn("cents", F.round(F.col("score") * 100).cast("int"))
    now = scored.select("id", F.col("pos").alias("now_pos"), F.col("cents").alias("now_cents"))
    tenths = F.round(F.col("price") * 10) + F.round(F.col("bank") * 10)
    starting = slots.where("section = 'xi'").join(now, "id").select("squad_id", "slot_no", F.col("id").alias("current_id"), "now_pos", "now_cents", F.least(tenths, F.lit(2.0**PRICE_BITS - 2)).cast("int").alias("limit"))
    most = slots.groupBy("squad_id").count().agg(F.max("count")).first()[0] or 0
    keys = ["now_pos", "limit", "now_cents"]
    lists = farthest(starting.select(*keys).where("limit >= 0").distinct(), scored, band, limit + most)
    own = slots.groupBy("squad_id").agg(F.collect_set("id").alias("own"))
    asked = starting.join(own, "squad_id").withColumn("part", F.pmod(F.xxhash64("squad_id"), F.lit(KEY_PARTS)).cast("int"))
    given = asked.join(lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1)))), [*keys, "part"])
    new = F.slice(F.filter("found", lambda c: ~F.array_contains("own", c["id"])), 1, limit)
    rows = given.select("squad_id", "slot_no", "current_id", "now_cents", F.posexplode(new).alias("at", "c"))
    delta = half_up(F.col("c.cents") / 100 - F.col("now_cents") / 100)
    return rows.select("squad_id", "slot_no", "current_id", (F.col("at") + 1).alias("rank"), "c.id", "c.name", "c.price", delta.alias("delta"))


def farthest(keys: DataFrame, scored: DataFrame, band: float, k: int) -> DataFrame:
    """keys (distinct now_pos, limit, now_cents) with `found`: the k available candidates of the position that cost at most `limit`
    tenths and score within `band`, farthest first, then by ord and id, as (cents, id, name, price).

    The index holds a candidate once for each level b of its price, in block price >> b of 2^b prices, and direction. Prices up to a limit are
    as many blocks as limit + 1 has one-bits, one of each level. In a block the candidates are sorted by score, upwards or downwards, so
    the farthest ones on one side of a score are k neighbours, from the first that is within the band on. A sweep over a block's
    candidates and the scores asked for numbers the candidates; each score takes the numbers after its own. So a key meets at
    most 2 k PRICE_BITS candidates, however many there are, and a block's answers serve all limits that hold it.
    Only blocks that are asked for are filled, of one position, price and score with at most k candidates.
    """
    block = ["now_pos", "side", "level", "block"]
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    levels = F.sequence(F.lit(0), F.lit(PRICE_BITS - 1))
    most = round(band * 100)

    # the first score within the band on a side: at its very edge the doubles' difference decides, as where scores are compared directly
    def within(side: int, cents: Column) -> Column:
        edge = F.abs((cents - side * most) / 100 - cents / 100) <= F.lit(band)
        return F.lit(side) * cents - F.when(edge, most).otherwise(most - 1)

    n, level = F.col("limit") + 1, F.col("level")
    sided = keys.select("*", sides).withColumn("at", F.when(F.col("side") == 1, within(1, F.col("now_cents"))).otherwise(within(-1, F.col("now_cents"))))
    asked = sided.select("*", F.explode(F.filter(levels, lambda b: F.getbit(n, b) == 1)).alias("level")).withColumn("block", F.call_function("shiftright", n, level) - 1)
    points = asked.select(*block, "at").distinct()

    tenths = F.round(F.col("price") * 10).cast("int")
    open_ = scored.where("status = 'a'").select("id", "ord", F.col("pos").alias("now_pos"), tenths.alias("tenths"), "cents").where(F.col("tenths").between(0, 2**PRICE_BITS - 2))
    in_cell = F.row_number().over(Window.partitionBy("now_pos", "tenths", "cents").orderBy("ord", "id"))
    few = open_.withColumn("in_cell", in_cell).where(F.col("in_cell") <= k)
    index = few.select("*", sides).select("*", F.explode(levels).alias("level")).withColumn("block", F.call_function("shiftright", F.col("tenths"), level))
    index = index.join(points.select(*block).distinct(), block, "left_semi").select(*block, (F.col("side") * F.col("cents")).alias("at"), F.struct("cents", "ord", "id").alias("c"))

    both = points.select(*block, "at", F.lit(None).cast(index.schema["c"].dataType).alias("c")).unionByName(index)
    sweep = Window.partitionBy(*block).orderBy("at", F.col("c").isNotNull(), "c.ord", "c.id")  # a point before the candidates of its score
    numbered = both.withColumn("number", F.count("c").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy(*block).orderBy("number").rangeBetween(1, k)
    answers = numbered.withColumn("near", F.collect_list("c").over(after)).where("c IS NULL").select(*block, "at", "near")

    together = asked.join(answers, [*block, "at"]).groupBy("now_pos", "limit", "now_cents").agg(F.flatten(F.collect_list("near")).alias("near"))
    away = lambda c: F.abs(c["cents"] / 100 - F.col("now_cents") / 100)
    close = F.filter(F.transform("near", lambda c: F.struct((-away(c)).alias("far"), c["ord"].alias("ord"), c["id"].alias("id"), c["cents"].alias("cents"))), lambda c: c["far"] >= F.lit(-band))
    together = together.select("now_pos", "limit", "now_cents", F.array_sort(close).alias("near"))
    # one found from both sides stands twice, side by side
    ordered = F.filter("near", lambda c, i: (i == 0) | (c["id"] != F.get("near", i - 1)["id"]))
    flat = together.select("now_pos", "limit", "now_cents", F.posexplode(F.slice(ordered, 1, k)).alias("at", "c")).select("now_pos", "limit", "now_cents", "at", "c.id", "c.cents")
    named = flat.join(scored.select("id", "name", "price"), "id")
    return named.groupBy("now_pos", "limit", "now_cents").agg(F.array_sort(F.collect_list(F.struct("at", "cents", "id", "name", "price"))).alias("found"))
