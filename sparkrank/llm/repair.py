"""Repair of conversation structure: the cheapest edits after which the turns alternate.

The roles' initials must read `(s?(ua)+)?`: nothing, or an optional system turn and then pairs of user and assistant. Edits and
their costs: keep a turn (0), give it the role user or assistant (3), delete it (4), insert an empty turn of user or assistant
anywhere (3). A blank or repeated turn must be deleted; a truncated one that isn't costs 3 more. Of the cheapest edit lists the
one whose initials (D, I, K, R) come first in ASCII is taken.

Faults come from windows over a conversation's turns in order; then the turns are collected as sorted structs, and aggregate()
folds over them. It carries one (cost, code) struct for each place that the pattern can be in: nothing yet, after the system turn,
after a user's, after an assistant's turn. Candidates meet in least(), which compares costs first and then codes.

A code is the audit with user and assistant told apart: I, J insert and R, S rerole to user and assistant. At the first letter
where two codes of equal cost in the same place differ the place is the same before it, so I never meets J and R never meets S,
and codes sort like audits. Neither code is a prefix of the other: it would take the same turns to the same place with a
dearer insertion. So the best code of each place is all that a prefix of the turns has to hand on, and an audit leaves
one repaired conversation. Two insertions in a row never pay: after two, the pattern is where it was, or a deleted system turn
(4) had been cheaper than they are (6), or the turns before could have stayed unwritten.

Long conversations are folded in blocks of `block` turns, each from every place, and the blocks' structs are then folded
likewise; codes grow in blocks and not by turns, so the work is linear up to the copies made once a block.

Nulls: text and role are one space when null (a blank turn; a role that no pattern has). A null turn number sorts first and
doesn't count for gaps. A null conversation id is a conversation. Turns of equal number are in the order of role and text, so
that reruns agree. A role counts by its first character: an empty one has none and is never kept. Conversations
without turns left have zeros, an empty audit and nothing to hash. `gaps` is null where it exceeds a long. A conversation has to fit one row, as its
digest and its edits are one row's values; conversations are spread over tasks, turns of one aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The places of the pattern.
PLACES = ["nothing", "system", "user", "assistant"]
#: More than any conversation costs: a place that can't be reached.
NEVER = 1 << 50
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SOLID = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone` after seeded damage by crc32(conv_id:turn) % 20, nulls as one space.

    0 drops a turn (a row with `gone` stays, so that every conversation is known), 1 empties its text, 2 removes `.!?` from it, 3
    repeats it, 4 gives it to the user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *shown)) % 20
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    return rows.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def as_rows(rows: DataFrame) -> DataFrame:
    """The columns that `repair` takes, nulls as one space, nothing damaged."""
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds place (from 1), fault (blank, duplicate, truncated or null) and illegal (pairs with the turn before) to each turn.

    One exchange by conversation serves both windows and the aggregate after them.
    """
    order = [F.col("gone"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    inner = Window.partitionBy("conv_id").orderBy(*order)
    alike = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("place", F.row_number().over(inner)).withColumn("before", F.lag(initial).over(inner)).withColumn("turn_before", F.lag("turn").over(inner))
    rows = rows.withColumn("nth", F.row_number().over(alike))
    last = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select(
        "conv_id", "turn", "role", "text", "gone", "place", fault.alias("fault"), initial.alias("initial"),
        (F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def bound(value: Column, function) -> Column:
    """function(value), in which value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), function), 1)


def place_struct(cost: Column, code: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), code.alias("code"))


def step(at: Column, cost: int | Column, letter: str) -> Column:
    return place_struct(at["cost"] + cost, F.concat(at["code"], F.lit(letter)))


def inserted(places: Column) -> Column:
    """The places after an insertion, where that is cheaper or comes first."""
    nothing, system, user, assistant = (places[p] for p in PLACES)
    return F.struct(
        nothing.alias("nothing"), system.alias("system"),
        F.least(user, *[step(at, INSERT, "I") for at in (nothing, system, assistant)]).alias("user"),
        F.least(assistant, step(user, INSERT, "J")).alias("assistant"),
    )


def taken(places: Column, turn: Column) -> Column:
    """The places after a turn was kept, given another role or deleted."""
    nothing, system, user, assistant = (places[p] for p in PLACES)
    more = F.when(turn["fault"].isin("blank", "duplicate"), NEVER).when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def kept(at: Column, initial: str) -> Column:
        return step(at, F.when(turn["initial"] == initial, more + KEEP).otherwise(NEVER), "K")

    return F.struct(
        step(nothing, DELETE, "D").alias("nothing"),
        F.least(step(system, DELETE, "D"), kept(nothing, "s")).alias("system"),
        F.least(step(user, DELETE, "D"), *[f for at in (nothing, system, assistant) for f in (kept(at, "u"), step(at, more + REROLE, "R"))]).alias("user"),
        F.least(step(assistant, DELETE, "D"), kept(user, "a"), step(user, more + REROLE, "S")).alias("assistant"),
    )


def start(place: str) -> Column:
    """Only one place is reached, at no cost."""
    return F.struct(*[place_struct(F.lit(0 if p == place else NEVER), F.lit("")).alias(p) for p in PLACES])


def fold(turns: Column, place: str) -> Column:
    return F.aggregate(turns, start(place), lambda places, turn: bound(taken(places, turn), inserted))


def after(places: Column, block: Column) -> Column:
    """Places after a block of turns, which holds the places reached from each."""
    return F.struct(*[F.least(*[place_struct(places[p]["cost"] + block[p][q]["cost"], F.concat(places[p]["code"], block[p][q]["code"])) for p in PLACES]).alias(q) for q in PLACES])


def cheapest(turns: Column, block: int) -> Column:
    """(cost, code) of the best edits of an array of turns."""
    first = bound(F.slice(turns, 1, block), lambda part: bound(inserted(start("nothing")), lambda begun: F.aggregate(part, begun, lambda places, turn: bound(taken(places, turn), inserted))))
    starts = F.when(F.size(turns) > block, F.sequence(F.lit(block + 1), F.size(turns), F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: bound(F.slice(turns, at, F.lit(block)), lambda part: F.struct(*[fold(part, p).alias(p) for p in PLACES])))
    return bound(F.aggregate(blocks, first, after), lambda places: F.least(places["nothing"], places["assistant"]))


def repair(rows: DataFrame, block: int = 256) -> DataFrame:
    """A row for each conversation of rows (as_rows or damage): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    `repaired`, an array of role and text."""
    rows = faults(rows)
    there = ~F.col("gone")
    counts = [F.count_if(there & (F.col("fault") == kind)).alias(kind) for kind in ("blank", "duplicate", "truncated")]
    bounds = [f(F.when(there, F.col("turn"))).cast("decimal(20,0)") for f in (F.max, F.min)]
    gaps = F.when(bounds[0].isNull(), 0).otherwise((bounds[0] - bounds[1] + 1 - F.count_if(there & F.col("new_turn"))).try_cast("long"))
    turns = F.array_sort(F.collect_list(F.when(there, F.struct("place", "initial", "fault", "role", "text"))))
    found = rows.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *counts, F.count_if(there & F.col("illegal")).alias("illegal"), turns.alias("turns"))
    found = found.withColumn("best", cheapest(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault"))), block))
    code = F.col("best.code")
    # each turn's letter with the insertion after it; one may stand before the first turn
    letters = F.concat(F.array(F.regexp_extract(code, "^[IJ]", 0)), F.regexp_extract_all(code, F.lit("[DKRS][IJ]?"), F.lit(0)))

    def written(turn: Column, letter: Column) -> Column:
        edit = F.substring(letter, 1, 1)
        own = F.when(edit == "K", turn["role"]).when(edit == "R", "user").when(edit == "S", "assistant")
        new = F.when(letter.endswith("I"), "user").when(letter.endswith("J"), "assistant")
        said = [F.struct(own.alias("role"), turn["text"].alias("text")), F.struct(new.alias("role"), F.lit("").alias("text"))]
        return F.filter(F.array(*said), lambda s: s["role"].isNotNull())

    holder = F.array(F.lit(None).cast("struct<place:int,initial:string,fault:string,role:string,text:string>"))
    repaired = F.flatten(F.zip_with(F.concat(holder, F.col("turns")), letters, written))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate(code, "JS", "IR").alias("audit"), repaired.alias("repaired"))


def digests(repaired: DataFrame) -> DataFrame:
    """repaired_sha256, of `role:text` in lines, in place of the repaired turns."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
