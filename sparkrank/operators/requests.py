"""Checks of request parameters: of one request, raising ValueError with what is wrong, and of tables of requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import METRICS
from .constants import POSITIONS, STRATEGIES


def _within(name: str, value: float, low: float, high: float, open_low: bool = False) -> None:
    if not (low < value if open_low else low <= value) or not value <= high:
        raise ValueError(f"{name} is {value}, not {low} to {high}")


def weights(given: Mapping[str, float]) -> dict[str, float]:
    """Weights by metric, each 0 to 1; missing ones are 0."""
    for metric, value in given.items():
        if metric not in METRICS:
            raise ValueError(f"{metric!r} is no metric")
        _within(metric, value, 0, 1)
    return {m: float(given.get(m, 0.0)) for m in METRICS}


def squad(given: Mapping) -> Mapping:
    """A nested squad: eleven and four slots with known positions and prices over 0 to 15, bank 0 to 100."""
    for part, n in (("startingXI", 11), ("bench", 4)):
        if len(given[part]) != n:
            raise ValueError(f"{part} has {len(given[part])} slots, not {n}")
        for slot in given[part]:
            if slot["pos"] not in POSITIONS.values():
                raise ValueError(f"{slot['pos']!r} is no position")
            _within("price", slot["price"], 0, 15, open_low=True)
    _within("bank", given["bank"], 0, 100)
    return given


def suggestion(position: str, max_price: float, limit: int = 5) -> None:
    if position not in POSITIONS.values():
        raise ValueError(f"{position!r} is no position")
    _within("max_price", max_price, 0, 15, open_low=True)
    _within("limit", limit, 1, 10)


def generation(strategy: str, budget: float = 100.0) -> None:
    if strategy != "ai" and strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is no strategy")
    _within("budget", budget, 80, 100)


# Request tables: JSON bodies checked as rows, all rules that a body breaks
#
# Bodies are read as VARIANT, so a number in quotes is no number. Each check gives an array of (path, error); a body's errors are
# those of all its checks. What is missing or null where a value is needed is `required`; what should be whole, in range or known
# and isn't says so, and a value that breaks several rules has an error for each. Unknown entries are passed over.

ERRORS = "array<struct<path:string,error:string>>"
BULK_METRICS = METRICS[:5]
#: Entries of the weights in a body, by metric.
WEIGHT_ENTRIES = dict(zip(METRICS, ["form", "xg90", "xa90", "expMin", "next3Ease", "avgPoints", "value", "ownership"], strict=True))


def _entry(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _bound(v: Column, then) -> Column:
    """then(v) with v evaluated once, however often then uses it."""
    return F.get(F.transform(F.array(v), then), F.lit(0))


def _kind(v: Column) -> Column:
    """STRING, BIGINT and so on; VOID for null, null for what is missing. Of lists and objects it walks through every entry: `_is_object` and a cast to an array don't."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def _issues(path: Column, *rules: tuple[Column, str]) -> Column:
    """The errors whose condition holds."""
    return F.filter(F.array(*[F.when(broken, F.struct(path.alias("path"), F.lit(error).alias("error"))) for broken, error in rules]), lambda e: e.isNotNull())


def _needed(v: Column, path: Column, then: Column, optional: bool = False) -> Column:
    """`required` for a value that is missing or null, unless it is optional and missing; or else `then`."""
    missing = v.isNull() if optional else v.isNull() | F.is_variant_null(v)
    return F.when(missing, F.array().cast(ERRORS) if optional else _issues(path, (F.lit(True), "required"))).otherwise(then)


def _typed(v: Column, path: Column, kinds: tuple[str, ...], name: str, then, optional: bool = False) -> Column:
    """Errors of a value that must be of some kinds: `required`, the wrong kind, or else those of then(value)."""
    wrong = _issues(path, (F.lit(True), f"not {name}"))
    return _bound(v, lambda x: _needed(x, path, F.when(~_kind(x).isin(*kinds), wrong).otherwise(then(x)), optional))


def _number(v: Column, path: Column, low: float | None = None, high: float | None = None, above: float | None = None, whole: bool = False, optional: bool = False) -> Column:
    def ranged(x: Column) -> Column:
        rules = [(x != F.floor(x), "not whole")] if whole else []
        rules += [(x <= above, f"not over {above}")] if above is not None else []
        rules += [(x < low, f"under {low}")] if low is not None else []
        rules += [(x > high, f"over {high}")] if high is not None else []
        return _issues(path, *rules)

    return _typed(v, path, ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "a number", lambda e: _bound(F.try_variant_get(e, "$", "double"), ranged), optional)


def _choice(v: Column, path: Column, known: list[str]) -> Column:
    return _typed(v, path, ("STRING",), "a text", lambda e: _issues(path, (~F.try_variant_get(e, "$", "string").isin(*known), "unknown")))


def _list(v: Column, path: Column, each, length: int | None = None, optional: bool = False) -> Column:
    """Errors of an array: its length, then those of its entries by each(entry, path)."""
    wrong = _issues(path, (F.lit(True), "not a list"))

    def listed(entries: Column) -> Column:
        own = _issues(path, (F.size(entries) != length, f"not {length} entries")) if length is not None else F.array().cast(ERRORS)
        inner = F.flatten(F.transform(entries, lambda e, i: each(e, F.concat(path, F.lit("."), i.cast("string")))))
        return F.when(entries.isNull(), wrong).otherwise(F.concat(own, inner))

    return _bound(v, lambda x: _needed(x, path, _bound(F.try_variant_get(x, "$", "array<variant>"), listed), optional))


def _object(v: Column, path: Column, entries, optional: bool = False) -> Column:
    """Errors of an object: those of its entries, a function of (object, path of an entry by its name)."""
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    wrong = _issues(path, (F.lit(True), "not an object"))
    return _bound(v, lambda x: _needed(x, path, F.when(~_is_object(x), wrong).otherwise(F.concat(*entries(x, at))), optional))


def _weight_entries(metrics):
    return lambda v, at: [_number(_entry(v, WEIGHT_ENTRIES[m]), at(WEIGHT_ENTRIES[m]), 0, 1, optional=True) for m in metrics]


def _slot(v: Column, path: Column) -> Column:
    return _object(v, path, lambda s, at: [_number(_entry(s, "id"), at("id"), above=0, whole=True), _choice(_entry(s, "pos"), at("pos"), list(POSITIONS.values())), _number(_entry(s, "price"), at("price"), above=0, high=15)])


def _squad(v: Column, path: Column) -> Column:
    return _object(v, path, lambda s, at: [_list(_entry(s, "startingXI"), at("startingXI"), _slot, 11), _list(_entry(s, "bench"), at("bench"), _slot, 4), _number(_entry(s, "bank"), at("bank"), 0, 100)])


def _wish(id_name: str):
    def entries(v: Column, at) -> list[Column]:
        ids = lambda e, path: _number(e, path, above=0, whole=True)
        return [
            _number(_entry(v, id_name), at(id_name), above=0, whole=True), _choice(_entry(v, "position"), at("position"), list(POSITIONS.values())),
            _number(_entry(v, "maxPrice"), at("maxPrice"), above=0, high=15), _list(_entry(v, "excludeIds"), at("excludeIds"), ids, optional=True),
        ]

    return entries


def _text(v: Column, path: Column) -> Column:
    sized = lambda n: _issues(path, (n < 1, "under 1 characters"), (n > 100, "over 100 characters"))
    return _typed(v, path, ("STRING",), "a text", lambda e: sized(F.length(F.try_variant_get(e, "$", "string"))))


#: The checks of each kind of request: functions of (body, path of an entry by its name).
KINDS = {
    "analyze": lambda v, at: [_squad(_entry(v, "squad"), at("squad")), _object(_entry(v, "weights"), at("weights"), _weight_entries(METRICS), optional=True)],
    "suggestion": lambda v, at: [*_wish("playerId")(v, at), _number(_entry(v, "limit"), at("limit"), 1, 10, whole=True, optional=True)],
    "bulk": lambda v, at: [_list(_entry(v, "players"), at("players"), lambda e, path: _object(e, path, _wish("id"))), _object(_entry(v, "weights"), at("weights"), _weight_entries(BULK_METRICS), optional=True)],
    "generate": lambda v, at: [_choice(_entry(v, "strategy"), at("strategy"), [*STRATEGIES, "ai"]), _number(_entry(v, "budget"), at("budget"), 80, 100, optional=True)],
    "search": lambda v, at: [_text(_entry(v, "name"), at("name"))],
}


def request_errors(requests: DataFrame, body: str = "body", kind: str = "kind") -> DataFrame:
    """requests with `errors`, an array of (path, error) in the order of the rules; empty for a sound request.

    body: JSON text; one that is none, or no object, has an error at path ''. A kind that isn't one of KINDS has an error at path 'kind'.
    """
    read = requests.withColumn("_body", F.try_parse_json(body))
    at = lambda name: F.lit(name)
    errors = _issues(F.lit("kind"), (F.lit(True), "unknown"))
    for name, entries in KINDS.items():
        errors = F.when(F.col(kind) == name, F.concat(*entries(F.col("_body"), at))).otherwise(errors)
    whole = F.when(~_is_object(F.col("_body")), _issues(F.lit(""), (F.lit(True), "not an object"))).otherwise(errors)
    return read.withColumn("errors", whole).drop("_body")
