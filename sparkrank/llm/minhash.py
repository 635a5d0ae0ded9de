"""MinHash near-dedup of weighted shingles: ProbMinHash signatures, banding, verification, components.

A text's five-word shingles weigh 1 plus the logarithm of how often they occur, so a line that is repeated over and
over doesn't outweigh the rest. ProbMinHash lets every shingle arrive at the registers as a Poisson process of its
weight; a register keeps its earliest arrival, and arrivals later than the latest register can't matter, so most
shingles end after one. Equal registers estimate the probability Jaccard.

1. Texts of equal word sequences are copies: their least doc_id stands for them from here on.
2. Bands of registers are bucket keys. A text that repeats shingles has a second signature, of weights that are all 1,
   whose equal registers estimate the plain Jaccard, and bands of both; without repeats the two are the same, so
   one set of buckets has candidates by either similarity. In a bucket every text is held against two representatives (least and
   largest id), so a group of n texts gives 2n pairs. Exact figures decide each pair: it links at a probability or
   plain Jaccard of `least` or more. A representative's text is dealt out where many pairs need it.
3. Links are merged to components. In a bucket that still holds several components, the texts outside its largest
   one are held against all others, so no link between different texts is lost to the representatives. Two texts that
   link have at least the share `least` of either's shingles, or of their weight, in common, so under any one order of all shingles
   both hold the first common one before what is left falls below that share. With rare shingles first these prefixes
   leave out what a bucket's texts share anyhow, like a site's boilerplate: only texts of a bucket whose prefixes share
   a shingle across components are compared. Groups with the same largest component are compared together: blocks
   of texts meet blocks of texts, and a task compares two blocks as a whole and returns links only. The order comes
   from `SLOTS` counters; it decides about speed, never about results.

Each document's class_id is the least doc_id of its component. Null, empty and blank texts link to nothing. A text of
fewer than five words is one shingle. Rows repeated with the same doc_id count once; rows of a null doc_id take
no part. Nothing is collected, whatever the sizes of groups and buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, dealt, map_texts, passes
from .textscan import content, mix, scan, shingles

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
#: Texts of a block, about, and equal shingles that a comparison of blocks holds at once.
BLOCK, MEETS = 256, 500_000
#: Pairs of two blocks that share a shingle from which on it is a column of a matrix, and columns of a matrix.
OFTEN, COLUMNS = 128, 1024
#: Counters of how many texts hold a shingle; their sums are all that the driver sees of them.
SLOTS = 1 << 20
_U = np.uint64


def weighed(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """A row of `registers` 64-bit codes for each of n texts, from their distinct shingles.

    All shingles give their next arrivals together. Texts with few shingles left give several at a time, about
    one for each register, so some dozen rounds end the work of any text.
    """
    time = np.full(n * registers, np.inf)
    code = np.zeros(n * registers, np.uint64)
    clock = np.zeros(len(owner))
    turn = np.zeros(len(owner), np.uint64)
    while len(owner):
        left = np.bincount(owner, minlength=n)
        many = np.maximum(1, registers // np.maximum(left, 1))[owner]
        each = np.repeat(np.arange(len(owner)), many)
        first = np.cumsum(many) - many
        rank = np.arange(len(each)) - first[each]
        bits = mix(value[each] + (turn[each] + rank.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        wait = -np.log(_uniform(bits)) / weight[each]
        total = np.concatenate([[0.0], np.cumsum(wait)])
        arrival = clock[each] + (total[1:] - total[first][each])
        slot = owner[each] * registers + (mix(bits) % _U(registers)).astype(np.int64)
        useful = arrival < time[slot]
        slot, at, source = slot[useful], arrival[useful], each[useful]
        np.minimum.at(time, slot, at)
        won = time[slot] == at
        code[slot[won]] = value[source[won]]
        clock, turn = arrival[first + many - 1], turn + many.astype(np.uint64)
        latest = time.reshape(n, registers).max(axis=1)
        on = clock < latest[owner]
        owner, value, weight, clock, turn = owner[on], value[on], weight[on], clock[on], turn[on]
    return code.reshape(n, registers)


def buckets(codes: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket keys for each signature."""
    steps = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    bands = (mix(codes).reshape(len(codes), BANDS, ROWS) * (steps | _U(1))).sum(axis=2, dtype=np.uint64)
    return mix(bands + mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, content hashes c1 and c2, and the bucket keys of its signatures, a row per row of docs.

    A text that repeats shingles has twice as many buckets: those of its weighted and of its plain signature.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scan(batch.column("text"))
        owner, value, count = shingles(s, WORDS)
        repeats = np.zeros(s.n, bool)
        repeats[owner[count > 1]] = True
        keys = np.zeros((s.n, 2, BANDS), np.int64)
        keys[:, 0] = buckets(signatures(owner, value, weighed(count), s.n))
        if repeats.any():
            own, place = repeats[owner], np.cumsum(repeats) - 1
            keys[repeats, 1] = buckets(signatures(place[owner[own]], value[own], np.ones(int(own.sum())), int(repeats.sum())))
        has = np.ones((s.n, 2), bool)
        has[:, 1] = repeats
        bounds = np.concatenate([[0], np.cumsum(has.sum(1) * BANDS)]).astype(np.int32)
        c1, c2 = content(s)
        columns = [batch.column("doc_id"), pa.array(s.per_text(owner)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[has].ravel()))]
        return pa.record_batch(columns, names=["doc_id", "n_shingles", "c1", "c2", "buckets"])

    return map_texts(docs, ["doc_id", "text"], "text", run, f"doc_id {kind}, n_shingles long, c1 long, c2 long, buckets array<long>")


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two weighted sets: sorted distinct values and their weights."""
    (va, wa), (vb, wb) = a, b
    common, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    union = len(va) + len(vb) - len(common)
    if not len(common):
        return 0.0, 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio, where = np.unique(x / y, return_inverse=True)
    # for weights (p, q) the sum over all elements of max(x/p, y/q) is that of max(x, y * p/q), over p
    total = np.array([np.maximum(x, y * r).sum() + only_a + only_b * r for r in ratio])
    return float((x / total[where]).sum()), len(common) / union


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of each text, and their weights."""
    owner, value, count = shingles(scan(texts), WORDS)
    order = np.lexsort((value, owner))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    value, weight = value[order], weighed(count[order])
    return [(value[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pair_similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = pa.concat_arrays([part.column("text_a").cast(pa.large_utf8()), part.column("text_b").cast(pa.large_utf8())]).dictionary_encode()
            sets, index, n = _sets(texts.dictionary), texts.indices.to_numpy(), part.num_rows
            found = [similarities(sets[index[i]], sets[index[n + i]]) for i in range(n)]
            yield pa.record_batch([part.column("a"), part.column("b"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["a", "b", "probability_jaccard", "jaccard"])


def block_links(few: list[tuple[np.ndarray, np.ndarray]], many: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which of few (rows) link to which of many (columns).

    Shingles that many pairs share are counted by matrix products, the others pair by pair.
    """
    n, m = len(few), len(many)
    if not n or not m:
        return np.zeros((n, m), bool)
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(v) for v, _ in sets]), np.concatenate([v for v, _ in sets]), np.concatenate([w / max(w.sum(), 1e-300) for _, w in sets]))
    (i, x, p), (j, y, q) = flat(few), flat(many)
    keys, x = np.unique(x, return_inverse=True)
    at = np.searchsorted(keys, y)
    both = np.flatnonzero(at < len(keys))
    both = both[keys[at[both]] == y[both]]
    j, y, q = j[both], at[both], q[both]
    meets = np.bincount(x, minlength=len(keys)) * np.bincount(y, minlength=len(keys))
    common, share_few, share_many = np.zeros((3, n, m))
    often = np.flatnonzero(meets >= OFTEN)
    for start in range(0, len(often), COLUMNS):
        column = np.full(len(keys), -1)
        column[often[start : start + COLUMNS]] = np.arange(len(often[start : start + COLUMNS]))
        a, b = np.flatnonzero(column[x] >= 0), np.flatnonzero(column[y] >= 0)
        filled = lambda rows, columns, values, size: _filled((size, min(COLUMNS, len(often) - start)), rows, columns, values)  # noqa: B023, E731
        holds_few, holds_many = filled(i[a], column[x[a]], 1.0, n), filled(j[b], column[y[b]], 1.0, m)
        common += holds_few @ holds_many.T
        share_few += filled(i[a], column[x[a]], p[a], n) @ holds_many.T
        share_many += holds_few @ filled(j[b], column[y[b]], q[b], m).T
    rest_x, rest_y = np.flatnonzero(meets[x] < OFTEN), np.flatnonzero(meets[y] < OFTEN)
    rest_y = rest_y[np.argsort(y[rest_y], kind="stable")]
    low = np.searchsorted(y[rest_y], x[rest_x], "left")
    size = np.searchsorted(y[rest_y], x[rest_x], "right") - low
    ends = np.cumsum(size)
    start = 0
    while start < len(rest_x):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MEETS, "right")))
        each, own = size[start:end], rest_x[start:end]
        other = rest_y[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[start:end], each)]
        own = np.repeat(own, each)
        cell = i[own] * m + j[other]
        for total, weight in ((common, None), (share_few, p[own]), (share_many, q[other])):
            total += np.bincount(cell, weight, n * m).reshape(n, m)
        start = end
    lengths_few, lengths_many = (np.array([len(v) for v, _ in sets]) for sets in (few, many))
    links = (common >= least * (lengths_few[:, None] + lengths_many[None] - common)) & (common > 0)
    # for shares s, t of weight that is common, the probability Jaccard is at most 1 / (1/s + 1/t - 1): the term of a common
    # shingle is a concave function, homogeneous of degree 1, of its two weights
    shares = share_few * share_many
    bound = shares / np.maximum(share_few + share_many - shares, 1e-300)
    for a, b in np.argwhere(~links & (bound + 1e-9 >= least)):
        links[a, b] = similarities(few[a], many[b])[0] >= least
    return links


def _filled(shape: tuple[int, int], rows: np.ndarray, columns: np.ndarray, values: np.ndarray | float) -> np.ndarray:
    out = np.zeros(shape)
    out[rows, columns] = values
    return out


def _slot(value: np.ndarray) -> np.ndarray:
    return (mix(value) % _U(SLOTS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for part in passes(batches, "text"):
        total += np.bincount(_slot(shingles(scan(part.column("text")), WORDS)[1]), minlength=SLOTS)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["slot", "n"])


def prefixes(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, often: np.ndarray, n: int, least: float) -> np.ndarray:
    """Places of the shingles that n texts' prefixes hold, rare ones first: those from which on the share `least` of the text is left."""
    order = np.lexsort((value, often, owner))
    own, w = owner[order], weight[order]
    size, total = np.bincount(own, minlength=n), np.bincount(own, w, n)
    first = np.cumsum(size) - size
    sums = np.concatenate([[0.0], np.cumsum(w)])
    left, left_weight = size[own] - (np.arange(len(own)) - first[own]), total[own] - (sums[:-1] - sums[first[own]])
    return order[(left >= (least - 1e-9) * size[own]) | (left_weight >= (least - 1e-9) * total[own])]


def _prefix_rows(counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in passes(batches, "text"):
            owner, value, count = shingles(scan(part.column("text")), WORDS)
            often = counts[_slot(value)]
            held = prefixes(owner, value, weighed(count), often, part.num_rows, least)
            held = held[often[held] > 1]  # others are no other text's
            at = pa.array(owner[held])
            yield pa.record_batch([*[part.column(c).take(at) for c in ("doc_id", "root", "mains")], pa.array(value[held].view(np.int64))], names=["doc_id", "root", "mains", "shingle"])

    return run


def _block_pairs(least: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple] = set()
            for row in range(batch.num_rows):
                few, many = ([v.as_py() for v in batch.column(c)[row].values] for c in ("few", "many"))
                links = block_links(_sets(pa.array([v["text"] for v in few])), _sets(pa.array([v["text"] for v in many])), least)
                for i, x in enumerate(few):
                    seen = {x["root"]}
                    for j in np.flatnonzero(links[i]):  # one link to each other component will do
                        if many[j]["root"] not in seen:
                            seen.add(many[j]["root"])
                            found.add(tuple(sorted((x["doc_id"], many[j]["doc_id"]))))
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


def texts_of_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents in pairs; of rows repeated with the same doc_id the least text counts."""
    wanted = pairs.select(F.explode(F.array("member", "rep")).alias("doc_id")).distinct()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    # the one join that shuffles all texts: it does so at every size
    return texts.hint("merge").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Of the pairs (member, rep) those that link: a, b, probability_jaccard, jaccard.

    A member is in few pairs (at most two for each of its buckets), a rep may be in any number: its text is dealt out.
    """
    of = lambda id_: texts.select(F.col("doc_id").alias(id_), F.col("text").alias(f"text_{id_}"))
    many = pairs.groupBy("rep").agg(F.count("*").alias("n"))
    total = pairs.count()
    both = dealt(pairs.join(of("member"), "member"), many.join(of("rep"), "rep"), ["rep"], total, "member", sizes=many)
    both = both.select(F.col("member").alias("a"), F.col("rep").alias("b"), F.col("text_member").alias("text_a"), F.col("text_rep").alias("text_b"))
    kind = dict(pairs.dtypes)["member"]
    found = both.mapInArrow(_pair_similarity, f"a {kind}, b {kind}, probability_jaccard double, jaccard double")
    return found.where((F.col("probability_jaccard") >= least) | (F.col("jaccard") >= least))


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (its component's least node) for every node of the links, by large-star and small-star rounds.

    Every round groups and joins on nodes, hot ones in parts; sums of a round's edges show when nothing changes any more.
    """
    edges = scratch.save(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        # large star: all larger neighbours point to the least neighbour
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = scratch.save(dealt(both, nearest, ["u"], 2 * now[0], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours point to the least of these
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = dealt(large, least, ["u"], large.count(), "v").where("v <> m").select(F.col("v"), F.col("m").alias("u")).unionAll(least.select(F.col("u").alias("v"), F.col("m").alias("u")))
        edges, old = scratch.save(small.where("u <> v").distinct()), edges
        now, before = state(edges), now
        scratch.drop(old, nearest, large, least)
        if now == before:
            break
    return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node").unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _meeting(mixed: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """main, doc_id and root of the texts whose prefixes share a shingle across components, in a bucket of the same largest one.

    mixed: main, doc_id and root of the texts of buckets of several components. main is here the largest component that
    holds the shingle.
    """
    own = mixed.groupBy("doc_id").agg(F.min("root").alias("root"), F.collect_set("main").alias("mains"))  # a few of its buckets'
    rows = own.join(texts, "doc_id")
    found = rows.select("text").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    kinds = dict(own.dtypes)
    each = rows.mapInArrow(_prefix_rows(counts, least), f"doc_id {kinds['doc_id']}, root {kinds['root']}, mains {kinds['mains']}, shingle long")
    each = scratch.save(each.select("doc_id", "root", F.explode("mains").alias("main"), "shingle").select("doc_id", "root", F.xxhash64("main", "shingle").alias("key")))
    several = scratch.save(each.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n"))
    total = several.agg(F.sum("n")).first()[0] or 0
    held = scratch.save(dealt(each, several, ["key"], total, "doc_id"))
    sizes = held.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = scratch.save(sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("n")).select("key", F.col("top.root").alias("main"), "n"))
    return dealt(held, largest, ["key"], total, "doc_id").groupBy("main", "doc_id").agg(F.min("root").alias("root"))


def _across(mixed: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links across components: of every largest component the texts outside it, in blocks, against blocks of all."""
    every = scratch.save(_meeting(mixed, texts, least, scratch))
    blocks_of = lambda condition: F.ceil(F.count_if(condition) / BLOCK).cast("int")
    outside = F.col("root") != F.col("main")
    sizes = scratch.save(every.groupBy("main").agg(blocks_of(outside).alias("rows"), blocks_of(F.lit(True)).alias("columns"), F.count("*").alias("n")))
    held = dealt(every, sizes, ["main"], every.count(), "doc_id").join(texts, "doc_id")
    kind = dict(every.dtypes)["doc_id"]

    def blocks(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        """Each block once for every block that it meets, so that hot components spread over the tasks."""
        number = F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int")
        made = rows.withColumn(f"at_{own}", number).groupBy("main", f"at_{own}", other).agg(F.collect_list(F.struct("doc_id", "root", "text")).alias(name))
        return made.select("main", f"at_{own}", name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"at_{other}"))

    both = blocks(held.where(outside), "rows", "columns", "few").join(blocks(held, "columns", "rows", "many"), ["main", "at_rows", "at_columns"]).select("few", "many")
    return both.mapInArrow(_block_pairs(least, to_arrow_type(every.schema["doc_id"].dataType)), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id of every distinct doc_id that isn't null.

    All that lies between is written to a folder of its own under the shared one, which is left with the result alone.
    """
    scratch, kept = Scratch(docs.sparkSession, "minhash"), Scratch(docs.sparkSession, "classes")
    base = scratch.save(signed(docs.where("doc_id is not null")))
    solid = base.where("n_shingles > 0")
    copies = scratch.save(solid.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    total = copies.agg(F.sum("n")).first()[0] or 0
    copied = scratch.save(dealt(solid.select("doc_id", "c1", "c2"), copies, ["c1", "c2"], total, "doc_id").where("doc_id <> first").groupBy("doc_id").agg(F.min("first").alias("first")))
    texts = solid.select("doc_id", "buckets").join(copied, "doc_id", "left_anti")

    # buckets of more than one text, their members, and these against two of them
    bands = texts.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = scratch.save(bands.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low <> high"))
    held = shared.agg(F.sum("n")).first()[0] or 0
    members = scratch.save(dealt(bands, shared, ["bucket"], held, "doc_id"))
    pair = lambda rep: members.where(F.col("doc_id") != F.col(rep)).select(F.col("doc_id").alias("member"), F.col(rep).alias("rep"))
    pairs = pair("low").unionAll(pair("high")).groupBy(F.least("member", "rep").alias("a"), F.greatest("member", "rep").alias("b")).agg(F.max("rep").alias("rep"))
    pairs = scratch.save(pairs.select(F.when(F.col("rep") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), "rep"))
    needed = scratch.save(texts_of_pairs(pairs, docs))
    links = scratch.save(verified(pairs, needed, least))
    scratch.drop(pairs)
    roots = scratch.save(components(links, scratch))

    # buckets that still hold several components: what the representatives didn't show
    classed = members.select("bucket", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sizes = classed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    # in buckets of up to three texts every pair was compared
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots"), F.sum("size").alias("n")).where("roots > 1 and n > 3").select("bucket", F.col("top.root").alias("main"), "n")
    largest = scratch.save(largest)
    if largest.take(1):
        more = scratch.save(_across(dealt(classed, largest, ["bucket"], largest.agg(F.sum("n")).first()[0], "doc_id"), needed, least, scratch))
        if more.take(1):
            roots = scratch.save(components(links.select("a", "b").unionAll(more), scratch))

    copies_of = copied.groupBy(F.col("first").alias("node")).agg(F.count("*").alias("n"))
    firsts = copies_of.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class_id"), "n")
    joined = dealt(copied.select("doc_id", F.col("first").alias("node")), firsts, ["node"], total, "doc_id", sizes=copies_of).select("doc_id", "class_id")
    own = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))
    alone = base.select("doc_id", F.col("doc_id").alias("class_id"))
    found = kept.save(alone.unionAll(joined).unionAll(own).groupBy("doc_id").agg(F.min("class_id").alias("class_id")))  # a class's id is its least
    scratch.close()
    return found


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns, without those whose class another document stands for.

    Of rows repeated with the same doc_id one stays; rows of a null doc_id all stay.
    """
    classes = near_duplicates(docs, least).where("doc_id <> class_id").select(F.col("doc_id").alias("_dropped"))
    kept = docs.join(classes, docs["doc_id"] == classes["_dropped"], "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 and doc_id is not null").select(F.col("doc_id").alias("_again"))
    if not again.take(1):
        return kept
    hit = kept["doc_id"] == again["_again"]
    return kept.join(again, hit, "left_anti").unionByName(kept.join(again, hit, "left_semi").dropDuplicates(["doc_id"]))
