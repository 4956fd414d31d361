"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two texts link when their sets of ``k``-word shingles have a Jaccard similarity of ``num / den`` or more. Texts with equal
sets form a class, which takes part once. A class posts only the rarest shingles of its set; any two similar sets share
one of these. All classes with a posted shingle in common are candidates, in three rounds:

1. along each posting list, a class is paired with the list's first class and with the one before it. Such pairs grow
   with the postings, not with their square;
2. where a list still holds classes of several components, its classes are put in an order of chance, another one on each
   list, and paired with the ``NEAR`` before them that are of other components; of the pairs that pass the filters, up to
   ``PAIRS`` for each two components are verified. Such pairs grow with the postings too, and join most of what is left of a
   large group of near copies;
3. where a list even then holds classes of several components, all pairs across components follow, so that none is missed.
   Pairs inside a component are not needed: their link changes no component.

Each pair passes the length, positional and suffix filters and is verified once, on the whole texts. So no pair of two
components is left unverified, and the components are those of all links. Components are the result, not the number of
links, which for one group of near copies is quadratic whatever the plan.

Joins are sort-merge joins at every size: none of the tables of ids, classes or lists has a bound that would let it be
broadcast.

Order of rareness: shingles that several sets of a block of text share are counted over all blocks; the most frequent
(up to ``ORDER_ENTRIES``) are kept by the power of two of their count and sent to the tasks. All others count as
rare and are ordered by hash. The order steers only the work: with any order the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import SMALL_BLOCK, free_shuffles, rows_asked_for, shingle_sets, signed, stored, text_blocks
from clearwell.llm.components import components

#: Size bound of the table of frequent shingles that is sent to the tasks: 9 bytes for each entry.
ORDER_ENTRIES = 1 << 20
#: Shingles that a task counts at once.
COUNT_BLOCK = 2_000_000
#: Members of a leader that are verified in one cell.
CELL = 1000
#: Classes of a list that a class is paired with in the second round, and pairs of two components that it verifies.
NEAR, PAIRS = 32, 64

_SETS = "doc_id long, n int, digest long, sig binary, token long, times long"
_PARITY = ("p0", "p1", "p2", "p3")


def _digest(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63


def _signature(x: np.ndarray) -> bytes:
    """For each of 256 ranges of the hash, whether the set holds an odd number of shingles there."""
    return np.packbits(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint8) & 1).tobytes()


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def counts() -> pa.RecordBatch:
            x, times = np.unique(np.concatenate(list(held.values())), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
            x, times = x[times > 1], times[times > 1]
            none = pa.nulls(len(x), pa.int64())
            return pa.record_batch(
                [none, pa.nulls(len(x), pa.int32()), none, pa.nulls(len(x), pa.binary()), pa.array(signed(x)), pa.array(times.astype(np.int64))],
                names=["doc_id", "n", "digest", "sig", "token", "times"])

        for batch in text_blocks(batches, limit=SMALL_BLOCK):
            sets = shingle_sets(batch.column("text"), k)
            digests = [_digest(x) for x in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array(digests, pa.int64()),
                 pa.array([_signature(x) for x in sets], pa.binary()), none, none],
                names=["doc_id", "n", "digest", "sig", "token", "times"])
            for x, d in zip(sets, digests):
                if len(x) and (len(x), d) not in held:
                    held[len(x), d] = x
                    size += len(x)
                    if size >= COUNT_BLOCK:
                        yield counts()
                        held, size = {}, 0
        yield counts()

    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with the power of two of their counts; at most ``ORDER_ENTRIES``."""
    total = counts.groupBy("token").agg(F.sum("times").alias("times"))
    total = stored(total.where("times >= 4").select("token", F.floor(F.log2("times")).cast("int").alias("power")), "frequent")
    kept, least = 0, 64
    for power, n in sorted(total.groupBy("power").count().collect(), reverse=True):
        if kept + n > ORDER_ENTRIES:
            break
        kept, least = kept + n, power
    rows = total.where(F.col("power") >= least).toArrow()
    token, power = rows.column("token").to_numpy().view(np.uint64), rows.column("power").to_numpy().astype(np.uint8)
    order = np.argsort(token)
    return token[order], power[order]


def _prefixes(k: int, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, power = frequent.value
        known = np.zeros(1 << 24, dtype=bool)
        known[(token >> np.uint64(40)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for batch in text_blocks(batches, limit=SMALL_BLOCK):
            out: list[tuple[np.ndarray, int, int]] = []
            for x in shingle_sets(batch.column("text"), k):
                n = len(x)
                if not n or (n, d := _digest(x)) in seen:
                    continue
                if len(seen) < 1_000_000:  # copies that are posted again fall together behind the shuffle
                    seen.add((n, d))
                p = n - -(-num * n // den) + 1
                maybe = np.flatnonzero(known[(x >> np.uint64(40)).astype(np.int64)])
                rank = np.zeros(n, dtype=np.uint8)
                if len(maybe):
                    at = np.minimum(np.searchsorted(token, x[maybe]), len(token) - 1)
                    rank[maybe] = np.where(token[at] == x[maybe], power[at], 0)
                    x = x[np.argsort(rank, kind="stable")]
                out.append((x[:p], n, d))
            if out:
                size = np.array([len(x) for x, _, _ in out])
                yield pa.record_batch(
                    [pa.array(signed(np.concatenate([x for x, _, _ in out]))),
                     pa.array(np.repeat(np.array([d for _, _, d in out], dtype=np.int64), size)),
                     pa.array(np.repeat(np.array([n for _, n, _ in out], dtype=np.int32), size)),
                     pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in size]))],
                    names=["token", "digest", "n", "pos"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, digest, n) to those of lists with two classes or more, each with the first and the last one.

    A row goes out with the row after it, so that the first of a list is known to have company. Only one row is kept
    between batches, whatever the length of a list.
    """
    names = ["token", "digest", "n", "pos"]
    kept: list[np.ndarray] | None = None  # the last row and the first row of its list
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if kept is not None:
            cols = [np.concatenate([a[:1], c]) for a, c in zip(kept, cols)]
        if not len(cols[0]):
            continue
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & (cols[2][1:] == cols[2][:-1])
        cols = [c[np.concatenate([[True], ~same])] for c in cols]
        starts = np.concatenate([[True], cols[0][1:] != cols[0][:-1]])
        head = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        leads = [c[head] for c in cols]
        if kept is not None:  # rows that go on with the kept list have its first row
            go_on = head == 0
            leads = [np.where(go_on, a[1], c) for a, c in zip(kept, leads)]
        later = np.flatnonzero(~starts)
        fields = [c[later] for c in cols] + [c[later] for c in leads[1:]] + [c[later - 1] for c in cols[1:]]
        if len(later):
            yield pa.record_batch([pa.array(f) for f in fields],
                                  names=names + [f"first_{x}" for x in names[1:]] + [f"last_{x}" for x in names[1:]])
        kept = [np.array([c[-1], x[-1]]) for c, x in zip(cols, leads)]


_LISTS = ("token long, digest long, n int, pos int, first_digest long, first_n int, first_pos int, "
          "last_digest long, last_n int, last_pos int")


def _may_link(num: int, den: int, a: str, b: str) -> Column:
    """Length filter, and the positional filter for a shingle taken as the first that both have."""
    na, nb, pa_, pb = (F.col(c).cast("long") for c in (f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (
        F.least(na - pa_, nb - pb) * (num + den) >= (na + nb) * num)


def _suffix_ok(num: int, den: int) -> Column:
    """Suffix filter: a range where one set has an odd and the other an even number of shingles holds a differing one."""
    diff = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in _PARITY), start=F.lit(0))
    size = F.col("a_n").cast("long") + F.col("b_n")
    # intersection >= size * num / (num + den), so difference <= size - 2 * size * num / (num + den)
    return diff * (num + den) <= size * (den - num)


def _cells(k: int, num: int, den: int):
    """Rows sorted by (leader, salt, leader first): each member's set against its leader's; one leader set is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, x = None, None
        for batch in text_blocks(batches, limit=SMALL_BLOCK):
            out = []
            sets = shingle_sets(batch.column("text"), k)
            names = ("leader", "salt", "member", "is_member", "n", "digest")
            for (a, salt, b, is_member, n, digest), y in zip(zip(*(batch.column(c).to_pylist() for c in names)), sets):
                if len(y) != n or _digest(y) != digest:
                    continue  # another text under the same doc_id
                if not is_member:
                    leader, x = (a, salt), y
                elif leader == (a, salt):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * den >= (len(x) + len(y) - both) * num:
                        out.append((a, b))
            yield pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the candidate pairs (a, b with n and digest) that link, each looked at once; a pair comes again where a doc_id is repeated.

    A leader's text goes once to each cell of about ``CELL`` members, a member's text once for each pair.
    """
    size = pairs.groupBy("a").agg(F.count("*").alias("members"))
    celled = pairs.join(size.hint("merge"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / CELL)).cast("int"))
    asked = celled.select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), "salt", F.col("b").alias("member"),
                          F.lit(True).alias("is_member"), F.col("b_n").alias("n"), F.col("b_digest").alias("digest"))
    heads = celled.select(F.col("a").alias("doc_id"), F.col("a").alias("leader"), "salt", F.col("a").alias("member"),
                          F.lit(False).alias("is_member"), F.col("a_n").alias("n"), F.col("a_digest").alias("digest")).distinct()
    rows = asked.union(heads)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    rows = rows.join(rows_asked_for(docs.select("doc_id", "text"), ids, "doc_id").hint("merge"), "doc_id")
    return (rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "is_member")
            .select("leader", "salt", "member", "is_member", "n", "digest", "text")
            .mapInArrow(_cells(k, num, den), "u long, v long"))


def _named(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes by digest and size to pairs of their smallest doc_ids that pass the suffix filter."""
    for side in ("a", "b"):
        own = classes.select(F.col("digest").alias(f"{side}_digest"), F.col("n").alias(f"{side}_n"), F.col("rep").alias(side), *(F.col(p).alias(f"{side}_{p}") for p in _PARITY))
        pairs = pairs.join(own.hint("merge"), [f"{side}_digest", f"{side}_n"])
    return pairs.where(_suffix_ok(num, den)).select("a", "a_n", "a_digest", "b", "b_n", "b_digest")


def ngram_join(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_shingles, component_id, class_size), a row for each row of ``docs``.

    Words are what stands between ASCII white space, with A-Z in lower case. A text of fewer than ``k`` words has one
    shingle, its whole sequence; null and blank texts have none and link with nothing. ``component_id`` is the smallest
    doc_id reachable by links, ``class_size`` the number of rows with an equal set (null for empty sets). Rows without a
    doc_id keep their size, link with nothing and have no component. Rows that repeat a doc_id are classed by their own
    text. Other columns are ignored; an empty table gives an empty result. Jobs run when this is called; the
    input is read four times and must return the same rows each time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(docs.mapInArrow(_describe(k), _SETS), "shingle-sets")
    sets = described.where("times is null").select("doc_id", "n", "digest", "sig")
    parity = [F.conv(F.hex(F.substring("sig", 8 * i + 1, 8)), 16, -10).cast("long").alias(p) for i, p in enumerate(_PARITY)]
    classes = stored(
        sets.where("n > 0 and doc_id is not null").select("doc_id", "digest", "n", *parity).groupBy("digest", "n")
        .agg(F.min("doc_id").alias("rep"), *(F.min(p).alias(p) for p in _PARITY), F.count("*").alias("class_size")), "classes")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(described.where("times is not null").select("token", "times")))

    postings = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        _prefixes(k, num, den, frequent), "token long, digest long, n int, pos int")
    lists = stored(
        postings.repartition("token").sortWithinPartitions("token", "digest", "n").mapInArrow(_lists, _LISTS), "lists")
    free_shuffles(docs.sparkSession)
    stars = [
        lists.select(*(F.col(f"{side}_{c}").alias(f"a_{c}") for c in ("digest", "n", "pos")),
                     *(F.col(c).alias(f"b_{c}") for c in ("digest", "n", "pos")))
        .where(_may_link(num, den, "a_", "b_")).select("a_digest", "a_n", "b_digest", "b_n")
        for side in ("first", "last")
    ]
    tried = stored(_named(stars[0].union(stars[1]).distinct(), classes, num, den), "candidates")
    free_shuffles(docs.sparkSession)
    found = _joined(_verified(tried, docs, k, num, den))

    # lists of up to three classes have had all their pairs; a list's first class is no row of its own
    long_ones = lists.groupBy("token").count().where("count >= 3").select("token")
    own, first = (F.struct(*(F.col(f"{side}{c}").alias(c) for c in ("digest", "n", "pos"))) for side in ("", "first_"))
    starts = F.expr("first_digest = last_digest and first_n = last_n")
    members = stored(lists.join(long_ones.hint("merge"), "token", "left_semi").select(
        "token", F.inline(F.when(starts, F.array(first, own)).otherwise(F.array(own)))), "long-lists")
    pairs = stored(_across_by_chance(members, classes, found, tried, num, den), "candidates")
    free_shuffles(docs.sparkSession)
    if not pairs.isEmpty():
        found = _joined(_as_edges(found).union(_verified(pairs, docs, k, num, den)))
        tried = tried.union(pairs)

    rest = stored(_across(members, classes, found, tried, num, den), "candidates")
    if not rest.isEmpty():
        found = _joined(_as_edges(found).union(_verified(rest, docs, k, num, den)))
    named = classes.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "digest", "n", "class_size", F.coalesce("component", "rep").alias("component_id"))
    linked = sets.join(named.hint("merge"), ["digest", "n"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return linked.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)).alias("component_id"), "class_size")


def _joined(edges: DataFrame) -> DataFrame:
    """The components; shuffled texts are the largest part of the disk used, and later steps have no use for them."""
    found = components(edges)
    free_shuffles(edges.sparkSession)
    return found


def _as_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _parts(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes with the component that they are in so far."""
    return classes.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(
        "digest", "n", "rep", *_PARITY, F.coalesce("component", "rep").alias("part"))


def _near(num: int, den: int):
    """Rows sorted by (token, place) to pairs of rows of one list, up to ``NEAR`` apart, that are in different components and pass all filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            before = len(kept[0]) if kept else 0
            cols = [np.concatenate(x) for x in zip(kept, cols)] if kept else cols
            token, digest, n, pos, rep, part, *parity = cols
            for away in range(1, min(NEAR, len(token) - 1) + 1):
                b = np.arange(max(away, before), len(token))
                a = b - away
                b, a = (x[(token[a] == token[b]) & (part[a] != part[b])] for x in (b, a))
                size = n[a] + n[b]
                ok = (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (
                    np.minimum(n[a] - pos[a], n[b] - pos[b]) * (num + den) >= size * num)
                ok &= sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in parity) * (num + den) <= size * (den - num)
                a, b = a[ok], b[ok]
                turned = (digest[a] > digest[b]) | ((digest[a] == digest[b]) & (n[a] > n[b]))
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                if len(a):
                    yield pa.record_batch(
                        [pa.array(c) for x in (a, b) for c in (rep[x], n[x].astype(np.int32), digest[x])]
                        + [pa.array(f(part[a], part[b])) for f in (np.minimum, np.maximum)],
                        names=["a", "a_n", "a_digest", "b", "b_n", "b_digest", "low", "high"])
            kept = [c[-NEAR:].copy() for c in cols]

    return run


def _across_by_chance(members: DataFrame, classes: DataFrame, found: DataFrame, tried: DataFrame, num: int, den: int) -> DataFrame:
    """Some candidate pairs of each two components that share a list: at most ``NEAR`` for each posting, ``PAIRS`` for each two components."""
    rows = members.join(_parts(classes, found).hint("merge"), ["digest", "n"]).select(
        "token", "digest", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "rep", "part", *_PARITY,
        F.xxhash64("token", "digest", "n").alias("place"))
    pairs = rows.repartition("token").sortWithinPartitions("token", "place").drop("place").mapInArrow(
        _near(num, den), "a long, a_n int, a_digest long, b long, b_n int, b_digest long, low long, high long")
    done = tried.select("a_digest", "a_n", "b_digest", "b_n")
    pairs = pairs.join(done.hint("merge"), done.columns, "left_anti")
    slot = F.pmod(F.xxhash64("a_digest", "b_digest"), F.lit(PAIRS)).alias("slot")
    return pairs.groupBy("low", "high", slot).agg(F.min(F.struct("a", "a_n", "a_digest", "b", "b_n", "b_digest")).alias("pair")).select("pair.*")


def _across(members: DataFrame, classes: DataFrame, found: DataFrame, tried: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of different components that are left after two rounds.

    On each list, the classes outside its largest component meet all the list's classes; those inside it need no pair. All
    filters stand in the join's condition.
    """
    members = stored(members.join(_parts(classes, found).hint("merge"), ["digest", "n"]), "open-lists")
    main = members.groupBy("token", "part").count().groupBy("token").agg(
        F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    a = members.join(main.hint("merge"), "token").where("part <> main")
    side = lambda x, s: x.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("digest", "n", "pos", "rep", "part", *_PARITY)))
    # a pair may come from both sides: the smaller digest leads
    low = F.struct("a_digest", "a_n") < F.struct("b_digest", "b_n")
    pairs = (side(a, "a").join(side(members, "b").hint("merge"), "token")
             .where((F.col("a_part") != F.col("b_part")) & _may_link(num, den, "a_", "b_") & _suffix_ok(num, den))
             .select(*(F.when(low, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}")
                       for x, y in (("a", "b"), ("b", "a")) for c in ("digest", "n", "rep"))))
    done = tried.select("a_digest", "a_n", "b_digest", "b_n")
    pairs = pairs.groupBy(*done.columns).agg(F.min("a_rep").alias("a"), F.min("b_rep").alias("b"))
    return pairs.join(done.hint("merge"), done.columns, "left_anti").select("a", "a_n", "a_digest", "b", "b_n", "b_digest")
