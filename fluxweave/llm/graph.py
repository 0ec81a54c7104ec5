"""Distributed union-find: smallest reachable id of each node of an edge list."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sized


def _mark(df: DataFrame) -> tuple[int, int]:
    """Rows and a hash of all of them, in no order."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id that its links reach) of every id in the edges; ids without an edge have no row.

    Large-star and small-star steps in turn until nothing changes: each is one shuffle by node with a minimum that is
    combined before it, so that a node of very many edges is no large group, and each round is written to the shared folder.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = saved(edges.where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(_star(F.col("a"), F.col("b"), F.col("m"))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        now = saved(small, "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _star(a: Column, b: Column, m: Column) -> Column:
    """Links of a node and of its smaller neighbour to the node's smallest one."""
    return F.array(F.struct(a.alias("a"), m.alias("b")), F.struct(b.alias("a"), m.alias("b")))


#: Rows whose keys could bring together more than so many pairs a row are tied first; for as long as that leaves at most this share of the pairs.
PAIRS, LEFT = 2, 0.5
#: Members of a bucket up to which all of its pairs of different roots meet: at most half as many a row, so in proportion to the rows. What larger buckets could bring together meets by differences.
SMALL = 256
#: Words of 64 bits of a set's parities.
PARITY = 8
#: An element is common if more than one in so many members of a leader's group differ from the leader by it.
COMMON = 16


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often later columns name it: a generator keeps it from being merged into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _compared(pairs: DataFrame, content: DataFrame, elements: Callable[[Column], Column], percent: int) -> DataFrame:
    """pairs (a, b) with the sets x and y, their sizes, how many elements both have, and ok: whether the Jaccard similarity is percent or more.

    The contents are joined as they are and made into sets only then: no set is shuffled.
    """
    one = content.select(F.col("rep").alias("a"), F.col("content").alias("_a"))
    two = content.select(F.col("rep").alias("b"), F.col("content").alias("_b"))
    met = once(once(pairs.join(one, "a").join(two, "b"), "x", elements(F.col("_a"))), "y", elements(F.col("_b"))).drop("_a", "_b")
    met = once(met, "both", F.size(F.array_intersect("x", "y"))).withColumns({"nx": F.size("x"), "ny": F.size("y")})
    return met.withColumn("ok", 100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both")))


def leaders(buckets: DataFrame) -> DataFrame:
    """key, leader and n: of each bucket the large member that meets the most others in all of its buckets, and how many members it has."""
    mates = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    central = buckets.join(mates, "key").groupBy("rep").agg(F.sum("n").alias("mates"))  # a text whose copies the others are meets most of them
    drawn = F.when(F.col("large"), F.struct(-F.col("mates"), F.xxhash64("rep").alias("h"), F.col("rep").alias("rep")))
    return buckets.join(central, "rep").groupBy("key").agg(F.min(drawn).alias("l"), F.count(F.lit(1)).alias("n")).select("key", F.col("l.rep").alias("leader"), "n")


def _sketched(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """pairs (a, b) with the sketches x and y."""
    sketches = sized(content.select("rep", "sketch"), 64)
    pairs = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a")
    return pairs.join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")


def linked(buckets: DataFrame, content: DataFrame, elements: Callable[[Column], Column], percent: int, likely: Callable[[Column, Column, int], Column]) -> DataFrame:
    """Links a, b whose components are those of all pairs in buckets with a similarity of percent/100 or more.

    buckets: key, rep and large (a pair needs one member that is large). content: a written table of rep, content, of which elements makes the
    set of distinct hashes, and sketch; likely(x, y, p) tells from two sketches whether the similarity may be p/100 or more, and only such pairs are verified. Each member of a bucket is held against one leader of it only, and what is linked to the
    same leader is one component. Jaccard distance is a metric, so of the members that are not linked to the leader only
    those within twice the distance of a link can be linked to one that is, and the others among themselves only. Members that
    such links could bring together meet again: in buckets of SMALL members at most pair by pair, in larger ones by differences. With E(x) for the difference between x and the leader, sets x and y have |E(x)| +
    |E(y)| - 2 |E(x) & E(y)| elements not in common, and linked ones c (|x| + |y|) at most, c = (100 - p) / (100 + p). If not both
    are linked to the leader, they can be linked only if E(x) and E(y) meet, and in so many elements that their first
    ones in one order (see _first) do; parities rule out most of those that are not. So members meet again by equal differences instead of pair by pair: a group of n
    loose copies of one text costs about n pairs, and no link between components is lost.
    """
    leader = sized(saved(leaders(buckets), "leaders"), 32)
    pairs = buckets.join(leader, "key").where("rep != leader").groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.max("large").alias("large"), F.max(F.col("n") > SMALL).alias("crowded"))
    twice = 2 * percent - 100
    x, y = F.col("x"), F.col("y")
    guess = saved(_sketched(saved(pairs, "pairs"), content).select("a", "b", "large", "crowded", likely(x, y, percent).alias("likely"), likely(x, y, twice).alias("near")), "guesses")
    exact = 100 * F.col("both") >= twice * (F.col("nx") + F.col("ny") - F.col("both"))
    met = _compared(guess.where("likely").select("a", "b", "large", "crowded"), content, elements, percent).select("a", "b", "large", "crowded", "ok", exact.alias("near"))
    met = saved(met.union(guess.where("NOT likely").select("a", "b", "large", "crowded", F.lit(False), "near")), "compared")
    links = met.where("ok").select("a", "b")
    found = sized(saved(components(links), "components"), 24).withColumnRenamed("id", "a")
    direct = _direct(buckets, leader, found, met, content, elements, percent, likely)
    rooted = met.where("crowded").join(found.withColumnRenamed("component", "root"), "a", "left").join(found.select(F.col("a").alias("b"), F.col("component").alias("leader_root")), "b", "left")
    rooted = rooted.select("a", "b", "large", "ok", "near", F.coalesce("root", "a").alias("root"), F.coalesce("leader_root", "b").alias("leader_root"))
    rooted = saved(rooted.withColumn("apart", F.col("root") != F.col("leader_root")), "rooted")
    alone = F.when(~F.col("ok"), F.col("root"))
    open_ = rooted.groupBy("b").agg(F.count_if(F.expr("near AND apart")).alias("n_near"), F.count_if("ok").alias("n_ok"), F.min(alone).alias("x"), F.max(alone).alias("y"), F.count(F.lit(1)).alias("members"))
    open_ = open_.select("b", (F.col("n_near") * F.col("n_ok") > 0).alias("with_linked"), F.coalesce(F.col("x") != F.col("y"), F.lit(False)).alias("others"), "members").where("with_linked OR others")
    open_ = saved(open_, "open")
    if not open_.limit(1).count():
        return links.union(direct)
    again = rooted.join(sized(open_, 24), "b").where("ok AND with_linked OR NOT ok AND (others OR near AND apart AND with_linked)").select("a", "b", "large", "root", "members")

    none = F.array().cast("array<long>")
    first = saved(_compared(again, content, elements, percent).select("a", "b", "large", "nx", "root", "members", (1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("away"), _first(percent, none).alias("first"), _parity(x).alias("parity")), "first")
    counts = first.select("b", "members", F.explode("first").alias("e")).groupBy("b", "members", "e").agg(F.count(F.lit(1)).alias("f"))
    common = counts.where(f"f >= 8 AND {COMMON} * f > members").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("c")).select("b", F.transform("c", lambda s: s.e).alias("common"))
    common = saved(common, "common")
    differing = _compared(first.select("a", "b", "large", "root", "away").join(common, "b"), content, elements, percent)
    differing = once(differing, "first", _first(percent, F.col("common"))).select("a", "b", "large", "nx", "root", "away", "first")
    differing = differing.union(first.join(common, "b", "left_anti").select("a", "b", "large", "nx", "root", "away", "first"))
    rows = saved(differing.select("a", "b", "large", "nx", "root", "away", F.explode("first").alias("e")).select("a", "large", "nx", "root", "away", F.xxhash64("b", "e").alias("key")), "differences")
    shared = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rows = rows.join(sized(saved(shared, "shared"), 16), "key")
    rows = rows.join(sized(content.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), 64), "a")
    rows = saved(rows.join(sized(saved(first.groupBy("a").agg(F.first("parity").alias("parity")), "parities"), 16 + 8 * PARITY), "a"), "differences")
    of_size = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    of_distance = 100 * F.abs(F.col("away") - F.col("away2")) <= 100 - percent + 1e-6  # from the leader; else they are too far from each other
    meet = (F.col("root") != F.col("root2")) & (F.col("large") | F.col("large2")) & of_size & of_distance & likely(x, y, percent) & _alike(percent)
    rows, ties = _tied(rows, meet, content, elements, percent)
    more = rows.join(rows.select("key", *_other()), "key").where((F.col("a") < F.col("b")) & meet)
    more = saved(more.select("a", "b").distinct(), "pairs")
    return reduce(DataFrame.union, ties, links).union(direct).union(saved(_compared(more, content, elements, percent).where("ok").select("a", "b"), "links"))


def _direct(buckets: DataFrame, leader: DataFrame, found: DataFrame, met: DataFrame, content: DataFrame, elements: Callable[[Column], Column], percent: int, likely: Callable[[Column, Column, int], Column]) -> DataFrame:
    """Links between members of small buckets: found has the roots (of a) that links to leaders give, met the pairs that were compared for them."""
    rows = buckets.join(leader.where(f"n BETWEEN 3 AND {SMALL}"), "key").where("rep != leader").select("key", F.col("rep").alias("a"), "large")
    rows = rows.join(found.withColumnRenamed("component", "root"), "a", "left").select("key", "a", "large", F.coalesce("root", "a").alias("root"))
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("large").alias("any")).where("any AND low != high").select("key")
    rows = saved(rows.join(apart, "key", "left_semi"), "small")
    sets = once(content.join(sized(rows.select(F.col("a").alias("rep")).distinct(), 16), "rep", "left_semi"), "set", elements(F.col("content")))
    known = saved(sets.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.size("set").alias("nx"), _parity(F.col("set")).alias("parity")), "parities")
    rows = rows.join(sized(known, 80 + 8 * PARITY), "a")
    other = rows.select("key", *[F.col(c).alias(d) for c, d in (("a", "b"), ("large", "large2"), ("root", "root2"), ("x", "y"), ("nx", "ny"), ("parity", "parity2"))])
    meet = (F.col("a") < F.col("b")) & (F.col("root") != F.col("root2")) & (F.col("large") | F.col("large2"))
    of_size = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    pairs = rows.join(other, "key").where(meet & of_size & likely(F.col("x"), F.col("y"), percent) & _alike(percent)).select("a", "b").distinct()
    pairs = pairs.join(met.where("NOT ok").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return saved(_compared(saved(pairs, "pairs"), content, elements, percent).where("ok").select("a", "b"), "links")


def _other() -> list[Column]:
    """The columns of the other one of two rows that meet."""
    return [F.col(c).alias(other) for c, other in (("a", "b"), ("large", "large2"), ("nx", "ny"), ("root", "root2"), ("away", "away2"), ("x", "y"), ("parity", "parity2"))]


def _parity(x: Column) -> Column:
    """Of 64 * PARITY classes of a set's elements whether their number is odd: sets have as many elements not in common, at least, as these differ."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    word = lambda k: F.aggregate(x, F.lit(0).cast("long"), lambda s, h: F.when(F.shiftrightunsigned(h, 6).bitwiseAND(PARITY - 1) == k, s.bitwiseXOR(bit(h))).otherwise(s))
    return F.array(*map(word, range(PARITY)))


def _alike(percent: int) -> Column:
    """Whether two rows' parities let a similarity of percent / 100 be; no such pair is lost."""
    differ = reduce(Column.__add__, [F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("parity2", F.lit(k)))) for k in range(PARITY)])
    return (100 + percent) * differ <= (100 - percent) * (F.col("nx") + F.col("ny"))


def _tied(rows: DataFrame, meet: Column, content: DataFrame, elements: Callable[[Column], Column], percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """rows with the roots that links between neighbours give, without keys of one root, and those links.

    The members of a key are put in an order drawn anew each round, and each is held against the next one: as many pairs as rows. What is linked gets one root,
    and members of one root need not meet. Where loose copies of a text are linked here and there, a round or two bring most of them under
    one root. Rounds end when the pairs of different roots that are left are few, or no longer become fewer; all of those pairs still meet afterwards.
    """
    ties, before = [], None
    while True:
        of_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        of_key = of_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        n, pairs = of_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")).cast("double") / 2), F.lit(0.0))).head()
        if pairs <= PAIRS * n or (before is not None and pairs > LEFT * before):
            return rows, ties
        before = pairs
        order = Window.partitionBy("key").orderBy(F.xxhash64("a", F.lit(len(ties))), "a")
        next_ = rows.select("*", F.lead(F.struct(*_other())).over(order).alias("_next")).select("*", "_next.*").where(meet)
        next_ = next_.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("root").alias("root"), F.first("root2").alias("root2"))
        tied = saved(_compared(saved(next_, "neighbours"), content, elements, percent).where("ok").select("a", "b", "root", "root2"), "ties")
        ties.append(tied.select("a", "b"))
        found = sized(saved(components(tied, "root", "root2"), "components"), 24).select(F.col("id").alias("root"), "component")
        rows = rows.join(found, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
        shared = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        rows = saved(rows.join(sized(saved(shared, "shared"), 16), "key"), "differences")


def _first(percent: int, common: Column) -> Column:
    """The first elements of the difference between x and its leader y, in this order: what the leader lacks, what x lacks, each
    by hash, and at last what is common, in the order given: elements that many differences from this leader have.

    Linked sets have more than |E| (1 - c) / 2 elements of their differences in common if the other one is not linked to
    the leader, and |E| - |x| (100 - p) / p at least in any case. Two sets that have o elements in common have one among
    the first |E| - o + 1 of each, whatever the order is.
    """
    more, less = F.array_except("x", "y"), F.array_except("y", "x")
    difference = F.concat(F.sort_array(F.array_except(more, common)), F.sort_array(F.array_except(less, common)), F.array_intersect(common, F.concat(more, less)))
    size = F.col("nx") + F.col("ny") - 2 * F.col("both")
    if_linked = size - F.floor(size * percent / (100 + percent))
    otherwise = F.floor(F.col("nx") * (100 - percent) / percent) + 1
    return F.slice(difference, 1, F.greatest(F.least(size, F.when(F.col("ok"), if_linked).otherwise(otherwise)), F.lit(0)).cast("int"))
