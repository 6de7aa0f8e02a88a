"""Similarity links between items that share a posting, without all pairs within a group.

Postings are (key, salt, id, n, last, pos): item ``id`` holds signature element ``key`` at ``pos``; ``n`` is its set size
and ``last`` the place in a global order of the last element that it has sent; ``salt`` is -1 for ordinary keys
and a block number from 0 for frequent ones.  Two rounds find the components of the graph of all candidate pairs that
pass the exact check:

1. every item is compared with one hub, the item that shares most, of the lists it is in; this ties a group of
   thousands of near copies together with one comparison for each copy;
2. every remaining candidate pair *between different components* is compared.

A pair within one component can't change the components, so nothing is lost by leaving it out.
Lists of very frequent keys are split by ``salt`` in round 1 and by Spark's skew join in round 2.

Families also keep round 2 from pairing all copies of one hub that aren't similar enough to it: what
two items of a family share is in the hub, or in neither's part of it.  So with c elements shared with the
hub, a pair can only match if it shares an element that the hub lacks, or if the smaller c is enough by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.work import BROADCAST_ROWS, Work


#: An element that more than so many of a family have is common to it.
COMMON = 32
#: Longs of a bitmap, in which each element of a set has one bit.
LONGS = 32


def shared_postings(postings: DataFrame, t: int = 0) -> DataFrame:
    """Postings whose list holds another item (those of frequent keys, which stand in several blocks, all), with the list's size.

    With ``t`` the other item's n must be within t % of the own one or the other way round, as that of any similar set; next to an item
    in the order of n are those of the nearest n.  A copy of a posting that another task has sent counts as one such.
    """
    w = Window.partitionBy("key", "salt")
    lists = postings.select("*", F.min("id").over(w).alias("low"), F.max("id").over(w).alias("top"), F.count("*").over(w).cast("int").alias("size"))
    other = F.expr("low != top")
    if t:
        order = w.orderBy("n", "id")
        lists = lists.select("*", F.lag("n").over(order).alias("less"), F.lead("n").over(order).alias("more"))
        other &= F.expr(f"coalesce(less * 100 >= n * {t}, false) or coalesce(n * 100 >= more * {t}, false)")
    return lists.where(other | F.expr("salt >= 0")).drop("low", "top", "less", "more")


def with_hubs(shared: DataFrame, sent: Column, by_size: bool) -> DataFrame:
    """Adds cap, n less the elements that no other item has sent (of ``sent`` elements), rank, how many shared elements come before, and each list's hub.

    The hub is the item that shares the largest part of its postings, or with ``by_size`` the one that is in the
    longest lists, the smallest of these.  An original shares what its edited copies kept, each copy has elements of its
    own; so the original of a group, to which all copies are similar though not to each other, becomes the hub.
    """
    own, lists = Window.partitionBy("id"), Window.partitionBy("key", "salt")
    ranked = shared.withColumn("rank", F.dense_rank().over(own.orderBy("pos")) - 1)  # tasks may have sent copies of a posting
    ranked = ranked.withColumn("c", F.max("rank").over(own) + 1).withColumn("p", sent)
    score = F.sum("size").over(own) if by_size else F.col("c") * 1000 / F.col("p")
    rows = ranked.select("*", score.cast("int").alias("share"), F.expr("n - p + c").alias("cap")).drop("c", "p", "size")
    hub = F.max(F.struct("share", (-F.col("id")).alias("neg"), "n", "cap", "last")).over(lists)
    return rows.select("*", hub.alias("hub"))


def _votes(rows: DataFrame) -> DataFrame:
    return rows.select("id", (-F.col("hub.neg")).alias("other"), F.col("n").alias("n1"), F.col("cap").alias("cap1"), F.col("last").alias("last1"), F.col("hub.n").alias("n2"), F.col("hub.cap").alias("cap2"), F.col("hub.last").alias("last2"))


def _between(rows: DataFrame, group: str, condition: Column) -> DataFrame:
    """Rows 1 and 2 of one key in different groups and components; most of the rows are in the key's major group."""
    sizes = rows.groupBy("key", group).agg(F.count("*").alias("count"), F.min("comp").alias("low"), F.max("comp").alias("top"))
    keys = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max_by(group, F.struct("count", group)).alias("major"), F.min("low").alias("low"), F.max("top").alias("top"))
    keys = keys.where("k > 1 and low != top").select("key", "major")  # others hold no pair to compare
    several = rows.join(keys, "key")
    names = [c for c in rows.columns if c != "key"]
    a = several.where(f"{group} != major").select("key", *[F.col(c).alias(f"{c}1") for c in names])
    b = several.select("key", "major", *[F.col(c).alias(f"{c}2") for c in names])
    # Pairs of minor groups meet twice; one of them is enough.
    meet = F.expr(f"{group}1 != {group}2 and comp1 != comp2 and ({group}2 = major or id1 < id2)")
    return a.join(b, (a["key"] == b["key"]) & meet & condition)


def _open(work: Work, members: DataFrame) -> DataFrame:
    """The members of hubs whose members are in different components; others hold no pair to compare."""
    hubs = work.keep(members.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).where("low != top").select("hub"))
    return members.join(F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs, "hub", "left_semi")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def _alike(t: int) -> Column:
    """Whether two sets may match by their bitmaps: each bit that one lacks is of an element of the other's own."""
    own = ["(" + " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(LONGS)) + ")" for x, y in (("bits1", "bits2"), ("bits2", "bits1"))]
    return F.expr(f"least(n1 - {own[0]}, n2 - {own[1]}) * {100 + t} >= (n1 + n2) * {t}")


def _within(work: Work, family: DataFrame, t: int) -> DataFrame:
    """Pairs of a family in different components that share a rare element that the hub lacks, or enough of the rest.

    Elements that many of the family have count as if the hub had them; so c bounds what two items share of these.
    """
    of_key = Window.partitionBy("key")
    own = family.select(F.explode("extras").alias("e"), "hub", "id", "comp", "n").withColumn("key", F.xxhash64("hub", "e")).drop("e", "hub")
    own = own.select("*", F.count("*").over(of_key).alias("k"), (F.min("comp").over(of_key) != F.max("comp").over(of_key)).alias("open"))
    own = work.keep(own.where(f"open or k > {COMMON}"))  # most elements are one item's own
    more = own.where(f"k > {COMMON}").groupBy("id").agg(F.count("*").alias("f"))
    family = work.keep(family.drop("extras").join(more, "id", "left").withColumn("c", F.expr("c + coalesce(f, 0)")).drop("f"))
    bits = "bits" in family.columns
    sides = [family.select("hub", "linked", *[F.col(c).alias(f"{c}{k}") for c in ("id", "comp", "n", "c", *["bits"] * bits)]) for k in (1, 2)]
    loose = sides[0].where(f"not linked and c1 * 100 >= n1 * {t}").drop("linked")
    enough = loose.join(sides[1], (loose["hub"] == sides[1]["hub"]) & F.expr(f"comp1 != comp2 and (linked or id1 < id2) and least(c1, c2) * {100 + t} >= (n1 + n2) * {t}") & (_alike(t) if bits else F.lit(True)))
    rare = own.where(f"open and k <= {COMMON}").select("key", "k", "id", "comp", "n").join(family.select("id", "c"), "id")
    of_id = Window.partitionBy("id")
    rare = rare.select("*", F.count("*").over(of_id).alias("u"), F.row_number().over(of_id.orderBy("k", "key")).alias("place"))
    rare = work.keep(rare.where(f"u - place + 1 >= (n * {t} + 99) div 100 - c").drop("k"))
    sizes = F.expr(f"least(n1, n2) * 100 >= greatest(n1, n2) * {t} and (least(c1, c2) + 1 + least(u1 - place1, u2 - place2)) * {100 + t} >= (n1 + n2) * {t}")
    return _pairs(enough).union(_pairs(_between(rare, "comp", sizes)))


def link_components(
    work: Work, shared: DataFrame, texts: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], sent: Column, sizes: Column, places: Column, family: Callable[[DataFrame], DataFrame], threshold: int = 80, by_size: bool = True
) -> DataFrame:
    """(id, component) of items that have at least one verified link; component is the smallest id.

    ``shared`` are the postings (key, salt, id, n, last, pos, size) whose list holds another item, as of :func:`shared_postings`.
    ``texts(ids, n)`` returns (id, text) of the n ids; ``verify`` filters (a, text_a, b, text_b) to the linked pairs
    (a, b); ``sent`` counts an item's postings; ``sizes`` is a necessary condition on n, cap and last of a pair and
    ``places`` one on pos and rank too.  ``family`` maps the pairs of round 1 to (a, b, linked, n, c, extras): a's
    size, what it shares with b, and its other elements, and may add ``bits``, a's bitmap; the links are of Jaccard similarity threshold / 100.  With
    ``by_size`` (many short items) hubs are chosen by the length of their lists, and items that miss theirs try a second one.
    """
    hubs = work.keep(with_hubs(work.keep(shared), sent, by_size))
    # Hubs of the blocks of a frequent key are tied to the best of them in the same way.
    tops = hubs.where("salt >= 0").select("key", F.col("hub.share").alias("share"), (-F.col("hub.neg")).alias("id"), F.col("hub.n").alias("n"), F.col("hub.cap").alias("cap"), F.col("hub.last").alias("last")).distinct()
    best = F.max(F.struct("share", (-F.col("id")).alias("neg"), "n", "cap", "last")).over(Window.partitionBy("key"))
    votes = _votes(hubs).union(_votes(tops.select("*", best.alias("hub")))).where((F.col("id") != F.col("other")) & sizes)
    first = votes.groupBy("id", "other").count().groupBy("id").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    first = first.select(F.col("id").alias("a"), F.col("other").alias("b"))
    if by_size:  # a hub's own hub is nearer to the middle of the group; hubs only ever lead to better ones
        for _ in range(2):
            first = work.keep(first)
            first = first.join(first.select(F.col("a").alias("b"), F.col("b").alias("up")), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
    first = work.keep(first)
    compared, have = check(work, first, texts, family)
    links = compared.where("linked").select("a", "b")
    if by_size:  # those that missed the hub are compared with the copy that has the least besides the hub's elements
        nearest = compared.where("linked").groupBy("b").agg(F.max_by("a", F.struct(F.expr("c / n"), "a")).alias("near"))
        missed = compared.where("not linked").join(nearest, "b").select("a", F.col("near").alias("b"))
        links = links.union(check(work, missed, texts, verify, have)[0])
    comps = work.keep(components(work, links))

    known = hubs.join(comps, "id", "left").select("key", "id", "n", "pos", "rank", "cap", "last", F.coalesce("component", "id").alias("comp"))
    near = compared if by_size else compared.where("2 * c >= n")  # others share little with the hub: they are compared by their postings
    members = near.join(comps.withColumnRenamed("id", "a"), "a", "left")
    members = work.keep(members.select(F.col("a").alias("id"), F.col("b").alias("hub"), "linked", "n", "c", "extras", *[c for c in near.columns if c == "bits"], F.coalesce("component", "a").alias("comp")))
    known = known.join(members.select("id", "hub"), "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    within = _within(work, work.keep(_open(work, members)), threshold)
    rest = _pairs(_between(work.keep(known), "hub", sizes & places)).union(within).distinct()
    if by_size:
        rest = work.keep(rest)  # texts of round 1 are there, but not of hubs of all their lists that no item was compared with
        ends = work.keep(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().join(have.select("id"), "id", "left_anti"))
        n = ends.count()
        have = have.union(work.keep(texts(ends, n))) if n else have
    else:
        done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # in round 1: every pair is verified once
        rest = work.keep(rest.join(done, ["a", "b"], "left_anti"))
    more, have = check(work, rest, texts, verify, have if by_size else None)
    if more.isEmpty():
        return comps
    return components(work, links.union(more))


def check(work: Work, pairs: DataFrame, texts: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], have: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that pass ``verify``, and the (id, text) used; the texts of either end travel to the pairs."""
    pairs = work.keep(pairs)
    if have is None:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        have = work.keep(texts(ids, ids.count()))
    left = pairs.join(have.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(have.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return work.keep(verify(both.select("a", "text_a", "b", "text_b"))), have
