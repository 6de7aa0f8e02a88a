"""Links of hubs that nobody chose."""

from pyspark.sql import functions as F

from weft.llm import linkage
from weft.llm.jaccard_join import place_of
from weft.llm.linkage import link_components, shared_postings
from weft.llm.work import Work


def test_hub_that_no_item_chose_keeps_its_links(spark):
    hub, lists = 1, []
    for i in range(3):  # item 10 + i shares 3 bands with the hub and 4 with 20 + i, which is in longer lists
        lists += [(hub, 10 + i)] * 3 + [(10 + i, 20 + i)] * 4 + [(20 + i, 30 + i)] * 6
    postings = [(key, -1, x, key) for key, pair in enumerate(lists) for x in pair]
    postings = spark.createDataFrame(postings, "key long, salt int, id long, pos int")
    shared = shared_postings(postings).withColumns({"n": F.lit(1).cast("long"), "last": F.lit(0).cast("long")})
    true = F.col("a") == hub

    def texts(ids, n):
        return ids.select("id", F.col("id").cast("string").alias("text"))

    def verify(pairs):
        return pairs.where(true).select("a", "b")

    def family(pairs):
        return pairs.select("a", "b", true.alias("linked"), F.lit(10).cast("long").alias("n"), F.lit(1).cast("long").alias("c"), F.array().cast("array<long>").alias("extras"))

    every = F.lit(True)
    got = link_components(Work(spark, "test"), shared, texts, verify, F.lit(10), every, every, family)
    assert {(r.id, r.component) for r in got.collect()} == {(hub, hub), (10, hub), (11, hub), (12, hub)}


def test_copies_that_share_too_little_besides_the_hub_are_not_paired(spark, monkeypatch):
    rows = []  # (hub, id, comp, linked, n, c, extras): each needs 10 elements besides the hub's
    for i in range(60):  # one element in common with 19 others, or two that are the only ones anybody else has
        rows.append((1, 100 + i, 100 + i, False, 100, 70, [i // 20, 10 + i // 2, *range(1000 + 40 * i, 1028 + 40 * i)]))
    rows += [(1, 200 + i, 200 + i, False, 100, 70, [*range(20, 40), *range(5000 + 40 * i, 5010 + 40 * i)]) for i in range(2)]
    rows += [(1, 300 + i, 300 + i, False, 100, 85, [*range(50 + 15 * i, 65 + 15 * i)]) for i in range(3)]  # need nothing besides
    members = spark.createDataFrame(rows, "hub long, id long, comp long, linked boolean, n long, c long, extras array<long>")
    made = []

    def between(rows, group, condition, plain=linkage._between):
        made.append(plain(rows, group, condition))
        return made[-1]

    monkeypatch.setattr(linkage, "_between", between)
    got = linkage._within(Work(spark, "test"), members, 80)
    assert sorted((r.a, r.b) for r in got.distinct().collect()) == [(200, 201)]
    assert made[0].count() < 20  # 700 before
    loose = members.withColumn("c", F.when(F.col("id") >= 300, 95).otherwise(F.col("c")).cast("long"))
    got = linkage._within(Work(spark, "test"), loose, 80)
    assert sorted((r.a, r.b) for r in got.collect()) == [(200, 201)] * made[1].count() + [(300, 301), (300, 302), (301, 302)]


def test_postings_are_shared_by_items_of_like_sizes(spark):
    rows = [(1, -1, 10, 50), (1, -1, 11, 100), (1, -1, 12, 200)]  # no two are within 80 %
    rows += [(2, -1, 10, 50), (2, -1, 13, 62), (2, -1, 14, 77), (2, -1, 12, 200)]  # 50 and 62, 62 and 78 are; 50 and 77 aren't
    rows += [(3, -1, 15, 80), (3, -1, 16, 100), (4, -1, 17, 79), (4, -1, 16, 100)]
    rows += [(5, -1, 10, 50), (5, -1, 10, 50), (6, 0, 10, 50), (6, 1, 12, 200)]  # a copy of one's own; blocks of a frequent key
    postings = spark.createDataFrame(rows, "key long, salt int, id long, n long")
    got = sorted((r.key, r.id) for r in shared_postings(postings, 80).collect())
    assert got == [(2, 10), (2, 13), (2, 14), (3, 15), (3, 16), (6, 10), (6, 12)]
    assert len(shared_postings(postings).collect()) == 13


def test_places_are_short_and_in_order():
    order = [(0, 0), (0, 2**64 - 1), (1, 0), (1, 2**63), (2, 5), (3, 0), (1000, 7), (1001, 0), (2**32 - 1, 2**64 - 1)]
    places = [place_of(*x) for x in order]
    assert places == sorted(places) and places[0] >= 0 and places[-1] < 1 << 19
    assert place_of(1, 0) < place_of(1, 2**62) < place_of(2, 0) < place_of(3, 0)
