import random

from pagelens.llm.common import joined_by_key
from pagelens.llm.components import connected_components


def plain(links):
    label = {x: x for link in links for x in link if None not in link and link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and b is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components_match_plain_version(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]  # many small groups
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(3000, 2000 + i) for i in range(60)]  # a chain and a hub
    links += [(5, 5), (None, 3), (4, None), (-7, 2000)] + links[:20]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain(links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_by_key_however_large_the_table(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, 4])], "k long, i long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 4").selectExpr("k", "k * 10 as v", "n")
    want = sorted((k, i, 10 * k) for k, i in ((r.k, r.i) for r in rows.collect()) if k != 4)
    for small in (100, 1):
        assert sorted((r.k, r.i, r.v) for r in joined_by_key(rows, table, "k", hot=10, small=small).collect()) == want
