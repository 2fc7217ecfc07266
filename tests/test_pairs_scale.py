"""Pairs that share a group: the least shared group by lists, against plain Python."""

import re

from lectern.operators.skew import least_shared_group


def plain(rows):
    groups, least = {}, {}
    for g, m in rows:
        groups.setdefault(g, set()).add(m)
    for g, ms in sorted(groups.items()):
        for a in ms:
            for b in ms:
                if a < b:
                    least.setdefault((a, b), g)
    return sorted((a, b, g) for (a, b), g in least.items())


def memberships():
    # one group of all members, one member of all groups
    return sorted({(0, m) for m in range(90)} | {(g, (g * 7 + k * k) % 90) for g in range(1, 60) for k in range(6)} | {(g, 3) for g in range(60)})


def test_least_shared_group_of_cut_groups_and_hot_members(spark):
    rows = memberships()
    members = spark.createDataFrame(rows, "v long, d long")
    for block, most in ((256, 1 << 23), (16, 1 << 23), (16, 40), (256, 40)):
        got = sorted(tuple(r) for r in least_shared_group(members, "v", "d", block, most).collect())
        assert got == plain(rows), (block, most)


def test_pairs_are_reduced_where_they_are_unpacked(spark):
    text = least_shared_group(spark.createDataFrame(memberships(), "v long, d long"), "v", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: re.search(r"Generate explode\(_after", text).start()]
