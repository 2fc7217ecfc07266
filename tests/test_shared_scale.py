"""Designations that share a variety: pairs stay in the task that unpacks them, and are not written."""

import random
import re

import pytest

from lectern.operators import graph, pair_lists
from lectern.operators.skew import consecutive_ids, cut_lists, least_group_of_lists
from lectern.plans.registered import graphs


def edges(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, p string, o string, k long")
    return graph.edges_of(df, F.col("s"), F.col("o"), F.col("p"), graph.order_key(0, F.lit("x"), F.col("k"), F.lit(0), F.lit(0)))


def plain(groups):
    least = {}
    for g, of in sorted(groups.items()):
        for a in of:
            for b in of:
                if a < b:
                    least.setdefault((a, b), g)
    return sorted((a, b, g, f"name {g}") for (a, b), g in least.items())


@pytest.mark.parametrize("scale", [1, 1 << 33])
def test_pairs_of_lists_with_names(spark, scale):
    rng = random.Random(4)
    groups = {g * scale: sorted({rng.randrange(120) * scale - 7 for _ in range(rng.choice((1, 3, 8, 40)))}) for g in range(60)}
    groups[61 * scale] = [m * scale - 7 for m in range(120)]  # all members in one group
    rows = [(g, f"name {g}", of) for g, of in groups.items()]
    lists = spark.createDataFrame(rows, "g long, name string, of array<long>")
    for block, most in ((256, 1 << 23), (16, 1 << 23), (16, 300), (7, 20)):
        got = least_group_of_lists(cut_lists(lists, "of", block), "g", most, label="name")
        assert sorted(map(tuple, got.collect())) == plain(groups), (block, most)


def test_tasks_reduce_a_few_pairs_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pair_lists, "AT_ONCE", 50)
    monkeypatch.setattr(pair_lists, "ROW_PAIRS", 4)
    rng = random.Random(5)
    groups = {g: sorted({rng.randrange(40) for _ in range(12)}) for g in range(30)}
    batch = pa.RecordBatch.from_pydict(
        {"g": list(groups), "_l": pa.array(groups.values(), pa.list_(pa.int32())), "_r": pa.array([None] * 30, pa.list_(pa.int32()))})
    bounds = {"group": "g", "label": None, "least": 0}
    sent = list(pair_lists.deal([batch], width=1, first=[0] * 40, pieces=[1] * 40, **bounds))
    assert len(sent) > 10 and all(s.num_rows == 1 for s in sent)
    kinds = {"member_kind": "int", "group_kind": "bigint", "last": 39, "least_group": 0, "last_group": 29, "lows": [0]}
    rows = [x for out in pair_lists.reduce(sent, **bounds, **kinds) for x in out.to_pylist()]
    assert max(len(x["_after"]) for x in rows) <= 4
    assert sorted((x["a"], y["b"], y["g"], f"name {y['g']}") for x in rows for y in x["_after"]) == plain(groups)


def test_numbers_follow_the_order_without_gaps(spark):
    df = spark.createDataFrame([(f"n{k:04d}",) for k in range(500)], "x string").repartition(7)
    got = consecutive_ids(df, ("x",), "n").collect()
    assert sorted((r.n, r.x) for r in got) == [(k, f"n{k:04d}") for k in range(500)]
    assert consecutive_ids(df.limit(0), ("x",), "n").count() == 0


def test_shared_pairs_are_not_shuffled_for_their_names(spark):
    listed = edges(spark, [(f"d{k % 9}", "AUTHORIZES_VARIETY", f"v{k % 7}") for k in range(60)] + [("d1", "X", "d2")])
    found = graph.shares_variety(listed)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: re.search(r"Generate explode\(_after", text).start()]
    assert found.count() == 9 * 8 // 2 - 1


def test_inferred_shared_edges_are_seen_but_not_written(spark, monkeypatch):
    given = edges(spark, [
        ("A", "AUTHORIZES_VARIETY", "w"), ("A", "AUTHORIZES_VARIETY", "v"), ("B", "AUTHORIZES_VARIETY", "v"), ("B", "AUTHORIZES_VARIETY", "w"),
        ("C", "AUTHORIZES_VARIETY", "A"), (None, "AUTHORIZES_VARIETY", "v"), ("B", "AUTHORIZES_VARIETY", None),
        # A is also a zone and a province: of B, with which it shares a variety, of v, which it lists, of C, of A itself
        *[(d, "CONTAINS_MUNICIPALITY", f"t {d}") for d in ("A", "B", "C", "v", "B2")],
        *[(f"t {d}", "MUNICIPALITY_IN_ZONE", "A") for d in ("A", "B", "C", "v")], ("t B2", "MUNICIPALITY_IN_PROVINCE", "A"),
        # B is a zone of A: the shared edge is A -> B; C has A as its zone when A as its province is tried
        ("t A", "MUNICIPALITY_IN_ZONE", "B"), ("t C", "MUNICIPALITY_IN_PROVINCE", "A"), (None, None, None),
    ])
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, cut=graph.cut_lineage: written.append(cut(df)) or written[-1])
    out = graph.infer_shared(given)
    assert out.count() == given.count() + 5
    got = {(r.src, r.predicate, r.dst, r.attrs.get("variety")) for r in out.filter("source = 'cross_inference'").collect()}
    assert got == {
        ("A", "SHARES_VARIETY_WITH", "B", "w"), ("A", "ZONE_IN_DOP", "A", None), ("A", "ZONE_IN_DOP", "C", None), ("B", "ZONE_IN_DOP", "A", None),
        ("A", "PROVINCE_CONTAINS_DOP", "B2", None),
    }
    tables = [t for t in written if "predicate" in t.columns]
    assert tables and not any(t.filter("predicate = 'SHARES_VARIETY_WITH'").count() for t in tables)


def test_edges_of_other_kinds_do_not_read_what_was_sold(spark, tmp_path):
    kinds = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]), "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 0)]), "part": ("p_partkey long", [(1,)]),
        "customer": ("c_nationkey int, c_mktsegment string", [(0, "S")]),
        "lineitem": ("l_suppkey long, l_partkey long", [(1, 1), (2, 1), (2, 1), (None, 1), (1, None)]),
    }
    for name, (ddl, rows) in kinds.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    _, made = graphs.trade_graph(spark, str(tmp_path))
    assert made.filter("predicate = 'AUTHORIZES_VARIETY'").count() == 4
    towns = made.filter("predicate = 'CONTAINS_MUNICIPALITY'")
    assert towns.count() == 2 and "l_partkey" not in towns._jdf.queryExecution().optimizedPlan().toString()
