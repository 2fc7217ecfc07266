import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.operators import graph, matching, skew
from lectern.operators.skew import next_event, pairs_sharing, products_within


def edge_table(spark, rows):
    """rows: (src, predicate, dst, stage, position)"""
    df = spark.createDataFrame(rows, "s string, p string, d string, stage int, n long")
    return graph.edges_of(df, F.col("s"), F.col("d"), F.col("p"), graph.order_key(F.col("stage"), F.lit(""), F.col("n"), F.lit(0), F.lit(0)))


def triples(spark, raw):
    df = spark.createDataFrame([("d", 0, "l", raw)], "path string, section_ord int, label string, raw string")
    return graph.triple_rows(df.withColumn("triples", replies.parse_triples("raw")))


def empty(spark):
    edges = edge_table(spark, [("", "", "", 0, 0)]).limit(0)
    nodes = edges.select(F.col("src").alias("name"), F.lit("t").alias("type"), "source", "attrs", "ord")
    return nodes, edges


def test_add_triples(spark):
    raw = """[{"subject": " rioja  alta", "subject_type": "Zone", "predicate": "P", "object": "tempranillo", "object_type": "Variety", "attrs": {"k": "v", "n": null}},
      {"subject": "Rioja Alta", "subject_type": "DOP", "predicate": "Q", "object": "Haro", "attrs": {"predicate": "R", "source": "s"}},
      {"subject": "", "predicate": "P", "object": "x"}, {"subject": "a", "predicate": "", "object": "x"}]"""
    nodes, edges = graph.add_triples(*empty(spark), triples(spark, raw))
    assert {(r.name, r.type) for r in nodes.collect()} == {("Rioja Alta", "Zone"), ("Tempranillo", "Variety"), ("Haro", "Entity")}
    got = {(r.src, r.dst, r.predicate, r.source, tuple(r.attrs.items())) for r in edges.collect()}
    assert got == {("Rioja Alta", "Tempranillo", "P", "llm:l", (("k", "v"),)), ("Rioja Alta", "Haro", "R", "s", ())}


def test_coauthorized_with_known_varieties(spark):
    edges = edge_table(spark, [("D", "AUTHORIZES_VARIETY", "A", 0, 1), ("D", "AUTHORIZES_VARIETY", "B", 0, 2), ("D", "AUTHORIZES_VARIETY", "C", 20, 3)])
    got = {(r.src, r.dst, r.via) for r in graph.coauthorized(edges).collect()}
    assert got == {("C", "A", "D"), ("A", "C", "D"), ("C", "B", "D"), ("B", "C", "D")}


def coauthorized_by_hand(rows):
    present, made = [], []
    for s, p, d, stage, n in sorted(rows, key=lambda r: (r[3], r[4])):
        present.append((s, p, d))
        if stage == 20 and p == "AUTHORIZES_VARIETY":
            for s2, p2, other in list(present):
                if s2 == s and p2 == p and other != d:
                    for a, b in ((d, other), (other, d)):
                        if not any(x == a and z == b for x, _, z in present):
                            present.append((a, "COAUTHORIZED_WITH", b))
                            made.append((a, b, s))
    return made


def test_coauthorized_random(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = []
        for n in range(60):
            if rng.random() < 0.85:
                rows.append((f"D{rng.randint(0, 3)}", "AUTHORIZES_VARIETY", f"V{rng.randint(0, 9)}", rng.choice([0, 20]), n))
            else:
                rows.append((f"V{rng.randint(0, 9)}", "OTHER", f"V{rng.randint(0, 9)}", 20, n))
        got = sorted((r.src, r.dst, r.via) for r in graph.coauthorized(edge_table(spark, rows)).collect())
        assert got == sorted(coauthorized_by_hand(rows))


def test_soil_in_climate_random(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = []
        for n in range(80):
            zone = f"Z{rng.randint(0, 4)}"
            rows.append(rng.choice([
                (zone, "HAS_SOIL", f"S{rng.randint(0, 4)}", 20, n), (zone, "HAS_CLIMATE", f"C{rng.randint(0, 4)}", 20, n),
                (f"M{n}", "MUNICIPALITY_IN_ZONE", zone, 20, n), (f"S{rng.randint(0, 4)}", "X", f"C{rng.randint(0, 4)}", 20, n),
            ]))
        present, made = [], []
        for s, p, d, _, _ in rows:
            present.append((s, p, d))
            if p == "MUNICIPALITY_IN_ZONE":
                soils = [z for x, q, z in present if x == d and q == "HAS_SOIL"]
                climates = [z for x, q, z in present if x == d and q == "HAS_CLIMATE"]
                for a, b in itertools.product(soils, climates):
                    if not any(x == a and z == b for x, _, z in present):
                        present.append((a, "SOIL_IN_CLIMATE", b))
                        made.append((a, b, d))
        got = sorted((r.src, r.dst, r.via) for r in graph.soil_in_climate(edge_table(spark, rows)).collect())
        assert got == sorted(made)


def test_pairs_of_a_hot_group(spark):
    rows = [("hot", f"m{i:03d}") for i in range(150)] + [(f"g{i % 20}", f"m{i % 37:03d}") for i in range(200)]
    rows = sorted(set(rows))
    got = pairs_sharing(spark.createDataFrame(rows, "g string, m string"), "g", "m", block=16).select("g", "a", "b").collect()
    want = sorted((g, a, b) for g in {r[0] for r in rows} for a, b in itertools.combinations(sorted(m for x, m in rows if x == g), 2))
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_next_event_within_and_across_ranges(spark, coalesce, monkeypatch):
    rng = random.Random(1)
    probes = [(rng.choice("ab"), rng.randint(0, 100)) for _ in range(60)] + [("z", 1), (None, 3), ("a", None)]
    events = [(rng.choice("aaaab"), rng.choice([5, 6, 70, 99, *range(40, 44)])) for _ in range(60)] + [("y", 4), (None, 5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    kept = []
    monkeypatch.setattr(skew, "cut_lineage", lambda df, cut=skew.cut_lineage: kept.append(cut(df)) or kept[-1])
    try:
        got = next_event(spark.createDataFrame(probes, "k string, t int"), spark.createDataFrame(events, "k string, t int"), "k", "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = [(k, t) for k, t in probes if k is not None and t is not None]
    want = {(k, t, min(e for x, e in events if x == k and e > t)) for k, t in known if any(x == k and e > t for x, e in events)}
    assert {tuple(r) for r in got if r.k is not None and r.t is not None} == want
    if coalesce == "false":  # the frequent key lies in several ranges
        assert kept[0].filter("k = 'a'").select("_range").distinct().count() > 2


def test_products_within_groups(spark):
    rng = random.Random(2)
    left, right = ([(rng.choice("aaab"), f"{side}{k}") for k in range(90)] + [(side, "alone")] for side in "lr")
    got = products_within(spark.createDataFrame(left, "g string, l string"), spark.createDataFrame(right, "g string, r string"), "g", block=10)
    assert sorted(map(tuple, got.select("g", "l", "r").collect())) == sorted((g, a, b) for g, a in left for h, b in right if g == h)


def test_shared_entities(spark):
    edges = edge_table(spark, [
        ("A", "AUTHORIZES_VARIETY", "v", 0, 1), ("B", "AUTHORIZES_VARIETY", "v", 0, 2), ("C", "AUTHORIZES_VARIETY", "v", 0, 3), ("A", "X", "C", 0, 4),
        ("A", "CONTAINS_MUNICIPALITY", "t", 0, 5), ("t", "MUNICIPALITY_IN_ZONE", "z", 0, 6), ("t", "MUNICIPALITY_IN_PROVINCE", "p", 0, 7),
        ("p", "KNOWN", "A", 0, 8), ("B", "CONTAINS_MUNICIPALITY", "t", 0, 9),
    ])
    out = graph.infer_shared(edges).filter("source = 'cross_inference'").collect()
    assert {(r.src, r.predicate, r.dst) for r in out} == {
        ("A", "SHARES_VARIETY_WITH", "B"), ("B", "SHARES_VARIETY_WITH", "C"), ("z", "ZONE_IN_DOP", "A"), ("z", "ZONE_IN_DOP", "B"), ("p", "PROVINCE_CONTAINS_DOP", "B"),
    }


def test_walk_and_text(spark):
    edges = edge_table(spark, [("a", "HAS_SOIL", "b", 0, 1), ("c", "AUTHORIZES_VARIETY", "b", 0, 2), ("c", "UNKNOWN", "d", 0, 3), ("d", "HAS_SOIL", "e", 0, 4)])
    nodes = spark.createDataFrame([(x, "T") for x in "abcd"], "name string, type string")
    seeds = spark.createDataFrame([("a",)], "name string")
    around = graph.neighbourhood(edges, seeds, 2)
    assert {(r.name, r.hop) for r in around.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    kept = graph.induced_edges(edges, around)
    lines = [r.line for r in graph.render_lines(kept, nodes, seeds, 1).orderBy("line_no").collect()]
    assert lines == ["## Coneixements del graf de relacions", "- a (T) → té sòl → b (T)", "- ... i 1 relacions més"]
    assert graph.render_lines(kept.limit(0), nodes, seeds).count() == 0
    got = {(r.kind, r.name, r.n) for r in graph.stats(nodes, edges).collect()}
    assert ("predicate", "HAS_SOIL", 2) in got and ("total", "edges", 4) in got and ("node_type", "T", 4) in got


NODES = [("Rioja", 0), ("Penedès", 1), ("Rioja Alta", 2), ("Alta Ribagorça", 3), ("la", 4), ("tempranillo negre", 5)]


def test_fuzzy_match_few_and_many(spark):
    nodes = spark.createDataFrame(NODES, "name string, ord long")
    entities = ["Rioja", "PENEDES", "Alta", "Tempranillo", "Zzz", "Rioja Alta Baixa"]
    want = {("Rioja", "Rioja", 1), ("PENEDES", "Penedès", 2), ("Alta", "Rioja Alta", 3), ("Tempranillo", "tempranillo negre", 3), ("Rioja Alta Baixa", "Rioja", 3)}
    assert {tuple(r) for r in matching.match_few(nodes, entities).collect()} == want
    table = spark.createDataFrame([(e,) for e in entities], "entity string")
    assert {tuple(r) for r in matching.match_many(table, nodes).collect()} == want


def test_lexicon(spark):
    texts = spark.createDataFrame([(1, "vins de rioja i priorat"), (2, "res de res"), (3, "la mancha-nord")], "id int, t string")
    known = spark.createDataFrame([("Rioja", "Rioja"), ("Priorat__Priorato", "Priorat / Priorato"), ("La_Mancha", "La Mancha"), ("res", "res")], "gi_name string, display_name string")
    want = {(1, "Rioja"), (1, "Priorat__Priorato"), (3, "La_Mancha")}
    assert {tuple(r) for r in matching.lexicon_mentions(texts, "id", "t", known).collect()} == want


def test_contained_names_equal_every_comparison(spark):
    import random

    random.seed(7)
    draw = lambda n: "".join(random.choice("abé€ ") for _ in range(n))
    texts = [(k, "x", draw(random.randint(0, 60))) for k in range(80)] + [(90, "y", None), (91, "y", ""), (92, "z", "abé€ " * 4000), (92, "z", "ab"), (None, "n", "abab")]
    names = {draw(random.randint(1, 12)) for _ in range(120)} | {"a", "€", "é€", "", "ab" * 40, "ab", "zz", "zzzzz"}
    want = {(i, s, n) for i, s, t in texts for n in names if t and n and n in t}
    df = spark.createDataFrame(texts, "id int, piece string, t string").repartition(4)
    lexicon = spark.createDataFrame([(n,) for n in names] + [(None,), ("ab",)], "n string")
    got = matching.contained_names(df, ["id", "piece"], "t", lexicon, "n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    got = {tuple(r) for r in matching.contained_names(df, ["id", "piece"], "t", lexicon, "n", least=4).collect()}
    assert got == {w for w in want if len(w[2]) >= 4}
    assert matching.contained_names(df.limit(0), ["id"], "t", lexicon, "n").count() == 0 == matching.contained_names(df, ["id"], "t", lexicon.limit(0), "n").count()


def test_names_are_keyed_by_rare_pieces_and_texts_stay(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "common words everywhere " + ("rarely" if k == 7 else "")) for k in range(60)], "id int, t string")
    lexicon = spark.createDataFrame([("words everywhere rarely",), ("common words nowhere",)], "n string")
    found = matching.contained_names(texts, ["id"], "t", lexicon, "n")
    assert [tuple(r) for r in found.collect()] == [(7, "words everywhere rarely")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_text_before" in plan and "t#" not in plan.split("Exchange")[0]
    sent = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df, cut=matching.cut_lineage: sent.append(cut(df)) or sent[-1])
    matching.contained_names(texts, ["id"], "t", lexicon, "n")
    assert [r["_name"] for r in sent[1].collect()] == ["words everywhere rarely"]  # a piece that no text has rules the other out


def test_short_entities_meet_nodes(spark):
    nodes = spark.createDataFrame([("Ribera", 0), ("Ebre", 1)], "name string, ord long")
    table = spark.createDataFrame([("eb",), ("r",)], "entity string")
    few = {tuple(r) for r in matching.match_few(nodes, ["eb", "r"]).collect()}
    assert few and {tuple(r) for r in matching.match_many(table, nodes).collect()} == few
