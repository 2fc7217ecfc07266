"""The trie of conversations against a plain build, and contraction against recursion."""

import hashlib
import random
import zlib

import pytest

from lectern.llm import prefix_trie


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())
            turns.setdefault(c, []).append((order, role, text))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        saved[s] = (len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids.get(s, []))
    ends = lambda s: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[s] if built[c] == s))).encode()).hexdigest()
    return sorted((min(m), len(s), str(min(nodes[s[:-1]]) if s else None), len(m), len(kids.get(s, [])), leaves[s], saved[s], ends(s)) for s, m in nodes.items())


def talks():
    random.seed(8)
    rows = []
    for c in range(60):
        for turn in range(random.randint(0, 12)):
            rows.append((c, turn, random.choice(["user", "bot"]), random.choice(["é", "yes", "no"]) if turn < 3 else f"{c % 7} {turn}"))
    rows += [(100, turn, "user", f"long {turn % 3}") for turn in range(150)] + [(101, turn, "user", f"long {turn % 3}") for turn in range(140)]
    rows += [(200 + k, turn, "user", "the same talk") for k in range(40) for turn in range(3)]  # many equal conversations
    rows += [(300, None, None, None), (300, None, "a", "bc"), (300, None, "ab", "c"), (300, 1, "", ""), (300, 1, "", ""), (None, 1, "user", "nobody"), (-7, 0, "user", "x"), (-5, 0, "user", "y" * 70000), (-5, 1, "user", "z")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_trie_equals_the_plain_build(spark, block):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(5)
    got = prefix_trie.trie_rows(df, block=block).collect()
    assert sorted((r.conv_id, r.depth, str(r.parent_conv_id), *tuple(r)[3:]) for r in got) == plain(rows)


def test_nothing_and_almost_nothing(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert prefix_trie.trie_rows(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.trie_rows(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
    # a conversation whose turns all belong to those taken from a missing first of the group
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    got = prefix_trie.trie_rows(spark.createDataFrame([(c, 0, "a", "b")], schema)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "comb"])
def test_contraction_equals_recursion(spark, shape):
    random.seed(1)
    up = {0: None}
    for k in range(1, 120):
        up[k] = {"random": random.randrange(k), "chain": k - 1, "star": 0, "comb": k - 1 if k % 2 else max(0, k - 2)}[shape]
    depth = {}
    for k in up:
        depth[k] = 0 if k == 0 else depth[up[k]] + 1
    value = {k: random.randint(-5, 9) for k in up}
    want = dict(value)
    for k in sorted(up, reverse=True):
        if k:
            want[up[k]] += want[k]
    tree = spark.createDataFrame([(k, p, depth[k], sum(q == k for q in up.values()), value[k]) for k, p in up.items()], "node long, parent long, depth long, kids long, v long")
    got = prefix_trie.subtree_totals(tree, ["v"]).collect()
    assert len(got) == len(up) and {r.node: r.v for r in got} == want


def test_ids_are_hashed_in_order_whatever_the_pieces(spark):
    ids = {b"a": list(range(-3, 40)), b"b": [7], b"c": list(range(95, 130, 3))}
    df = spark.createDataFrame([(bytearray(n), c) for n, cs in ids.items() for c in random.sample(cs, len(cs))], "node binary, conv_id long")
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.hashed_ids(df.repartition(4), chunk=5).collect()}
    assert got == {n: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest() for n, cs in ids.items()}
