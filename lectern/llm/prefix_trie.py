"""The trie of conversations' beginnings, with totals of every subtree by parallel tree contraction.

Every conversation c is rebuilt from the first h turns of conversation ``c - c % group`` and its own turns
after the first h (h from the crc32 of c in decimal).  Each distinct sequence of first turns is a
node.  The job never holds a conversation or a group of equal ones in one task:

1. Turns are sorted over all partitions by (conversation, turn); a turn's place is its distance from the
   conversation's first turn in the partition plus the turns in the partitions before.  Texts stay where they
   are: an MD5 of role and text and the number of bytes travel.
2. A sequence's key is the sum of 128-bit hashes of (place, role and text), so keys are running sums, taken
   within blocks of ``block`` turns and carried from block to block.  Different sequences with one key are
   as unlikely as two equal 128-bit hashes.
3. Nodes are counted before the shuffle.  The numbers of the conversations that end in a node are
   written by many tasks as pieces of up to 4096 and hashed as a stream of pieces.
4. Subtree totals: a round *rakes* all leaves, adding their totals to their parents, and *compresses*
   chains of nodes with one child by taking out every node that comes before its neighbours in the chain
   (by trailing zeros of the depth, then the depth, so every second one of a fresh chain), whose sum its child
   keeps on the way up.  Nodes halve at least along chains, so rounds grow with the logarithm of
   the tree's size.  The rounds are then undone in reverse, each node that was taken out getting its total
   from its child.  Joins are on unique nodes; what goes to a parent is added up before it is sent.

Order and odd rows: turns are taken by turn, null first; equal turns by the MD5 of role and text, repeated rows
all count.  Null role or text is empty.  Rows without conv_id take no part.  ``%`` has the sign of c.
A conversation without turns after rebuilding is a member of the root only.  An empty table gives no
rows.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage, join_hot, only

SUMS = ("s0", "s1", "s2", "s3")
EMPTY = hashlib.sha256(b"").hexdigest()


def borrowed(c: Column, most: int = 8) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(c.cast("string").cast("binary")) % (most + 1)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, content, n_bytes), ``at`` rising with (conv_id, turn); written, so numbers are fixed."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").filter("conv_id IS NOT NULL")
    turns = named.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("content"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("any"),
    )
    ordered = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "content", "any")
    return cut_lineage(ordered.select("conv_id", F.monotonically_increasing_id().alias("at"), "content", "n_bytes"))


def stretches(ordered: DataFrame, group: int, most: int) -> DataFrame:
    """One row for each part of a conversation that lies in one partition of the sort: (conv_id, part,
    start, before, h, taken, size), with the turns in earlier partitions and the turns it has after rebuilding."""
    part = F.shiftright("at", 33)
    pieces = ordered.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut_lineage(pieces.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total")))
    first = pieces.filter("before = 0").select(F.col("conv_id").alias("base"), F.col("total").alias("lent"))
    h, base = borrowed(F.col("conv_id"), most), F.col("conv_id") - F.col("conv_id") % group
    pieces = pieces.withColumn("h", h).withColumn("base", base).join(first, "base", "left")
    taken = F.least("h", F.coalesce("lent", F.lit(0)))
    size = taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    return cut_lineage(pieces.select("conv_id", "part", "start", "before", "h", taken.alias("taken"), size.alias("size")))


def rebuilt_turns(ordered: DataFrame, pieces: DataFrame, group: int, most: int) -> DataFrame:
    """(conv_id, depth, size, content, n_bytes) of the rebuilt conversations, depth from 1."""
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(pieces, ["conv_id", "part"])
    placed = cut_lineage(placed.select("conv_id", (F.col("at") - F.col("start") + F.col("before") + 1).alias("place"), "h", "taken", "size", "content", "n_bytes"))
    own = placed.filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "size", "content", "n_bytes")
    steps = F.sequence(F.lit(1 - group), F.lit(group - 1))
    lent = placed.filter((F.col("place") <= most) & (F.col("conv_id") % group == 0))
    lent = lent.select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "content", "n_bytes", F.explode(steps).alias("step"))
    lent = lent.withColumn("conv_id", F.try_add("base", "step")).filter(F.col("conv_id") - F.col("conv_id") % group == F.col("base"))
    takers = pieces.filter("before = 0").select("conv_id", "h", "size")
    lent = lent.join(takers, "conv_id").filter("depth <= h").select("conv_id", "depth", "size", "content", "n_bytes")
    return own.unionByName(lent)


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def paths_of(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, node, parent, depth, n_bytes, ends) for every turn of the rebuilt conversations."""
    one, two = F.xxhash64("content", "depth"), F.xxhash64(F.lit(1), "depth", "content")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    hashes = [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)]
    own = turns.select("conv_id", "depth", "size", "n_bytes", F.floor((F.col("depth") - 1) / block).alias("block"), *[h.alias(s) for h, s in zip(hashes, SUMS)])
    # only conversations longer than a block have a row here
    sums = own.filter(F.col("size") > block).groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in SUMS])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(sums.select("conv_id", "block", *[F.sum(s).over(earlier).alias(f"before_{s}") for s in SUMS]).filter("block > 0"))
    running = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.select("conv_id", "block", "depth", "size", "n_bytes", *SUMS, *[F.sum(s).over(running).alias(f"to_{s}") for s in SUMS])
    summed = summed.join(carried, ["conv_id", "block"], "left")
    here = [F.col(f"to_{s}") + F.coalesce(f"before_{s}", F.lit(0)) for s in SUMS]
    above = [x - F.col(s) for x, s in zip(here, SUMS)]
    return cut_lineage(summed.select(
        "conv_id", node_key(F.col("depth"), here).alias("node"), node_key(F.col("depth") - 1, above).alias("parent"),
        "depth", "n_bytes", (F.col("depth") == F.col("size")).alias("ends"),
    ))


def hashed_ids(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of the ids in ascending order, comma-joined."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            nodes, firsts, texts = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.binary())], ["node", "first", "ids"])

        last, held = None, []
        for batch in batches:
            found = []
            for node, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (node != last or len(held) == chunk):
                    found.append((last, held[0], ",".join(map(str, held)).encode()))
                    held = []
                last = node
                held.append(c)
            if found:
                yield rows(found)
        if held:
            yield rows([(last, held[0], ",".join(map(str, held)).encode())])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            nodes, hashes = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == last:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    nodes.append(last), hashes.append(state.hexdigest())
                last, state = node, hashlib.sha256(ids)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes)], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pack, "node binary, first long, ids binary")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): each value summed over the node's subtree, the node included.

    ``tree`` has (node, parent, depth, kids, *values): parent null for the only root, the number of
    children, and each node's own values.
    """
    ways = [f"way_{v}" for v in values]  # what a node adds to its total on the way to its parent
    live = cut_lineage(tree.select("node", "parent", "depth", "kids", *values, *[F.lit(0).cast("long").alias(w) for w in ways]))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    leaf, inner = F.col("kids") == 0, F.col("parent").isNotNull()
    while not live.filter(inner).isEmpty():
        # rake: leaves give their totals to their parents, which also learn which child is left if one is
        gifts = live.filter(inner).groupBy(F.col("parent").alias("node")).agg(
            *[F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(w))), F.lit(0)).alias(f"gift_{v}") for v, w in zip(values, ways)],
            F.count(F.when(~leaf, 1)).alias("stay"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
        )
        rest = live.filter(~(leaf & inner)).join(gifts, "node", "left")
        rest = cut_lineage(rest.select("node", "parent", "depth", F.coalesce("stay", F.lit(0)).alias("kids"), "child", *[(F.col(v) + F.coalesce(f"gift_{v}", F.lit(0))).alias(v) for v in values], *ways))

        # compress: of each chain of nodes with one child, those that come before both neighbours are taken out
        single = (F.col("kids") == 1) & inner
        zeros = F.when(F.col("depth") == 0, 63).otherwise(F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1))
        ranked = rest.withColumn("rank", F.when(single, F.struct(zeros.alias("zeros"), "depth")))
        above = ranked.filter(single).select(F.col("child").alias("node"), F.col("rank").alias("above"))
        first = ranked.filter(single).join(above, "node", "left").filter("above IS NULL OR rank < above")
        first = first.select(F.col("child").alias("node"), F.col("node").alias("out"), F.col("parent").alias("next"), F.col("rank").alias("out_rank"), *[F.col(c).alias(f"out_{c}") for c in values + ways])
        taken = ranked.join(first, "node", "left")
        won = F.col("out").isNotNull() & (F.col("rank").isNull() | (F.col("out_rank") < F.col("rank")))
        joined = cut_lineage(taken.select(
            "node", F.when(won, F.col("next")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *values,
            *[F.when(won, F.col(w) + F.col(f"out_{v}") + F.col(f"out_{w}")).otherwise(F.col(w)).alias(w) for v, w in zip(values, ways)],
            F.when(won, F.col("out")).alias("out"), *[(F.col(w) + F.col(f"out_{v}")).alias(f"over_{v}") for v, w in zip(values, ways)],
        ))
        gone = joined.filter("out IS NOT NULL")
        rounds.append((live.filter(leaf & inner).select("node", *values), gone.select("node", "out", *[f"over_{v}" for v in values])))
        live = cut_lineage(joined.join(gone.select(F.col("out").alias("node")), "node", "left_anti").select(*live.columns))

    known = live.select("node", *values)
    for raked, gone in reversed(rounds):
        if not gone.isEmpty():
            back = gone.join(known, "node").select(F.col("out").alias("node"), *[(F.col(v) + F.col(f"over_{v}")).alias(v) for v in values])
            known = known.unionByName(cut_lineage(back))
        known = known.unionByName(raked)
    return known


def trie_rows(conversations: DataFrame, group: int = 5, most: int = 8, block: int = 4096) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    ordered = ordered_turns(conversations)
    pieces = stretches(ordered, group, most)
    paths = paths_of(rebuilt_turns(ordered, pieces, group, most), block)
    members = pieces.filter("before = 0").select("conv_id", "size")
    top = node_key(F.lit(0), [F.lit(0)] * len(SUMS))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"))
    root = root.select(top.alias("node"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = cut_lineage(nodes.unionByName(root))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))

    own = nodes.select("node", "parent", "depth", "kids", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    ends = paths.filter("ends").select("node", "conv_id").unionByName(members.filter("size = 0").select(top.alias("node"), "conv_id"))
    full = cut_lineage(nodes.join(totals, "node").join(hashed_ids(ends), "node", "left"))
    facts = nodes.filter("kids > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("kids").alias("n"))
    return join_hot(full, facts, "parent", full.count()).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie_sql(group: int = 5, most: int = 8) -> str:
    """The same with whole sequences as keys and every pair of a node and a node below it."""
    byte = "list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda a, b: {byte}))"
    return f"""
        WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS p FROM given),
        convs AS (SELECT c, {crc} % {most + 1} AS h FROM (SELECT DISTINCT conv_id AS c FROM given)),
        rebuilt AS (SELECT c, 0 AS own, p, role, text FROM convs JOIN t ON conv_id = c - c % {group} WHERE p <= h
          UNION ALL SELECT c, 1, p, role, text FROM convs JOIN t ON conv_id = c WHERE p > h),
        numbered AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, role, text FROM rebuilt),
        keyed AS (SELECT c, d, strlen(text) AS b, md5(CAST(to_json(list([role, text]) OVER (PARTITION BY c ORDER BY d)) AS VARCHAR)) AS k FROM numbered
          UNION ALL SELECT c, 0, 0, '' FROM convs),
        paths AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM keyed),
        nodes AS (SELECT k, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(b) AS b,
                    sha256(coalesce(string_agg(CASE WHEN ends THEN c END, ',' ORDER BY c), '')) AS ends_sha256 FROM paths GROUP BY k),
        kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
        below AS (SELECT DISTINCT a.k AS top, z.k FROM paths a JOIN paths z ON a.c = z.c AND a.d <= z.d),
        totals AS (SELECT top, count(*) FILTER (WHERE n IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
          FROM below JOIN nodes USING (k) LEFT JOIN kids ON kids.up = nodes.k GROUP BY top)
        SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
        FROM nodes v JOIN totals ON top = v.k LEFT JOIN nodes u ON u.k = v.up LEFT JOIN kids ON kids.up = v.k"""
