"""Conversation prefix trie: ternary search trees over range shards of the conversations, merged at their borders.

A turn is known by the 128-bit digest of its role and text, taken at the scan; only digests and lengths move. A
conversation is the row of its turns' digests in order. Conversations are dealt into ranges by that row, then by id, so
a prefix lies in neighbouring shards, and a sequence shared by any number of conversations is cut by id. A task takes
its range in shards of at most `SHARD_TURNS` turns: it numbers the shard's digests in order (its dictionary), inserts
the distinct sequences median first into a ternary search tree, so that the trees of siblings are balanced, and adds up
members, leaves and savings over the tree without recursion.

Only nodes on the paths of a shard's first and last sequence can go on in another shard. These boundary nodes leave the
task as parts; 2**`FAN_BITS` neighbouring parts at a time merge theirs, whereby all nodes but those on the two outer paths are
complete, until one group is left. So a task holds one shard, or the outer paths of those that it merges.

The digest of the ids that end at a boundary node is taken from a sorted stream of pieces: one SHA-256 over all ids of a
node is sequential by its nature, but nothing of it is held in memory.

Defined cases: rows without conversation id belong to no conversation and are left out; null role or text is empty;
null turns come first; equal turn numbers are ordered by the digest of role and text, and repeated rows stay repeated
turns; an empty table gives an empty result (no root). Columns besides conv_id, turn, role and text are not read. The
digests of one conversation (40 bytes a turn) meet in one row. Two different turns are one with a probability of 2**-128
a pair.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions, settle, table

#: A shard is closed at so many turns.
SHARD_TURNS = 400_000
#: 2**FAN_BITS neighbouring parts merge their boundary nodes at a time.
FAN_BITS = 8
#: Ids in one piece of a boundary node's list of ends.
PIECE = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: kind "node": complete; "edge": part of a boundary node; "ends": ids that end at a boundary node.
SHAPE = ("kind string, part int, chunk int, pos int, up int, mark int, depth long, turn binary, length long, path binary, above binary, "
         "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string")
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in SHAPE.split(", "))])
FIRST, LAST = 1, 2


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each as number, digest of role and text, and text length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("length"))
    return slim.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "length"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, lengths): the first h turns of conversation c - c % 100, then c's own after its first h, where h
    is crc32 of c in decimals modulo 6. At most 100 conversations share a head of at most five turns."""
    own = conversations.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
                               (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"))
    heads = conversations.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    whole = own.join(heads, "base", "left").select("conv_id", F.expr(
        "concat(IF(h = 0 OR head IS NULL, array(), slice(head, 1, greatest(h, 1))), slice(turns, h + 1, size(turns)))").alias("turns"))
    return whole.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.length").alias("lengths"))


class TernaryTree:
    """Sequences of numbers; place 0 is the root, a place's `equal` opens the tree of its children."""

    def __init__(self):
        self.turn, self.low, self.equal, self.high = [-1], [0], [0], [0]

    def insert(self, sequence) -> int:
        """The place of the sequence's last number; 0 is no child of any place, so it also says "none"."""
        turn, low, equal, high = self.turn, self.low, self.equal, self.high
        at, links = 0, equal
        for t in sequence:
            here = links[at]
            while here and turn[here] != t:
                at, links = here, low if t < turn[here] else high
                here = links[at]
            if not here:
                here = links[at] = len(turn)
                turn.append(t)
                low.append(0)
                equal.append(0)
                high.append(0)
            at, links = here, equal
        return at

    def insert_median_first(self, sequences: list) -> list[int]:
        """Places of the sequences, which are distinct and in order."""
        ends, ranges = [0] * len(sequences), [(0, len(sequences))]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                m = (a + b) // 2
                ends[m] = self.insert(sequences[m])
                ranges += ((a, m), (m + 1, b))
        return ends

    def walk(self) -> tuple[list[int], list[int]]:
        """Places with every place after its parent; and each place's parent."""
        order, parent, open_ = [], [-1] * len(self.turn), [0]
        while open_:
            at = open_.pop()
            order.append(at)
            siblings = [self.equal[at]]
            while siblings:
                child = siblings.pop()
                if child:
                    parent[child] = at
                    open_.append(child)
                    siblings += (self.low[child], self.high[child])
        return order, parent

    def path(self, sequence) -> list[int]:
        places, links, at = [0], self.equal, 0
        for t in sequence:
            here = links[at]
            while self.turn[here] != t:
                here = self.low[here] if t < self.turn[here] else self.high[here]
            places.append(here)
            at, links = here, self.equal
        return places


def _shard(ids: list[int], sequences: list[list[bytes]], lengths: dict[bytes, int], part: int, chunk: int):
    """Rows of a shard: ids and their sequences, in order of sequence and id."""
    digests = sorted(lengths)
    number = {d: i for i, d in enumerate(digests)}
    distinct, groups = [], []
    for conv, sequence in zip(ids, sequences, strict=True):
        if not groups or sequence != distinct[-1]:
            distinct.append(sequence)
            groups.append([])
        groups[-1].append(conv)
    coded = [[number[d] for d in s] for s in distinct]
    tree = TernaryTree()
    places = tree.insert_median_first(coded)
    order, parent = tree.walk()
    size = len(order)
    depth, n, least = [0] * size, [0] * size, [None] * size
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    ends = dict(zip(places, groups, strict=True))
    for at, group in ends.items():
        n[at], least[at] = len(group), group[0]
    mark = [0] * size
    for at in tree.path(coded[0]):
        mark[at] |= FIRST
    for at in tree.path(coded[-1]):
        mark[at] |= LAST
    for at in order[1:]:
        depth[at] = depth[parent[at]] + 1
    length = [0] + [lengths[digests[t]] for t in tree.turn[1:]]
    for at in reversed(order[1:]):
        up = parent[at]
        n[up] += n[at]
        least[up] = least[at] if least[up] is None else min(least[up], least[at])
        if not mark[at]:
            saved[at] += (n[at] - 1) * length[at]
            leaves[at] = leaves[at] or 1
            kids[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    path, pos = {}, {}
    for at in order:
        row = {"part": part, "chunk": chunk, "depth": depth[at], "conv_id": least[at], "n_convs": n[at], "n_children": kids[at],
               "n_leaves": leaves[at], "saved_tokens": saved[at]}
        up = parent[at]
        if mark[at]:
            digest = digests[tree.turn[at]] if at else b""
            path[at] = hashlib.md5(path[up] + digest).digest() if at else b""
            pos[at] = len(pos)
            yield row | {"kind": "edge", "pos": pos[at], "up": pos.get(up), "mark": mark[at], "turn": digest, "length": length[at],
                         "path": path[at], "above": path.get(up)}
            group = ends.get(at, ())
            for first in range(0, len(group), PIECE):
                yield {"kind": "ends", "part": part, "chunk": chunk, "pos": first // PIECE, "path": path[at],
                       "ids": ",".join(map(str, group[first:first + PIECE]))}
        else:
            told = hashlib.sha256(",".join(map(str, ends[at])).encode()).hexdigest() if at in ends else NO_ENDS
            yield row | {"kind": "node", "ends_sha256": told} | ({"above": path[up]} if mark[up] else {"parent_conv_id": least[up]})


def _batches(rows, most: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


def shards(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Rows of SHAPE from (conv_id, digests, lengths), in ranges."""
    def build(batches):
        settle("prefix_trie")
        part, chunk, turns = TaskContext.get().partitionId(), 0, 0
        ids, held, lengths = [], [], {}
        for batch in batches:
            for conv, digests, sizes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if turns >= shard_turns:
                    yield from _batches(_shard(ids, held, lengths, part, chunk))
                    chunk, turns, ids, held, lengths = chunk + 1, 0, [], [], {}
                ids.append(conv)
                held.append(digests)
                lengths.update(zip(digests, sizes, strict=True))
                turns += len(digests) + 1
        if ids:
            yield from _batches(_shard(ids, held, lengths, part, chunk))

    ranged = sequences.repartitionByRange(partitions(sequences.sparkSession), "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    return ranged.select("conv_id", "digests", "lengths").mapInArrow(build, SHAPE)


def merged(edges: DataFrame, bits: int, last: bool) -> DataFrame:
    """The boundary nodes of 2**bits neighbouring parts at a time as one: "node" rows for those that are complete, "edge"
    rows for those on the group's outer paths (none if `last`)."""
    def add(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["chunk"], r["pos"]))
        outer = {(rows[0]["part"], rows[0]["chunk"]): FIRST}
        outer[rows[-1]["part"], rows[-1]["chunk"]] = outer.get((rows[-1]["part"], rows[-1]["chunk"]), 0) | LAST
        nodes, child, place = [], {}, {}
        for r in rows:
            shard = r["part"], r["chunk"]
            up = place[(*shard, r["up"])] if r["up"] is not None else None
            at = child.setdefault((up, r["turn"]), len(nodes))
            place[(*shard, r["pos"])] = at
            kept = 0 if last else r["mark"] & outer.get(shard, 0)
            if at == len(nodes):
                nodes.append(r | {"up": up, "mark": kept})
                continue
            node = nodes[at]
            node["mark"] |= kept
            node["conv_id"] = min(node["conv_id"], r["conv_id"])
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[c] += r[c]
        pos = {at: i for i, at in enumerate(a for a, x in enumerate(nodes) if x["mark"])}
        for at in range(len(nodes) - 1, -1, -1):
            node = nodes[at]
            up = node["up"]
            if node["mark"]:
                node |= {"pos": pos[at], "up": pos.get(up)}
                continue
            node |= {"kind": "node", "n_leaves": node["n_leaves"] or 1, "saved_tokens": node["saved_tokens"] + (node["n_convs"] - 1) * node["length"]}
            if up is not None:
                nodes[up]["n_children"] += 1
                nodes[up]["n_leaves"] += node["n_leaves"]
                nodes[up]["saved_tokens"] += node["saved_tokens"]
        group = rows[0]["part"] >> bits
        return pa.Table.from_pylist([x | {"part": group, "chunk": 0} for x in nodes], schema=ARROW)

    return edges.groupBy(F.shiftright("part", bits).alias("group")).applyInArrow(add, SHAPE)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256) from pieces of ids: pieces of one node follow each other in order of their shards."""
    def digest(batches):
        path, running = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != path or running is None:
                    if running is not None:
                        done.append((path, running.hexdigest()))
                    path, running = at, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())],
                                             ["path", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["path", "ends_sha256"])

    ordered = ends.repartition(partitions(ends.sparkSession), "path").sortWithinPartitions("path", "part", "chunk", "pos")
    return ordered.select("path", "ids").mapInArrow(digest, "path binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, *, shard_turns: int = SHARD_TURNS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per node of the trie of (conv_id, digests, lengths): conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    raw = keep(shards(keep(sequences), shard_turns))
    edges = open_ = raw.where("kind = 'edge'")
    widest = edges.agg(F.max("part").alias("part"), F.max("chunk").alias("chunk")).first()
    levels, complete = [0] if widest["chunk"] else [], []
    reach = widest["part"] or 0
    while reach or not levels:
        levels.append(fan_bits)
        reach >>= fan_bits
    for i, bits in enumerate(levels):
        step = keep(merged(open_, bits, i == len(levels) - 1))
        complete.append(step.where("kind = 'node'"))
        open_ = step.where("kind = 'edge'")
    border = complete[0]
    for more in complete[1:]:
        border = border.unionByName(more)
    numbers = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    known = border.select("path", F.col("conv_id").alias("known"))
    told = (border.drop("ends_sha256").join(digests_of_ends(raw.where("kind = 'ends'")), "path", "left")
            .join(known.withColumnRenamed("path", "above"), "above", "left")
            .select("conv_id", "depth", F.col("known").alias("parent_conv_id"), *numbers, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    nodes = raw.where("kind = 'node'")
    # a shard's nodes below its boundary learn their parent's smallest member; a shard is a bounded key
    parents = edges.select("part", "chunk", "path").join(known, "path").select("part", "chunk", F.col("path").alias("above"), "known")
    below = nodes.where("above IS NOT NULL").drop("parent_conv_id").join(parents, ["part", "chunk", "above"]).withColumnRenamed("known", "parent_conv_id")
    columns = told.columns
    return told.unionByName(nodes.where("above IS NULL").select(columns)).unionByName(below.select(columns))


def op13_prefix_trie(spark, folder):
    return prefix_trie(rebuilt(digested(table(spark, folder, "conversations"))))


#: crc32 of a decimal number by its table of 256 values, which a rule makes; then nodes as (smallest member, depth).
OP13_SQL = """
WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, rest, v) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM own
    UNION ALL SELECT conv_id, rest[2:], xor(v >> 8, t[1 + (xor(v, ascii(rest)) & 255)]) FROM crc, tab WHERE rest <> ''),
c AS MATERIALIZED (SELECT conv_id, xor(v, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE rest = ''),
r AS (SELECT c.conv_id, role, text, place FROM c JOIN own ON own.conv_id = base AND place <= h UNION ALL SELECT c.conv_id, role, text, place FROM c JOIN own USING (conv_id) WHERE place > h),
p AS (SELECT conv_id, text, row_number() OVER w AS depth,
             sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
m AS MATERIALIZED (SELECT conv_id, depth, path, length(text) AS len FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
deep AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS MATERIALIZED (SELECT min(m.conv_id) AS node, m.depth, path, any_value(len) AS len, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE deep.depth = m.depth), '')) AS ends_sha256
    FROM m JOIN deep USING (conv_id) GROUP BY m.depth, path),
parent AS (SELECT n.node, n.depth, q.node AS up FROM n JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1 JOIN n q ON q.depth = m.depth AND q.path = m.path),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS k FROM parent GROUP BY ALL),
own_sums AS (SELECT n.node, n.depth, coalesce(k, 0) AS n_children, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * len AS saved FROM n LEFT JOIN kids USING (node, depth)),
sums AS (SELECT a.node, a.depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM own_sums u JOIN m ON m.conv_id = u.node AND m.depth <= u.depth
    JOIN n a ON a.depth = m.depth AND a.path = m.path GROUP BY ALL)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, up AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN own_sums USING (node, depth) JOIN sums USING (node, depth) LEFT JOIN parent USING (node, depth)
"""
