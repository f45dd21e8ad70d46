"""The trie of conversations' prefixes by truncation peeling.

A rebuilt conversation is a path: one entry of 24 bytes for each turn (16 bytes of the hash of role and text, 8 of the
text's length in bytes), so the first d turns are the first 24 * d bytes, and paths in order of their bytes have the members of
each node side by side.

Paths are dealt by ranges of (path, conv_id), so neither a common first turn nor thousands of copies meet in one task. A task peels
its range from the deepest level up: conversations that end at a level are merged with the nodes that survive from below, each node is
added up and given out, its last turn is stripped, and the stripped paths are regrouped. A node that the range before or after may share
lies on the first or the last path of the range; it is given out as an open part. Open parts (at most two paths a task) are dealt and peeled again in
fewer tasks until one task is left, which closes all. The conversations that end at an open node are hashed as a stream of parts in order.

Rows without conv_id belong to no conversation and are left out; c - c % 5 has the sign of SQL's remainder. Turns of one number are ordered by
role, then by the hash of role and text. Rows that repeat are turns of their own. A conversation whose turns all go (its own are
fewer than h, and c - c % 5 is absent) ends at the root. No rows give no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm._shared import materialise, table

ENTRY = 24
NONE = hashlib.sha256(b"").hexdigest()
NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
#: What a task gives: nodes, with the hash of their path if they were open before, and of their parent's where that is open still;
#: open parts (path and the node's sums, so far); and the conversations that end at open nodes, as comma-joined ids in parts.
GIVEN = {"kind": pa.int32(), "key": pa.binary(), "parent_key": pa.binary(), "path": pa.binary(), "ended": pa.bool_(), "ids": pa.string(), **NODE}
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
GIVEN_DDL = ", ".join(f"{name} {_DDL[kind]}" for name, kind in GIVEN.items())
NODES, OPEN, ENDS = 0, 1, 2


def _entry(role: Column, text: Column) -> Column:
    of = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(of, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def rebuilt_paths(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, path of each conversation c: the first h turns of conversation c - c % ``family`` and its own turns after the first h,
    h = crc32(c) % ``heads``. One shuffle brings a family together; a conversation's turns are in one row, as its path is."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select((c - c % family).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), _entry(role, text).alias("entry"))
    together = turns.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "role", "entry"))).alias("turns"))
    lead = F.slice(F.filter("turns", lambda t: t["conv_id"] == F.col("base")), 1, heads - 1)
    each = together.select(lead.alias("lead"), "turns", F.explode(F.array_distinct("turns.conv_id")).alias("conv_id")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    own = each.withColumn("own", F.filter("turns", lambda t: t["conv_id"] == F.col("conv_id")))
    path = F.concat(F.slice("lead", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return own.select("conv_id", F.unhex(F.array_join(F.transform(path, lambda t: F.hex(t["entry"])), "")).alias("path"))


class Node:
    """Sums of what a task has seen of a node: its smallest member, members, children, and the sums over its children's subtrees."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "ended", "below")

    def __init__(self):
        self.conv, self.n, self.children, self.leaves, self.saved, self.ended, self.below = None, 0, 0, 0, 0, False, []

    def add(self, conv, n, children=0, leaves=0, saved=0, ended=False):
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children, self.leaves, self.saved, self.ended = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved, self.ended or ended


def _key(path: bytes) -> bytes:
    return xxhash.xxh3_128_digest(path)


def peel(levels: dict[int, dict[bytes, Node]], is_open, ends, keyed: bool):
    """Peels ``levels`` (depth: path: node, of what ends there) from the deepest on and yields rows of ``GIVEN``.

    ``is_open`` says whether others may have parts of a path's node; ``ends`` yields the parts of the ids that end at a path, or is None where
    they were given before; ``keyed`` nodes carry the hash of their path.
    """

    def given(kind, node, **more):
        row = dict.fromkeys(GIVEN) | {"kind": kind, "conv_id": node.conv, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        return row | more

    depth = max(levels, default=-1)
    while depth >= 0:
        for path, node in levels.pop(depth, {}).items():
            opened = is_open(path)
            if opened:  # so is its parent, which learns of it when it is closed
                yield given(OPEN, node, path=path, ended=node.ended)
                if node.ended and ends:
                    for first, ids in ends(path):
                        yield dict.fromkeys(GIVEN) | {"kind": ENDS, "key": _key(path), "conv_id": first, "ids": ids}
            else:
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.n - 1) * int.from_bytes(path[-8:])
                sha = NONE if not node.ended else None
                if node.ended and ends:
                    of = hashlib.sha256()
                    for k, (_, ids) in enumerate(ends(path)):
                        of.update(("," * (k > 0) + ids).encode())
                    sha = of.hexdigest()
                row = given(NODES, node, ends_sha256=sha, key=_key(path) if keyed else None)
                if depth:
                    up = levels.setdefault(depth - 1, {}).setdefault(path[:-ENTRY], Node())
                    up.add(node.conv, node.n, 1, node.leaves, node.saved)
                    up.below.append(row)
                else:
                    yield row
            for row in node.below:
                yield row | ({"parent_key": _key(path)} if opened else {"parent_conv_id": node.conv})
            node.below = []
        depth -= 1


def _batches(rows, size: int = 8192):
    held = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kind) for c, kind in GIVEN.items()], list(GIVEN))

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    yield batch()


def _shared_with(paths: list[bytes]):
    """Whether a path lies on the first or last of ``paths``, which are in order."""
    edges = (paths[0], paths[-1]) if paths else ()
    return lambda path: any(e.startswith(path) for e in edges)


def _peel_conversations(part: int = 65_536):
    """(path, conv_id) in order to rows of ``GIVEN``."""

    def run(batches):
        found: list[tuple[bytes, list]] = []  # each path with its ids: a range of bounded size
        for batch in batches:
            for conv, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if not found or found[-1][0] != path:
                    found.append((path, []))
                found[-1][1].append(conv)
        levels: dict[int, dict[bytes, Node]] = {}
        for path, ids in found:
            node = levels.setdefault(len(path) // ENTRY, {}).setdefault(path, Node())
            node.add(ids[0], len(ids), ended=True)
        of = dict(found)
        yield from _batches(peel(levels, _shared_with([p for p, _ in found]), lambda p: ((of[p][k], ",".join(map(str, of[p][k : k + part]))) for k in range(0, len(of[p]), part)), False))

    return run


def _peel_open(last: bool):
    """Open parts in the order of their paths to rows of ``GIVEN``; the last task closes all nodes."""

    def run(batches):
        levels: dict[int, dict[bytes, Node]] = {}
        edges: list[bytes] = []
        for batch in batches:
            for r in batch.to_pylist():
                edges = [edges[0] if edges else r["path"], r["path"]]
                node = levels.setdefault(len(r["path"]) // ENTRY, {}).setdefault(r["path"], Node())
                if r["conv_id"] is not None:
                    node.add(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ended"])
        yield from _batches(peel(levels, (lambda path: False) if last else _shared_with(edges), None, True))

    return run


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """key, sha: the hash of all ids that end at an open node, from its parts in order."""

    def run(batches):
        key = of = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key] if of else [], pa.binary()), pa.array([of.hexdigest()] if of else [], pa.string())], ["key", "sha"])

        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    yield done()
                    key, of = k, hashlib.sha256(ids.encode())
                else:
                    of.update(b"," + ids.encode())
        yield done()

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(run, "key binary, sha string")


def prefix_trie(paths: DataFrame, tasks: int, fan_in: int = 64, most: int = 1_000_000) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path): the columns of ``NODE``.

    ``tasks`` tasks peel the paths; ``fan_in`` of them meet in a task of the next round. Up to ``most`` nodes that were open (two paths a task)
    are broadcast to their children, more are joined by shuffles with the children dealt into lanes.
    """
    dealt = paths.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    first = materialise(dealt.mapInArrow(_peel_conversations(), GIVEN_DDL), "trie-nodes")
    given, rounds = [first], first
    while True:
        tasks = -(-tasks // fan_in)
        parts = rounds.where(F.col("kind") == OPEN).repartitionByRange(tasks, "path").sortWithinPartitions("path")
        rounds = materialise(parts.mapInArrow(_peel_open(tasks == 1), GIVEN_DDL), "trie-open")
        given.append(rounds)
        if tasks == 1:
            break
    shas = _hashed_ends(first.where(F.col("kind") == ENDS))
    late = given[1]
    for more in given[2:]:
        late = late.unionByName(more)
    late = late.where(F.col("kind") == NODES).join(shas, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha")).drop("sha")
    late = materialise(late, "trie-closed")
    every = first.where(F.col("kind") == NODES).unionByName(late.select(*first.columns))
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    if late.count() <= most:
        joined = every.join(F.broadcast(parents), "parent_key", "left")
    else:
        lanes = 64
        lane = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(lanes)).cast("int")
        joined = every.withColumn("lane", lane).join(parents.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), ["parent_key", "lane"], "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent")).select(*NODE)


def op13_prefix_trie(spark: SparkSession, sf_dir: str, turns_a_task: int = 200_000) -> DataFrame:
    """All nodes of the trie of rebuilt conversations; about ``turns_a_task`` turns are peeled by a task."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // turns_a_task))
    return prefix_trie(rebuilt_paths(conversations), tasks)


OP13_SQL = r"""
with recursive said as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
),
heads as (
  select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null)
),
rebuilt as (
  select h.conv_id, s.i as d, s.role, s.text from heads h join said s on s.conv_id = h.conv_id - h.conv_id % 5 and s.i <= h.h
  union all
  select h.conv_id, s.i - h.h + least(h.h, (select count(*) from said b where b.conv_id = h.conv_id - h.conv_id % 5)), s.role, s.text
  from heads h join said s on s.conv_id = h.conv_id and s.i > h.h
),
prefixes as (
  select conv_id, 0 as d, '' as path, 0 as bytes, '' as parent from heads
  union all
  select r.conv_id, r.d, sha256(p.path || strlen(r.role)::varchar || ':' || r.role || r.text), strlen(r.text), p.path
  from prefixes p join rebuilt r on r.conv_id = p.conv_id and r.d = p.d + 1
),
ended as (
  select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha
  from (select conv_id, arg_max(path, d) as path from prefixes group by conv_id) group by path
),
nodes as (select path, any_value(parent) as parent, any_value(d) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs from prefixes group by path),
kids as (select parent, count(*) as n from nodes where depth > 0 group by parent),
sums as (
  select a.path, sum(case when k.n is null then 1 else 0 end) as leaves, sum((n.n_convs - 1) * n.bytes) as saved
  from (select distinct a.path, b.path as below from prefixes a join prefixes b on a.conv_id = b.conv_id and b.d >= a.d) a
  join nodes n on n.path = a.below left join kids k on k.parent = n.path group by a.path
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens,
  coalesce(e.sha, sha256('')) as ends_sha256
from nodes n left join nodes p on n.depth > 0 and p.path = n.parent left join kids k on k.parent = n.path join sums s on s.path = n.path left join ended e on e.path = n.path
"""
