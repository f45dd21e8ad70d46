"""The trie of conversations' prefixes against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from oddsmill.llm.prefix_trie import NODE, op13_prefix_trie, prefix_trie, rebuilt_paths

SCHEMA = "conv_id long, turn long, role string, text string, path binary, h int, n_convs string"


def conversations(spark, rows):
    """Conversations with further columns whose names clash with those that the operator uses."""
    return spark.createDataFrame([(*r, b"x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + turns[h:]
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str
    )


def made(r, n=60):
    rows = [(None, 0, "user", "nobody's"), (7000, None, "user", None), (7000, 3, None, "b"), (7001, 0, "user", ""), (7001, 0, "user", ""), (-3, 0, "user", "minus"), (-7, 1, "user", "minus")]
    for c in range(n):  # few texts, so that many prefixes are shared; ties of turns
        rows += [(c, r.choice([t, t, 0, None]), r.choice(["user", "assistant"]), r.choice(["a", "é", "", None])) for t in range(r.randrange(1, 12))]
    for c in range(1000, 1200):  # a large group of copies
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(2001, t, "user", f"long {t % 7}") for t in range(300)] + [(2006, t, "user", f"long {t % 7}") for t in range(299)]  # long ones
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tasks", [1, 9, 40])
def test_trie_equals_brute_force_however_it_is_dealt(spark, tasks):
    rows = made(random.Random(tasks))
    out = prefix_trie(rebuilt_paths(conversations(spark, rows)), tasks, fan_in=3, most=0 if tasks == 9 else 1000)
    assert out.columns == list(NODE)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_ids_that_end_at_a_node_are_hashed_in_parts(spark):
    rows = [(c, 0, "user", "x") for c in range(5, 3000, 5)]
    out = prefix_trie(rebuilt_paths(conversations(spark, rows)), 5, fan_in=2)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_query_reads_the_table_and_an_empty_one_has_no_nodes(spark, tmp_path):
    rows = made(random.Random(8), 10)
    conversations(spark, rows).write.parquet(f"{tmp_path}/a/conversations.parquet")
    conversations(spark, rows).limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert sorted(map(tuple, op13_prefix_trie(spark, f"{tmp_path}/a", 50).collect()), key=str) == brute(rows)
    assert op13_prefix_trie(spark, f"{tmp_path}/b").collect() == []
