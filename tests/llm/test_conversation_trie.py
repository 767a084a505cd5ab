"""The conversation trie against plain recursion, also with components cut by joins."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from underwrite.llm import conversation_trie as ct
from underwrite.llm.queries import QUERIES

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    from hashlib import md5

    digest = lambda r: md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    turns = {c: [r[2:] for r in sorted(t, key=lambda r: (r[:2], digest(r)))] for c, t in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = int(c / 100) * 100
        out[c] = turns.get(block, [])[:h] + t[h:]
    return out


def plain(rows):
    convs = rebuilt(rows)
    members, ends, children = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                children.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves = sum(totals[x][0] for x in below) or int(not below)
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(totals[x][1] for x in below)
        totals[node] = leaves, saved
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), *totals[node],
            sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def built(spark, rows, local=ct.LOCAL):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = ct.trie(*ct.rebuild(ct.placed_turns(df)), local)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


def test_query_equals_recursion(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversation_trie"](spark, sf).collect()) == plain(rows)


@pytest.mark.parametrize("local", [1, 9, 4096])
def test_odd_conversations_at_every_cut(spark, local):
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", None, "a"]), draw.choice(["x", "yy", None, "", "é" * 5])) for c in [0, 1, 2, 3, 100, 101, 102, 205, 206, -3, -101] for t in range(draw.randint(1, 7))]
    rows += [(7, t, "user", f"turn {t}") for t in range(60)]  # a long chain
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]  # copies
    rows += [(None, 1, "user", "nowhere"), (8, None, "user", "first"), (8, None, "user", "first"), (8, 1, "b", "x"), (8, 1, "b", "x"), (9, 0, "user", "long " * 20000)]
    assert built(spark, rows, local) == plain(rows)


def test_empty_table_and_one_turn(spark):
    assert built(spark, [(None, 1, "user", "x")]) == []
    assert built(spark, [(5, 0, None, None)]) == plain([(5, 0, None, None)])


def test_roll_up_on_random_forests():
    draw = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        parent = np.array([-1] + [int(draw.integers(-1 if i % 11 == 0 else 0, i)) for i in range(1, n)])
        depth = np.zeros(n, dtype=np.int64)
        component = np.zeros(n, dtype=np.int64)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
            component[i] = component[:i].max(initial=-1) + 1 if parent[i] < 0 else component[parent[i]]
        values = draw.integers(0, 9, (2, n))
        want, weight = values.copy(), draw.integers(1, 4, n)
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                want[:, parent[i]] += want[:, i]
                weight[parent[i]] += weight[i]
        assert (ct.roll_up(component, parent, depth, weight, values) == want).all()


def test_components_that_span_batches(spark, monkeypatch):
    monkeypatch.setattr(ct, "BATCH", 3)
    rows = [(c, t, "u", str(c % 3 * 10 + t)) for c in range(1, 40) for t in range(3)]
    assert built(spark, rows) == plain(rows)
