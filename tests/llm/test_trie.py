import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fieldglass.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, n long, place long, key string, total long"
EXTRA = (1, 2, 3, "k", 4)


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA, extra=EXTRA):
    table = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    return sorted((tuple(r) for r in trie.trie(*trie.rebuilt(*trie.numbered_turns(table))).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    """Few texts, so prefixes are shared deep down; nulls, equal turns, repeated rows, negative and absent bases."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 25), 1000, 1003, 2004]:
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, t, 2, None]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "é", "", None, "long text " * 3])))
    rows += rows[:3] + [(None, 1, "user", "a")]
    assert got(spark, rows) == brute(rows)


def test_same_conversations_and_a_long_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 200, 5) for t in range(4)] + [(1, t, "user", "x") for t in range(300)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert max(x[3] for x in want) == 41


def test_ends_in_pieces(spark, monkeypatch):
    rows = [(5 * c, 0, "user", "hello") for c in range(57)]
    monkeypatch.setattr(trie, "PIECE", 10)
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "a")]) == []
