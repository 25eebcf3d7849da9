"""The trie of rebuilt conversations against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from citeharbor.llm import prefixtrie
from citeharbor.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, name string, base int, forest string"


def plain_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", plain_digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * words
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, who in members.items())


def found(nodes):
    return sorted(tuple(-1 if x is None else x for x in r) for r in nodes.collect())


def build(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], TURNS)


def trie(frame):
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(frame)))


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), 90):
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "user", None, ""]),
                  rng.choice(["hi", "a b", "", None, " x\ty\n", "é ü"])) for k in range(rng.choice([1, 2, 3, 5, 8, 17]))]
    rng.shuffle(rows)
    assert found(trie(build(spark, rows))) == plain_trie(rows)


def test_depths_at_and_beside_powers_of_two(spark):
    rows = [(c, k, "user", "w " * (k % 3) + str(k if k < cut else c)) for c, (n, cut) in enumerate(
        [(1, 1), (2, 1), (3, 3), (4, 2), (7, 7), (8, 8), (8, 5), (9, 9), (16, 16), (33, 20), (33, 31), (64, 40)]) for k in range(n)]
    assert found(prefixtrie.prefix_trie(prefixtrie.sequences(build(spark, rows)))) == plain_trie(rows, rebuild=False)


def test_many_copies_ties_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 7)
    rows = [(c, k, "user", f"turn {k}") for c in range(300) for k in range(4)]
    rows += [(900, 1, "b", "x"), (900, 1, "a", "y"), (900, 1, "a", "x"), (900, 1, "a", "x"), (900, None, None, None)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    got = found(trie(build(spark, rows).repartition(5)))
    assert got == plain_trie(rows) and any(r[3] > 200 for r in got)


def test_conversations_without_turns_end_in_the_root(spark):
    rows = [(c, k, "user", f"t{c}") for c in range(1, 60) for k in range(1 + c % 3)]  # absent leaders take turns away
    got = found(trie(build(spark, rows)))
    assert got == plain_trie(rows)
    empty_hash = hashlib.sha256(b"").hexdigest()
    assert got[0][1] == 0 and got[0][7] != empty_hash


def test_only_conversations_without_turns(spark):
    alone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "x") for c in alone]
    got = found(trie(build(spark, rows)))
    assert got == plain_trie(rows) and len(got) == 1 and got[0][5] == 1


def test_empty_table(spark):
    assert trie(build(spark, [])).count() == 0


def test_query_on_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_prefix_trie"](spark, sf_dir)) == plain_trie(rows)
