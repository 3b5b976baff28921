"""The prefix trie against plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from pricetrail.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos string, total string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes by brute force; turns of one number are in the order of their digest."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))

    def digest(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
        own[conv] = [t[1:] for t in turns]
    paths = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        paths[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    children = {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * words
    return sorted(
        (
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children.get(path, 0), leaves[path],
                saved[path], hashlib.sha256(",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(path)))).encode()).hexdigest(),
            )
            for path, convs in members.items()
        ),
        key=str,
    )


def made(rng):
    rows = []
    for conv in range(-25, 130):
        rows += [(conv, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\tc", "", None, "  ", "é ü", "x" * 5000])) for t in range(rng.randint(1, 6))]
    # Long conversations: three alike for 60 turns, then apart; two equal ones; one alone.
    for conv, end in ((1000, 70), (1001, 60), (1002, 90), (1003, 90), (1004, 300)):
        shared = 60 if conv < 1004 else 0
        rows += [(conv, t, "user", f"w{t} w" if t < shared else f"{conv // 2 * 2 if conv >= 1002 else conv} {t}") for t in range(end)]
    rows += [(200, None, "user", "late"), (200, None, "user", "early"), (200, 1, "user", "z"), (200, 1, "user", "z")]
    rows += [(None, 0, "user", "nobody's"), (219, 0, "user", "only one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, seed):
    rows = made(random.Random(seed))
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA).repartition(5)
    got = trie.trie(docs).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain(rows)
    assert len({r.node for r in got}) == len(got)


def test_one_conversation_with_most_turns_is_cut(spark):
    rows = [(7, t, "user", f"t{t} x") for t in range(300)] + [(c, 0, "user", "t0 x") for c in range(8, 60)]
    turns = trie.ordered(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(8))
    got = sorted((r.pos, r.before) for r in turns.where("conv_id = 7").collect())
    assert got == [(t + 1, 2 * t) for t in range(300)]
    nodes = trie.trie(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=str) == plain(rows)


def test_equal_conversations_share_all_nodes(spark):
    rows = [(c, t, "user", "same words") for c in range(400, 2000) for t in range(5)]
    got = trie.trie(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain(rows)
    assert len(got) == 6


def test_empty_tables(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], SCHEMA)).collect() == []
