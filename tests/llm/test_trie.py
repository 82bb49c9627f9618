"""The prefix trie against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from prismal.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, rank string, depth string, a string"


def rebuilt(rows, every=20, heads=4):
    """conv_id to turns, rebuilt as branches; every None: as they are."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    if every is None:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(c - every * int(c / every))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Rows of the trie, by walking every conversation from the root."""
    nodes = [{"depth": 0, "parent": None, "kids": {}, "members": [], "ends": [], "words": 0}] if convs else []
    for c in sorted(convs):
        at = 0
        nodes[0]["members"].append(c)
        for turn in convs[c]:
            if turn not in nodes[at]["kids"]:
                nodes[at]["kids"][turn] = len(nodes)
                nodes.append({"depth": nodes[at]["depth"] + 1, "parent": at, "kids": {}, "members": [], "ends": [], "words": len(re.findall(r"[^\x20\x09-\x0D]+", turn[1]))})
            at = nodes[at]["kids"][turn]
            nodes[at]["members"].append(c)
        nodes[at]["ends"].append(c)
    for n in nodes:
        n["leaves"], n["saved"] = int(not n["kids"]), (len(n["members"]) - 1) * n["words"]
    for n in reversed(nodes[1:]):
        nodes[n["parent"]]["leaves"] += n["leaves"]
        nodes[n["parent"]]["saved"] += n["saved"]
    return sorted((min(n["members"]), n["depth"], -1 if n["parent"] is None else min(nodes[n["parent"]]["members"]), len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()) for n in nodes)


def collected(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def sample():
    draw = random.Random(5)
    rows = []
    for c in [*range(-25, 90), 10**12]:
        if c in (40, 60, -20):
            continue  # heads that are absent
        for k in range(draw.choice([1, 2, 3, 5, 8])):
            rows.append((c, draw.choice([k, k, None, 1]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a b", "a  b", "", None, "c\x0bd\te", "é ü", "A b"])))
    rows += [(7, 3, "user", "same")] * 3 + [(None, 1, "user", "nobody's")] * 4
    return rows


@pytest.mark.parametrize("primes", [trie.PRIMES, (7, 11)])
def test_branches_equal_a_walk_even_where_fingerprints_collide(spark, primes):
    rows = sample()
    turns = trie.ordered(frame(spark, rows))
    assert collected(trie.trie(turns, trie.branched(turns), primes)) == brute(rebuilt(rows))


def test_plain_conversations_of_several_blocks(spark):
    long = [(3, k, "user", f"w{k % 7}") for k in range(9000)] + [(5, k, "user", f"w{k % 7}") for k in range(8500)] + [(5, 8500, "user", "x"), (4, 0, "user", "w0")]
    turns = trie.ordered(frame(spark, long))
    assert collected(trie.trie(turns, trie.plain(turns))) == brute(rebuilt(long, None))


def test_one_copied_conversation_and_none(spark):
    rows = [(c, k, "user", t) for c in range(200) for k, t in enumerate(["x y", "x y", "z"])]
    turns = trie.ordered(frame(spark, rows))
    assert collected(trie.trie(turns, trie.plain(turns))) == brute(rebuilt(rows, None))
    empty = trie.ordered(frame(spark, []))
    assert trie.trie(empty, trie.branched(empty)).count() == 0
