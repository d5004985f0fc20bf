import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tidewheel.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, node string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, leaves, saved = defaultdict(list), {}, {}
    for key in members:
        if key:
            children[key[:-1]].append(key)
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = sum(saved[k] for k in children[key]) + ((len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0)
    return sorted(
        (m[0], len(key), members[key[:-1]][0] if key else -1, len(m), len(children[key]), leaves[key], saved[key],
         hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(key)).encode()).hexdigest())
        for key, m in members.items())


def found(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def corpus():
    rng = random.Random(2)
    opening = [("system", "Be brief."), ("user", "Höi 😀"), ("assistant", ""), ("user", "again"), ("assistant", "again")]
    rows = []
    for c in [*range(-7, 40), 5000, 5001, 10**12]:
        if c in (10, 25):
            continue  # families without their first conversation
        kept = rng.randrange(len(opening) + 1)
        turns = opening[:kept] + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(1, 5))]
        rows += [(c, t, r, x, t, "x") for t, (r, x) in enumerate(turns)]
    rows += [(41, t, "user", "long chain", t, None) for t in range(60)] + [(45, t, "user", "long chain", t, None) for t in range(75)]
    rows += [(50, None, None, None, 1, "a"), (50, None, "user", "tie", 1, "a"), (50, 3, "user", "same", 1, "a"), (50, 3, "user", "same", 1, "b"), (50, 3, "user", "b", 1, "a"),
             (None, 1, "user", "nobody", 1, "a"), (55, 0, "user", "w " * 50_000, 1, "a"), (56, 0, "user", "only", 1, "a")]
    rng.shuffle(rows)
    return rows


def test_every_node_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert any(r[4] > 5 for r in want) and any(r[1] > 60 for r in want)
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == want


def test_a_turnless_conversation_ends_at_the_root(spark):
    short = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(short, 0, "user", "gone", 0, None), (short, 1, "user", "gone too", 0, None)]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) == [(short, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_no_conversations(spark):
    assert found(prefix_trie.trie(spark.createDataFrame([], SCHEMA))) == []


def test_runs_and_id_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = corpus()
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_totals_of_random_forests(spark):
    rng = random.Random(8)
    parents = {}
    for i in range(1, 500):
        kind = i % 3
        parents[i] = i - 1 if kind == 0 or i < 120 else rng.randrange(i) if kind == 1 else max(0, i - rng.randrange(1, 9))
    parents[0] = parents[499] = None
    depth, kids, weight = {}, defaultdict(int), {i: i * i % 101 for i in range(500)}
    for i in range(500):
        depth[i] = 0 if parents[i] is None else depth[parents[i]] + 1
        if parents[i] is not None:
            kids[parents[i]] += 1
    want = dict(weight)
    for i in sorted(range(500), key=lambda i: -depth[i]):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    tree = spark.createDataFrame([(i, parents[i], kids[i], depth[i], weight[i]) for i in range(500)], "node long, parent long, n_children long, depth long, w long")
    got = {r.node: (r.w, r.one) for r in prefix_trie.subtree_totals(tree.withColumn("one", F.lit(1).cast("long")), ["w", "one"]).collect()}
    assert {i: w for i, (w, _) in got.items()} == want
    assert got[499][1] == 1 and got[0][1] == 499
