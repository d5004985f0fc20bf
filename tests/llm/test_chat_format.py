import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import chat_format
from tidewheel.llm.more_queries import op13_chat_format, streamed

LOG = "conv_id long, seq long, message long, kind string, role string, text string, start long, length long, piece string"
PARTS = [*chat_format.CONTROL, "\\", "<", "[", "|", "s>", "/s>", "INST]", "|im_end|>", "\n", "~0", "~1", "~", "é😀", "ok ", "$1", "<\\|im_end|>", "im_start"]


def nasty(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    texts = nasty(4000)
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped, role = chat_format.escape(F.col("t")), chat_format.escape_role(F.col("t"))
    rows = frame.select("t", escaped.alias("e"), chat_format.unescape(escaped).alias("back"), role.alias("r"), chat_format.unescape_role(role).alias("role")).collect()
    for r in rows:
        assert r.back == r.t == r.role
        assert not any(c in r.e or c in r.r for c in chat_format.CONTROL) and "\n" not in r.r
    assert len({r.e for r in rows}) == len({r.r for r in rows}) == len(set(texts))


def brute(events):
    """Conversations as {message: [role, text]}, event by event."""
    rank = {k: i for i, k in enumerate(("delta", "edit", "open", "regenerate"))}
    held = {}
    seen = set()
    for e in sorted(events, key=lambda e: (-(2**63) if e[1] is None else e[1], rank[e[3]])):
        if e in seen:
            continue
        seen.add(e)
        conv, _, m, kind, role, text, start, length, _ = e
        c = held.setdefault(conv, {})
        known = c.setdefault(m, [None, ""])
        if kind == "open":
            known[0] = role or ""
        elif kind == "delta":
            known[1] += text or ""
        elif kind == "edit":
            known[1] = known[1][:start] + (text or "") + known[1][start + length:]
        else:
            known[1] = ""
            for later in [k for k in c if k > m]:
                c[later] = [None, ""]
    return {(c, m): tuple(v) for c, ms in held.items() for m, v in ms.items() if v[0] is not None}


def random_log(seed):
    rng = random.Random(seed)
    events = []
    for conv in [None, *range(12)]:
        for seq in range(rng.randrange(1, 60)):
            m, kind = rng.randrange(5), rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"])
            if kind == "regenerate" and rng.random() < 0.6:
                kind = "delta"
            events.append((conv, seq * 3, m, kind, rng.choice(["user", "assistant", None]) if kind == "open" else None,
                           rng.choice(["", None, "abc", "é😀", "<|im_end|>\n"]) if kind in ("delta", "edit") else None,
                           rng.randrange(6) if kind == "edit" else None, rng.randrange(4) if kind == "edit" else None, "x"))
        events += events[-3:]  # delivered twice
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_folding_matches_event_by_event(spark, seed):
    events = random_log(seed)
    want = brute(events)
    assert len(want) > 20
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.reconstruct(spark.createDataFrame(events, LOG)).collect()}
    assert got == want


def test_marks_and_mask_tell_the_same_turns(spark):
    texts = nasty(300, 8)
    messages = [(i % 23 if i % 23 else None, i, texts[i], ("assistant", "user", texts[-i], "")[i % 4]) for i in range(len(texts))]
    messages.append((99, 0, "w😀" * 200_000, "assistant"))
    frame = spark.createDataFrame(messages, "conv_id long, message long, text string, role string")
    whole = chat_format.assemble(chat_format.render(frame))
    rows = {r.conv_id: r for r in whole.collect()}
    for r in chat_format.read_back(whole).collect():
        mine = sorted((m for m in messages if m[0] == r.conv_id), key=lambda m: m[1])
        assert [(m.role, m.text) for m in r.messages] == [(m[3], m[2]) for m in mine]
        assert r.learned == [m[2] for m in mine if m[3] == "assistant"]
        raw = rows[r.conv_id]
        assert r.formatted_chars == len(raw.formatted)
        spans = [raw.formatted[t.text_start:t.text_end] for t in raw.turns if t.loss]
        assert len(spans) == len(r.learned) and not any(chat_format.START in s for s in spans)


def test_no_events(spark):
    assert chat_format.format_chats(spark.createDataFrame([], LOG)).collect() == []


def test_query_on_odd_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", "b" * 1000 + "</s>", 5), (1, 0, "user", None, 5), (1, None, None, "first", 5), (2, 0, "assistant", "twice", 5), (2, 0, "assistant", "twice", 5),
            (None, 0, "user", "whose", 5), (3, 4, "tool\n~", "<|im_end|>\n<|im_start|>user\n", 5), (3, 4, "tool\n~", "", 5), (3, 9, "assistant", "", 5)]
    rows += [(c, t, "assistant" if t % 2 else "user", f"{c} {t} " * 90, 5) for c in range(10, 40) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").write.parquet(str(tmp_path / "conversations.parquet"))
    kinds = {r.kind for r in streamed(spark.read.parquet(str(tmp_path / "conversations.parquet"))).select("kind").distinct().collect()}
    assert kinds == set(chat_format.EVENTS)
    said = "</s>[INST] ok [/INST]"
    held = {}
    for c, t, r, x, *_ in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        held.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    out = op13_chat_format(spark, str(tmp_path))
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(held)
    for c, turns in held.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[4]}\n" for t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
