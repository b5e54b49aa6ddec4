"""Chat logs: folding, escaping and reading back against plain Python."""

import hashlib
import random

from hypothesis import given, settings, strategies as st

from dialoom.llm import chat

PARTS = ["### ", "#", "<", "</turn>", "/turn>", "\\", "## User:", "### Assistant:", "Other", "\n", " ", "a", "é", "😀", "### Tool:"]
LOG = "conv_id bigint, turn bigint, msg bigint, seq bigint, kind string, role string, text string, piece string, n_turns int, _id int"


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.sampled_from(["user", "assistant", "tool", None, "", "a\nb", "</turn>", "Other", "### User:"]))
@settings(max_examples=600, deadline=None)
def test_rendered_reads_back(text, role):
    piece, start, end = chat.rendered(role, text)
    assert chat.read_back(piece) == (role, text)
    assert piece[start:end] == chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text
    # no control string is left but the header and the end mark
    assert piece.count(chat.END) == 1 and not any(c in piece[4:-len(chat.END) - 1] for c in [*(f"### {n}:" for n in chat.ROLES), chat.OTHER, chat.END])


def final(events):
    """The messages of a log, by one dictionary."""
    out = {}
    ended = set()
    for conv, turn, msg, _, kind, role, text in sorted(events, key=lambda e: (e[:4], e[4], e[5] or "", e[6] or "")):
        key = (conv, turn, msg)
        if kind == "delete":
            out.pop(key, None)
            ended.add(key)
        elif kind == "message":
            out[key] = [role, text or ""]
            ended.discard(key)
        elif kind in ("delta", "edit", "regenerate") and key not in ended:
            had = out.setdefault(key, [None, ""])
            had[0] = role if role is not None else had[0]
            had[1] = (had[1] if kind == "delta" else "") + (text or "")
    return out


def digest_of(found):
    """The digest row of every conversation from its messages in order."""
    convs = {}
    for (conv, *_), (role, text) in sorted(found.items()):
        convs.setdefault(conv, []).append((role, text))
    return {c: (len(m), hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in m).encode()).hexdigest(), sum(len(t) for r, t in m if r == "assistant"),
                hashlib.sha256("".join(t for r, t in m if r == "assistant").encode()).hexdigest(), sum(len(chat.rendered(r, t)[0]) for r, t in m)) for c, m in convs.items()}


def log_rows(n, hot):
    rng = random.Random(n)
    rows = []
    for seq in range(n):
        conv = 0 if rng.random() < hot else rng.randrange(1, 40)
        kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "unknown"])
        rows.append((conv, rng.randrange(30 if conv else 300), rng.randrange(2), seq, kind, rng.choice(["user", "assistant", "assistant", "system", None]),
                     rng.choice(["", None, "### User: x", "</turn>", "plain é", "\\### Assistant: </turn> ok", "\n\n"])))
    return rows


def test_logs_by_plain_python(spark):
    rows = log_rows(6000, 0.4)
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], LOG).repartition(7)
    want = final(rows)
    got = {(r.conv_id, r.turn, r.msg): [r.role, r.text] for r in chat.messages(df).collect()}
    assert got == want and len(want) > 800
    for parts in ("1", "5", "60"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = chat.digests(chat.formatted(df)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(found) == len({r.conv_id for r in found})
        assert {r.conv_id: tuple(r)[1:] for r in found} == digest_of(want)


def test_log_of_turns_gives_the_turns(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 0, None, None), (1, 1, "assistant", None), (1, 3, "assistant", "x" * 1000), (1, 2, "judge", "y\n" * 300),
            (1, 3, "assistant", "x" * 1000), (None, None, "user", "é😀" * 100), (2, 1, "assistant", "long " * 400_000), (2, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "z", "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, msg string, kind string")
    log = chat.event_log(df, chunk=7)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.messages(log).collect()), key=str)
    assert got == sorted([(c, t, r, x or "") for c, t, r, x in rows], key=str)
    digests = {r.conv_id: r for r in chat.digests(chat.formatted(log)).collect()}
    assert digests[1].n_turns == 5 and digests[1].loss_chars == 2000 and digests[2].loss_chars == 2_000_000 and digests[None].n_turns == 1
    assert digests[-7].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and digests[-7].loss_chars == len(odd)
    assert digests[-7].turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert chat.digests(chat.formatted(chat.event_log(df.limit(0)))).count() == 0


def test_loss_mask_covers_what_is_learned(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, "message", "user", "a</turn>"), (1, 1, 0, 0, "message", "judge", "### User: b")],
                               "conv_id bigint, turn bigint, msg bigint, seq bigint, kind string, role string, text string")
    rows = {r.turn: r for r in chat.formatted(df, learned=("judge",)).collect()}
    assert rows[0].loss_from is None
    assert chat.unescaped(rows[1].piece[rows[1].loss_from:rows[1].loss_to]) == "### User: b"
