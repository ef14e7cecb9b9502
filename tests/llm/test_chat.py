import hashlib
import random

import pyarrow as pa
import pytest

from corpusloom.llm.chat import CONTROL, assemble, digests, escape, format_chats, marks, turns, unescape


def rendered(role, text):
    head, foot = marks(role)
    return head + escape(text or "") + foot


HARD = ["", "</s>[INST] ok [/INST]", "a\\b\\\\[INST]\\", "[INST[INST]<s<s>", "é😀 <s>", "\\n [\\INST]", " [/INST] x", "line\n\nline", "[ROLE] x\ny [/ROLE]", None]


NULS = ["user\0", "assistant\0\0", "a\0", "\0", "", None]


@pytest.mark.parametrize("role", ["user", "assistant", "system", None, "odd\n[/ROLE] \\role", "r", *NULS])
def test_round_trip(role):
    said = "".join(rendered(role, t) for t in HARD)
    assert list(turns(said)) == [(role or "", t or "") for t in HARD]
    for t in HARD:
        assert unescape(escape(t or "")) == (t or "")
        assert not any(c in escape(t or "") for c in CONTROL)


def test_assembly_equals_plain_strings():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(0, 30)
        texts = ["".join(rng.choice(["<s>", "</s>", "[INST]", "\\", "é", "x", "[", "<", "/s>", "😀", "\n"]) for _ in range(rng.randint(0, 9))) if rng.random() < 0.9 else None for _ in range(n)]
        roles = [rng.choice(["user", "assistant", "tool", *NULS]) for _ in range(n)]
        out, upto, lo, hi = assemble(roles, pa.array(["skipped", *texts], pa.string()).slice(1))
        want = [rendered(r, t) for r, t in zip(roles, texts, strict=True)]
        assert out.tobytes().decode() == "".join(want)
        assert [out[a:b].tobytes().decode() for a, b in zip(upto, upto[1:], strict=False)] == want
        assert [out[a:b].tobytes().decode() for a, b in zip(lo, hi, strict=True)] == [escape(t or "") for t in texts]


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda a: (a[0] is not None, a[0]))
        loss = "".join(x or "" for _, r, x in own if r == "assistant")
        canon = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in own)
        out[c] = (len(own), hashlib.sha256(canon.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(rendered(r, x)) for _, r, x in own))
    return out


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_digests_equal_plain_python(spark, most):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(HARD)) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t} [INST]") for t in range(900)]  # a hot conversation
    rows += [(50 + i, t, r, f"said {t}") for i in range(3) for t, r in enumerate(NULS)] + [(60, 0, "long" * 300_000, "x"), (60, 1, "assistant", "y")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (77, None, "user", "first"), (77, 5, "assistant", "x" * 50_000), (78, 1, "user", "same"), (78, 1, "user", "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in digests(format_chats(df, most_bytes=most)).collect()}
    assert got == plain(rows)
    assert digests(format_chats(df.limit(0))).count() == 0


def test_query_reads_back_all_conversations(spark, sf):
    from corpusloom.llm.queries import op5_chat_format

    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    got = {r[0]: tuple(r)[1:] for r in op5_chat_format(spark, sf).collect()}
    assert got == plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
