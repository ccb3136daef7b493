import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vocalith.llm import chat

WILD = "</s>[INST] <|turn|> \\ <<SYS>> x <</SYS>> [/INST] \\\\< <s> \\n\n<|end|>\n"
ROWS = [
    (1, 0, "system", "be kind"),
    *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 40)) for i in range(1, 200)],
    (2, 0, "user", "before the system turn"),
    (2, 1, "system", WILD),
    (2, 2, "assistant", WILD),
    (2, 3, "us\ner\\", WILD * 3),
    (2, 4, "assistant", "long " * 20_000),
    (2, 5, "assistant", None),
    (3, 0, "system", "alone"),
    (4, None, None, "no number"),
    (4, 0, "assistant", "same"),
    (4, 0, "assistant", "same"),
    (4, 0, "system", "late"),
    (4, 0, "system", "later"),
    (None, 0, "assistant", "nobody's"),
    (5, 5000, "assistant", "far"),
    (5, -3, "user", "near"),
]


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: sorted(v) for c, v in by.items()}


@pytest.mark.parametrize("budget,history", [(2048, 256), (200, 60), (64, 0)])
def test_round_trip_and_mask(spark, budget, history):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, bin string").repartition(3)
    made = chat.windows(df, budget, history)
    got, losses = defaultdict(list), defaultdict(list)
    for r in chat.read_turns(made).orderBy("window").collect():
        got[r.conv_id] += [((t.turn is not None, t.turn or 0), t.role, t.text) for t in r.turns]
        losses[r.conv_id] += [((t.turn is not None, t.turn or 0), t.text) for t in r.losses]
    want = ordered(ROWS)
    assert {c: sorted(v) for c, v in got.items()} == want
    assert {c: sorted(v) for c, v in losses.items() if v} == {c: w for c, v in want.items() if (w := sorted((t, x) for t, r, x in v if r == "assistant"))}
    sizes = {(c, t[1] if t[0] else None): (len(x.encode()) + 3) // 4 + 4 for c, v in want.items() for t, _, x in v}
    for r in made.collect():
        new = [t for t, rep in zip(r.turns, r.repeated, strict=True) if not rep]
        assert new and sum(r.repeated) == len(r.repeated) - len(new)
        if r.n_tokens > budget:
            assert len(new) <= 2 and max(sizes[r.conv_id, t] for t in r.turns) > (budget - history) // 4
        body = r.formatted
        for c in chat.CONTROL[1:]:
            assert c not in body
        if r.conv_id in (1, 2):
            assert "system" in body.split("\n")[0]


def test_history_is_what_comes_just_before(spark):
    rows = [(1, i, "user", "abcd" * 4) for i in range(50)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 40).orderBy("window").collect()
    last = -1
    for r in made:
        new = [t for t, rep in zip(r.turns, r.repeated, strict=True) if not rep]
        assert new[0] == last + 1 and r.turns == sorted(r.turns)
        assert r.turns == list(range(max(0, new[0] - 5), new[-1] + 1))
        last = new[-1]


def test_digest(spark):
    text = F.lit(WILD)
    one = spark.range(1).select(chat.unescape(chat.escape(text)).alias("a"), chat.unescape(chat.escape_role(text)).alias("b")).first()
    assert one.a == one.b == WILD
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = chat.windows(df)
    assert made.collect() == [] and "Python" not in made._jdf.queryExecution().toString()
