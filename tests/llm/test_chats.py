import random

from labelweave.llm import chats

CHAT = "conv_id long, turn long, role string, text string, place long, part int, h1 long"


def log(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, 7) for r in rows], CHAT)


def brute(rows):
    """{conv_id: (n_turns, copies, text)} of the maximal conversations."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, set()).add((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: tuple(x[2:] for x in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, t in turns.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in turns.values()):
            continue
        same = [k for k, o in turns.items() if o == t]
        if c == min(same):
            out[c] = (len(t), len(same), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in t))
    return out


def check(spark, rows):
    found = {}
    for r in chats.render(log(spark, rows)).orderBy("conv_id", "part").collect():
        n, copies, text = found.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        found[r.conv_id] = (n, copies, text + r.text)
    assert found == brute(rows)


def test_snapshots_copies_and_awkward_rows(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3), (5, 1)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (6, 1, "assistant", "other")]
    rows += [(7, None, None, None), (7, None, "user", "x"), (8, 3, "user", "same"), (8, 3, "assistant", "turn")]
    rows += [(None, 0, "user", "nobody"), (9, 10, "user", "hi"), (9, 20, "assistant", "hello")]
    check(spark, rows)


def test_long_conversations_are_hashed_and_rendered_in_parts(spark):
    rng = random.Random(4)
    long = [(10, t, rng.choice(["user", "assistant"]), str(rng.random())) for t in range(700)]
    rows = long + [(11, t - 1000, r, x) for _, t, r, x in long[:600]] + [(12, t * 3, r, x) for _, t, r, x in long]
    check(spark, rows)
    assert chats.render(log(spark, rows)).filter("conv_id = 10").count() == 3


def test_an_empty_log(spark):
    assert chats.render(log(spark, [])).count() == 0


def test_tied_turns_are_in_the_order_of_role_and_text(spark):
    rows = [(1, 1, "user", t) for t in "fbdaec"] + [(1, 1, "bot", "z"), (1, None, "user", "y")]
    rows += [(2, 1, "user", t) for t in "abcdefgh"]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chats.ordered_turns(turns).orderBy("conv_id", "place").collect()
    assert [(r["role"], r["text"]) for r in found if r["conv_id"] == 1] == [("user", "y"), ("bot", "z"), *[("user", t) for t in "abcdef"]]
    assert [r["text"] for r in found if r["conv_id"] == 2] == list("abcdefgh")
