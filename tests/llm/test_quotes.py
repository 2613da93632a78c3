import random

from orrery.llm import quotes


def linked(spark, rows):
    return quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def brute(rows):
    """The turn that each message of a conversation answers: of distinct turns, quotes of level 1 that are whole lines of one message."""
    out, seen = {}, {}
    for conv, turn, _, text in sorted(rows):
        lines = text.split("\n")
        own = [x for x in lines if not x.startswith(">")]
        quoted = [x[1:].strip().lower() for x in lines if x.startswith(">")]
        before = max((t for c, t in seen if c == conv), default=None)
        source = [t for (c, t), said in sorted(seen.items()) if c == conv and quoted and all(q in said for q in quoted)]
        out[conv, turn] = (source[0] if source else before, "\n".join(own).strip())
        seen[conv, turn] = [x.lower() for x in own]
    return out


def test_random_threads(spark):
    rnd = random.Random(3)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rnd.choice((3, 9, 40))):
            own = [f"message {conv} {turn} line {k} " + str(rnd.random()) for k in range(rnd.randint(1, 4))]
            quoted = [f"> {x}" for x in rnd.choice(said)] if said and rnd.random() < 0.5 else []
            said.append(own)
            rows.append((conv, turn * rnd.choice((1, 1)) * 50, "user", "\n".join([*quoted, *own])))
    expected = brute(rows)
    for r in linked(spark, rows).collect():
        assert (r.parent_turn, r.text) == expected[r.conv_id, r.turn]


def test_levels_introductions_and_branches(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you today my friend?"),
        (1, 1, "assistant", "I am fine."),
        (1, 2, "user", "Bob wrote:\n> Hello   THERE\n> how are you today my friend?\nGood question"),
        (1, 3, "assistant", ">> Hello there\n> I am fine.\n\nok then"),
        (1, 4, "user", "continue"),
        (1, 400, "user", "> unknown text\nlate"),
        (3, 5, "user", "> Hello there\nno"),
    ]
    got = {(r.conv_id, r.turn): r for r in linked(spark, rows).collect()}
    assert [got[1, t].parent_turn for t in (0, 1, 2, 3, 4, 400)] == [None, 0, 0, 1, 3, 4]
    assert [got[1, t].branch for t in (0, 1, 2, 3, 4, 400)] == [0, 0, 2, 3, 3, 3]
    assert [got[1, t].pos for t in (0, 1, 2, 3, 4, 400)] == [0, 1, 0, 0, 1, 2]
    assert got[1, 2].text == "Good question" and got[1, 3].text == "ok then"
    assert (got[1, 3].n_quoted, got[1, 3].n_linked) == (2, 2) and (got[3, 5].n_quoted, got[3, 5].n_linked) == (1, 0)
    chats = {(r.conv_id, r.branch): r for r in quotes.chats(linked(spark, rows)).collect()}
    assert chats[1, 3].n_messages == 3 and ">" not in chats[1, 3].text.replace("|>", "")


def test_conversations_in_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you today my friend?"),
        (1, 1, "assistant", "I am fine."),
        (1, 2, "user", "> Hello there\n> how are you today my friend?\nGood question"),
        (1, 3, "assistant", "> I am fine.\n\nok then"),
        (1, 4, "user", "> Good question\nasked"),
        (1, 5, "user", "> ok then\nlate"),
        (2, None, "user", "alone"),
    ]
    got = {(r.conv_id, r.thread): r for r in quotes.threads(linked(spark, rows)).collect()}
    said = lambda k: [x.split("|>")[1].strip() for x in got[k].text.split("<|")[1:]]
    hello = rows[0][3]
    assert said((1, 0)) == [hello, "I am fine.", "ok then", "late"] and said((1, 2)) == [hello, "Good question", "asked"]
    assert len(got) == 3 and said((2, None)) == ["alone"] and got[1, 2].n_above == 1 and got[1, 0].n_above == 0


def test_conversations_of_random_trees(spark):
    rnd, rows, parents = random.Random(8), [], {}
    for conv in range(3):
        for turn in range((3, 60, 200)[conv]):
            parent = turn - 1 if rnd.random() < 0.4 else rnd.randrange(max(0, turn - 9), turn) if turn else None
            parents[conv, turn] = parent if turn else None
            rows.append((conv, turn, "user", f"> text of {parent} here\ntext of {turn} here" if turn else "text of 0 here"))
    thread, seen, expected = {}, set(), {}
    for (conv, turn), up in parents.items():
        thread[conv, turn] = thread[conv, up] if up is not None and (conv, up) not in seen else turn
        seen.add((conv, up))
        path = [turn]
        while (above := parents[conv, path[0]]) is not None:
            path.insert(0, above)
        expected[conv, thread[conv, turn]] = path
    found = {}
    for r in sorted(quotes.threads(linked(spark, rows)).collect(), key=lambda r: (r.conv_id, r.thread, r.segment)):
        assert r.n_messages <= quotes.MESSAGES_IN_SEGMENT
        found.setdefault((r.conv_id, r.thread), []).extend(int(x.split()[-2]) for x in r.text.split("<|")[1:])
    assert found == expected and max(map(len, found.values())) > 20


def test_order_over_blocks(spark):
    rows = [(1, t, "user", f"turn {t}" if t != 700 else "> turn 3\nback") for t in range(0, 2000, 3) if t != 699] + [(1, 700, "user", "> turn 3\nback")]
    got = {r.turn: r for r in linked(spark, rows).collect()}
    turns = sorted(got)
    assert all(got[b].parent_turn == (3 if b == 700 else a) for a, b in zip(turns, turns[1:]))
    after = [t for t in turns if t >= 700]
    assert [got[t].pos for t in after] == list(range(len(after))) and {got[t].branch for t in after} == {700}


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "> q"), (1, 1, None, ""), (1, 2, "user", "> only\n> quotes"), (1, 2, "user", "y" * 100_000)]
    out = linked(spark, rows).collect()
    assert len(out) == len(rows)
    assert all(r.branch is None for r in out if r.turn is None or r.conv_id is None)
    assert [r.text for r in out if r.turn == 2 and len(r.text) < 10] == [""]
    assert linked(spark, rows).limit(0).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, id string, n int")
    assert quotes.link(none).count() == 0 and quotes.chats(quotes.link(none)).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in [quotes.link(none)._jdf.queryExecution().executedPlan().toString()])
