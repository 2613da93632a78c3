import collections
import hashlib
import random
import re

from orrery.llm import pii


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, form, good) in enumerate(FORMS) for m in re.finditer(form, text or "") if good(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


ODD = [
    None, "", "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 1.2.3.45 999.1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1111-1 +1 (556) 555-9070.", "é😀 a@b.co 😀 10.0.0.1", "+1 2",
    "+49 (0) 30 1234567 -", "00000000000000000000 0000000000000000", "1.1.1.1111111111111111111111111111111111111111111111 0000001.2.3.4", "x 4111111111111111 4111111111111112", "a" * 3000 + "@b.c" + ".d" * 2000,
    "1 " * 3000, "aaa@b..c a@b.c.", "12345678901234567 8 9", "+1.2.3.4 +1.200.300.4000", "+4111 1111 1111 1111",
]


def test_fixed_forms(spark, documents, texts):
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.spans == brute(ODD[r.doc_id]), ODD[r.doc_id]
    for r in pii.personal_data(documents).collect():
        expected = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in expected.split(",")) for k in ("email", "ip", "card", "phone")]
        assert not set(filter(None, expected.split(","))) - set(r.spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Dear sir write to contact: {w}@mail.com now and then the end") for i, w in enumerate(["abc1", "bob22", "eve33", "joe44"])]
    rows += [(10, "please contact: k99-at-host thanks"), (11, "the number 12345 here is fine"), (12, "contact: zed77#site or to 55511 then")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "context:16:27" and got[11] == "" and got[12] == "context:9:19"


def test_patterns_need_different_instances(spark):
    rows = [(i, "write to contact: abc1@mail.com now") for i in range(50)] + [(99, "contact: k99-at-host")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == ""


def test_second_round_learns_from_the_first(spark):
    rows = [(i, f"contact: u{i}@mail.com is it") for i in range(4)]
    rows += [(20 + i, f"contact: zz{i}-host") for i in range(4)] + [(30, "reach: u1@mail.com")] + [(40 + i, f"reach: zz{i}-host") for i in range(4)] + [(50, "reach: qq9-host")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "context:9:17" and got[50] == "context:7:15"


def test_patterns_without_seeds_and_long_chains(spark):
    rows = [(i, f"contact: u{i}@mail.com is it") for i in range(4)]
    for k, w in enumerate(["contact:", "account:", "third:", "fourth:", "fifth:"]):  # mostly what the word before finds, and something new
        rows += [(100 * k + 20 + i, f"{w} z{j}{i}-host") for i in range(3) for j in [k] * 3 * (k > 0) + [k + 1]]
    rows += [(1000, "account: qq9-host"), (1001, "fifth: qq8-host"), (1002, "other: qq7-host")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == "context:9:17" and got[1001] == "context:7:15" and got[1002] == ""


def test_mask(spark):
    rows = [(1, "mail a@b.co or +4111 1111 1111 1111 end", "k", 3), (2, None, "k", 3), (3, "é😀 10.0.0.1", None, None)]
    out = {r.doc_id: r for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string, spans string, n int")).collect()}
    assert out[1].text == "mail [EMAIL] or +[CARD] end" and out[2].text is None and out[3].text == "é😀 [IP]" and out[1].spans == "k"


def test_native_plan_and_edge_cases(odd, empty):
    df = pii.personal_data(odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.spans for r in rows if r.doc_id == 6] == [brute("é😀 ünïcode a@b.co +1 (555) 555-0100 10.0.0.1")]
    assert pii.personal_data(empty).count() == 0
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == odd.count() and pii.mask(empty).count() == 0


WS = r"\x20\x09-\x0D"


def left_of(before):
    found = re.search(r"([^\s]+(?:[ \t]+[=:#]+)?)[\s\"'(]*$", before[-64:], re.A)
    return re.sub(r"\s", "", found.group(1)).lower() if found else ""


def brute_context(texts):
    """Patterns and the spans they find, by the plain definition: a list of (start, end) for each text."""
    seeds, tokens, words = [], [], []
    for text in texts:
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
        seeds += [(left_of(text[:a]), text[a:b]) for a, b in spans]
        mine, last = [], 0
        for m in re.finditer(f"[^{WS}]+", text):
            if not re.search("[0-9@]", m.group()):
                continue
            before, last = text[last : m.start()], m.end()
            if any(a < m.end() and m.start() < b for a, b in spans):
                continue
            key = re.match(r"([^=:0-9@]+[=:]+[\"']?)?", m.group()).group()
            value = m.group().rstrip(".,;:!?)\"'")[len(key) :]
            if len(value) >= 4:
                mine.append((m.start() + len(key), m.start() + len(key) + len(value), re.sub("[\"']$", "", key).lower() if key else left_of(before), value))
        tokens.append(mine)
        glued = re.sub(r"[ \t]+([=:#]+)", r"\1", text).lower()
        words += [re.sub(r"^([^=:0-9@]+[=:]+)[\"']?.+$", r"\1", w, flags=re.S) for w in re.split(f"[{WS}]+", glued)]
    seed_forms = {f for left, f in seeds if left}
    edges = collections.Counter([x for x in seeds if x[0]] + [(t[2], t[3]) for mine in tokens for t in mine if t[2]])
    occurs, score, promoted = collections.Counter(words), {f: float(f in seed_forms) for _, f in edges}, {}
    for _ in range(100):
        promoted = {}
        for left in {k for k, _ in edges}:
            forms = [(f, n) for (k, f), n in edges.items() if k == left]
            rate = sum(n * score[f] for f, n in forms) / occurs[left] if occurs[left] else 0
            if rate >= pii.LEAST_SCORE and sum(score[f] >= pii.LEAST_SCORE for f, _ in forms) >= pii.LEAST_INSTANCES:
                promoted[left] = rate
        score = {f: max([float(f in seed_forms), *(min(1.0, promoted[k]) for (k, g) in edges if g == f and k in promoted)]) for f in score}
    return [[(a, b) for a, b, left, _ in mine if left in promoted] for mine in tokens]


def test_contextual_spans_are_those_of_the_definition(spark):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choices("abcdefg", k=4)) + str(rnd.randrange(100))
    say = [
        lambda: f"contact: {name()}@mail.com", lambda: f"contact: {name()}-host,", lambda: f"user={name()}", lambda: f"user='{name()}@x.org'", lambda: f"the {name()}x", lambda: "the end.",
        lambda: f"Ticket # {name()}99", lambda: f"ticket # {name()}@a.bc", lambda: f"(see {name()}!!)", lambda: f"host {rnd.randrange(256)}.1.2.{rnd.randrange(300)}", lambda: f"host {name()}:80", lambda: "été \U0001f600 a=b",
    ]
    weights = [4, 1, 1, 4, 1, 3, 1, 4, 1, 2, 1, 1]
    texts = ["  ".join(rnd.choices(say, weights)[0]() for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    expected = brute_context(texts)
    assert sum(map(len, expected)) > 20
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        more = [f"context:{a}:{b}" for a, b in expected[k]]
        assert [x for x in got[k].spans.split(",") if x.startswith("context")] == more
        out, spans = [], sorted((int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0]), int(x.split(":")[2]), x.split(":")[0]) for x in got[k].spans.split(",") if x)
        last = i = 0
        while i < len(spans):
            start, end, kind = spans[i][0], spans[i][2], spans[i][3]
            while i < len(spans) and spans[i][0] < max(end, start + 1):
                end, i = max(end, spans[i][2]), i + 1
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
        assert masked[k] == "".join(out) + text[last:]


def test_time_grows_with_the_text(spark):
    import time

    unit = "mail a%d@mail.com or 10.0.0.1 and +1 (555) 555-0100 to x77-y é the 4111 1111 1111 1111 end "
    took = []
    for n in (200, 2_000, 8_000):
        text = "".join(unit % i for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.personal_data(docs).first()
        masked = pii.mask(docs).first().text
        took.append(time.perf_counter() - began)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n, n, n, n)
        assert masked == "mail [EMAIL] or [IP] and [PHONE] to x77-y é the [CARD] end " * n or "[CONTEXT]" in masked
    assert took[2] < 8 * (took[1] + 1)
