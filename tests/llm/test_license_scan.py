import random
import re

from orrery.llm import license_scan


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_base_is_the_definition(documents, texts):
    rows = license_scan.scan(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, places = brute(texts[r.doc_id])
        labels = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_overlapping_places_and_marks():
    s = license_scan.Scanner()
    assert s.scan("CC-BY cc by, CC  BY all-rights RESERVED")["base"] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by"), (6, "reserved")]
    assert s.scan("cc bye acc by")["base"] == []


def edits(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(1, len(text) - 1)
        text = rnd.choice((text[:i] + text[i + 1 :], text[:i] + rnd.choice("qxz") + text[i:], text[:i] + rnd.choice("qxz") + text[i + 1 :]))
    return text


def test_edits_within_the_bound_are_found():
    rnd, s = random.Random(4), license_scan.Scanner()
    prose = " ".join("ereth onou thing wher and the".split() * 20)
    for notice, label, bound, _ in s.notices:
        for n in range(bound + 1):
            spans = s.scan(f"{prose}\n{edits(rnd, notice, n).upper()}. {prose}")["spans"]
            assert any(x[2] == label or x[3] <= n for x in spans), (notice, n)
    assert s.scan(prose)["spans"] == []


def test_longer_notices_stay_beside_exact_shorter_ones():
    labels = lambda text: {x[2] for x in license_scan.Scanner().scan(f"Work {text} here")["spans"]}
    assert labels("licensed under a creative commons attribution share alike") == {"cc-by", "cc-by-sa"}
    assert labels("licensed under the apache license verison 2 0") == {"apache", "apache-2.0"}
    # A hit with edits inside an exact one still gives way.
    spans = [(2, 9, "a", 0, 1.0), (2, 9, "b", 2, 0.9), (3, 8, "c", 1, 0.9), (3, 10, "d", 1, 0.9), (8, 9, "e", 0, 1.0)]
    assert [x[2] for x in license_scan._best(spans)] == ["a", "d", "e"]


def test_spans_and_edits_are_reported():
    spans = license_scan.Scanner().scan("Intro words. Relesed undr the MIT Licence!")["spans"]
    assert spans == [(2, 7, "mit", 3, 0.9)]


def least_edits(notice, text):
    """The fewest edits between notice and whole words of text, by the table of all of them."""
    row = [0 if i == 0 or text[i - 1] == " " else 10**6 for i in range(len(text) + 1)]  # spans start with words
    for a in notice:
        new = [row[0] + 1]
        for i, b in enumerate(text):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (a != b)))
        row = new
    return min(x for i, x in enumerate(row) if i == len(text) or text[i] == " ")


def test_one_notice_against_the_table_of_edits():
    rnd, notice = random.Random(6), "released under the mit license"
    scanner = license_scan.Scanner({notice: "mit"}, {})
    bound = scanner.notices[0][2]
    n_found = 0
    for _ in range(300):
        text = f"{rnd.choice(('we', 'mit', 'the license'))} {edits(rnd, notice, rnd.randint(0, 6))} {rnd.choice(('x', 'license', 'mit'))}"
        text = " ".join(text.split())
        least, spans = least_edits(notice, text), scanner.scan(text)["spans"]
        assert (min((s[3] for s in spans), default=None) == least) if least <= bound else not spans, text
        n_found += bool(spans)
    assert 100 < n_found < 300


def test_neighbouring_notices_are_all_found_in_linear_time():
    import time

    scanner, took = license_scan.Scanner(), []
    assert [s[:4] for s in scanner.scan("released under the mitt license released under the mit license")["spans"]] == [(0, 5, "mit", 1), (5, 10, "mit", 0)]
    for n in (1_000, 1_000, 8_000):
        began = time.perf_counter()
        found = scanner.scan("released under the mitt licenze and all rights reserved " * n)
        took.append(time.perf_counter() - began)
        assert [s[0] for s in found["spans"] if s[2] == "mit"] == list(range(0, 9 * n, 9)) and len(found["base"]) == n
    assert took[2] < 16 * took[1]


def test_edge_cases(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.n_words, r.n_base, r.labels, r.score, r.first_word) == (0, 0, "", 0.0, None) for r in rows if r.doc_id in (2, 3, 4))
    assert license_scan.scan(empty).count() == 0
