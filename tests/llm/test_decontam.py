from orrery.llm import decontam
from orrery.llm.decontam import brute


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_is_the_definition(spark, documents, texts, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = brute(list(texts.items()), [(r.item_id, r.text) for r in items.collect()])
    found = rows(decontam.contamination(documents, items))
    assert found == sorted(expected) and any(r[5] for r in found)
    # A benchmark of many blocks gives the same.
    assert rows(decontam.contamination(documents, items, block_bytes=3000)) == found


def test_short_items_case_and_marks(spark):
    items = spark.createDataFrame([(1, "Alpha, BETA"), (2, "?!"), (3, None), (None, "gamma"), (4, "ÉTÉ"), (1, "Alpha, BETA"), (5, "a b c d e f g h i j k")], "item_id long, text string")
    docs = [(1, "x alpha-beta beta ALPHA BETA"), (2, "gamma"), (3, "ÉTÉ"), (4, "été"), (5, "a b c d e f g h i j"), (6, "b c d e f g h i j k x a b c d e f g h i j")]
    found = rows(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items))
    assert found == sorted(brute(docs, [tuple(r) for r in items.collect()]))
    assert {r[0]: r[2] for r in found} == {1: 4, 2: 0, 3: 1, 4: 0, 5: 10, 6: 20}


def test_removes_what_it_finds(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = decontam.decontaminate(documents, items)
    assert clean.columns == documents.columns
    assert decontam.contamination(clean, items).where("contaminated").count() == 0
    touched = {r.doc_id for r in decontam.contamination(documents, items).where("contaminated").collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (documents, clean))
    assert all(before[d] == t for d, t in after.items() if d not in touched)
    assert set(before) - set(after) <= touched


def test_blocks_cut_as_one(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    cut = lambda docs, items, size: rows(decontam.decontaminate(docs, items, block_bytes=size).select("doc_id", "text"))
    assert cut(documents, items, 3000) == cut(documents, items, 16 << 20)
    # Windows of several items overlap in a text, and two items hit 30 % of another each.
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(k, " ".join(words[k : k + 12])) for k in range(0, 28, 4)] + [(100, "a1 a2 a3"), (101, "b1 b2 b3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " * 30 + " ".join(words) + " z"), (2, "a1 a2 a3 c d b1 b2 b3 e f"), (2, "a1 a2 a3 c d b1 b2 b3 e f"), (3, "x"), (None, None)], "doc_id long, text string")
    docs = docs.repartition(1)
    one = decontam.decontaminate(docs, items)
    many = decontam.decontaminate(docs, items, block_bytes=20)
    assert len(decontam.blocks(items, 20)) > 5 and many.columns == docs.columns
    both = [sorted(((r.doc_id, r.text) for r in x.collect()), key=str) for x in (one, many)]
    assert both[0] == both[1] == sorted([(1, "x y " * 30 + " " + " ".join(words[36:]) + " z"), (3, "x"), (None, None)], key=str)


def test_edge_cases(spark, odd, empty):
    items = spark.createDataFrame([(9, "nine ten eleven")], "item_id long, text string")
    found = decontam.contamination(odd, items).collect()
    assert len(found) == odd.count() and sum(r.contaminated for r in found) == 2
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(odd, items).count() == odd.count()
    assert decontam.contamination(odd, items, block_bytes=1).count() == odd.count()


def test_what_is_broadcast_is_bounded_by_the_block():
    import pickle
    import random

    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(1, 6))) for _ in range(200_000))
    windows = decontam.Windows([(1, text[: len(text) // 2]), (2, text[len(text) // 2 :]), (3, "one two"), (4, None), (None, "x")])
    assert len(pickle.dumps(windows, 5)) < 9 * len(text) + (13 << 20)
    words = decontam.words_of(text)
    mixed = b" . ".join(words[50:60] + [b"One", b"TWO"] + words[150_000:150_009]).decode()
    assert windows.scan(mixed) == (21, [[0, 12]], {"1", "3"})
    assert decontam.Windows([]).scan("a b") == (2, [], set()) and windows.scan(None) == (0, [], set())


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    text = ("ab  cd é" + "x" * 9000 + " ab Cd " * 300 + "").encode().lower()
    starts, ends, values = decontam._hashed(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    monkeypatch.setattr(decontam, "CHUNK", 7)
    for one, other in zip(decontam._hashed(text), (starts, ends, values)):
        assert (one == other).all()
    assert len(set(values.tolist())) == len(set(text.split())) and decontam._hashed(b"  ")[0].size == 0
