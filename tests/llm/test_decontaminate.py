import random

from idloom.llm import decontaminate as d

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


def brute(item, text):
    """Least edit distance between the item and a part of the text, by the table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def phrases(r, n):
    return " ".join("".join(r.choices(["the", "tion", "er", "on", "ed", "sh"], k=r.randrange(1, 4))) for _ in range(n))


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + 1] = r.choice([[], ["x"], [t[i], "y"]])
    return "".join(t)


def test_distance():
    r = random.Random(1)
    for _ in range(40):
        item, window = phrases(r, 8), phrases(r, 12)
        assert d.distance(d.prepared(1, item, 0.1), window) == brute(item, window)


def test_against_brute_force(spark):
    r = random.Random(2)
    items = [(i, phrases(r, r.randrange(8, 30)), 0) for i in range(12)]
    docs = []
    for i in range(120):
        body = phrases(r, 40)
        if i % 3:
            t = items[i % 12][1]
            body += "  \n" + edited(r, t, int(len(t) * r.choice([0, 0.03, 0.08, 0.1, 0.14]))).upper() + " " + phrases(r, 5)
        docs.append((i, body, "x"))
    want = {(i, j, v) for i, t, _ in docs for j, x, _ in items if (v := brute(d.normal(x), d.normal(t))) <= d.budget(len(d.normal(x)))}
    assert len(want) > 40
    for block in (1 << 20, 300):
        got = d.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), ["doc_id"], block=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in d.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=300).collect()}
    assert kept == {i for i, _, _ in docs} - {i for i, _, _ in want}


def test_short_null_and_repeated(spark):
    items = [(1, "yes", 0), (2, None, 0), (3, " ", 0), (4, "", 0), (5, "Yes", 0), (None, "q" * 60, 0)]
    docs = [(1, "Well, YES.", "x"), (2, "eyes", "x"), (3, None, "x"), (4, "", "x"), (1, "Well, YES.", "x"), (None, "yes", "x"), (6, "a b " * 50000 + "q" * 58, "x")]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in d.leaks(*frames, ["doc_id"]).collect())
    assert got == [(0, 1, 0), (0, 5, 0), (1, 1, 0), (1, 1, 0), (1, 5, 0), (1, 5, 0), (6, 0, 2)]
    assert sorted(r.doc_id for r in d.clean(*frames).collect()) == [2, 3, 4]
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.leaks(none[0], frames[1], ["doc_id"]).collect() == [] and d.leaks(frames[0], none[1], ["doc_id"]).collect() == []
    assert d.clean(frames[0], none[1]).count() == len(docs)
