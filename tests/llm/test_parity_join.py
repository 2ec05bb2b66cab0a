import random
import re
from collections import Counter

from graphloom.llm import parity_join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    """Rows of an id have the links of all their sets; each has its own size."""
    items = [(doc, shingles(text, k)) for doc, text in rows]
    root = {d: d for d, _ in items}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((d, len(x), find(d)) for d, x in items), key=str)


def found(got):
    return sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (1003, "One two"), (1004, "one TWO"), (1005, "a b c d")]
    for doc in range(0, 240, 4):
        words = rng.choices(vocab, k=rng.choice([3, 6, 20, 60, 200]))
        for j in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((doc + j, " ".join(copy)))
    for k, percent in ((4, 85), (5, 80)):
        got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
        assert found(got) == brute(rows, k, percent)


def test_empty_table(spark):
    assert parity_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_large_group_of_which_few_pairs_link(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    first, rows = rng.choices(vocab, k=150), []
    for doc in range(300):
        copy = list(first)
        for _ in range(rng.choice([1, 3, 4, 5, 6, 12])):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((doc, " ".join(copy)))
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    expected = brute(rows, 4, 85)
    assert len({c for _, _, c in expected}) > 10
    assert found(got) == expected


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_that_defeat_power_series(spark):
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    rows = [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} p q r {b} p q r")]
    assert found(parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)) == brute(rows, 4, 85) == [(1, 1, 1), (2, 1, 2), (3, 5, 3)]


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for k, percent in ((4, 85), (5, 80)):
        assert found(parity_join.near_duplicates(docs, k, percent)) == brute(rows, k, percent)


def test_repeated_and_null_ids_and_long_texts(spark):
    texts = {c: " ".join(f"{c}{i % 70}" for i in range(90)) for c in "abc"}
    near = {c: t.replace(f"{c}5 ", "other ", 1) for c, t in texts.items()}
    long = " ".join(str(i * i) for i in range(60_000))
    rows = [(5, texts["a"]), (5, texts["b"]), (5, texts["b"]), (2, near["a"]), (7, near["b"]), (9, texts["c"]), (None, texts["c"]), (None, None), (8, near["c"])]
    rows += [(20, long), (21, long + " end"), (22, long.replace("9 ", "8 ", 9000))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key long, keys string")
    assert found(parity_join.near_duplicates(docs, 4, 85)) == brute(rows, 4, 85)
    left = Counter(r.doc_id for r in parity_join.representatives(docs, 4, 85).collect())
    assert left == Counter([2, 8, None, None, 20, 22])


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "HOT_COPIES", 20)
    rows = [(i, "one text with several words in it") for i in range(50)] + [(100 + i, f"other text {i // 2} with words") for i in range(10)] + [(200, "")]
    assert found(parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)) == brute(rows, 4, 85)
