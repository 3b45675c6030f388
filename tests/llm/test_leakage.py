import random

from pyspark.sql import functions as F

from vitaeloom.llm.leakage import align, contains, item_passages, leaked_items, longest_stretch, words_of

RNG = random.Random(6)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]


def some(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_stretches():
    item = some(40)
    swap = lambda w, *at: [x if i not in at else "zzz" for i, x in enumerate(w)]
    noise = some(30)
    assert contains(noise + item[5:20] + noise, item, 15, 2)
    assert not contains(noise + item[5:19] + noise, item, 15, 2)
    assert contains(noise + swap(item[5:22], 4, 9) + noise, item, 15, 2)
    assert not contains(noise + swap(item[5:20], 4, 7, 10) + noise, item, 15, 2)
    assert not contains(item[:8] + noise + item[8:16], item, 15, 2)
    assert not contains(list(reversed(item)), item, 15, 2)
    assert not contains([], item, 15, 2)
    assert longest_stretch([(i, i) for i in range(15)], 15, 2) == 15


def test_second_place_counts():
    item = some(60)
    assert contains(item[:12] + some(40) + item[30:46], item, 15, 2)


def test_found(spark):
    items = [(i, " ".join(some(45)) + ". Show each step of your working.", " ".join(some(30)) + ".", "clash") for i in range(12)]
    q = words_of([items[3][1]])[0]
    marked = "> " + " ".join(f"<b>{w.upper()}</b>" if k % 4 == 0 else w for k, w in enumerate(q[10:30]))
    docs = [(1, marked), (2, " ".join(some(200))), (3, "Show each step of your working. " + " ".join(q[30:41]) + " show each step of your working"), (4, None), (5, ""), (6, " ".join(words_of([items[7][2]])[0])), (6, " ".join(words_of([items[7][2]])[0])), (None, marked)]
    passages = item_passages(spark.createDataFrame(items, "item_id int, question string, reference_answer string, text string"), "item_id", ["question", "reference_answer"])
    assert passages.where("text like '%each step%'").count() == 0
    found = leaked_items(spark.createDataFrame(docs, "doc int, text string").withColumn("item", F.lit(0)).drop("item"), passages)
    assert sorted((r["doc"], r["item"]) for r in found.collect()) == [(1, 3), (6, 7)]
    none = leaked_items(spark.createDataFrame([], "doc int, text string"), passages)
    assert none.count() == 0
    assert leaked_items(spark.createDataFrame(docs, "doc int, text string"), passages.limit(0)).count() == 0


def test_alignment_skips_words():
    import numpy as np

    assert align(np.array([9, 1, 2, 8, 3, 4]), np.array([1, 2, 3, 4])) == [(0, 1), (1, 2), (2, 4), (3, 5)]


def test_common_run_may_be_all_that_is_left(spark):
    common = some(5)
    items = [(i, "q", " ".join([*some(12), *common, *some(12)])) for i in range(30)]
    w = items[8][2].split()
    docs = [(1, " ".join([*some(20), *w[7:11], "zzz", *common, "zzz", *w[18:22], *some(20)])), (2, " ".join([*some(20), *common, *some(20)]))]
    found = leaked_items(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, part string, text string"))
    assert [(r["doc"], r["item"]) for r in found.collect()] == [(1, 8)]


def test_shorter_quotations_do_not_hide_a_stretch():
    item = some(80)
    stretch = [*item[60:64], "zzz", *item[65:70], "zzz", *item[71:75]]
    for n in (12, 13, 14):
        quotes = [w for i in range(9) for w in [*item[i * 4 : i * 4 + n], *(["noise"] * 40)]]
        assert not contains(quotes, item, 15, 2)
        assert contains(quotes + stretch, item, 15, 2)
        assert contains(stretch + ["noise"] * 40 + quotes, item, 15, 2)


def plain_stretch(doc, item, stretch=15, replaced=2):
    """All stretches without gaps, by definition."""
    for shift in range(-len(item), len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == item[i] for i in range(len(item))]
        for a in range(len(item)):
            for z in range(a + stretch, len(item) + 1):
                if same[a] and same[z - 1] and all(sum(same[k : k + stretch]) >= stretch - replaced for k in range(a, z - stretch + 1)):
                    return True
    return False


def test_equals_brute_force_without_gaps():
    for n in range(300):
        item = some(40)
        start, length = RNG.randrange(20), RNG.randint(12, 20)
        quote = item[start : start + length]
        for i in RNG.sample(range(length), RNG.randint(0, 3)):
            quote[i] = f"other{i}"
        doc = some(RNG.randrange(30)) + quote + some(RNG.randrange(30))
        assert contains(doc, item, 15, 2) == plain_stretch(doc, item), (n, quote, item)


def test_join_gives_the_same(spark):
    items = [(i, "q", " ".join(some(45))) for i in range(10)]
    docs = [(k, " ".join(some(30) + items[k % 10][2].split()[5 : 5 + 10 + k % 9] + some(30))) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, part string, text string")
    want = {(k, k % 10) for k in range(60) if 10 + k % 9 >= 15}
    for most in (0, 500_000):
        assert {(r["doc"], r["item"]) for r in leaked_items(d, i, most_seeds=most).collect()} == want


def test_a_very_long_document():
    item = some(60)
    doc = ["noise", *item[:12]] * 3000 + item[20:36]
    assert contains(doc, item, 15, 2) and not contains(doc[:-2], item, 15, 2)


def test_words_put_in_and_left_out():
    item = some(50)
    assert contains(some(9) + item[5:13] + ["put", "in"] + item[13:22] + some(9), item, 15, 2)
    assert contains(some(9) + item[5:13] + item[14:23] + some(9), item, 15, 2)
