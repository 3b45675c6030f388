import json
import random

import numpy as np

from vitaeloom.llm.nearcopies import BITS, Fingerprints, _words, classes, json_text, key_pairs, near_copies, recall, tables_for

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]


def edit(words, n):
    words = list(words)
    for _ in range(n):
        i = RNG.randrange(len(words))
        words[i] = RNG.choice(WORDS)
    return words


def brute(rows):
    sets = []
    for tab, key, text, is_json in dict.fromkeys(rows):
        if text is None:
            continue
        w = _words([json_text(text) if is_json else text])[0]
        sets.append((tab, key, set(zip(w, w[1:], w[2:]))))
    out = set()
    for i, (t, a, x) in enumerate(sets):
        for u, b, y in sets[:i]:
            if t == u and a != b and x | y and len(x & y) / len(x | y) > 0.5:
                out.add((t, min(a, b), max(a, b)))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "tab string, key string, text string, is_json boolean")
    return {(r["tab"], r["key_a"], r["key_b"]) for r in key_pairs(*near_copies(df)).collect()}


def test_equals_brute_force(spark):
    rows = []
    for g in range(40):
        base = [RNG.choice(WORDS) for _ in range(120)]
        for v in range(RNG.randint(1, 4)):
            rows.append(("t", f"{g}-{v}", " ".join(edit(base, RNG.randint(0, 6))), False))
    rows += [("t", "0-0c", rows[0][2].upper() + "!!", False), ("u", "other", rows[0][2], False), ("t", "null", None, False), ("t", "short", "two words", False), ("t", "empty", "", False), rows[3], rows[3]]
    assert run(spark, rows) == brute(rows)


def test_json_form(spark):
    text = " ".join(RNG.choice(WORDS) for _ in range(60)) + " é"
    a, b = json.dumps({"x": text, "y": [1, 2]}), json.dumps({"y": [1, 2], "x": text}, ensure_ascii=False, indent=3)
    assert run(spark, [("j", "a", a, True), ("j", "b", b, True), ("j", "c", "{broken", True)]) == {("j", "a", "b")}


def test_a_hot_group_of_copies(spark):
    text = " ".join(RNG.choice(WORDS) for _ in range(50))
    rows = [("t", f"{i:03}", text, False) for i in range(120)] + [("t", "x", " ".join(edit(text.split(), 1)), False)]
    assert len(run(spark, rows)) == 121 * 120 // 2


def test_empty(spark):
    assert run(spark, []) == set()


def test_each_pair_meets_once_in_a_table():
    rng = np.random.default_rng(1)
    for d in (0, 1, 2):
        for _ in range(50):
            x = int(rng.integers(0, 1 << BITS))
            y = x
            for i in rng.choice(BITS, d, replace=False):
                y ^= 1 << int(i)
            ball = lambda v: {f: v if f < 0 else v ^ 1 << f for f in range(-1, BITS)}
            met = sum(a == b and (f < 0 or g > f) for f, a in ball(x).items() for g, b in ball(y).items() if (f < 0 and g < 0) == (d == 0) or d == 2 or (f < 0 or g > f))
            kept = [(f, g) for f, a in ball(x).items() for g, b in ball(y).items() if a == b and (f < 0 or g > f)]
            assert kept and met >= 1 and (len(kept) == 1)


def test_classes(spark):
    base = [RNG.choice(WORDS) for _ in range(80)]
    rows = [("t", "a", " ".join(base), False), ("t", "b", " ".join(base).upper(), False), ("t", "c", " ".join(edit(base, 2)), False), ("t", "d", " ".join(RNG.choice(WORDS) for _ in range(80)), False), ("t", "e", None, False)]
    df = spark.createDataFrame([*rows, rows[0]], "tab string, key string, text string, is_json boolean")
    got = {r["key"]: (r["class_id"], r["links"]) for r in classes(*near_copies(df)).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"][0] == got["b"][0] == got["c"][0] != got["d"][0]
    assert [got[k][1] for k in "abcd"] == [2, 2, 2, 0]


def test_recall_of_the_formula():
    n = tables_for(0.5, 0.92)
    assert recall(0.5, n, sketch_most=48) >= 0.919 and recall(0.6, n, sketch_most=48) > 0.98 and recall(0.75, n) > 0.999


def test_recall_for_edits_insertions_and_blocks():
    rng = np.random.default_rng(5)
    tables = tables_for(0.5, 0.92)
    prints = Fingerprints(tables)
    new = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)

    def sequences(words):
        h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = h[:-2] * np.uint64(3) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[2:] >> np.uint64(7))
        return np.unique((x ^ x >> np.uint64(32)).astype(np.uint32))

    for kind in ("edits", "insertions", "block"):
        for length in (40, 300):
            met = close = 0
            while close < 200:
                w = new(length)
                if kind == "block":
                    n = int(length * 0.31)
                    at = int(rng.integers(0, length - n))
                    v = np.concatenate([w[:at], new(n), w[at + n :]])
                elif kind == "edits":
                    v = w.copy()
                    at = rng.choice(length, max(1, int(length * 0.115)), replace=False)
                    v[at] = new(len(at))
                else:
                    at = rng.choice(length, max(1, int(length * 0.13)), replace=False)
                    v = np.insert(w, at, new(len(at)))
                a, b = sequences(w), sequences(v)
                j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                if not 0.5 < j < 0.56:
                    continue
                close += 1
                p, s = prints([a, b], np.zeros(2, np.uint64))
                near = any(bin(int(x ^ y) & 2**64 - 1).count("1") <= 2 and x >> BITS == y >> BITS for x, y in zip(*p))
                met += near and sum(bin(int(x ^ y) & 2**64 - 1).count("1") for x, y in zip(*s)) <= 48
            assert met / close >= 0.9, (kind, length, met / close)


def test_plan_shuffles_variants_and_sequences(spark):
    rows = [("t", str(i), " ".join(RNG.choice(WORDS) for _ in range(20)), False) for i in range(5)]
    seen = []
    import vitaeloom.llm.nearcopies as module

    kept = module.durable
    module.durable = lambda df: seen.append(df) or kept(df)
    try:
        near_copies(spark.createDataFrame(rows, "tab string, key string, text string, is_json boolean"))
    finally:
        module.durable = kept
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3


def test_variants_are_not_shuffled(spark):
    rows = [("t", str(i), " ".join(RNG.choice(WORDS) for _ in range(150)), False) for i in range(200)]
    rows += [("t", f"{i}x", " ".join(edit(rows[i][2].split(), 2)), False) for i in range(20)]
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        stages = jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)
        return {(x.stageId(), x.attemptId()): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in stages}

    old = set(written())
    assert len(run(spark, rows)) == 20
    new = [x for k, x in written().items() if k not in old]
    # Each text by its fingerprints, not by their variants; sequences of those only that met.
    assert sum(n for n, _ in new) < 25 * len(rows) and sum(n for _, n in new) < 1500 * len(rows)


def test_meeting_equals_brute_force(monkeypatch):
    import vitaeloom.llm.nearcopies as module

    monkeypatch.setattr(module, "COMPARED", 50)
    monkeypatch.setattr(module, "HANDLED", 100)
    rng = np.random.default_rng(3)
    n, most, finer = 600, 48, module.finer_most(0.5)
    prints = (rng.choice([-7, 3, 4, *range(100, 200)], n, p=[0.3, 0.3, 0.1, *[0.003] * 100]) << BITS) + rng.choice([0, 1, 3, 7, 8, 4095], n)
    bases = rng.integers(-(2**63), 2**63 - 1, (4, 6))
    sketches = bases[rng.integers(0, 4, n)] ^ (np.int64(1) << rng.integers(0, 60, (n, 6)))
    sketches[:100, 2:] = 0
    same = rng.integers(0, 500, n)
    order = np.lexsort((same, prints))
    cols = [prints[order], same[order], *sketches[order].T]
    batches = [module.pa.RecordBatch.from_arrays([module.pa.array(c[i : i + 37]) for c in cols], [str(k) for k in range(8)]) for i in range(0, n, 37)]
    got = {(a, b) for r in module._meet(most, finer)(iter(batches)) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
    once = [i for i in range(n) if not i or (cols[0][i], cols[1][i]) != (cols[0][i - 1], cols[1][i - 1])]
    bits = lambda x: bin(int(x) & 2**64 - 1).count("1")
    want = set()
    for i in once:
        for j in once:
            if cols[1][i] < cols[1][j] and cols[0][i] >> BITS == cols[0][j] >> BITS and bits(cols[0][i] ^ cols[0][j]) <= 2:
                off = [c[i] ^ c[j] for c in cols[2:]]
                short = not cols[4][i] or not cols[4][j]
                if bits(off[0]) + bits(off[1]) <= most and (short or bits(off[0] | off[2] | off[4]) + bits(off[1] | off[3] | off[5]) <= finer):
                    want.add((int(cols[1][i]), int(cols[1][j])))
    assert {x for x in got if x[0] != x[1]} == want and want
