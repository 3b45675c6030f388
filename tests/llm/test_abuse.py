import itertools
import random

import numpy as np
import pytest

from vitaeloom.llm.abuse import Features, Field, chunks_of, counted_numbers, pair_numbers, places_of, score_documents, source_rates, tokens_of, train_field, unmask

FINE = ["The index starts at one.", "Use a left join.", "Restart the job and look at the log.", "It took me two hours to see it.", "That parser is stupidly slow but it works.", "I felt like an idiot when I found the comma.", "Kill the parent process first.", "Thanks for the long answer."]
BAD = ["You are a worthless {} and everyone knows it.", "Shut your mouth, you {}.", "Nobody would miss you, {}.", "What a {} lol, get lost."]
WHO = ["moron", "idiot", "loser", "clown", "parasite"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.35
        parts = rng.choices(FINE, k=rng.randint(1, 4))
        if bad:
            parts.insert(rng.randint(0, len(parts)), rng.choice(BAD).format(rng.choice(WHO)))
        rows.append((i, " ".join(parts), rng.choice(["a", "b", None]), bad))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, t, s, 0.5) for i, t, s, _ in rows] + [(-1, None, "a", 0.5), (-2, "", "a", 0.5), (-3, "fine " * 3000, "a", 0.5)], "doc_id bigint, text string, source string, score double")
    labels = [(i, int(b != (rng.random() < 0.05))) for i, _, _, b in rows[:400]]
    labels = spark.createDataFrame([*labels, (1, None), (10**9, 1)], "doc_id bigint, verdict int")
    scored = score_documents(docs, labels).cache()
    got = {r["doc_id"]: r for r in scored.collect()}
    held = rows[400:]
    right = [(got[i]["score"] >= 0.5) == b for i, _, _, b in held]
    assert sum(right) / len(right) > 0.97
    assert got[-1]["score"] == got[-2]["score"] == 0.0 and got[-3]["score"] < 0.5
    i, text, _, _ = next(r for r in held if r[3] and got[r[0]]["passages"])
    span = got[i]["passages"][0]
    assert any(w in text[span["start"] : span["end"]] for w in WHO)
    rates = {r["source"]: r for r in source_rates(scored, docs).collect()}
    assert set(rates) == {"a", "b", None} and all(0 < r["rate"] < 0.6 for r in rates.values())


def test_needs_both_kinds():
    with pytest.raises(ValueError):
        train_field(["a", "b"], [0, 0])


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "You moron", "a")], "doc_id bigint, text string, source string")
    for rows in ([], [(1, 1)], [(1, None)], [(1, 0), (1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, verdict int")
        assert [(r["score"], r["passages"]) for r in score_documents(docs, labels).collect()] == [(0.0, [])]
    assert score_documents(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id bigint, verdict int")).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    field = Field(moves=rng.normal(size=(2, 2)))
    rows = [rng.normal(size=n) for n in (1, 4, 6)]
    p, mask, moves, z = field.marginals(rows)
    told = np.zeros((2, 2))
    for k, s in enumerate(rows):
        weights = {}
        for y in itertools.product((0, 1), repeat=len(s)):
            weights[y] = np.exp(sum(v for v, b in zip(s, y) if b) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        assert np.isclose(np.log(total), z[k])
        for i in range(len(s)):
            assert np.isclose(p[k, i], sum(w for y, w in weights.items() if y[i]) / total)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                told[a, b] += w / total
    assert np.allclose(told, moves)


def test_disguises():
    assert [unmask(w) for w in ("l0ser", "scumb@g", "looooser", "i d i o t", "IDIOT", "123", "m***n")] == ["loser", "scumbag", "loser", "idiot", "idiot", "9", "m*n"]
    words, places = tokens_of("You i d i o t, no!"), places_of("You i d i o t, no!")
    assert words == ["You", "i d i o t", ",", "no", "!"] and places[1] == (4, 13)
    (features,) = Features()([words])
    assert len(features) == 5


def test_features_of_a_document_stand_alone():
    reader, docs = Features(), [["ape", "bee"], [], ["cat", "ape", "bee", "."]]
    together = reader(docs)
    for d, f in zip(docs, together):
        assert (Features()([d])[0] == f).all() if d else len(f) == 0


def test_counts_of_sentences():
    numbers, is_pair, n = counted_numbers(Features(), ["Ape bee. Ape ape bee!", None, "", "bee ape"])
    word = Features().stack([["ape", "bee", "ape"]])[0][2:5, 0]
    got = {(int(x), bool(p)): int(c) for x, p, c in zip(numbers, is_pair, n)}
    ab, ba = pair_numbers(word)
    assert got[(0, False)] == 3 and got[(int(word.view("int64")[0]), False)] == 3 and got[(int(ab), True)] == 2 and got[(int(ba), True)] == 1


def test_chunks_are_bounded():
    sizes = [0, 5, 1000, 7, 3, 900]
    chunks = chunks_of(sizes, 1000)
    assert sorted(i for c in chunks for i in c) == [1, 2, 3, 4, 5] and all(len(c) == 1 or len(c) * max(sizes[i] for i in c) <= 1000 for c in chunks)
