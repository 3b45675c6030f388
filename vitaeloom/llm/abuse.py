"""Abusive, hateful and sexual passages, tagged by a linear-chain conditional random field.

Verdicts are given for whole documents and some are wrong, so the tokens are labelled first, from the
verdicts alone: of the sentences of a document judged abusive about one is, sooner one that is unusual in
the corpus; those of other documents count as fine; expectation-maximisation of a two-class model of words and
word pairs settles which sentences are toxic, and their tokens carry the label. No word list takes part. The field is
trained on these sequences on the driver, from at most `most_labelled` documents of either verdict (a documented
bound; the rest of the labels is not needed). Every document of the corpus is then tagged; forward-backward
marginals give the score of a document (its strongest run of tokens) and the offsets of the offending passages.

Features are numbers computed by array operations over all tokens of a batch; only distinct words are read in Python.

Offsets count characters of the text in its one form (see codepoints). Defined results: null and empty
texts score 0 and have no passages; repeated reviews count as often as they occur; documents with as
many verdicts for as against are not used; without labels of both kinds everything scores 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold_texts
from vitaeloom.llm.strings import plain
from vitaeloom.session import durable

LEET = str.maketrans("0134578@$", "oieastbas")
TOKEN = re.compile(r"(?:(?<![^\W_])[^\W\d_] ){2,}[^\W\d_](?![^\W_])|[^\W_]+(?:[@$*'’_-]+[^\W_]+)*|[.!?…]+|\n+|[^\w\s]")
SPACE = 1 << 18
END = re.compile(r"[.!?\n…]")
# Cells of the padded arrays of one forward-backward pass.
CELLS = 1 << 20
# Share of abusive sentences before any evidence, and how much sooner a document is judged abusive if it has one.
RARE, WRONG = 0.01, 0.05
FULL_STOP = np.uint64(xxhash.xxh64_intdigest("."))


def unmask(word: str) -> str:
    """A plain reading of a disguised word: without accents, digits and signs as letters, spaced letters joined, long repeats as one letter."""
    w = plain(word)
    if " " in w:
        return w.replace(" ", "")
    if "*" in w:
        return re.sub(r"\*+", "*", w)
    if re.search(r"[a-z]", w) and re.search(r"[0-9@$]", w):
        w = w.translate(LEET)
    w = re.sub(r"(.)\1{2,}", r"\1", w)
    return re.sub(r"\d+", "9", w)


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text)


def places_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of numbers, element by element."""
    x = np.full(1, 0x2545F4914F6CDD1D, np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ x >> np.uint64(29)
    return x


class Features:
    """Numbers of the features of each token. `common` has the pairs of words that many documents hold, sorted."""

    def __init__(self, common: np.ndarray | None = None) -> None:
        self.common = np.empty(0, np.int64) if common is None else np.sort(common)
        self.read: dict[str, tuple[str, int]] = {}
        self.rows: list[tuple[int, int, int, int]] = []

    def words(self, tokens: list[str]) -> list[str]:
        return [self._known(t)[0] for t in tokens]

    def _known(self, token: str) -> tuple[str, int]:
        found = self.read.get(token)
        if found is None:
            w = "." if END.match(token) else unmask(token)
            number = lambda x: xxhash.xxh64_intdigest(x)
            self.rows.append((number(w), number("p" + w[:4]), number("s" + w[-3:]), number(f"k{w[0]}{len(token.replace(' ', ''))}{w[-1]}")))
            found = self.read[token] = (w, len(self.rows) - 1)
        return found

    def stack(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all tokens, (n, 4), with two rows of zeros before, between and after documents, and the rows of the tokens."""
        if len(self.read) > 500_000:
            self.read.clear()
            self.rows.clear()
        at = np.fromiter((self._known(t)[1] for d in docs for t in d), np.int64)
        sizes = np.array([len(d) for d in docs], np.int64)
        place = np.arange(len(at)) + 2 * (1 + np.repeat(np.arange(len(docs)), sizes))
        out = np.zeros((len(at) + 2 * (len(docs) + 1), 4), np.uint64)
        if len(at):
            out[place] = np.array(self.rows, np.uint64)[at]
        return out, place

    def usual(self, hashes: np.ndarray) -> np.ndarray:
        """For each row: is the pair that it forms with the next one common?"""
        pair = pair_numbers(hashes)
        at = np.minimum(np.searchsorted(self.common, pair), max(len(self.common) - 1, 0))
        return np.append(self.common[at] == pair if len(self.common) else np.zeros(len(pair), bool), False)

    def __call__(self, docs: list[list[str]]) -> list[np.ndarray]:
        """For each document (tokens, features)."""
        h, place = self.stack(docs)
        w = h[:, 0]
        u = self.usual(w).astype(np.uint64)
        near = lambda x, k: x[place + k]
        flags = near(u, -2) | near(u, -1) << np.uint64(1) | near(u, 0) << np.uint64(2) | near(u, 1) << np.uint64(3)
        w0, wl, wr = near(w, 0), near(w, -1), near(w, 1)
        columns = (
            _mix(1, w0), _mix(2, wl), _mix(3, wr), _mix(4, near(w, -2)), _mix(5, near(w, 2)), _mix(6, wl, w0), _mix(7, w0, wr), _mix(8, wl, w0, wr),
            _mix(9, near(h[:, 1], 0)), _mix(10, near(h[:, 2], 0)), _mix(11, near(h[:, 3], 0)), _mix(12, near(h[:, 3], 0), wl), _mix(13, flags), _mix(14, near(w, -2), w0), _mix(15, near(h[:, 1], 0), near(h[:, 1], 1)),
        )
        numbers = np.empty((len(place), len(columns)), np.int64)
        for k, x in enumerate(columns):
            numbers[:, k] = (x >> np.uint64(20)).astype(np.int64) & (SPACE - 1)
        return np.split(numbers, np.cumsum([len(d) for d in docs])[:-1]) if docs else []


def pair_numbers(hashes: np.ndarray) -> np.ndarray:
    """A number for each row and the next one."""
    return _mix(99, hashes[:-1], hashes[1:]).view(np.int64)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    """Linear chain over the states 0 (fine) and 1 (toxic)."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None) -> None:
        self.weights = np.zeros(SPACE, np.float32) if weights is None else weights
        self.moves = np.array([[1.0, -1.0], [-1.0, 1.0]]) if moves is None else moves

    @staticmethod
    def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(len(r) for r in rows)
        scores, mask = np.zeros((len(rows), longest)), np.zeros((len(rows), longest), bool)
        for i, r in enumerate(rows):
            scores[i, : len(r)], mask[i, : len(r)] = r, True
        return scores, mask

    def unary(self, features: np.ndarray) -> np.ndarray:
        """Score of each row of feature numbers."""
        return self.weights[features].sum(1).astype(float)

    def marginals(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded rows: P(toxic), mask, expected moves, log partition."""
        s, mask = self._pad(rows)
        n, t = s.shape
        e = np.zeros((n, t, 2))
        e[:, :, 1] = s
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = e[:, 0]
        for i in range(1, t):
            step = _logsum(a[:, i - 1, :, None] + self.moves[None], 1) + e[:, i]
            a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = _logsum(self.moves[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        z = _logsum(a[:, -1], 1)
        p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
        moves = np.zeros((2, 2))
        if t > 1:
            pair = a[:, :-1, :, None] + self.moves[None, None] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
            moves = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        return p, mask, moves, z

    def train(self, features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, batch: int = 128, rate: float = 0.2, l2: float = 2e-5) -> "Field":
        rng = np.random.default_rng(7)
        order = sorted(range(len(features)), key=lambda i: len(features[i]))
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        seen, seen_moves = np.full(SPACE, 1e-2, np.float32), np.full((2, 2), 1.0)
        for _ in range(rounds):
            for k in rng.permutation(len(chunks)):
                picked = chunks[k]
                p, _, moves, _ = self.marginals([self.unary(features[i]) for i in picked])
                wrong = np.concatenate([labels[i] - p[j, : len(labels[i])] for j, i in enumerate(picked)])
                flat = np.concatenate([features[i] for i in picked])
                numbers, at = np.unique(flat, return_inverse=True)
                gradient = np.bincount(at.ravel(), np.repeat(wrong, flat.shape[1]), len(numbers)).astype(np.float32)
                gradient -= l2 * len(picked) * self.weights[numbers]
                told = np.zeros((2, 2))
                for i in picked:
                    np.add.at(told, (labels[i][:-1], labels[i][1:]), 1)
                seen[numbers] += gradient**2
                self.weights[numbers] += rate * gradient / np.sqrt(seen[numbers])
                g = told - moves
                seen_moves += g**2
                self.moves += rate * g / np.sqrt(seen_moves)
        return self


def chunks_of(lengths: list[int], most: int = CELLS) -> list[list[int]]:
    """Numbers of texts in chunks of similar length whose padded size is bounded; a text longer than the bound is one by itself."""
    out: list[list[int]] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i]):
        if out and len(out[-1]) < 256 and (len(out[-1]) + 1) * lengths[i] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _sentences(words: list[str]) -> list[tuple[int, int]]:
    out, start = [], 0
    for i, w in enumerate(words):
        if w == "." and i + 1 > start:
            out.append((start, i + 1))
            start = i + 1
    if start < len(words):
        out.append((start, len(words)))
    return out


def sentence_bags(h: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Distinct numbers of the words and of the pairs of neighbouring words of each sentence."""
    pairs = pair_numbers(h)
    return [np.unique(np.concatenate([h[a:b].view(np.int64), pairs[a : b - 1]])) for a, b in spans]


def label_sentences(docs: list[list[str]], hashes: list[np.ndarray], verdicts: list[int], usual: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray], total: int, rounds: int = 12) -> list[list[tuple[int, int, float]]]:
    """For each document of words: (start, end, P(toxic)) of its sentences.

    `usual` tells which words form a common pair with the next; `counts` has, sorted by number, in how many
    of all `total` sentences of the corpus a word or pair occurs. Sentences without a verdict are taken as fine
    here, so that what is rare among the judged ones, but not in the corpus, is no evidence.
    """
    place, bags, strange = [], [], []
    for words, h, u in zip(docs, hashes, usual):
        spans = _sentences(words)
        place.append(spans)
        bags += sentence_bags(h, spans)
        for a, b in spans:
            known = u[a : b - 1]
            strange.append(1.02 - float(known.mean()) if len(known) else 0.1)
    sizes = np.array([len(b) for b in bags])
    named, flat = np.unique(np.concatenate(bags), return_inverse=True)
    held = np.bincount(flat, minlength=len(named)).astype(float)
    if len(counts[0]):
        at = np.minimum(np.searchsorted(counts[0], named), len(counts[0]) - 1)
        held = np.maximum(held, np.where(counts[0][at] == named, counts[1][at], 0))
    owner = np.repeat(np.arange(len(bags)), sizes)
    doc = np.repeat(np.arange(len(docs)), [len(x) for x in place])
    suspect = np.array(verdicts)[doc] > 0
    # Of the sentences of a document judged abusive one or more are; a verdict is wrong now and then.
    weight = np.clip(np.array(strange), 0.1, 1.0)
    p = np.where(suspect, weight / np.maximum(1, np.bincount(doc, weight, len(docs))[doc]), 0.0)
    base = np.log(RARE * weight / (1 - RARE * weight))
    size = np.maximum(1, sizes)
    for _ in range(rounds):
        hot = np.bincount(flat, p[owner], len(named))
        share = float(np.clip(p.sum() / max(total, len(bags)), 1e-5, 0.5))
        # A sentence is judged by the others that share its words, not by itself. Smoothed by one expected
        # toxic sentence, so that what was hardly seen says hardly anything.
        others_hot, others_cold = hot[flat] - p[owner], np.maximum(held[flat] - hot[flat] - (1 - p[owner]), 0)
        told = np.log((others_hot + 1) / (others_cold + 1 / share - 1)) - np.log(share / (1 - share))
        # Words of a sentence depend on each other: the evidence counts as that of a few words.
        evidence = np.bincount(owner, np.clip(told, -4, 4), len(bags)) / size * np.minimum(size, 6)
        alone = 1 / (1 + np.exp(-np.clip(evidence + base, -30, 30)))
        some = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(alone, 1 - 1e-9)), len(docs)))[doc]
        p = np.where(suspect, alone / (some + (1 - some) * WRONG), 0.0)
    out, k = [], 0
    for spans in place:
        out.append([(a, b, float(p[k + i])) for i, (a, b) in enumerate(spans)])
        k += len(spans)
    return out


def train_field(texts: list[str], verdicts: list[int], common: np.ndarray | None = None, counts: tuple[np.ndarray, np.ndarray] | None = None, total: int = 0) -> Field:
    if not 0 < sum(verdicts) < len(verdicts):
        raise ValueError("labels of both kinds are needed")
    reader = Features(common)
    read = [(t, v) for t, v in zip((tokens_of(t) for t in fold_texts(texts)), verdicts) if t]
    tokens = [t for t, _ in read]
    features = reader(tokens)
    hashes, place = reader.stack(tokens)
    split = lambda x: np.split(x[place], np.cumsum([len(t) for t in tokens])[:-1])
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    found = label_sentences([reader.words(t) for t in tokens], split(hashes[:, 0]), [v for _, v in read], split(reader.usual(hashes[:, 0])), counts or none, total)
    labels = []
    for t, sentences in zip(tokens, found):
        y = np.zeros(len(t), int)
        for a, b, p in sentences:
            if p > 0.5:
                y[a:b] = 1
        labels.append(y)
    return Field().train(features, labels)


def passages(p: np.ndarray, text: str, least: float = 0.5, width: int = 3) -> tuple[float, list[tuple[int, int]]]:
    """Score of a document, the mean of its strongest tokens in a row, and its offending passages, as (start, end)."""
    if not len(p):
        return 0.0, []
    total = np.concatenate(([0.0], np.cumsum(p)))
    score = float((total[width:] - total[:-width]).max() / width) if len(p) >= width else float(total[-1] / width)
    if p.max() < least:
        return score, []
    hot = np.concatenate(([0], (p >= least).astype(int), [0]))
    starts, ends = np.flatnonzero(np.diff(hot) == 1), np.flatnonzero(np.diff(hot) == -1)
    places = places_of(text)
    return score, [(places[a][0], places[b - 1][1]) for a, b in zip(starts, ends) if b - a >= min(width, len(p))]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(number, is_pair, n): in how many sentences each word and each pair of neighbouring words occurs; number 0 counts all sentences."""

    def run(batches):
        reader = Features()
        for b in batches:
            yield pd.DataFrame(dict(zip(("number", "is_pair", "n"), counted_numbers(reader, b["text"].tolist()))))

    return docs.select("text").mapInPandas(run, "number bigint, is_pair boolean, n bigint").groupBy("number", "is_pair").agg(F.sum("n").alias("n"))


def counted_numbers(reader: Features, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words and pairs, whether they are pairs, and in how many sentences of the texts they occur."""
    tokens = [tokens_of(t or "") for t in fold_texts(texts)]
    h, place = reader.stack(tokens)
    w = h[:, 0]
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    begins = np.append(True, (w[:-1] == FULL_STOP) | (w[:-1] == 0))
    sentence = np.cumsum(begins)
    inner = place[:-1][(np.diff(place) == 1) & (sentence[place[1:]] == sentence[place[:-1]])]
    out = [(np.zeros(1, np.int64), np.array([len(np.unique(sentence[place]))]))]
    for numbers, at in ((w.view(np.int64), place), (pair_numbers(w), inner)):
        once = np.unique(_mix(sentence[at], numbers[at].view(np.uint64)), return_index=True)[1]
        out.append(np.unique(numbers[at][once], return_counts=True))
    return np.concatenate([x for x, _ in out]), np.repeat([False, False, True], [len(x) for x, _ in out]), np.concatenate([n for _, n in out])


def score_documents(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, common_share: float = 0.0005) -> DataFrame:
    """(doc_id, text, ...) and (doc_id, verdict) → (doc_id, score, passages): passages are (start, end) offsets.

    Pairs of words that at least `common_share` of all sentences hold are common: at most (mean pairs of a
    sentence) / common_share of them, whatever the number of documents.
    """
    spark = docs.sparkSession
    votes = labels.where("verdict is not null").groupBy("doc_id").agg(F.avg("verdict").alias("share")).where("share <> 0.5")
    known = votes.join(docs.select("doc_id", "text"), "doc_id").where("text is not null").withColumn("verdict", (F.col("share") > 0.5).cast("int"))
    # Bounded: at most most_labelled documents of either verdict reach the driver.
    sample = [known.where(F.col("verdict") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for v in (0, 1)]
    rows = sample[0].unionByName(sample[1]).select("text", "verdict").toPandas()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if rows["verdict"].nunique() < 2:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int>>").alias("passages"))
    counts = durable(corpus_counts(docs))
    total = counts.where("number = 0").agg(F.sum("n")).first()[0] or 0
    asked = spark.createDataFrame(pd.DataFrame({"number": counted_numbers(Features(), rows["text"].tolist())[0]})).distinct()
    # What comes back is bounded by the share and by the judged documents.
    usual = counts.where(F.col("is_pair") & (F.col("n") >= total * common_share)).select("number").toPandas()["number"].to_numpy()
    held = counts.join(asked, "number", "left_semi").groupBy("number").agg(F.sum("n").alias("n")).toPandas().sort_values("number")
    field = train_field(rows["text"].tolist(), rows["verdict"].tolist(), usual, (held["number"].to_numpy(), held["n"].to_numpy()), total)
    shared = spark.sparkContext.broadcast((field.weights, field.moves, usual))

    def run(batches):
        weights, moves, usual_pairs = shared.value
        model, reader = Field(weights, moves), Features(usual_pairs)
        for b in batches:
            scores, spans = score_texts(model, reader, b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "passages": [[{"start": a, "end": z} for a, z in s] for s in spans]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, passages array<struct<start:int,end:int>>")


def score_texts(model: Field, reader: Features, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """Score and passages of each text."""
    folded = fold_texts(texts)
    tokens = [tokens_of(t or "") for t in folded]
    unary = [model.unary(f) for f in reader(tokens)]
    scores: list[float] = [0.0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for picked in chunks_of([len(t) for t in tokens]):
        p = model.marginals([unary[i] for i in picked])[0]
        for j, i in enumerate(picked):
            scores[i], spans[i] = passages(p[j, : len(tokens[i])], folded[i])
    return scores, spans


def source_rates(scored: DataFrame, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, flagged, rate), null sources as one group."""
    joined = docs.select("doc_id", "source").join(scored.select("doc_id", "score"), "doc_id")
    hot = F.sum((F.col("score") >= threshold).cast("bigint"))
    return joined.groupBy("source").agg(F.count("*").alias("documents"), hot.alias("flagged"), (hot / F.count("*")).alias("rate"))
