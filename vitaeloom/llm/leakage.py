"""Evaluation passages inside a corpus.

Texts are read as words: look-alike characters put right, markup tags, entities, case and punctuation
dropped. Every run of five words of an item is a seed, however many items hold it; a stretch of fifteen
words with two replaced always keeps such a run. Where a document shares a seed with an item, both are
aligned with Smith-Waterman over words, in a band that holds every stretch through the seed: first without
gaps (words replaced), then with gaps (words left out or put in). An alignment counts if it
holds a stretch of at least `stretch` item words, beginning and ending with a match, of which at most
`replaced` in any `stretch` are missing. Alignments of a batch are computed together, and their
number and size follow from the shared runs alone, so that a long document costs what it repeats.

Items whose seeds are few enough are sent to every task, and documents are read once, where they are, without
a shuffle; beyond BROADCAST_SEEDS seeds of documents and items are joined instead.

A sentence that ends several items (a closing instruction) is no part of an item.

Defined results: null texts and texts shorter than the stretch have no row; repeated rows count once.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold_texts
from vitaeloom.session import durable

TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--|-->")
WORD = re.compile(r"[^\W_]+")
SEED = 5
BROADCAST_SEEDS = 500_000


def words_of(texts: list[str]) -> list[list[str]]:
    plain = [html.unescape(TAG.sub(" ", t)) if "<" in t or "&" in t else t for t in fold_texts(texts)]
    return [WORD.findall(t.lower()) for t in plain]


def _seeds(h: np.ndarray) -> np.ndarray:
    """A hash of every run of SEED words."""
    x = np.zeros(len(h) - SEED + 1, np.uint64)
    for i in range(SEED):
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - SEED + 1 + i]
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _with_seeds(name: str):
    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 1_000_000:
                known.clear()
            words = [_stack([w], known) for w in words_of(b["text"].tolist())]
            yield b[[name]].assign(seeds=[np.unique(_stacked_seeds(*w)[0]) for w in words])

    return run


def align(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int]]:
    """Smith-Waterman over word numbers: the pairs (item place, document place) of the best local alignment that match."""
    n, m = len(item), len(doc)
    score = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1, :-1] + np.where(doc == item[i - 1], 2, -1), score[i - 1, 1:] - 1)
        row = np.concatenate(([0], np.maximum(best, 0)))
        score[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    out = []
    while i > 0 and j > 0 and score[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (2 if same else -1):
            if same:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def longest_stretch(matches: list[tuple[int, int]], stretch: int, replaced: int) -> int:
    """Item words of the longest stretch between two matches in which any `stretch` words miss at most `replaced`."""
    places = [i for i, _ in matches]
    best = 0
    k = 0
    while k < len(places):
        end = k
        for e in range(k + 1, len(places)):
            window = [p for p in places[k : e + 1] if p > places[e] - stretch]
            span = min(stretch, places[e] - places[k] + 1)
            gap = places[e] - places[e - 1] - 1
            if gap > replaced or span - len(window) > replaced:
                break
            end = e
        best = max(best, places[end] - places[k] + 1)
        k += 1
    return best


class Items:
    """Words and sorted seeds of items, end to end, with the part that each place belongs to."""

    def __init__(self, texts: list[list[str]], known: dict[str, int]) -> None:
        self.words, self.bounds = _stack(texts, known)
        seeds, places = _stacked_seeds(self.words, self.bounds)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]

    def find(self, docs: list[list[str]], known: dict[str, int], stretch: int, replaced: int) -> np.ndarray:
        """(n, 2): the document and the item number of every document that repeats a stretch of an item."""
        words, bounds = _stack(docs, known)
        seeds, places = _stacked_seeds(words, bounds)
        low, high = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        n = high - low
        if not n.sum():
            return np.empty((0, 2), np.int64)
        at = np.repeat(places, n)
        item = self.places[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        # Seeds that follow each other on one diagonal form a run, aligned once.
        order = np.lexsort((at, at - item))
        at, item = at[order], item[order]
        starts = np.ones(len(at), bool)
        starts[1:] = (np.diff(at) != 1) | (np.diff(item) != 1)
        at, item = at[starts], item[starts]
        out = np.stack([np.searchsorted(bounds, at, "right") - 1, np.searchsorted(self.bounds, item, "right") - 1], 1)
        kept = [self._aligned(words, bounds, at[k : k + 20_000], item[k : k + 20_000], out[k : k + 20_000], stretch, replaced) for k in range(0, len(at), 20_000)]
        return np.unique(out[np.concatenate(kept)], axis=0)

    def _aligned(self, words, bounds, at, item, owners, stretch, replaced) -> np.ndarray:
        """Whether a stretch goes through the run that starts at each of the places."""
        reach = stretch - SEED
        # A run of `stretch` words or more is a stretch by itself; a shorter one ends within the width.
        width = reach + stretch - 1 + reach
        right = _window(self.words, self.bounds, item - reach, owners[:, 1], width, 1)
        left = _window(words, bounds, at - reach, owners[:, 0], width, 2)
        good = _whole_stretch(left == right, stretch, replaced)
        rest = np.flatnonzero(~good)
        wide = _window(words, bounds, at[rest] - reach - stretch, owners[rest, 0], width + 2 * stretch, 2)
        least = 2 * (stretch - replaced) - replaced
        for k in np.flatnonzero(_best_scores(wide, right[rest]) >= least):
            good[rest[k]] = _gapped(wide[k], right[rest[k]], stretch, replaced, least)
        return good


def _stack(texts: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the place where each text begins, with the end."""
    for t in texts:
        for w in t:
            if w not in known:
                # The lowest bits are free for marks of places outside a text.
                known[w] = xxhash.xxh64_intdigest(w) & ~3
    flat = np.fromiter((known[w] for t in texts for w in t), np.uint64)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _stacked_seeds(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds within one text, with their places."""
    if len(words) < SEED:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places = np.arange(len(words) - SEED + 1)
    inside = places + SEED <= bounds[np.searchsorted(bounds, places, "right")]
    return _seeds(words)[inside], places[inside]


def _window(words: np.ndarray, bounds: np.ndarray, start: np.ndarray, owner: np.ndarray, width: int, outside: int) -> np.ndarray:
    """(n, width) words from each start; what lies outside of the text equals nothing on the other side."""
    at = start[:, None] + np.arange(width)
    inside = (at >= bounds[owner][:, None]) & (at < bounds[owner + 1][:, None])
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(outside))


def _whole_stretch(same: np.ndarray, stretch: int, replaced: int) -> np.ndarray:
    """Rows that hold a stretch without gaps: matches at both ends, at most `replaced` missing in any `stretch`."""
    total = np.concatenate([np.zeros((len(same), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
    full = total[:, stretch:] - total[:, :-stretch] >= stretch - replaced
    out, runs = np.zeros(len(same), bool), np.ones_like(full)
    # A stretch that is no longer than it must be has at most `replaced` words more than `stretch`.
    for more in range(replaced + 1):
        runs = runs[:, : full.shape[1] - more] & full[:, more:]
        out |= (runs & same[:, : runs.shape[1]] & same[:, stretch - 1 + more : stretch - 1 + more + runs.shape[1]]).any(1)
    return out


def _best_scores(docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of many pairs at once: 2 for a match, -1 for anything else."""
    n, m = docs.shape
    above, best, steps = np.zeros((n, m + 1), np.int32), np.zeros(n, np.int32), np.arange(m + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        row = np.zeros((n, m + 1), np.int32)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(docs == items[:, i : i + 1], 2, -1), above[:, 1:] - 1), 0)
        above = np.maximum.accumulate(row + steps, 1) - steps
        best = np.maximum(best, above.max(1))
    return best


def _gapped(doc: np.ndarray, item: np.ndarray, stretch: int, replaced: int, least: int) -> bool:
    """Best local alignments one after the other, each masked, until none can hold a stretch; each round masks words."""
    while True:
        matches = align(doc, item)
        if not matches or 2 * len(matches) < least:
            return False
        if longest_stretch(matches, stretch, replaced) >= stretch:
            return True
        doc = doc.copy()
        doc[matches[0][1] : matches[-1][1] + 1] = 2


def contains(doc_words: list[str], item_words: list[str], stretch: int, replaced: int) -> bool:
    known: dict[str, int] = {}
    return len(Items([item_words], known).find([doc_words], known, stretch, replaced)) > 0


def item_passages(items: DataFrame, key: str, texts: list[str], shared_by: int = 3) -> DataFrame:
    """(item, part, text) without the closing sentences that at least `shared_by` items share."""
    stacked = items.select(F.col(key).alias("item"), F.explode(F.array(*[F.struct(F.lit(t).alias("part"), F.col(t).alias("text")) for t in texts])).alias("x"))
    parts = stacked.select("item", "x.part", "x.text").where("text is not null").distinct()
    closing = F.trim(F.element_at(F.split(F.regexp_replace(F.trim("text"), r"([.?!])\s+", "$1\u0001"), "\u0001"), -1))
    ended = parts.withColumn("closing", closing)
    shared = ended.groupBy("closing").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= shared_by).select("closing", F.lit(True).alias("is_shared"))
    cut = F.expr("substring(trim(text), 1, length(trim(text)) - length(closing))")
    return ended.join(shared, "closing", "left").select("item", "part", F.when(F.col("is_shared"), cut).otherwise(F.col("text")).alias("text"))


def leaked_items(docs: DataFrame, items: DataFrame, stretch: int = 15, replaced: int = 2, most_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc, text) and (item, part, text) → (doc, item) for every document that repeats such a stretch of an item."""
    docs = docs.where("doc is not null and text is not null").select("doc", "text")
    parts = durable(items.where("item is not null and text is not null").withColumn("id", F.xxhash64("item", "part", "text")).select("id", "item", "text"))
    kinds = f"doc {docs.schema['doc'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}"
    # A part has at most half as many seeds as characters.
    if (parts.agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * most_seeds:
        listed = parts.select("item", "text").toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((listed["item"].tolist(), words_of(listed["text"].tolist())))

        def scan(batches):
            known: dict[str, int] = {}
            names, texts = shared.value
            index = Items(texts, known)
            for b in batches:
                if len(known) > 2_000_000:
                    known.clear()
                found = index.find(words_of(b["text"].tolist()), known, stretch, replaced)
                doc = b["doc"].tolist()
                yield pd.DataFrame({"doc": [doc[d] for d in found[:, 0]], "item": [names[i] for i in found[:, 1]]})

        return docs.mapInPandas(scan, kinds).distinct()
    seeds = parts.mapInPandas(_with_seeds("id"), "id bigint, seeds array<bigint>").select("id", F.explode("seeds").alias("seed"))
    grams = docs.mapInPandas(_with_seeds("doc"), f"{kinds.split(', item ')[0]}, seeds array<bigint>").select("doc", F.explode("seeds").alias("seed"))
    pairs = durable(grams.join(seeds, "seed").select("doc", "id").distinct())
    full = pairs.join(docs, "doc").join(parts.withColumnRenamed("text", "item_text"), "id").select("doc", "item", "text", "item_text")

    def verify(batches):
        for b in batches:
            kept = [False] * len(b)
            rows = b["item_text"].reset_index(drop=True)
            for text, at in rows.groupby(rows).groups.items():
                known: dict[str, int] = {}
                index = Items(words_of([text]), known)
                for d, _ in index.find(words_of([b["text"].iat[k] for k in at]), known, stretch, replaced):
                    kept[at[d]] = True
            yield b.loc[kept, ["doc", "item"]]

    return full.mapInPandas(verify, kinds).distinct()
