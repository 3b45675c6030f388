"""Records that are the same but for small edits, found by ball hashing that meets in the middle.

Texts are compared by their distinct three-word sequences. Every text gets `tables` fingerprints: a word
that names the least sequence under one hash function, kept whole, and `BITS` bits, one of the least
sequence under each of as many further hash functions. Each of these agrees with the probability that
follows from the share of common sequences alone, whatever kind of edit made the difference. Every
fingerprint emits all variants within half the radius (itself and each single flipped bit); two
fingerprints within the radius of 2 share a variant. Fingerprints are shuffled by their word, which all
variants share, so that variants are made and meet inside a task and never reach a disk. A pair is taken
at one of its meeting points only. A sketch of 128 further bits drops chance collisions; as these grow with the
square of the rows, two more bits of each of its least hashes drop those of long texts that remain. The rest are
verified exactly on the sets of sequences; only the sets of texts that met are shuffled.

Recall: `recall` gives the probability of finding a pair by its similarity; `tables_for` the number of
tables that a recall at the limit of similarity needs. No bucket is capped. A larger collection takes
more `words` in a fingerprint and with them more tables, so that chance collisions stay in proportion to the rows.

Defined results: null texts and texts of fewer than three words have no partner; rows with equal
sequences are joined once, as one representative, and put back afterwards; repeated rows count once.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold_texts
from vitaeloom.session import durable

BITS, RADIUS, SKETCH, BINS = 12, 2, 128, 4
# Fixed sizes: fingerprints and pairs handled at once, bits of the filter before verification (16 MB).
HANDLED, COMPARED, FILTER = 1 << 17, 1 << 21, 27
# Further bits of each least hash of a sketch, the sequences of a text from which on they count, and the share of pairs they may lose.
FINER, LONG, LOST = 2, 24, 1e-6
WORD = re.compile(r"[^\W_]+")
FULL = np.iinfo(np.uint64).max
SKETCHED = [f"sketch{i}" for i in range((1 + FINER) * SKETCH // 64)]


def recall(similarity: float, tables: int, words: int = 1, sketch_most: int = SKETCH) -> float:
    """Probability that a pair of this similarity meets in a table and passes the sketch."""
    off = (1 - similarity) / 2
    at_most = lambda n, k: sum(math.comb(n, i) * off**i * (1 - off) ** (n - i) for i in range(k + 1))
    return (1 - (1 - similarity**words * at_most(BITS, RADIUS)) ** tables) * at_most(SKETCH, sketch_most)


def tables_for(similarity: float, wanted: float, words: int = 1) -> int:
    """Tables that find a pair of this similarity with the probability wanted."""
    return next(n for n in range(1, 10_000) if recall(similarity, n, words) >= wanted)


def finer_most(least: float) -> int:
    """Least hashes of a sketch whose bits may differ: all but LOST of the pairs at this similarity differ in no more."""
    off, rest = min(1.0, 1 - least) * (1 - 0.5 ** (FINER + 1)), 1.0
    for i in range(SKETCH):
        rest -= math.comb(SKETCH, i) * off**i * (1 - off) ** (SKETCH - i)
        if rest <= LOST:
            return i
    return SKETCH


def json_text(source: str) -> str:
    """The values of a JSON text, by sorted keys; the text itself where it can't be parsed."""
    try:
        value = json.loads(source)
    except ValueError:
        return source
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack.extend(v[k] for k in sorted(v, reverse=True))
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif v is not None:
            out.append(str(v))
    return "\n".join(out)


def _words(texts: list[str]) -> list[list[str]]:
    lower = [t.lower() for t in fold_texts(texts)]
    # This capital alone becomes two characters.
    again = [i for i, t in enumerate(lower) if "i\u0307" in t]
    for i, t in zip(again, fold_texts([lower[i] for i in again])):
        lower[i] = t
    return [WORD.findall(t) for t in lower]


class Fingerprints:
    """Words and bits of least hashes; the hash functions follow from a fixed seed.

    Sequences fall into BINS parts; one pass under a function gives the least hash of each part, and an
    empty part takes the hash of the next one.
    """

    def __init__(self, tables: int, words: int = 1) -> None:
        rng = np.random.default_rng(20240229)
        self.tables, self.words = tables, words
        self.slots = tables * (words + BITS) + SKETCH
        n = -(-self.slots // BINS)
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def least(self, sets: list[np.ndarray]) -> np.ndarray:
        """(n, slots): the least hashes of each set of sorted numbers."""
        n = len(sets)
        flat = np.concatenate(sets)
        part = np.repeat(np.arange(n, dtype=np.int64) * BINS, [len(x) for x in sets]) + (flat >> np.uint32(32 - BINS.bit_length() + 1))
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        held = part[starts]
        flat = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        flat ^= flat >> np.uint64(29)
        out = np.empty((n, len(self.a) * BINS), np.uint64)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            h = flat * a + b
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            found = np.full(n * BINS, FULL)
            found[held] = np.minimum.reduceat(h, starts)
            found = found.reshape(n, BINS)
            for _ in range(BINS - 1):
                empty = found == FULL
                if not empty.any():
                    break
                found = np.where(empty, np.where(np.roll(empty, -1, 1), FULL, np.roll(found, -1, 1) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), found)
            out[:, k * BINS : (k + 1) * BINS] = found
        return out[:, : self.slots]

    def __call__(self, sets: list[np.ndarray], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (n, tables), the bits lowest, and sketches (n, 2); equal texts under different salts never meet."""
        prints, sketch = self.shapes(sets, salt)
        return prints, sketch[:, : SKETCH // 64]

    def shapes(self, sets: list[np.ndarray], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and sketches with their FINER further bits; those are 0 for texts too short for them."""
        least = self.least(sets)
        mixed = (least ^ least >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        bits = mixed >> np.uint64(63)
        prints = np.empty((len(sets), self.tables), np.int64)
        for t in range(self.tables):
            at = t * (self.words + BITS)
            name = salt + np.uint64(t)
            for w in range(self.words):
                name = (name ^ name >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) + least[:, at + w]
            name = (name ^ name >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            x = name >> np.uint64(BITS) << np.uint64(BITS)
            for i in range(BITS):
                x |= bits[:, at + self.words + i] << np.uint64(i)
            prints[:, t] = x.view(np.int64)
        sketch = np.zeros((len(sets), (1 + FINER) * SKETCH // 64), np.uint64)
        for k in range(1 + FINER):
            bits = mixed[:, self.slots - SKETCH :] >> np.uint64(63 - k) & np.uint64(1)
            for i in range(SKETCH):
                sketch[:, (k * SKETCH + i) // 64] |= bits[:, i] << np.uint64(i % 64)
        sketch[[len(x) < LONG for x in sets], SKETCH // 64 :] = 0
        return prints, sketch.view(np.int64)


def _sequences(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the three-word sequences."""
    x = h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x165667B19E3779F9)
    return np.unique((x ^ x >> np.uint64(32)).astype(np.uint32))


def _shape(tables: int, words: int):
    def run(batches):
        prints = Fingerprints(tables, words)
        for b in batches:
            texts = [json_text(t) if j else t for t, j in zip(b["text"], b["is_json"])]
            rows = [(i, w) for i, w in enumerate(_words(texts)) if len(w) >= 3]
            if not rows:
                continue
            kept = b.iloc[[i for i, _ in rows]]
            sets = [_sequences(prints.hashes(w)) for _, w in rows]
            salts = {t: xxhash.xxh64_intdigest(t or "") for t in set(kept["tab"])}
            salt = np.array([salts[t] for t in kept["tab"]], np.uint64)
            fp, sketch = prints.shapes(sets, salt)
            same = [xxhash.xxh64_intdigest(s.tobytes(), salts[t]) - 2**63 for s, t in zip(sets, kept["tab"])]
            yield pd.DataFrame({"tab": kept["tab"].values, "key": kept["key"].values, "same": same, "prints": list(fp)} | dict(zip(SKETCHED, sketch.T)) | {"seqs": [s.view(np.int32) for s in sets]})

    return run


def _met(prints: np.ndarray, same: np.ndarray, sketch: list[np.ndarray], most: int, finer: int):
    """Arrays (a, b) of the rows whose fingerprints lie within the radius and whose sketches differ in at most `most` bits and `finer` least hashes.

    Rows are sorted by fingerprint and distinct. Variants are made once for each distinct fingerprint; fingerprints that differ
    in two bits meet at two variants, in one bit at more: one of them counts.
    """
    words = prints >> BITS
    alike = words[1:] == words[:-1]
    kept = np.flatnonzero(np.concatenate(([False], alike)) | np.concatenate((alike, [False])))
    if not len(kept):
        return
    prints, same, sketch = prints[kept], same[kept], [x[kept] for x in sketch]
    half = SKETCH // 64
    long = sketch[half] != 0
    start = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    size = np.diff(np.concatenate((start, [len(prints)])))
    distinct = prints[start]
    masks = np.concatenate(([0], np.int64(1) << np.arange(BITS, dtype=np.int64)))
    variants = (distinct[:, None] ^ masks).ravel()
    order = np.argsort(variants, kind="stable")
    variants, of, flip = variants[order], order // len(masks), order % len(masks)
    x, y = [np.flatnonzero(size > 1)], [np.flatnonzero(size > 1)]
    # A variant has at most as many origins as it has variants itself.
    for k in range(1, len(masks)):
        at = np.flatnonzero(variants[k:] == variants[:-k])
        if not len(at):
            break
        at = at[(flip[at] == 0) | (flip[at + k] > flip[at])]
        x.append(of[at])
        y.append(of[at + k])
    x, y = np.concatenate(x), np.concatenate(y)
    for part in _lots(size[x]):
        # Each row of x against the rows of y, a long run of y in pieces.
        p, q = x[part], y[part]
        rows = np.repeat(start[p], size[p]) + _counted(size[p])
        first, reach = np.repeat(start[q], size[p]), np.repeat(size[q], size[p])
        pieces = -(-reach // COMPARED)
        piece = _counted(pieces) * COMPARED
        rows, first, reach = (np.repeat(v, pieces) for v in (rows, first, reach))
        first, reach = first + piece, np.minimum(reach - piece, COMPARED)
        for lot in _lots(reach):
            a = np.repeat(rows[lot], reach[lot])
            b = np.repeat(first[lot], reach[lot]) + _counted(reach[lot])
            off = sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int16) for s in sketch[:half])
            # Fingerprints that are equal meet as (a, b) and (b, a).
            near = (off <= most) & ((prints[a] != prints[b]) | (a < b))
            a, b = a[near], b[near]
            off = sum(np.bitwise_count(np.bitwise_or.reduce([s[a] ^ s[b] for s in sketch[k::half]])).astype(np.int16) for k in range(half))
            near = (off <= finer) | ~long[a] | ~long[b]
            a, b = same[a[near]], same[b[near]]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)


def _lots(sizes: np.ndarray) -> list[slice]:
    """Slices that hold about COMPARED each."""
    share = np.cumsum(sizes) // COMPARED
    cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(sizes)]
    return [slice(i, j) for i, j in zip(cuts, cuts[1:])]


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _meet(most: int, finer: int):
    """Rows (print, same, sketch) sorted by print and same, all of a word in one task → pairs (a, b)."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def met(cols):
            once = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            for a, b in _met(cols[0][once], cols[1][once], [c[once].view(np.uint64) for c in cols[2:]], most, finer):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [x.to_numpy() for x in batch.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            n += len(cols[0])
            # The last word may go on in the next batch.
            if n >= HANDLED and held[0][0][0] >> BITS != cols[0][-1] >> BITS:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1] >> BITS << BITS))
                yield from met([c[:cut] for c in whole])
                held = [[c[cut:] for c in whole]]
                n = len(whole[0]) - cut
        if held:
            yield from met([np.concatenate(c) for c in zip(*held)])

    return run


def _listed(same: DataFrame) -> Column:
    """Is `same` among the listed ones? A bitmap of fixed size tells, so that some others pass as well."""
    context = same.sparkSession.sparkContext
    size = 1 << FILTER
    place = same.select(F.col("same").bitwiseAND(size - 1).alias("at"))
    buckets = place.groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in buckets.toLocalIterator():
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = context.broadcast(bits)

    def run(x: pd.Series) -> pd.Series:
        at = x.to_numpy() & (size - 1)
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return F.pandas_udf(run, "boolean")("same")


def near_copies(texts: DataFrame, least: float = 0.5, wanted: float = 0.92, words: int = 1, sketch_most: int = 48) -> tuple[DataFrame, DataFrame]:
    """(tab, key, text, is_json) → pairs of representatives (tab, a, b, similarity) and membership (tab, key, same).

    `same` names the representative of a row, `a` and `b` are such names. similarity is the share of
    distinct three-word sequences that occur in both among those that occur in either; it exceeds
    `least` in every pair. A pair at `least` is found with the probability `wanted`, a closer one more surely;
    two texts at `least` differ in more than `sketch_most` bits of their sketches once in 2,000 times.
    """
    rows = texts.where("text is not null and key is not null")
    shape = _shape(tables_for(least, wanted, words), words)
    shaped = durable(rows.mapInPandas(shape, "tab string, key string, same bigint, prints array<bigint>, " + "".join(f"{c} bigint, " for c in SKETCHED) + "seqs array<int>"))
    members = shaped.select("tab", "key", "same").distinct()
    # Equal sequences have equal fingerprints, so that any row of a group stands for it.
    prints = shaped.select(F.explode("prints").alias("print"), "same", *SKETCHED)
    worded = prints.repartition(F.shiftright("print", BITS)).sortWithinPartitions("print", "same")
    candidates = durable(worded.mapInArrow(_meet(sketch_most, finer_most(least)), "a bigint, b bigint").distinct())
    # Sequences are most of the bytes: only those of texts that met are shuffled, once for both sides.
    met = candidates.select(F.explode(F.array("a", "b")).alias("same"))
    one = shaped.where(_listed(met)).groupBy("same").agg(F.first("tab").alias("tab"), F.first("seqs").alias("seqs")).join(met.hint("merge"), "same", "left_semi")
    sets = lambda x: one.select(F.col("same").alias(x), F.col("tab").alias(f"tab_{x}"), F.col("seqs").alias(f"seqs_{x}")).hint("merge")
    # Both tabs are asked for, so that both sides are one exchange.
    both = candidates.join(sets("a"), "a").join(sets("b"), "b").where("tab_a <=> tab_b").withColumn("common", F.size(F.array_intersect("seqs_a", "seqs_b")))
    both = both.withColumn("similarity", F.col("common") / (F.size("seqs_a") + F.size("seqs_b") - F.col("common")))
    pairs = both.where(F.col("similarity") > least).select(F.col("tab_a").alias("tab"), "a", "b", "similarity")
    return durable(pairs), members


def key_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(tab, key_a, key_b) for every pair of rows, copies included, the smaller key first."""
    m = lambda name, key: members.select("tab", F.col("same").alias(name), F.col("key").alias(key))
    apart = pairs.select("tab", "a", "b").join(m("a", "x"), ["tab", "a"]).join(m("b", "y"), ["tab", "b"]).select("tab", "x", "y")
    together = m("same", "x").join(m("same", "y"), ["tab", "same"]).where("x < y").select("tab", "x", "y")
    every = apart.unionByName(together).where("x <> y")
    return every.select("tab", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(tab, key, class_id, links): one row for each row with words; rows joined by any chain of pairs share a class.

    links counts the rows that exceed the similarity with this one, copies included; rows without any are
    a class of their own. Nothing is expanded into pairs of rows.
    """
    from vitaeloom.llm.graph import components

    node = lambda c: F.xxhash64("tab", c)
    sizes = members.groupBy("tab", "same").agg(F.count("*").alias("n"))
    both = pairs.select("tab", F.col("a").alias("same"), F.col("b").alias("other")).unionByName(pairs.select("tab", F.col("b").alias("same"), F.col("a").alias("other")))
    met = both.join(sizes.select("tab", F.col("same").alias("other"), F.col("n").alias("m")), ["tab", "other"]).groupBy("tab", "same").agg(F.sum("m").alias("met"))
    found = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    per = sizes.join(met, ["tab", "same"], "left").withColumn("node", node("same")).join(found, "node", "left")
    per = per.select("tab", "same", F.coalesce("component", "node").alias("class_id"), (F.col("n") - 1 + F.coalesce("met", F.lit(0))).alias("links"))
    return members.join(per, ["tab", "same"]).select("tab", "key", "class_id", "links")
