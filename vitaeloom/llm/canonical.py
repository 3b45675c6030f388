"""Free-entered values mapped to the entries of a reference list.

Values are normalised (look-alike characters, case, blanks, remarks that people add) and deduplicated. Every entry is
indexed by its character n-grams: the padded bigrams and trigrams of its tokens, the trigrams with their letters
sorted, which a swap of neighbours leaves alone, and the trigrams of the tokens without vowels, each with its inverse
frequency in the list as weight; and once more by the last kind alone, for values typed without vowels. A value retrieves all entries with which it shares a gram, scored by the weighted
cosine. The entry with the highest cosine is accepted if it reaches the threshold and leads every entry of another
wording by the margin; a token check (slips, short forms, dropped vowels, joined and split tokens) may veto it.

Defined results: null and blank values and values without letters have no entry; a value that is an
entry but for case and blanks is reported with zero slips; an entry under several targets gives a row
for each; ties within the margin between different wordings give none.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import folded
from vitaeloom.llm.strings import edits, plain
from vitaeloom.session import durable

# Remarks that people add to a skill.
REMARKS = "basic basics advanced expert certified beginner intermediate proficient experienced some using with the a of in daily use used hands on self taught tool tools work working skills skill knowledge yrs years year yr months level good strong and v".split()
BROADCAST_ENTRIES = 20_000


def spaced(value: Column) -> Column:
    """Lower case, single blanks, look-alike characters put right."""
    return F.lower(F.trim(F.regexp_replace(folded(value), r"(?U)\s+", " ")))


def bare(value: Column) -> Column:
    """A spaced value without the remarks around what is meant; the value itself if it is nothing but remarks."""
    tokens = F.split(F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}.+#&'/-]+", " ")), " ")
    kept = F.filter(tokens, lambda t: ~F.rtrim(t, F.lit(".")).isin(*REMARKS) & ~t.rlike(r"^v?\d+[.\d]*\+?$"))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(value)


def grams(value: Column) -> Column:
    """Distinct grams of the tokens of a normal value: bigrams (=), trigrams, trigrams sorted (#) and without vowels (~)."""
    tokens = F.filter(F.split(F.regexp_replace(value, r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")
    cut = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, n))
    padded = lambda ts: F.transform(ts, lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    every = lambda ts, n: F.flatten(F.transform(padded(ts), lambda t: cut(t, n)))
    marked = lambda xs, mark, f=lambda x: x: F.transform(xs, lambda g: F.concat(F.lit(mark), f(g)))
    ordered = lambda g: F.array_join(F.array_sort(F.array(*[F.substring(g, k, 1) for k in (1, 2, 3)])), "")
    thin = F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, "[aeiou]", "")), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(every(tokens, 3), marked(every(tokens, 2), "="), marked(every(tokens, 3), "#", ordered), marked(every(thin, 3), "~")))


def thin_grams(all_grams: Column) -> Column:
    return F.filter(all_grams, lambda g: g.startswith("~"))


def _tokens(s: str) -> list[str]:
    return re.findall(r"[^\W_]+\.?", plain(s).replace("'", ""))


def _thin(t: str) -> str:
    return re.sub("[aeiou]", "", t)


def _remark(t: str) -> bool:
    t = t.rstrip(".")
    return t in REMARKS or bool(re.fullmatch(r"v?\d+", t)) or len(t) >= 3 and any(len(r) >= 4 and edits(t, r, 1) <= 1 for r in REMARKS)


def token_slips(t: str, form: str) -> int | None:
    """Slips between a typed token and a token of an entry; None if they aren't the same word."""
    bare = t.rstrip(".")
    if bare == form:
        return 0
    if len(bare) >= (3 if t.endswith(".") else 4) and form.startswith(bare):
        return 1
    most = 1 if len(form) < 7 else 2
    n = edits(bare, form, most)
    if n <= most and (n < 2 or len(bare) >= 5):
        return n
    thin = _thin(form)
    if len(thin) >= 2 and len(bare) <= len(form) - 1 and (bare == thin or bare == form[0] + _thin(form[1:]) or len(thin) >= 5 and edits(bare, thin, 1) <= 1):
        return 1
    return None


def meant(value: str, form: str) -> int | None:
    """Slips by which a value is the entry `form`; None if it means something else."""
    f, v = _tokens(form), _tokens(value)
    compact = "".join(x.rstrip(".") for x in f)
    rest = [x for x in v if not _remark(x) or x.rstrip(".") in f]
    most = 1 if len(compact) < 8 else 2 if len(compact) < 14 else 3
    best = None
    for tokens in (rest, v):
        n = edits("".join(x.rstrip(".") for x in tokens), compact, most)
        if n <= most and (best is None or n < best):
            best = n
    # Split and joined tokens with remarks around them.
    if best is None and len(rest) >= 1:
        for i in range(len(rest)):
            for j in range(i + 1, len(rest) + 1):
                inside, outside = "".join(x.rstrip(".") for x in rest[i:j]), rest[:i] + rest[j:]
                if outside and not all(_remark(x) for x in outside):
                    continue
                n = edits(inside, compact, most)
                if n <= most and (best is None or n < best):
                    best = n
    left, total = list(v), 0
    for t in sorted(f, key=len, reverse=True):
        found = [(s, i) for i, x in enumerate(left) if (s := token_slips(x, t.rstrip("."))) is not None]
        if not found:
            return best
        s, i = min(found)
        total += s
        left.pop(i)
    if all(_remark(x) for x in left) and total <= max(2, len(f) + 1):
        best = total if best is None else min(best, total)
    return best


class Index:
    """Inverted index of the grams of a list, whole and without vowels, for use inside Arrow batches."""

    def __init__(self, forms: list[str], grams_: list[list[str]]) -> None:
        ways = [*grams_, *([g for g in gs if g.startswith("~")] for gs in grams_)]
        self.forms = np.array(forms, object)
        self.number: dict[str, int] = {}
        flat = np.array([self.number.setdefault(g, len(self.number)) for gs in ways for g in gs], np.int64)
        owner = np.repeat(np.arange(len(ways)), [len(gs) for gs in ways])
        order = np.argsort(flat, kind="stable")
        self.owner, held = owner[order], np.bincount(flat, minlength=len(self.number))
        self.starts, self.held = np.concatenate(([0], np.cumsum(held))), held
        self.unknown = math.log(len(forms) + 1.0)
        self.weight = np.log((len(forms) + 1.0) / np.maximum(held, 1))
        self.norm = np.sqrt(np.bincount(owner, self.weight[flat] ** 2, len(ways)))

    def near(self, asked: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, score) of every pair whose weighted cosine is at least `least`."""
        n, out = len(self.forms), []
        step = max(1, (1 << 22) // max(1, 2 * n))
        for k in range(0, len(asked), step):
            part = asked[k : k + step]
            flat = np.array([self.number.get(g, -1) for gs in part for g in gs], np.int64)
            row = np.repeat(np.arange(len(part)), [len(gs) for gs in part])
            norm = np.sqrt(np.bincount(row, np.where(flat < 0, self.unknown, self.weight[flat]) ** 2, len(part)))
            row, flat = row[flat >= 0], flat[flat >= 0]
            m = self.held[flat]
            at = np.repeat(self.starts[flat] - np.cumsum(m) + m, m) + np.arange(m.sum())
            dot = np.bincount(np.repeat(row, m) * 2 * n + self.owner[at], np.repeat(self.weight[flat] ** 2, m), len(part) * 2 * n)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.nan_to_num(dot.reshape(len(part), 2 * n) / (norm[:, None] * self.norm)).reshape(len(part), 2, n).max(1)
            found = np.nonzero(score >= least)
            out.append((found[0] + k, found[1], score[found]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def near_entries(asked: DataFrame, wordings: DataFrame, n: int, least: float, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """(vid, grams) and (form, grams) → (vid, form, score): the weighted cosine of every value and entry, at least `least`.

    A list of up to `most` entries is sent to every task as an inverted index, and nothing is shuffled; postings of
    a longer one are joined.
    """
    if n <= most:
        listed = wordings.select("form", "grams").toPandas()
        shared = asked.sparkSession.sparkContext.broadcast((listed["form"].tolist(), [list(g) for g in listed["grams"]]))

        def run(batches):
            index = Index(*shared.value)
            for b in batches:
                row, entry, score = index.near(b["grams"].tolist(), least)
                yield pd.DataFrame({"vid": b["vid"].to_numpy()[row], "form": index.forms[entry], "score": score})

        return asked.select("vid", "grams").mapInPandas(run, "vid bigint, form string, score double")
    ways = wordings.select("form", F.lit(False).alias("thin"), "grams").unionByName(wordings.select("form", F.lit(True).alias("thin"), thin_grams(F.col("grams")).alias("grams")))
    postings = ways.select(F.struct("form", "thin").alias("form"), F.explode("grams").alias("gram"))
    weight = postings.groupBy("gram").agg(F.log(F.lit(n + 1.0) / F.count("*")).alias("w"))
    norms = postings.join(weight, "gram").groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("form_norm"))
    spread = asked.select("vid", F.explode("grams").alias("gram")).join(weight, "gram", "left").withColumn("w", F.coalesce("w", F.lit(math.log(n + 1.0))))
    value_norm = spread.groupBy("vid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = spread.join(postings, "gram").groupBy("vid", "form").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dots.join(value_norm, "vid").join(norms, "form").withColumn("score", F.col("dot") / (F.col("norm") * F.col("form_norm")))
    return scored.groupBy("vid", F.col("form.form").alias("form")).agg(F.max("score").alias("score")).where(F.col("score") >= least)


def map_values(values: DataFrame, entries: DataFrame, threshold: float = 0.35, margin: float = 0.02) -> DataFrame:
    """(tab, row_key, value) and (target, entry) → (tab, row_key, value, normal, form, target, entry, score, slips), one row for each target meant.

    Rows without a match have null form, target, entry, score and slips, so that they can be reported.
    """
    rows = values.where("row_key is not null").select("tab", "row_key", "value", spaced(F.col("value")).alias("normal")).withColumn("vid", F.xxhash64("normal"))
    rows = durable(rows.dropDuplicates(["tab", "row_key"]))
    asked = rows.where(F.col("normal").rlike(r"\p{L}")).groupBy("vid").agg(F.first("normal").alias("normal"))
    asked = asked.withColumn("bare", bare(F.col("normal"))).withColumn("grams", grams(F.col("bare")))
    asked = durable(asked.withColumn("grams", F.when(F.col("bare").rlike("[aeiou]"), F.col("grams")).otherwise(thin_grams(F.col("grams")))).drop("bare"))
    forms = entries.where("entry is not null and target is not null").select("target", "entry", spaced(F.col("entry")).alias("form"))
    wordings = durable(forms.select("form").distinct().withColumn("grams", grams(F.col("form"))))
    n = wordings.count()
    small = F.broadcast if n <= BROADCAST_ENTRIES else (lambda d: d)
    scored = near_entries(asked, wordings, n, threshold - margin)
    exact = asked.join(small(wordings), asked["normal"] == wordings["form"]).select("vid", "form", F.lit(2.0).alias("score"))
    # The best two entries of a value say whether the margin is kept.
    two = F.slice(F.sort_array(F.array_agg(F.struct("score", "form")), asc=False), 1, 2)
    best = scored.unionByName(exact).groupBy("vid").agg(two.alias("two"))
    kept = best.where((F.col("two")[0]["score"] >= threshold) & ((F.size("two") < 2) | (F.col("two")[0]["score"] - F.get("two", 1)["score"] >= margin) | (F.col("two")[0]["form"] == F.get("two", 1)["form"])))
    near = kept.select("vid", F.col("two")[0]["form"].alias("form"), F.least(F.col("two")[0]["score"], F.lit(1.0)).alias("score")).join(asked.select("vid", "normal"), "vid")

    def check(batches):
        for b in batches:
            slips = [meant(v, f) for v, f in zip(b["normal"], b["form"])]
            kept = [s is not None for s in slips]
            yield b[kept][["vid", "form", "score"]].assign(slips=[s for s in slips if s is not None])

    good = near.select("vid", "normal", "form", "score").mapInPandas(check, "vid bigint, form string, score double, slips int")
    return rows.join(good.join(small(forms), "form"), "vid", "left").select("tab", "row_key", "value", "normal", "form", "target", "entry", "score", "slips")
