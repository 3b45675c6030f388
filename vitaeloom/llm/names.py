"""Spellings of one organisation among names typed by people.

Every distinct name is reduced to what it names: legal forms, remarks, places and articles go,
words for a line of business or a type of school become one word each through a table of short and
foreign forms, and the rest, sorted, is the proper name. Names are blocked by the phonetic codes of all their
sorted tokens: the code keeps the sound class of each consonant, so that one slip of the hand changes at most one
class, and every name also emits its codes with one class left out of one or of two tokens. Short forms are
blocked by the token they begin with, beside the codes of the other tokens; names written with and without blanks
by the code of the whole run together. All pairs of a block are compared with Jaro-Winkler and an edit bound;
accepted pairs form connected components.

Whatever `same_name` accepts shares a block: at most two tokens of a name may have a slip, at most two may be short.

Defined results: null and blank names have no row; repeated rows count once; a name that consists of
table words only stands for itself; names that differ in case, blanks or punctuation are always one.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold_texts
from vitaeloom.llm.graph import components
from vitaeloom.llm.strings import edits, jaro_winkler, plain
from vitaeloom.session import durable

# Lines of business with their short forms.
BUSINESS = {
    "analytics": "anl", "aviation": "avn", "brewing": "brw brewery", "ceramics": "cer", "consulting": "consultancy cons", "energy": "nrg",
    "finance": "fin financial", "foods": "food", "health": "hlth healthcare", "insurance": "ins assurance", "logistics": "log lgstcs",
    "media": "med", "mobility": "mob", "networks": "netw network ntwk", "optics": "opt optical", "pharma": "pharmaceuticals pharmaceutical",
    "plastics": "plas", "robotics": "robot", "shipping": "shpg", "software": "sw soft", "systems": "sys system", "textiles": "textile txt",
    "timber": "tmbr", "travel": "trvl", "banking": "bank", "mining": "", "telecom": "telecoms tel", "construction": "constr", "engineering": "eng",
}
# Types of schools and their subjects, with short and foreign forms.
SCHOOL = {
    "university": "u uni univ universidad universite universitat universita universidade",
    "polytechnic": "poly polytech politechnic polytechnik polytechnique politecnico politecnica polytechnikum",
    "college": "coll colegio", "state": "st", "institute": "inst instituto institut istituto",
    "agriculture": "agric agr", "commerce": "comm com", "music": "mus", "design": "des", "education": "educ edu", "mining": "min",
    "technology": "tech technol", "arts": "art", "medicine": "", "law": "", "engineering": "eng", "science": "sci sciences",
}
LEGAL = "inc incorporated llc ltd limited gmbh plc corp corporation co company sa ag kg bv srl spa oy ab lc".split()
COMPANY_DROP = set("the group and of holding holdings".split())
SCHOOL_DROP = set("the of de del di der la le und and for ecole school escuela scuola hochschule".split())
# Least letters of a token that is cut short with and without a full stop.
DOTTED, CLIPPED = 4, 6
# Sound classes of consonants; vowels and h, w, y have none.
SOUNDS = {c: str(i) for i, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}
SILENT = "aeiouhwy"


class Reader:
    """Reduces names of one field to a type and a proper name."""

    def __init__(self, school: bool) -> None:
        self.school = school
        self.words = SCHOOL if school else BUSINESS
        self.drop = SCHOOL_DROP if school else COMPANY_DROP
        self.short = {plain(s): w for w, forms in self.words.items() for s in [w, *forms.split()]}
        self.seen: dict[str, str | None] = {}

    def word(self, token: str) -> str | None:
        """The table word that a token stands for: itself, a short form, a beginning with a full stop, or one with a slip."""
        if token not in self.seen:
            self.seen[token] = self._word(token)
        return self.seen[token]

    def _word(self, token: str) -> str | None:
        bare = token.rstrip(".")
        if bare in self.short:
            return self.short[bare]
        if token.endswith(".") and len(bare) >= 3:
            for w in self.words:
                if w.startswith(bare):
                    return w
        if len(bare) >= 4:
            for w in [w for w in self.short if len(w) >= 5]:
                most = 2 if len(w) >= 8 else 1
                if bare[0] == w[0] and edits(bare, w, most) <= most or edits(bare, w, 1) <= 1:
                    return self.short[w]
        return None

    def legal(self, token: str) -> bool:
        bare = token.strip(".,")
        return bare in LEGAL or len(bare) <= 5 and any(edits(bare, x, 1) <= 1 for x in ("inc", "llc", "ltd", "plc", "gmbh"))

    def filler(self, token: str) -> bool:
        """An article or a like word, perhaps with two letters swapped, one doubled or one left out."""
        if token in self.drop or not token:
            return True
        for w in self.drop:
            if len(w) == len(token) and sorted(w) == sorted(token) or len(token) == len(w) + 1 and re.sub(r"(.)\1", r"\1", token) == w or len(w) >= 3 and len(token) == len(w) - 1 and token[0] == w[0] and edits(token, w, 1) == 1 or len(w) >= 5 and edits(token, w, 1) == 1:
                return True
        return False

    def read(self, name: str) -> tuple[str, str, str]:
        s = plain(name)
        s = re.sub(r"\([^)]*\)|\[[^]]*\]", " ", s)
        s = re.sub(r"\b((?:\w\.){2,})", lambda m: m[1].replace(".", "") + " ", s)
        if self.school:
            s = re.sub(r"^\s*\w{2,5}\s+[-–—:]\s+(?=\S+\s+\S)", " ", s)
        pieces = [p for p in re.split(r"[,;|]", s) if p.strip()]
        if len(pieces) > 1:
            known = [any(self.word(t) for t in self.tokens(p)) for p in pieces]
            if known[0]:
                rest = [t for t in self.tokens(pieces[0]) if not self.word(t) and t.rstrip(".") not in self.drop]
                # "Type, Proper name" is turned round; "Proper name type, place" loses the place.
                pieces = pieces[: 1 if rest else 2]
        tokens = [t for p in pieces for t in self.tokens(p)]
        kinds, core = [], []
        for i, t in enumerate(tokens):
            bare = t.strip(".")
            w = self.word(t)
            if w:
                kinds.append(w)
            elif self.filler(bare):
                continue
            elif (kinds or i == len(tokens) - 1) and core and self.legal(t):
                continue
            else:
                core.append(t if t.endswith(".") and len(bare) >= 4 else bare)
        if not core:
            own = re.findall(r"\w+", plain(name))
            return "", " ".join(own), "".join(own)
        split = []
        for t in core:
            for w in sorted(self.words, key=len, reverse=True):
                if len(t) > len(w) + 3 and t.endswith(w):
                    kinds.append(w)
                    t = t[: -len(w)]
            split.append(t)
        return " ".join(sorted(set(kinds))), " ".join(sorted(split)), "".join(split)

    def tokens(self, piece: str) -> list[str]:
        out = []
        for t in re.findall(r"[^\W_]+\.?", re.sub(r"['’]", "", piece)):
            # Two table words without a blank between them.
            first = next((w for w in self.words if t.startswith(w) and t[len(w) :].rstrip(".") in self.words), None)
            out += [t] if first is None else [first, t[len(first) :]]
        return out


def read_names(names: DataFrame) -> DataFrame:
    """(field, name) → (field, name, kind, core, run): the parts that a name is compared by, its tokens sorted and run together."""

    def run(batches):
        readers = {"company": Reader(False), "institution": Reader(True)}
        for b in batches:
            got = [readers[f].read(n) for f, n in zip(b["field"], fold_texts(b["name"].tolist()))]
            yield b.assign(kind=[k for k, _, _ in got], core=[c for _, c, _ in got], run=[r for _, _, r in got])

    return names.mapInPandas(run, "field string, name string, kind string, core string, run string")


def sounds(token: str) -> str:
    """The sound classes of the consonants of a token, repeated ones included; other characters stand for themselves."""
    return "".join(SOUNDS.get(c, c) for c in token if c not in SILENT and c != ".")


def slipped(code: str) -> list[str]:
    """A code and the same without each of its classes: codes that are one insertion, deletion, replacement or swap apart share one."""
    return [code, *dict.fromkeys(code[:i] + code[i + 1 :] for i in range(len(code)))]


def sound_blocks(tokens: list[str]) -> list[str]:
    """The code of all tokens, sorted, and the same with a class left out of one or two of them."""
    codes = [slipped(sounds(t)) for t in tokens]
    rows = {tuple(sorted(c[0] for c in codes))}
    for n in (1, 2):
        for at in combinations(range(len(codes)), n):
            for picked in product(*(codes[i] for i in at)):
                rows.add(tuple(sorted([*picked, *(c[0] for k, c in enumerate(codes) if k not in at)])))
    return ["s" + " ".join(r) for r in rows]


def short_blocks(tokens: list[str], long: bool) -> list[str]:
    """Blocks in which a name with one or two short tokens meets those that it may stand for (`long`)."""

    def forms(token: str) -> list[str]:
        bare = token.rstrip(".")
        if long:
            return [bare[:n] for n in range(DOTTED, len(bare) + 1)]
        return [bare] if len(bare) >= (DOTTED if token.endswith(".") else CLIPPED) else []

    codes = [slipped(sounds(t)) for t in tokens]
    rows = set()
    for n in (1, 2):
        for at in combinations(range(len(tokens)), n):
            rest = [k for k in range(len(tokens)) if k not in at]
            others = {tuple(sorted(codes[k][0] for k in rest))}
            if n == 1:
                others |= {tuple(sorted([v, *(codes[m][0] for m in rest if m != k)])) for k in rest for v in codes[k]}
            for picked in product(*(forms(tokens[i]) for i in at)):
                rows |= {("p", *sorted(picked), "", *o) for o in others}
    return [" ".join(r) for r in rows]


def blocks(keys: DataFrame) -> DataFrame:
    """(field, kind, core, run, key) → (block, side, key): the blocks of a name, as one that others stand for (1), as short form (0), or both (2)."""

    def emit(batches):
        for b in batches:
            found, side, key = [], [], []
            for f, k, c, r, n in zip(b["field"], b["kind"], b["core"], b["run"], b["key"]):
                tokens = c.split(" ")
                runs = {x for t in {r, "".join(tokens)} for x in slipped(sounds(t))}
                for kind, rows in ((2, sound_blocks(tokens)), (2, ["r" + x for x in runs]), (1, short_blocks(tokens, True)), (0, short_blocks(tokens, False))):
                    found += [xxhash.xxh64_intdigest(f"{f}\t{k}\t{x}") for x in rows]
                    side += [kind] * len(rows)
                    key += [n] * len(rows)
            yield pd.DataFrame({"block": np.array(found, np.uint64).view(np.int64), "side": side, "key": key})

    return keys.mapInPandas(emit, "block bigint, side int, key bigint").distinct()


def candidates(keys: DataFrame) -> DataFrame:
    """(field, kind, core, run, key) → (key, key_b), each pair once: all that same_name can accept."""
    b = blocks(keys)
    alike = b.where("side = 2").select("block", "key")
    met = alike.join(alike.select("block", F.col("key").alias("key_b")), "block").where("key < key_b").select("key", "key_b")
    short = b.where("side = 0").select("block", "key").join(b.where("side = 1").select("block", F.col("key").alias("key_b")), "block").where("key <> key_b")
    return met.unionByName(short.select(F.least("key", "key_b").alias("key"), F.greatest("key", "key_b").alias("key_b"))).distinct()


def same_name(a: str, b: str, least: float, run_a: str = "", run_b: str = "") -> bool:
    """Two proper names, as sorted tokens: every token matches its counterpart but for one slip, in two tokens at most; tokens are cut short; or they are one when run together."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return any(edits(r, q, 1) <= 1 for r in {run_a or "".join(x), "".join(x)} for q in {run_b or "".join(y), "".join(y)})
    rest = [*(Counter(x) - Counter(y)), *(Counter(y) - Counter(x))]
    if len(rest) == 2:
        # All other tokens are equal: a beginning of six letters stands for the whole, also without a full stop.
        short, long = sorted(rest, key=len)
        if len(short) >= CLIPPED and long.startswith(short):
            return True
    slips = shorts = 0
    for s in x:
        best = max(y, key=lambda t: jaro_winkler(s, t))
        short, long = sorted((s, best), key=len)
        y.remove(best)
        if s == best:
            continue
        if short.endswith(".") and len(short) > DOTTED and long.startswith(short[:-1]):
            shorts += 1
            continue
        if min(len(s), len(best)) < 5 or jaro_winkler(s, best) < least or edits(s, best, 1) > 1:
            return False
        slips += 1
    return shorts <= 2 and slips <= (2, 1, 0)[shorts] and (slips <= 1 or len(x) > 1)


def link_names(names: DataFrame, least: float = 0.8) -> DataFrame:
    """(field, name) of any multiplicity → (field, name, org): org is the same for all spellings of one organisation.

    `least` is the Jaro-Winkler similarity that two proper names must reach.
    """
    distinct = names.where("name is not null and trim(name) <> ''").select("field", "name").distinct()
    read = durable(read_names(distinct).withColumn("key", F.xxhash64("field", "kind", "core")))
    keys = durable(read.groupBy("field", "kind", "core", "key").agg(F.min("run").alias("run")))
    pairs = candidates(keys)
    core = lambda k, c, r: keys.select(F.col("key").alias(k), F.col("core").alias(c), F.col("run").alias(r))
    pairs = pairs.join(core("key", "core", "run"), "key").join(core("key_b", "core_b", "run_b"), "key_b")

    def compare(batches):
        for b in batches:
            yield pd.DataFrame({"a": b["key"], "b": b["key_b"]})[[same_name(x, y, least, r, q) for x, y, r, q in zip(b["core"], b["core_b"], b["run"], b["run_b"])]]

    links = pairs.mapInPandas(compare, "a bigint, b bigint")
    groups = components(links)
    return read.join(groups.withColumnRenamed("node", "key"), "key", "left").select("field", "name", F.coalesce("component", "key").alias("org"))


def name_classes(linked: DataFrame) -> DataFrame:
    """(field, name, class_id, links): every spelling with its organisation and the number of its other spellings; nothing is expanded into pairs."""
    sizes = linked.groupBy("field", "org").agg((F.count("*") - 1).alias("links"))
    return linked.join(sizes, ["field", "org"]).select("field", "name", F.col("org").alias("class_id"), "links")


def name_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of different stored spellings of one organisation, the smaller one first."""
    a = linked.select("field", "org", F.col("name").alias("name_a"))
    b = linked.select("field", "org", F.col("name").alias("name_b"))
    return a.join(b, ["field", "org"]).where("name_a < name_b").select("field", "name_a", "name_b")
