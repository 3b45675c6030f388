"""Personal information in free text: found, listed and replaced by typed placeholders.

Patterns propose spans of five kinds (name, email, phone, address, identity), wide enough to include
look-alikes such as row counts, date ranges and company names. Labelers vote on every span: for it,
against it, or not at all. They read the shape of the span, word lists (first names learned from the
name column of the whole table, street words, job words) and the words around it. Expectation-
maximisation over the counts of all vote patterns estimates how reliable each labeler is; its
posteriors train a logistic span classifier on votes and shapes, which takes the decision.

JSON fields are read value by value after decoding. Texts are read in their one form (codepoints).
Defined results: null and empty values and rows without a key have no spans, unparsable JSON is read as text; of
overlapping spans the surer one is kept for the placeholders; equal values of one record are one row.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeloom.llm.codepoints import fold_texts
from vitaeloom.llm.strings import plain
from vitaeloom.session import durable

KINDS = ("name", "email", "phone", "address", "identity")
VOTERS = 6
# Fixed value: first names up to this number are broadcast.
BROADCAST_NAMES = 200_000
SHAPES = 4096

# Street words after and before a street's name, endings of joined street names.
STREET_AFTER = "street st road rd avenue ave lane ln close court ct drive dr way place pl square sq terrace crescent boulevard blvd row mews gardens grove hill parade walk quay".split()
STREET_BEFORE = "calle via rue avenida plaza paseo rua viale piazza chemin allee impasse camino carrer".split()
STREET_END = "weg platz straße strasse str gasse allee ring damm ufer straat laan".split()
# Words of jobs, companies and schools that no person's name has.
NO_NAME = set(
    "analyst engineer manager developer scientist consultant assistant administrator researcher modeller lead senior junior data product team support quality "
    "platform warehouse insight forecasting operations pricing risk survey reporting methodologist specialist curator language statistician university college "
    "institute polytechnic school state group systems software insurance pharma media energy finance travel foods optics textiles robotics plastics analytics "
    "health networks logistics brewing timber ceramics aviation mobility shipping consulting inc ltd llc gmbh plc summary experience education skills projects "
    "tools methods other further details references profile languages contact emergency former reference phone mobile email address present street road avenue "
    "hub flow project side master bachelor doctor certificate diploma science arts".split()
)
# What people write before identity numbers.
ID_LABEL = re.compile(
    r"(?i)\b(?:ni number|soc(?:ial|\.)?\s*sec(?:urity|\.)?(?:\s*(?:no|nr|number)\b\.?)?|ssn|nino|national insurance(?:\s*(?:no|number)\b\.?)?|steuer-?id(?:nr\.?)?|steuernummer|tax (?:number|id|no\.?)|tin|"
    r"national id(?:entity)?(?:\s*(?:card|no|number)\b\.?)*|id(?:entity)? card(?:\s*(?:no|number)\b\.?)?|personalausweis(?:-nr\.?)?|dni|nie|nif|nss|"
    r"driv(?:er|ing)(?:'?s)? licen[cs]e(?:\s*(?:no|number)\b\.?)?|führerschein(?:-nr\.?)?|permis de conduire|passport(?:\s*(?:no|number)\b\.?)?|reisepass(?:-nr\.?)?|passeport|pasaporte)\s*[:#№]?\s*#?\s*"
)
ID_VALUE = re.compile(r"[A-Z0-9]{1,14}(?:[ ./-][A-Z0-9]{1,12}){0,6}(?![A-Za-z])")
SSN = re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])")
AT = r"(?:\s?@\s?|\s?[\(\[\{]\s?at\s?[\)\]\}]\s?|\sat\s)"
DOT = r"(?:\.|\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?i)(?<![\w.+-])([a-z0-9_][\w.+-]*)({AT})([a-z0-9-]+(?:{DOT}[a-z0-9-]+)*{DOT}[a-z]{{2,}})(?![\w-])")
PHONE = re.compile(r"(?<![\w.+/-])\+?\(?\d{1,12}\)?(?:(?:[ ./-]|\s?(?=\()|(?<=\)))\s?\(?\d{1,12}\)?){0,7}(?![\w])")
STREETS = [
    re.compile(rf"(?i)(?<![\w.,/-])(\d{{1,5}}[ \t]?[a-z]?)[ \t]+((?:[^\W\d_][\w'’-]*[ \t]+){{1,3}}?(?:{'|'.join(STREET_AFTER)})\b\.?|(?:{'|'.join(STREET_BEFORE)})[ \t]+[^\W\d_][\w'’-]*)(?![\w-])"),
    re.compile(rf"(?i)(?<![\w-])([^\W\d_][\w’'-]*(?:{'|'.join(STREET_END)})\.?)[ \t]+(\d{{1,5}}[ \t]?[a-z]?)\b(?![\w.-]\d)"),
    re.compile(rf"(?i)(?<![\w-])((?:{'|'.join(STREET_BEFORE)})[ \t]+(?:(?:de|del|della|di|du|des|la|le|los|las)[ \t]+)*[^\W\d_][\w’'-]*(?:[ \t][^\W\d_][\w’'-]*)?)[ \t]+(\d{{1,5}}[a-z]?)\b"),
]
CAPITAL = r"[^\W\d_a-zß-öø-ÿ][\w’'-]*\.?"
NAME = re.compile(rf"{CAPITAL}(?: {CAPITAL}){{1,4}}")
NAME_BEFORE = re.compile(r"(?i)(?:\b(?:reference|referee|refs?|contact|manager|supervisor|mentor|recruiter|c/o|go to|name|attn|written by|ask for|speak to|call|mr|mrs|ms|dr)\b\.?:?\s*|c/o\s*)$")
NAME_AFTER = re.compile(r"^\s*(?:<|,|\(|will\b|$|\n|[-–|·/])")
PHONE_WORD = re.compile(r"(?i)\b(?:tel|phone|mobile|cell|ring|call|fax|contact|reached under|whatsapp|handy|telefon|t|m)\b[^\n\d]{0,40}$")
MAIL_WORD = re.compile(r"(?i)\b(?:e-?mail|write to|contact|go to|mailto|reach)\b[^\n@]{0,60}$")
COUNT_AFTER = re.compile(r"(?i)^\s*(?:rows|calls|records|sites|users|hours|hrs|days|cases|nodes|gb|mb|tb|%|percent|euro|eur|usd|pages|cases|items|weeks|months|years|requests|lines|to\s+\d|k\b)")
DATES = re.compile(r"^\(?(?:19|20)\d\d[ ./-](?:0?[1-9]|1[0-2])?(?:[ ./-]\d{1,2})?")


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of all texts in a decoded JSON value; list positions are left out of the path."""
    if isinstance(value, str):
        return [(path, value)]
    if isinstance(value, dict):
        return [x for k in value for x in leaves(value[k], f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, path)]
    return []


class Finder:
    """Proposes spans with the votes on them."""

    def __init__(self, first_names: frozenset[str]) -> None:
        self.first_names = first_names

    def __call__(self, text: str, role: str) -> list[tuple[int, int, str, str, list[int], str]]:
        """(start, end, kind, value, votes, shape); role is the column or JSON key that holds the text."""
        out = self.emails(text, role) + self.identities(text) + self.phones(text, role) + self.addresses(text) + self.names(text, role)
        return out

    def emails(self, text, role):
        out = []
        if "@" not in text and not re.search(r"(?i)\bat\b", text):
            return out
        for m in EMAIL.finditer(text):
            local, at, domain = m[1].strip("."), m[2], m[3]
            worded = bool(re.fullmatch(r"(?i)\s+at\s+", at))
            dotted = re.sub(rf"(?i){DOT}", ".", domain).replace(" ", "").lower()
            spelt = bool(re.search(r"(?i)[\[\(\s]dot[\]\)\s]", domain))
            if worded and not spelt:
                continue
            before = text[max(0, m.start() - 70) : m.start()]
            votes = [
                1 if "@" in at else 0,
                1 if re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,12}", dotted) else -1,
                1 if re.search(r"[a-z]", local, re.I) else -1,
                1 if MAIL_WORD.search(before) or role in ("email", "phone") else 0,
                1 if re.fullmatch(r"(?i)[a-z0-9_]+([.+_-][a-z0-9_]+)*", local) else -1,
                1 if spelt or "(" in at or "[" in at else 0,
            ]
            out.append((m.start(), m.end(), "email", f"{local}@{dotted}".lower(), votes, "email" + at.strip()))
        return out

    def identities(self, text):
        out, labelled = [], []
        for m in ID_LABEL.finditer(text):
            v = ID_VALUE.match(text, m.end())
            if not v:
                continue
            raw = v[0]
            value = re.sub(r"[^A-Za-z0-9]", "", raw)
            digits = sum(c.isdigit() for c in value)
            if len(value) < 5 or digits < 4:
                continue
            labelled.append((v.start(), v.end()))
            after = text[v.end() : v.end() + 16]
            before = text[max(0, m.start() - 40) : m.start()]
            votes = [
                1,
                1 if 7 <= len(value) <= 14 else -1,
                1 if digits >= 6 else 0,
                1 if re.search(r"(?i)on file|papers|documents", before) or after.lower().startswith(", valid") else 0,
                1 if re.match(r"\s*(?:$|\n|,|;|\.|\))", after) else -1,
                -1 if COUNT_AFTER.match(after) else 0,
            ]
            out.append((v.start(), v.end(), "identity", value.lower(), votes, "id" + _shape(raw)))
        for m in SSN.finditer(text):
            if any(a <= m.start() < b for a, b in labelled):
                continue
            after = text[m.end() : m.end() + 16]
            votes = [0, 1, 1, 0, 1 if re.match(r"\s*(?:$|\n|,|;|\.|\))", after) else -1, -1 if COUNT_AFTER.match(after) else 0]
            out.append((m.start(), m.end(), "identity", re.sub(r"\D", "", m[0]), votes, "id" + _shape(m[0])))
        return out

    def phones(self, text, role):
        out = []
        ids = [(m.end(), m.end() + 24) for m in ID_LABEL.finditer(text)]
        for m in PHONE.finditer(text):
            raw = m[0].strip()
            digits = re.sub(r"\D", "", raw)
            if not 9 <= len(digits) <= 15:
                continue
            before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 16]
            line = before.rpartition("\n")[2]
            groups = [len(g) for g in re.findall(r"\d+", raw)]
            trunk = raw.startswith(("+", "0", "(0", "(")) or groups[:3] == [1, 3, 3]
            labelled = any(a <= m.start() < b for a, b in ids)
            american = groups[-3:] == [3, 3, 4] or groups == [10]
            votes = [
                1 if trunk and not labelled else 0,
                1 if american else -1 if groups == [3] * len(groups) or len(groups) > 2 and groups[1:] == [3] * (len(groups) - 1) and not trunk else 0,
                1 if PHONE_WORD.search(line) or role in ("phone", "email") else 0,
                -1 if COUNT_AFTER.match(after) or re.search(r"(?i)(?:from|moved|version|build|ticket|no\.|between|to)\s*$", line) and "under" not in line else 0,
                -1 if labelled else 0,
                -1 if DATES.match(raw) or labelled else 1 if len(digits) >= 10 and (trunk or american) else -1,
            ]
            out.append((m.start(), m.start() + len(raw), "phone", digits, votes, "phone" + _shape(raw)))
        return out

    def addresses(self, text):
        out = []
        if not re.search(r"\d", text):
            return out
        for which, pattern in enumerate(STREETS):
            for m in pattern.finditer(text):
                if "\n" in m[0]:
                    continue
                words = m[2] if which == 0 else m[1]
                named = all(w[0].isupper() for w in re.findall(r"[^\W\d_][\w’'-]*", words) if plain(w) not in ("de", "del", "la", "le", "des", "du", "della", "di", "los", "las", *STREET_BEFORE))
                before, after = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 24]
                votes = [
                    1 if named else -1,
                    1 if re.search(r"(?:^|\n|,\s|c/o[^\n]*,\s|[·|]\s|[-–:]\s|\bat\s)$", before) else -1,
                    1 if re.match(r"\s*(?:$|\n|,|#|\.|;|\()", after) else 0 if re.match(r"\s*[·|–-]", after) else -1,
                    1 if re.match(r"(?i)\s*,?\s*(?:flat|apt|unit|suite|#)", after) or re.match(r",\s*[^\W\d_][\w -]+\s\d{4,5}", after) else 0,
                    1 if any(plain(w).rstrip(".") in STREET_AFTER + STREET_BEFORE for w in words.split()) or which == 1 else 0,
                    -1 if COUNT_AFTER.match(after) else 0,
                ]
                value = " ".join(re.sub(r"[.,]", " ", m[0]).lower().split())
                out.append((m.start(), m.end(), "address", value, votes, f"address{which}"))
        return out

    def names(self, text, role):
        out = []
        whole = role.endswith("name") and not role.endswith(("projects.name", "file_name"))
        if role.endswith(("company", "institution", "position", "location", "degree", "status", "check_name", "requirement_type", "dates", "start_date", "end_date")):
            return out
        head = text.split("\n", 1)[0].strip() if role in ("raw_text", "resume.raw_text") else text.strip() if whole else ""
        heads = {head} if head else set()
        for m in NAME.finditer(text):
            words = m[0].split(" ")
            known = [i for i, w in enumerate(words) if plain(w) in self.first_names]
            at = known[0] if known else 0
            skip = len(" ".join(words[:at])) + bool(at)
            start = m.start() + skip
            kept = words[at:]
            while kept and plain(kept[-1]).strip(".") in NO_NAME:
                kept.pop()
            if not 2 <= len(kept) <= 5:
                continue
            span = " ".join(kept)
            end = start + len(span)
            if span.endswith(".") and len(kept[-1]) > 2:
                span, end = span[:-1], end - 1
            before, after = text[max(0, start - 40) : start], text[end : end + 8]
            line = before.rpartition("\n")[2]
            is_head = span in heads or whole and span == head
            context = bool(NAME_BEFORE.search(line))
            first = plain(kept[0]) in self.first_names
            if not (is_head or context or first):
                continue
            bad = any(plain(w).strip(".") in NO_NAME for w in kept)
            votes = [
                1 if first else -1,
                1 if is_head else 0,
                1 if context or after.startswith(" <") else 0,
                1 if NAME_AFTER.match(after) else -1,
                -1 if bad else 0,
                1 if first and all(len(w.strip(".")) > 2 or w.endswith(".") or len(w) == 1 for w in kept) and re.fullmatch(r"(?i)[^\W\d_][\w’'-]+", kept[-1]) else -1,
            ]
            value = " ".join(span.replace(".", " ").lower().split())
            out.append((start, end, "name", value, votes, f"name{len(kept)}{int(first)}{int(is_head)}"))
        return out


def _shape(raw: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", raw))


def first_names(names: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(first) tokens that begin at least `least` names, whatever the number of rows."""
    firsts = names.where(f"{column} is not null").select(F.substring_index(F.trim(column), " ", 1).alias("first"))
    return firsts.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("first")


def read_parts(text: str, is_json: bool, column: str) -> list[tuple[str, str]]:
    """(role, text) of the readable parts of a value."""
    if is_json:
        try:
            return leaves(json.loads(text))
        except ValueError:
            pass
    return [(column, text)]


def _folded_parts(b: pd.DataFrame) -> list[tuple]:
    """(row, field, rec_id, part, role, text) of the readable parts of a batch."""
    parts = [(i, f, r, n, role, t) for i, (f, r, t, j) in enumerate(zip(b["field"], b["rec_id"], b["text"], b["is_json"])) for n, (role, t) in enumerate(read_parts(t, j, f.rpartition(".")[2]))]
    return [(*p[:5], t) for p, t in zip(parts, fold_texts([p[5] for p in parts]))]


def _with_listed(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Texts with `listed`, the listed first names among their words, looked up by a join."""

    def words(batches):
        for b in batches:
            found = {(f, r, plain(w)) for _, f, r, _, _, t in _folded_parts(b) for m in NAME.finditer(t) for w in m[0].split(" ")}
            yield pd.DataFrame(list(found), columns=["field", "rec_id", "first"])

    def firsts(batches):
        for b in batches:
            yield pd.DataFrame({"first": [plain(x) for x in b["first"]]})

    kinds = "field string, rec_id string, first string"
    held = texts.mapInPandas(words, kinds).distinct().join(names.mapInPandas(firsts, "first string").distinct(), "first")
    return texts.join(held.groupBy("field", "rec_id").agg(F.collect_list("first").alias("listed")), ["field", "rec_id"], "left")


def proposals(texts: DataFrame, names: DataFrame, most: int = BROADCAST_NAMES) -> DataFrame:
    """(field, rec_id, text, is_json) and (first) → one row for each proposed span; more than `most` names are joined instead of broadcast."""
    texts = texts.where("text is not null and rec_id is not null and field is not null")
    few = [r["first"] for r in names.limit(most + 1).collect()]
    joined = len(few) > most
    shared = texts.sparkSession.sparkContext.broadcast(frozenset() if joined else frozenset(plain(x) for x in few))

    def run(batches):
        find = Finder(shared.value)
        for b in batches:
            cols: dict[str, list] = {c: [] for c in ("field", "rec_id", "part", "start", "end", "pii_kind", "pii_value", "votes", "shape")}
            listed = b["listed"].tolist() if joined else None
            for i, f, r, n, role, t in _folded_parts(b):
                if joined:
                    find.first_names = frozenset(listed[i] if listed[i] is not None else ())
                for start, end, kind, value, votes, shape in find(t, role):
                    for c, v in zip(cols, (f, r, n, start, end, kind, value, votes, zlib.crc32(shape.encode()) % SHAPES)):
                        cols[c].append(v)
            yield pd.DataFrame(cols)

    rows = _with_listed(texts, names) if joined else texts
    return rows.mapInPandas(run, "field string, rec_id string, part int, start int, end int, pii_kind string, pii_value string, votes array<tinyint>, shape int")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (n, voters in -1, 0, 1): posteriors of the patterns, accuracies of the voters, share of true spans.

    A voter that casts a vote is right with its own probability, whatever the truth; not voting says
    nothing. Voters are believed to be better than chance, so that the two classes can't change places.
    """
    weight = counts.astype(float)
    p = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))
    right, share = np.full(patterns.shape[1], 0.8), 0.5
    for _ in range(rounds):
        share = float(np.clip((p * weight).sum() / weight.sum(), 0.05, 0.95))
        for v in range(patterns.shape[1]):
            vote = patterns[:, v]
            agreed = (weight * np.where(vote > 0, p, 1 - p))[vote != 0].sum()
            right[v] = np.clip((agreed + 8) / (weight[vote != 0].sum() + 10), 0.6, 0.97)
        logit = np.log(share / (1 - share)) + patterns @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, right, share


def _inputs(votes: np.ndarray) -> np.ndarray:
    """For and against of each voter, and a constant."""
    return np.concatenate([votes > 0, votes < 0, np.ones((len(votes), 1), bool)], 1).astype(float)


def fit_spans(votes: np.ndarray, shapes: np.ndarray, soft: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on votes and shapes, with the posteriors as targets."""
    x = _inputs(votes)
    w, u = np.zeros(x.shape[1]), np.zeros(SHAPES)
    often = np.bincount(shapes, minlength=SHAPES) + 20.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + u[shapes], -30, 30)))
        wrong = soft - p
        w += 4.0 * (x.T @ wrong / len(x) - 1e-4 * w)
        u += 0.5 * (np.bincount(shapes, wrong, SHAPES) / often - 1e-3 * u)
    return w, u


def find_spans(texts: DataFrame, names: DataFrame, most_spans: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(field, rec_id, text, is_json) and (first) names → accepted spans (field, rec_id, part, start, end, pii_kind, pii_value, score).

    `most_spans` bounds the spans of each kind on which the classifier is fitted; the reliabilities are
    estimated from the counts over all spans.
    """
    spans = durable(proposals(texts, names))
    counted = spans.groupBy("pii_kind", "votes").agg(F.count("*").alias("n")).toPandas()
    models: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for kind, rows in counted.groupby("pii_kind"):
        patterns = np.array(rows["votes"].tolist(), int)
        posterior, _, _ = estimate(patterns, rows["n"].to_numpy())
        known = {tuple(v): q for v, q in zip(patterns.tolist(), posterior)}
        sample = spans.where(F.col("pii_kind") == kind).orderBy(F.xxhash64("field", "rec_id", "part", "start")).limit(most_spans).select("votes", "shape").toPandas()
        votes = np.array(sample["votes"].tolist(), int)
        models[kind] = fit_spans(votes, sample["shape"].to_numpy(), np.array([known[tuple(v)] for v in votes.tolist()]))
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for b in batches:
            s = np.zeros(len(b))
            votes, shapes, kinds = np.array(b["votes"].tolist(), int).reshape(len(b), -1), b["shape"].to_numpy(), b["pii_kind"].to_numpy()
            for kind, (w, u) in shared.value.items():
                at = kinds == kind
                if at.any():
                    s[at] = 1 / (1 + np.exp(-np.clip(_inputs(votes[at]) @ w + u[shapes[at]], -30, 30)))
            yield b.drop(columns=["votes", "shape"]).assign(score=s)[s >= threshold]

    return spans.mapInPandas(score, "field string, rec_id string, part int, start int, end int, pii_kind string, pii_value string, score double")


def _put(value, texts: list[str]):
    """The JSON value with its texts replaced in reading order."""
    if isinstance(value, str):
        return texts.pop(0)
    if isinstance(value, dict):
        return {k: _put(v, texts) for k, v in value.items()}
    if isinstance(value, list):
        return [_put(v, texts) for v in value]
    return value


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(field, rec_id, text, is_json) and accepted spans → (field, rec_id, text) with placeholders such as [PHONE]."""
    listed = spans.groupBy("field", "rec_id").agg(F.collect_list(F.struct("part", "start", "end", "pii_kind", "score")).alias("spans"))
    joined = texts.join(listed, ["field", "rec_id"], "left")

    def run(batches):
        for b in batches:
            out = []
            for f, t, j, spans_ in zip(b["field"], b["text"], b["is_json"], b["spans"]):
                if t is None:
                    out.append(None)
                    continue
                parts = [x for _, x in read_parts(t, j, (f or "").rpartition(".")[2])]
                parts = fold_texts(parts)
                taken: dict[int, list] = {}
                for s in sorted(spans_ if spans_ is not None else [], key=lambda s: (-s["score"], s["start"] - s["end"])):
                    if all(s["end"] <= a or s["start"] >= z for a, z, _ in taken.get(s["part"], [])):
                        taken.setdefault(s["part"], []).append((s["start"], s["end"], s["pii_kind"]))
                for n, places in taken.items():
                    for a, z, kind in sorted(places, reverse=True):
                        parts[n] = f"{parts[n][:a]}[{kind.upper()}]{parts[n][z:]}"
                whole = parts[0] if parts else ""
                if j:
                    try:
                        whole = json.dumps(_put(json.loads(t), parts), ensure_ascii=False)
                    except ValueError:
                        pass
                out.append(whole)
            yield b[["field", "rec_id"]].assign(text=out)

    return joined.mapInPandas(run, "field string, rec_id string, text string")
