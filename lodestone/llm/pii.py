"""Operator 3: personal data by weak supervision.

Four exact patterns give base spans, which always stay.  Beside them every text gives candidate
spans: what looks like an address, a long number or a secret in wider patterns.  Six labelers -
patterns, gazetteers and context - vote for, against or not at all on each candidate.  Expectation
maximisation estimates the share of true candidates of each kind and how each labeler votes given the
truth: no vote decides on its own, that of the exact patterns no more than others, and all
reliabilities are estimated, from a belief that a labeler is better than chance.  The truth so estimated trains a logistic span classifier on the candidates' features.
A candidate that it accepts and that no base span overlaps is added.

Votes and features take few values, so the estimation sees only counts of their combinations, over
all texts: at most 5 * 3**6 vote rows and 5 * 8 * 5 * 3**4 feature rows reach the driver.

Defined cases: a null text counts as empty; an empty text has no spans and the digest of an empty
string; long texts are taken whole, in time that grows with their length and no faster, whatever they
hold; repeated rows give repeated rows; an empty table gives no rows and a model that adds
nothing; offsets are code points; redaction keeps every other column whatever its name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import picked, release, table, tidied, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("pattern", "gazetteer", "context", "shape", "border", "digits")
#: How much each is believed before any candidate is seen, as a number of votes that were right.
TRUST = (3.0, 0.5, 0.5, 0.5, 0.5, 0.5)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the start of a run of digits, so the look-behind changes nothing but the time
# that long runs take.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# What may not follow a number is looked at afterwards: in the pattern it would be tried again from
# every digit of a long run.
_NUMBER = re.compile(r"(?<![0-9A-Za-z_])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
_NAME = re.compile(r"(?:password|passwd|secret|token|api[_-]?key)(?=[ ]?[=:][ ]?[\"']?\Z)", re.I)
_SECRET = re.compile(r"(?<![A-Za-z0-9])(password|passwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?([A-Za-z0-9+/_-]{6,256})", re.I)

#: Gazetteers and context words.
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz co us ca ch at it nl".split())
COUNTRY_CODES = ("1", "44", "49", "33", "34", "39", "41", "43", "31", "86", "81", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
PERSONAL = frozenset("mail email e-mail contact write tel phone call mobile fax card visa credit account ip host address login password passwd secret token".split())
IMPERSONAL = frozenset("version isbn issn doi page pages chapter section id item order row total sum".split())
#: Names that are given to secrets alone, and values that stand for one.
SECRET_NAMES = ("password", "passwd", "api")
PLACEHOLDERS = frozenset("password passwd secret token example changeme xxxxxx string required optional undefined".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four exact patterns, by start and then by kind as listed."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _border(c: str) -> str:
    return "n" if not c else "w" if c.isalnum() or c in "_@=/+-" else "s"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, features, votes) of base spans and of what the wider patterns find."""
    spans = [(k, a, b, True) for k, a, b in base]
    wide = []
    lower = text.lower() if "=" in text or ":" in text or "at" in text else ""
    if "at]" in lower or "at)" in lower or "at ]" in lower or "at )" in lower:
        wide += [("email", m.start(), m.end()) for m in _SPOKEN.finditer(text)]
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):
        wide += [("secret", m.start(2), m.end(2)) for m in _SECRET.finditer(text)]
    if _DIGITS.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() < 7 or _border(text[m.end() : m.end() + 1]) == "w" and text[m.end()] not in "@=/+-":
                continue
            n = sum("0" <= c <= "9" for c in m[0])
            if not 7 <= n <= 19:
                continue
            wide.append(("ip" if m[0].count(".") == 3 and n <= 12 and " " not in m[0] else "card" if 14 <= n <= 19 else "phone", m.start(), m.end()))
    if wide:
        taken = bytearray(len(text))  # what earlier spans cover
        for _, a, b, _ in spans:
            taken[a:b] = b"x" * (b - a)
        for k, a, b in wide:
            if taken.find(b"x", a, b) < 0:
                spans.append((k, a, b, False))
                taken[a:b] = b"x" * (b - a)
    return [(k, a, b, *_described(text, k, a, b, exact)) for k, a, b, exact in spans]


def _described(text: str, kind: str, a: int, b: int, exact: bool) -> tuple[str, str]:
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    left, right = _border(text[a - 1 : a]), _border(text[b : b + 1])
    near = {w.strip(".,:;()") for w in text[max(0, a - 40) : a].lower().split()[-4:]} | {w.strip(".,:;()") for w in text[b : b + 24].lower().split()[:2]}
    if kind == "card":
        known = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if groups in ([4, 4, 4, 4], [n]) else -1
    elif kind == "phone":
        known = 1 if span.startswith("+") and digits.startswith(COUNTRY_CODES) else 0
        shape = 1 if len(groups) >= 3 and max(groups) <= 5 else -1 if len(groups) == 1 else 0
    elif kind == "ip":
        known = 0
        shape = 1 if len(groups) == 4 and max(groups) <= 3 else -1
    elif kind == "email":
        known = 1 if re.split(r"[^A-Za-z]+", span.rstrip(")] "))[-1].lower() in ENDINGS else 0
        shape = 1 if len(span) <= 254 else -1
    else:
        name = _NAME.search(text, max(0, a - 24), a)
        known = -1 if span.lower() in PLACEHOLDERS else 1 if name and name[0].lower().startswith(SECRET_NAMES) else 0
        shape = 1 if n and n < len(span) and len(span) >= 8 else -1 if not n and (span.islower() or span.isupper() or span.istitle()) else 0
    pattern = 1 if exact else 0 if kind in ("email", "secret", "phone") else -1
    if kind == "secret":
        # Set with a sign of its own, quoted or ending in a break, as in a settings file; not in prose.
        # Set as in a settings file, by an equals sign or in quotes; a colon alone says nothing.
        sign = text[max(0, a - 3) : a].replace(" ", "")
        context = 1 if "=" in sign or sign[-1:] in "\"'" else 0
    else:
        context = 1 if near & PERSONAL else -1 if near & IMPERSONAL else 0
    border = 1 if (left != "w" or kind == "secret" and text[a - 1 : a] == "=") and right != "w" else -1
    if kind == "secret":
        variety = 1 if len(set(span.lower())) >= 8 else -1 if len(set(span.lower())) <= 4 else 0
    else:
        variety = 0 if n < 7 else -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" else 1
    size = min(7, n // 3)
    mix = 0 if len(groups) < 2 else 1 if "." in span else 2 if "-" in span else 3 if "(" in span else 4
    features = f"{ORDER[kind]}{size}{mix}{known + 1}{'nsw'.index(left)}{'nsw'.index(right)}{pattern + 1}"
    return features, "".join("-0+"[v + 1] for v in (pattern, known, context, shape, border, variety))


def reliabilities(rows: list[tuple[str, str, int]], rounds: int = 100) -> tuple[dict[tuple[str, str], float], np.ndarray]:
    """Expectation maximisation over (kind number, votes, count) rows: the probability that the
    candidates of each row are personal data, and for each labeler P(vote | truth, it votes); who
    does not vote says nothing."""
    if not rows:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 2)
    votes = np.array([["-0+".index(c) for c in v] for _, v, _ in rows])
    kind = np.array([int(k) for k, _, _ in rows])
    n = np.array([c for _, _, c in rows], dtype=float)
    truth = 1 / (1 + np.exp(-(votes - 1) @ np.array(TRUST)))  # a vote to begin with
    for _ in range(rounds):
        given = np.ones((len(LABELERS), 2, 3)) * 0.5  # half a vote each, so that nothing is certain
        given[:, 1, 2] += np.array(TRUST)  # and a labeler is better than chance before it is seen
        given[:, 0, 0] += np.array(TRUST)
        given[:, :, 1] = 0
        for j in range(len(LABELERS)):
            own = votes[:, j] != 1
            np.add.at(given[j, 1], votes[own, j], (n * truth)[own])
            np.add.at(given[j, 0], votes[own, j], (n * (1 - truth))[own])
        given /= given.sum(axis=2, keepdims=True)
        given[:, :, 1] = 1
        yes, no = np.ones(len(KINDS)), np.ones(len(KINDS))
        np.add.at(yes, kind, n * truth)
        np.add.at(no, kind, n * (1 - truth))
        score = np.log(yes / no)[kind] + sum(np.log(given[j, 1, votes[:, j]] / given[j, 0, votes[:, j]]) for j in range(len(LABELERS)))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - truth).max() < 1e-9
        truth = new
        if done:
            break
    return {(k, v): float(p) for (k, v, _), p in zip(rows, truth)}, given


def classifier(rows: list[tuple[str, float, float]], steps: int = 400) -> dict[str, float]:
    """Logistic regression on (features, count, expected positives); features -> probability."""
    if not rows:
        return {}
    names = sorted({(i, c) for f, _, _ in rows for i, c in enumerate(f)} | {(8, f[0] + f[1]) for f, _, _ in rows} | {(9, f[0] + f[3:]) for f, _, _ in rows})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for r, (f, _, _) in enumerate(rows):
        for y in [*enumerate(f), (8, f[0] + f[1]), (9, f[0] + f[3:])]:
            x[r, at[y]] = 1
    n, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - n * q) - 0.1 * w
        h = (x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return {f: float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for (f, _, _), v in zip(rows, x @ w)}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base, found: base spans, and every candidate as kind:start:end:features:votes."""

    def find(batches):
        for batch in batches:
            base, found = [], []
            for t in batch["text"]:
                spans = base_spans(t)
                base.append(joined(spans))
                found.append(",".join(f"{k}:{a}:{b}:{f}:{v}" for k, a, b, f, v in candidates(t, spans)))
            yield pd.DataFrame({"key": batch["key"].astype("Int64"), "base": base, "found": found})

    own = picked(docs, key=docs[key].cast("long"), text=F.coalesce(docs[text], F.lit("")))
    return own.mapInPandas(tidied(find), "key long, base string, found string")


def fit(scanned: DataFrame) -> dict[str, float]:
    """The probability for each combination of features, from all candidates' votes."""
    one = scanned.where("found != ''").select(F.explode(F.split("found", ",")).alias("c")).select(F.split("c", ":").alias("c"))
    counts = one.groupBy(F.element_at("c", 4).alias("f"), F.element_at("c", 5).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    by_votes: dict[tuple[str, str], int] = {}
    rows = [(r.f, r.v, r.n) for r in counts.collect()]
    for f, v, n in rows:
        by_votes[f[0], v] = by_votes.get((f[0], v), 0) + n
    truth, _ = reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    summed: dict[str, list[float]] = {}
    for f, v, n in sorted(rows):
        s = summed.setdefault(f, [0.0, 0.0])
        s[0] += n
        s[1] += n * truth[f[0], v]
    return classifier([(f, n, p) for f, (n, p) in summed.items()])


def decided(base: str, found: str, model: dict[str, float]) -> list[tuple[str, int, int]]:
    """Base spans and the candidates that the classifier accepts, by start and kind."""
    own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    exact = set(own)
    for c in found.split(",") if found else ():
        k, a, b, f, _ = c.split(":")
        if (s := (k, int(a), int(b))) not in exact and model.get(f, 0.0) >= 0.5:
            own.append(s)
    return sorted(own, key=lambda s: (s[1], ORDER[s[0]]))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base_spans and spans, both array<struct<kind, start, end>>."""
    scanned = written(scan(docs, key, text))
    model = fit(scanned)

    def decide(batches):
        for batch in batches:
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            yield pd.DataFrame({
                "key": batch["key"].astype("Int64"),
                "base_spans": [as_rows(decided(b, "", {})) for b in batch["base"]],
                "spans": [as_rows(decided(b, f, model)) for b, f in zip(batch["base"], batch["found"])],
            })

    kind = "array<struct<kind:string,start:long,end:long>>"
    return scanned.mapInPandas(tidied(decide), f"key long, base_spans {kind}, spans {kind}").withColumnRenamed("key", key)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; spans that overlap become one.  chars
    names the column, if there is one, that holds the text's length.  Null texts stay null."""
    model = fit(written(scan(docs, key, text).select("found")))

    def rewrite(texts):
        for batch in texts:
            out = []
            for t in batch:
                if t:
                    base = base_spans(t)
                    found = ",".join(f"{k}:{a}:{b}:{f}:{v}" for k, a, b, f, v in candidates(t, base))
                    end, parts = 0, []
                    for k, a, b in decided(joined(base), found, model):
                        if a >= end:
                            parts += [t[end:a], f"[{k.upper()}]"]
                        end = max(end, b)
                    t = "".join(parts) + t[end:] if parts else t
                out.append(t)
            yield pd.Series(out, dtype=object)
        release()

    from collections.abc import Iterator

    rewrite.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.withColumn(text, F.pandas_udf(rewrite, "string")(docs[text]))
    if chars in docs.columns:
        kind = docs.schema[chars].dataType
        out = out.withColumn(chars, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{chars}`")).otherwise(F.length(f"`{text}`").cast(kind)))
    return out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    of = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    number = lambda k: F.size(F.filter("base_spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, BASE), F.sha2(of(F.col("base_spans")), 256).alias("base_sha256"), of(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict = {}
