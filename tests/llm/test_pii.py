import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii as p

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and p.luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], p.ORDER[s[0]]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1 25-+(0)é_%\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert p.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["4337 1665 9846 4399", "4337166598464399", "+1 (988) 555-2485", "a.b+c@x.yz.com,", "1.2.3.4.5", "256.1.1.1", "00000000001.2.3.4"])
def test_base_spans_of_known_forms(text):
    assert p.base_spans(text) == plain(text)


@pytest.mark.parametrize("part", ["1", "a@", "+1 ", "1.1.", "1 2 3 4 5 6 7 8 ", "password=x1y2z3w4 ", "a@b.cc ", "555-1234 ", "a [at] b ", "token: ", "1-"])
def test_long_texts_take_linear_time(part):
    import time

    took = []
    for n in (100_000, 400_000):
        text = part * (n // len(part)) + "x"
        began = time.perf_counter()
        base = p.base_spans(text)
        found = p.candidates(text, base)
        p.decided(p.joined(base), ",".join(f"{k}:{a}:{b}:{f}:{v}" for k, a, b, f, v in found), {})
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.3


def test_numbers_in_words_are_no_candidates():
    for text in ("no 555 123 4567x", "x5551234567", "5551234567_", "12-34"):
        assert p.candidates(text, []) == []
    assert [c[:3] for c in p.candidates("call 555 123 4567. now", [])] == [("phone", 5, 17)]


def test_no_vote_decides_alone():
    """Labelers whose votes agree outweigh the exact pattern's, if it is the one that is often wrong."""
    counts = {}
    for truth, v, n in ((1, "+++++0", 300), (0, "-----0", 300), (0, "+----0", 120), (1, "-++++0", 100)):
        counts["3", v] = counts.get(("3", v), 0) + n
    truth, given = p.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert truth["3", "+----0"] < 0.1 and truth["3", "-++++0"] > 0.9
    assert 0.55 < given[0][1, 2] < 0.85 < given[1][1, 2]


def plain_reliabilities(rows, rounds=100):
    """The same estimate, one candidate at a time."""
    import math

    votes = [(k, v) for k, v, n in rows for _ in range(n)]
    sign = {"-": -1, "0": 0, "+": 1}
    truth = [1 / (1 + math.exp(-sum(t * sign[c] for t, c in zip(p.TRUST, v)))) for _, v in votes]
    for _ in range(rounds):
        count = [[{c: 0.5 + p.TRUST[j] * ((z, c) in ((1, "+"), (0, "-"))) for c in "-0+"} for z in (0, 1)] for j in range(6)]
        kinds = {k: [1.0, 1.0] for k, _ in votes}
        for (k, v), t in zip(votes, truth):
            for j, c in enumerate(v):
                count[j][1][c] += t * (c != "0")
                count[j][0][c] += (1 - t) * (c != "0")
            kinds[k][1] += t
            kinds[k][0] += 1 - t
        rate = [[{"0": 1, **{c: side[c] / (side["-"] + side["+"]) for c in "-+"}} for side in own] for own in count]
        truth = []
        for k, v in votes:
            z = math.log(kinds[k][1] / kinds[k][0]) + sum(math.log(rate[j][1][c] / rate[j][0][c]) for j, c in enumerate(v))
            truth.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return {x: t for x, t in zip(votes, truth)}


def test_reliabilities_equal_a_plain_version():
    import random

    random.seed(3)
    rows = [(str(random.randrange(5)), "".join(random.choice("-0+") for _ in range(6)), random.randint(1, 9)) for _ in range(40)]
    rows = sorted({(k, v): (k, v, n) for k, v, n in rows}.values())
    got, _ = p.reliabilities(rows)
    want = plain_reliabilities(rows)
    assert all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_added_spans(spark):
    """What the wider patterns add: secrets with a value that looks like one, and numbers written as
    others are; not words after a keyword."""
    rows = []
    for i in range(80):
        rows.append((i, f"x token = \"{i * 7919:08x}a9b8c7d6\" y"))
        rows.append((100 + i, f"the secret: plainly {i}"))
        rows.append((200 + i, f"phone +1 (988) 555-{1000 + i} or password=Zq{i}fT9xK2 ."))
        rows.append((300 + i, "the token = example ."))
    out = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in p.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == [("secret", 11)] and out[100 + i] == [] and out[300 + i] == [] for i in range(80))
    assert all([k for k, _ in out[200 + i]] == ["phone", "secret"] for i in range(80))


def test_em_finds_the_bad_labeler():
    import random

    random.seed(1)
    counts = {}
    for _ in range(4000):
        truth = random.random() < 0.4
        vote = lambda q: "+" if (random.random() < q) == truth else "-"
        v = "0" + vote(0.9) + vote(0.9) + vote(0.85) + vote(0.5) + vote(0.5)
        counts["3", v] = counts.get(("3", v), 0) + 1
    _, given = p.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    right = [(g[1, 2] + g[0, 0]) / 2 for g in given]
    assert min(right[1:4]) > 0.8 > 0.6 > max(right[4:])


def docs(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"write to user{i}@mail.example.com or call +1 (988) 555-{1000 + i} now", "x"))
        rows.append((100 + i, f"plain words and card 4337166598464399 host 10.0.0.{i} é", "x"))
        rows.append((200 + i, f"call us: 988 555 {1000 + i} soon", "x"))
        rows.append((300 + i, f"a number that fails 433716659846{4000 + 7 * i} here", "x"))
    return spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (0, rows[0][1], "x"), (None, "me@a.bc", "x")], "doc_id long, text string, found string")


def test_spans(spark):
    out = {}
    for r in p.find_personal_data(docs(spark)).collect():
        out.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    assert len(out[0]) == 2
    for k, rows in out.items():
        for r in rows:
            base = [(s.kind, s.start, s.end) for s in r.base_spans]
            assert base == plain(texts[k])
            assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
    assert out[900][0].spans == out[901][0].spans == []
    # What fails a card's check sum stays; nothing is added to plain words.
    assert all(bool(out[300 + i][0].spans) == p.luhn(re.sub("[^0-9]", "", texts[300 + i])) for i in range(60))


def test_redaction_keeps_the_other_columns(spark):
    df = docs(spark).withColumnRenamed("found", "n_chars")
    out = p.redact(df, chars=None).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].text == "write to [EMAIL] or call [PHONE] now" and by[1].n_chars == "x"
    assert by[900].text is None and by[901].text == "" and len(out) == df.count()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert p.find_personal_data(none).count() == p.redact(none).count() == 0
