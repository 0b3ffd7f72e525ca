"""Secret scan: the fixed patterns and the guess cost against brute force, and odd rows."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from clickloom.llm import guess_cost, queries, secret_scan

DOCS = "doc_id bigint, text string, spans string, values int, _row int, word int, n int"
KINDS = ("assign", "access", "hex")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"""({'|'.join(map(either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def shares(texts, values):
    """The dictionary: runs of letters of all texts, less those of the values."""
    counts = Counter()
    for t in texts:
        counts.update(re.findall("[a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)))
    for v in values:
        counts.subtract(re.findall("[a-z\x80-\U0010ffff]+", v.translate(LOWER)))
    counts = {w: n for w, n in counts.items() if n > 0 and 3 <= len(w.encode()) <= 96}
    total = sum(counts.values())
    return {w: n / total for w, n in counts.items()}


def expected(texts, threshold=secret_scan.GUESSES):
    found = [secret_scan.credential_values(t or "") for t in texts]
    share = shares(texts, [v for row in found for _, _, v in row])
    out = []
    for t, row in zip(texts, found):
        spans = base(t)
        costs = [(a, b, guess_cost.guesses(v, [(i, j, w, share[w]) for i, j, w in guess_cost.readings(v) if w in share])) for a, b, v in row]
        out.append((spans, sorted({(a, 3, b) for a, b, c in costs if c >= threshold}), costs))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, expected([d.text for d in docs]))}
    got = queries.queries()["op13_secrets"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        fixed, hard, costs = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.n_guess) == (*(sum(k == i for _, k, _ in fixed) for i in range(3)), len(hard))
        assert r.base_sha256 == digest(fixed)
        assert r.spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(fixed + hard))
        assert r.n_easy == len(costs) - len(hard)
    assert sum(r.n_guess for r in got) > 5


def test_odd_rows(spark):
    long = "word " * 40_000 + "password=Zx9$kLm2!qW " + "ab" * 3000 + " end"
    texts = [
        None, "", "password", "token =", "paſſword=abcdef1 toKen=abcdef1", 'pwd: "Tr0ub4dor &3 xk!"', "the secret is wonderful", "wonderful things are wonderful",
        "login=monkey1 monkey monkey", "https://me:Vq8#rT5^pL@host/x and http://me:secret@host", "API_KEY='q8Zr-T5vL+x9/Qw.1' apikey:short", "é" * 9 + "SECRET=ßabcdefg",
        "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15, "a" * 24 + "g" + "b" * 23, "x" * 5000, long, long, "Authorization: Bearer aB3dE5fG7hJ9kL", "password=" + "7f3k" * 1500,
    ]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in rows], DOCS)
    got = secret_scan.secret_digests(secret_scan.secrets(docs)).collect()
    want = [(i, len([s for s in fixed if s[1] == 0]), len(hard), digest(fixed), ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(fixed + hard)))
            for (i, _), (fixed, hard, _) in zip(rows, expected(texts))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_assign, r.n_guess, r.base_sha256, r.spans) for r in got), key=key) == sorted(want, key=key)
    spans = {r.doc_id: r.spans for r in got if r.doc_id is not None}
    assert spans[5] == "guess:6:22" and spans[6] == "" and spans[9] == "guess:11:21"
    assert secret_scan.secrets(docs.limit(0)).collect() == []


def test_one_value_in_a_third_of_all_texts(spark):
    value = "Zx9$kLm2!qW"
    docs = spark.range(900).selectExpr("id as doc_id", f"if(id % 3 = 0, 'my password: {value} here', concat('some text ', id)) as text").repartition(9)
    got = secret_scan.secret_digests(secret_scan.secrets(docs)).collect()
    assert len(got) == 900
    assert {(r.doc_id % 3 == 0, r.spans) for r in got} == {(True, "guess:13:24"), (False, "")}


def brute(value, found):
    """The cheapest of all cuts, one by one."""
    if not value:
        return 0.0
    best = guess_cost.character(value[-1]) + brute(value[:-1], found)
    for a, b, c in found:
        if b == len(value):
            best = min(best, c + brute(value[:a], found))
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("aab1@qwe9-2Zé", max_size=9), st.dictionaries(st.text("abeqw", min_size=3, max_size=5), st.floats(1e-9, 1), max_size=5))
def test_cheapest_cut(value, share):
    words = [(a, b, w, share[w]) for a, b, w in guess_cost.readings(value) if w in share]
    found = guess_cost.segments(value, words)
    assert all(0 <= a < b <= len(value) and c >= 0 for a, b, c in found)
    assert math.isclose(guess_cost.guesses(value, words), brute(value, found), abs_tol=1e-9)


@settings(max_examples=150, deadline=None)
@given(st.text("ab41@É", max_size=30))
def test_readings(value):
    tables = [str.maketrans({"4": "a", "@": "a", "1": one}) for one in "il"]
    plain, want = value.translate(LOWER), set()
    for read in (plain, *(plain.translate(t) for t in tables)):
        for a in range(len(value)):
            for b in range(a + 3, min(a + 24, len(value)) + 1):
                changed = sum(x != y for x, y in zip(plain[a:b], read[a:b]))
                if all(c.isalpha() for c in read[a:b]) and 3 * changed <= b - a:
                    want.add((a, b, read[a:b]))
    assert list(guess_cost.readings(value)) == sorted(want)


@pytest.mark.parametrize("easy, hard", [
    ("qwertyuiop", "qzwmeurpix"), ("aaaaaaaaaa", "ahqmaxpzla"), ("abcabcabcabc", "abcxqzmvplwk"), ("1984-05-12", "8419-50-21"), ("19840512", "98417259"),
    ("monkeymonkey", "monkeyqxzvwk"), ("Monkey1", "mOnkeY1"), ("m0nkey", "m0nk3y"),
])
def test_patterns_are_cheaper(easy, hard):
    share = {"monkey": 1e-6}
    cost = lambda v: guess_cost.guesses(v, [(a, b, w, share[w]) for a, b, w in guess_cost.readings(v) if w in share])
    assert cost(easy) < cost(hard) - 0.1
