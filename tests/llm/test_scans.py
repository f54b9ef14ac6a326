"""Secrets and licences."""

import hashlib
import random
import re
import textwrap

import pytest

from panelstat.llm import license_scan as L, secret_scan as S

from .conftest import LOWER_TABLE, ODD


def brute_base(text):
    """The contract, pattern by pattern."""
    out = []
    for m in re.finditer(S.ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(S.ACCESS, text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(S.HEX, text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def base(text):
    return [s for s in S.find_secrets(text) if s[0] in S.BASE_KINDS]


def test_base_spans_on_random_texts():
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "pass", "AKIA", "ABCDEFGHIJKLMNOP", "=", ":",
             " ", "'", '"', "deadbeef", "0123456789abcdef", "x9", "\n", "é", "İ", "ſecret", "toKen", "-", "_", "/", "."]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(text) == brute_base(text), repr(text)


def test_base_spans_of_the_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert base(r["text"]) == brute_base(r["text"])


def test_drops_come_after_matching():
    # the short match takes the text in which another one would start
    assert base("token=secret=abc token=abcdefgh") == brute_base("token=secret=abc token=abcdefgh")
    assert base("İİ password = 'hunter2hunter2'") == [("assign", 3, 29)]


def test_checksums_decide():
    body = "abcDEF0123456789abcDEF01234567"
    good = "ghp_" + body + S.base62_crc(body)
    bad = "ghp_" + body + ("000000" if S.base62_crc(body) != "000000" else "000001")
    assert ("github", 3, 43) in S.find_secrets("is " + good) and not S.find_secrets(bad)
    assert ("npm", 0, 40) in S.find_secrets("npm_" + good[4:])
    assert S.find_secrets("4111 1111 1111 1111") == [("card", 0, 19)] and not S.find_secrets("4111 1111 1111 1112")
    assert S.find_secrets("-----BEGIN RSA PRIVATE KEY-----") == [("private_key", 0, 31)]


def test_secrets_of_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in S.scan_secrets(odd).collect()), key=str)
    assert got == sorted(((r[0], S.find_secrets(r[1] or "")) for r in ODD), key=str)
    assert S.scan_secrets(empty).count() == 0


def test_secret_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in S.op9_secret_scan(spark, sf).collect():
        spans = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(S.joined(spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in S.BASE_KINDS]
        assert set(map(":".join, ((k, str(a), str(b)) for k, a, b in spans))) <= set(r["spans"].split(","))


def brute_licenses(text):
    lowered = (text or "").translate(LOWER_TABLE)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lowered)
    at, named = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        at += hits
        named |= {label} if hits else set()
    method, best = brute_windows(text or "")
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named)),
            ",".join(sorted(named | method)), 1.0 if at else best)


def test_licenses_against_brute_force(make):
    rng = random.Random(13)
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(L.TEMPLATES)[1].split()
            rng.shuffle(words) if rng.random() < 0.3 else None
            words = [w for w in words if rng.random() < 0.96] + rng.choice([[], ["extra", "naïve", "世界"]])
            lines.append(rng.choice([" ", ", ", " -- ", "\x00"]).join(w.upper() if rng.random() < 0.2 else w for w in words))
        rows.append((i, "\n".join(lines), "src0"))
    rows += [(1000, "mit license mit license MIT\nLicense", "s"), (1001, "cc by cc by-cc.by", "s"), (1002, "admit license", "s")]
    got = {r["doc_id"]: tuple(r)[1:-1] for r in L.scan_licenses(make(rows)).collect()}
    for i, text, _ in rows:
        assert got[i] == brute_licenses(text), (i, text)


@pytest.mark.parametrize("templates", [L.TEMPLATES, []])
def test_licenses_of_odd_rows(odd, empty, templates):
    got = sorted((tuple(r)[:-1] for r in L.scan_licenses(odd, templates=templates).collect()), key=str)
    want = sorted(((r[0], *brute_licenses(r[1])) for r in ODD), key=str)
    assert got == want
    assert L.scan_licenses(empty, templates=templates).count() == 0


def wrapped(text, width, lead=""):
    """The text in lines of at most ``width`` characters, as in a source file."""
    return "\n".join(lead + line for line in textwrap.wrap(text, width))


def test_wrapped_notices_are_found(make):
    rows, want = [], {}
    for k, (label, template) in enumerate(L.TEMPLATES):
        for w, width in enumerate((16, 30, 72)):
            for p, lead in enumerate(("", " * ", "# ")):
                i = 100 * k + 10 * w + p
                rows.append((i, "Some code\n" + wrapped(template.capitalize(), width, lead) + "\nand more of it", "src0"))
                want[i] = label
    for r in L.scan_licenses(make(rows)).collect():
        assert want[r["doc_id"]] in r["labels"].split(",") and r["score"] == 1.0, r


def test_scattered_words_do_not_add_up(make):
    filler = " ".join(f"word{i}" for i in range(200))
    rows = [(k, f" {filler} ".join(template.split()), "s") for k, (_, template) in enumerate(L.TEMPLATES)]
    rows += [(100, "Released by Someone Else under the old MIT license", "s"),
             (101, f"{filler} released by someone else under the well known MIT license {filler}", "s")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan_licenses(make(rows)).collect()}
    assert got.pop(100) == got.pop(101) == ("mit", 1.0)
    assert set(got.values()) == {("", 0.0)}


def brute_windows(text):
    """Every run of words against every template: labels and the best share."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lowered, best, labels = text.translate(LOWER_TABLE), 0.0, set()
    for label, template in L.TEMPLATES:
        tokens, n = set(template.split()), len(template.split())
        for words, width in [(word.findall(lowered), n)] + [(word.findall(x), L.LINE_SPAN * n) for x in lowered.split("\n")]:
            if len(tokens & set(words)) / len(tokens) < L.THRESHOLD - 1e-12:
                continue  # no run holds more
            for start in range(max(1, len(words) - width + 1)):
                share = len(tokens & set(words[start:start + width])) / len(tokens)
                if share >= L.THRESHOLD - 1e-12:
                    best, labels = max(best, round(share, 6)), labels | {label}
    return labels, best


def test_runs_of_words_against_brute_force(make):
    rng = random.Random(17)
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            some = [w for w in rng.choice(L.TEMPLATES)[1].split() if rng.random() < 0.97]
            gap = rng.choice([0, 0, 0.05, 0.5])
            words += [x for w in some for x in ([w, "between"] if rng.random() < gap else [w])] + ["other"] * rng.randint(0, 3)
        breaks = rng.choice([0, 0.02, 0.15])
        rows.append((i, "".join(w + ("\n" if rng.random() < breaks else " ") for w in words), "src0"))
    seen = set()
    for r in L.scan_licenses(make(rows)).collect():
        labels, best = brute_windows(rows[r["doc_id"]][1])
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, r["base_labels"].split(","))))), rows[r["doc_id"]]
        assert r["score"] == (1.0 if r["n_base"] else best)
        seen |= {b is None for b, _, _ in r["matches"]}
    assert seen == {True, False}


def test_sql_follows_the_same_rule(spark, make, tmp_path):
    """Wrapped, scattered and overlong notices: the DuckDB text against the operator."""
    import duckdb

    rng, rows = random.Random(23), []
    for i, (_, template) in enumerate(L.TEMPLATES * 3):
        words = [w for w in template.split() if rng.random() < 0.98]
        gap = rng.choice([0, 1, 3, 5])
        spread = [x for w in words for x in [w] + ["filler"] * rng.randint(0, gap)]
        rows.append((i, rng.choice([" ".join(spread), wrapped(" ".join(spread), 60, "# "), "Intro. " * 400 + " ".join(words)]), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "MIT License", "s")]
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = L.scan_licenses(docs).drop("matches")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({L.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {0.0} < {r[-1] for r in want}
