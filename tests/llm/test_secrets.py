import hashlib
import re

from rowforge.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "AbC9" * 10
TEXTS = [
    None, "", "nothing here", "token = token = \"abcdef123\"", "secret=secret=abcdefgh", "PassWord : hunter22 and api_key='xy' apikey:'longenough'",
    "😀 token: 😀 token:abcdef AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 16, "AKIA" + "Z" * 15, "x" + "a" * 23 + "g" + "0" * 24 + "h" + "f" * 30,
    f"blob {KEY} alone", f"AKIA{'Q' * 16} then {KEY} near", f"AKIA{'Q' * 16}" + " w" * 900 + f" {KEY}", "user: bob", "user: bob password: hunter22",
    "https://a.example.com/x", f"https://a.example.com/x user=bob {KEY}", "secreſ: abcdefgh toKen: abcdefgh", "token=abcdef " * 40,
]


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [(m.start(), 3, m.end()) for m in re.finditer(secrets.USER, text, re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(secrets.BLOB, text, re.A)]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT, text, re.A)]
    scopes = lambda s: {s[0] // secrets.HALF, s[0] // secrets.HALF - 1}
    have = lambda s, ranks: {k for k in scopes(s) if any(k in scopes(p) and p[1] in ranks for p in base + weak)}
    linked = []
    for s in weak:
        i, c = have(s, (1, 3)), have(s, (0, 2, 4))
        if any(b[0] < s[2] and s[0] < b[2] for b in base):
            continue
        if (i & c) if s[1] == 5 else i if s[1] == 4 else c:
            linked.append(s)
    names = [*secrets.RANK]
    join = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = [sum(s[1] == k for s in base) for k in range(3)]
    return (*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(base + linked))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, key string, base int, spans string")


def test_against_brute_force(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts.append("filler words " * 20000 + "token=abcdef " + f"AKIA{'Q' * 16} {KEY}")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.report(frame(spark, texts)).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert "blob" in got[10][-1] and "blob" not in got[9][-1] and "blob" not in got[11][-1] and "endpoint" in got[15][-1]


def test_repeats_nulls_and_empty(spark):
    rows = [(None, TEXTS[10]), (1, TEXTS[10]), (1, TEXTS[10]), (None, None)]
    got = secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.spans for r in got}) == 2
    assert secrets.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    texts = ["a token=abcdef b", f"AKIA{'Q' * 16}{KEY[:0]} then {KEY} é", "clean é", None, "password=" + "a" * 30]
    rows = secrets.redact(spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")).collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in rows}
    assert got == {0: ("a [SECRET] b", 12), 1: ("[SECRET] then [SECRET] é", 24), 2: ("clean é", 7), 3: (None, 7), 4: ("[SECRET]", 8)}
