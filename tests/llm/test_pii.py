import hashlib
import random
import re
import time

import pytest

from rowforge.llm import pii

GOOD_CARD, BAD_CARD = "4111 1111 1111 1111", "4111 1111 1111 1112"
ACCOUNT = "DE89 3704 0044 0532 0130 00"
TEXTS = [
    None, "", "nothing", "mail a@b.co, x@y, @b.c@d.e, a@b@c.d and a.b+c%d@e-f.gh-i.j.", "p@q.r_s@t.u", "a@b..c a@b.c.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3",
    f"card {GOOD_CARD} or {BAD_CARD}", "4111111111111111 4111-1111-1111-1111 4111  1111 1111 1111", "411111111111111 1" + "1" * 30, "+1 (743) 555-3824 +1 2 +49.89.1234567- +123456789012345678 ++4912345678",
    "12 34", "0" * 12, "0" * 20, "5-", "😀 a@b.co 😀 +1 743 555 3824", f"IBAN {ACCOUNT} AND MORE", "IBAN DE89 3704 0044 0532 0130 01", f"x{ACCOUNT}", "DE893704004405320130 00X",
    "ssn 123-45-6789", "part 123-45-6789", "123-45-6789", "call (555) 123-4567 today", "see (555) 123-4567", "born 01.02.1990 in", "built 01.02.1990 in", "phone +1 743 555 3824 tel 743-555-3824",
    "1.2.3.4@5.6 +1.2.3.4.5.6.7.8.9 4111.1111.1111.1111",
]


def brute_base(text):
    """The four patterns as they are given, by plain search."""
    text = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m)[::-1]
        if 12 <= len(d) <= 19 and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            card.append(m.span())
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    base = sorted((s, k, e) for k, found in enumerate((email, ip, card, phone)) for s, e in found)
    names = ("email", "ip", "card", "phone")
    line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
    return (len(email), len(ip), len(card), len(phone), hashlib.sha256(line.encode()).hexdigest()), line


def noise(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["@", ".", "1", "23", "255", "256", " ", "-", "+", "a", "b.c", "(", ")", "0", "4111 1111 1111 1111", "é", "x@y.z", "%", "_"]) for _ in range(rng.randint(1, 60)))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, found string, score int, _text_ string")


def test_base_spans_against_plain_patterns(spark):
    texts = TEXTS + [noise(k) for k in range(1500)] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        want, line = brute_base(text)
        assert tuple(rows[k])[1:6] == want, text
        assert set(line.split(",")) - {""} <= set(rows[k].spans.split(",")), text
        kept = [s for s in rows[k].spans.split(",") if s and s.split(":")[0] in pii.BASE]
        assert ",".join(kept) == line
        places = [(int(a), pii.RANK[kind]) for kind, a, _ in (s.split(":") for s in rows[k].spans.split(",") if s)]
        assert places == sorted(places)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        (f"IBAN {ACCOUNT} AND MORE", ["account:5:32"]), ("IBAN DE89 3704 0044 0532 0130 01", []), (f"x{ACCOUNT}", []), (f"{ACCOUNT}X", []), (f"{ACCOUNT}.", ["account:0:27"]),
        ("ssn 123-45-6789", ["national:4:15"]), ("part 123-45-6789", []), ("123-45-6789", []), ("order example ssn: 123-45-6789", []), ("ssn 666-45-6789", []),
        ("call (555) 123-4567 today", ["local_phone:5:19"]), ("see (555) 123-4567", []), ("born 01.02.1990 in", ["birth:5:15"]), ("built 01.02.1990", []),
        ("tel +1 743 555 3824", ["phone:4:19"]),
    ],
)
def test_context_and_checksums(text, spans):
    assert [f"{pii.KINDS[k].name}:{s}:{e}" for s, k, e, _ in pii.spans(text)] == spans


def test_scores():
    of = lambda text: [s[3] for s in pii.spans(text)]
    assert of("visa 4111 1111 1111 1111") > of("4111 1111 1111 1111") > of("order 4111 1111 1111 1111")
    assert all(0 <= p <= 1 for t in TEXTS for p in of(t))


def test_checksums_against_definitions():
    for card in ("79927398713", "4539578763621486", "0"):
        assert pii.luhn(card) and not pii.luhn(str(int(card) + 1).zfill(len(card)))
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765423")


def test_work_grows_with_the_text_alone():
    for unit in ("a", "1", "1.", "1 ", "+1", "a@", "@a.", "(1", "12-", "DE89", "1.2.3.", "+1(((((", "a.b-"):
        text = unit * (1_000_000 // len(unit))
        start = time.perf_counter()
        found = pii.spans(text)
        assert time.perf_counter() - start < 20, unit
        starts = [s[0] for s in found]
        assert starts == sorted(starts)


def test_nulls_repeats_empty_and_redaction(spark):
    rows = [(None, TEXTS[3]), (1, TEXTS[3]), (1, TEXTS[3]), (2, None)]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.spans for r in got}) == 2
    empty = pii.report(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "score"]
    out = pii.redact(spark.createDataFrame([(1, f"a@b.co and {GOOD_CARD}!", "k"), (2, None, None), (3, "clean", "k")], "doc_id long, text string, found string")).collect()
    assert {r.doc_id: (r.text, r.found) for r in out} == {1: ("[EMAIL] and [CARD]!", "k"), 2: (None, None), 3: ("clean", "k")}
