import zlib

import numpy as np
from pyspark.sql import functions as F

from rowforge.llm import langid as L


def brute_forward(word: bytes, prob: dict[bytes, float]) -> float:
    out = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - L.LONGEST), j):
            out[j] += out[i] * prob.get(word[i:j], 0.0)
    return out[-1]


def test_forward_and_expected_counts():
    pieces = [b" a", b"ab", b"b", b"a", b" ", b"bb", b" ab"]
    table = L.Pieces(pieces)
    p = np.array([0.1, 0.2, 0.05, 0.3, 0.15, 0.1, 0.1, 0.0])[:, None]
    prob = dict(zip(pieces, p[:, 0], strict=False))
    word = b" abab"
    grid = table.grid(np.frombuffer(word, np.uint8)[None, :])
    whole = brute_forward(word, prob)
    assert abs(L.forward(grid, p)[-1][0, 0] - whole) < 1e-15

    def segmentations(rest):
        if not rest:
            yield ()
        for q in pieces:
            if rest.startswith(q):
                yield from ((q, *more) for more in segmentations(rest[len(q) :]))

    want = {q: sum(s.count(q) * np.prod([prob[x] for x in s]) for s in segmentations(word)) / whole for q in pieces}
    got = L.expected(grid, p, np.array([3.0]))
    assert np.allclose([3 * want[q] for q in pieces], got[:-1]) and got[-1] == 0


def test_lookup_finds_every_piece_and_nothing_else():
    pieces = L.vocabulary()
    table = L.Pieces(pieces)
    for n in range(1, L.LONGEST + 1):
        own = [k for k, q in enumerate(pieces) if len(q) == n]
        data = np.array([np.frombuffer(pieces[k], np.uint8) for k in own])
        found = table.grid(data)[-1][0][1] if n <= L.LONGEST else None
        assert found.tolist() == own
    assert table.grid(np.frombuffer(b"\x00\x01\x02", np.uint8)[None, :])[-1][0][1][0] == table.size


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, piece string, held_out int")


def test_scores_against_plain_python(spark):
    rows = [(k, t, lang, "p", 1) for k, (t, lang) in enumerate([("The dog ran home", "en"), ("der Hund lief heim", "de"), ("a the the", "en"), ("und der die " * 5, "de")])]
    langs, prob = L.model(L.train(docs(spark, rows)))
    names = L.vocabulary()
    texts = ["the Hund " + "x" * 60, "ran", "42 !", None, "", "Äö der"]
    got = [(r.lang_pred, r.score) for r in L.predict(docs(spark, [(k, t, None, "p", 1) for k, t in enumerate(texts)]), langs, prob, "doc_id").orderBy("doc_id").collect()]
    tables = [dict(zip(names, prob[:-1, k], strict=True)) for k in range(len(langs))]
    room = L.CHUNK - 1
    for t, (pred, score) in zip(texts, got, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (pred, score) == ("und", 0)
            continue
        words = [w.encode() for w in t.translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
        chunks = [b" " + w[k : k + room] for w in words for k in range(0, len(w), room)]
        total = np.array([sum(np.log(brute_forward(c, table)) for c in chunks) for table in tables])
        share = np.exp(total - total.max())
        share /= share.sum()
        assert pred == langs[share.argmax()] and abs(score - share.max()) < 1e-9


def test_held_out_accuracy(spark):
    got = L.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in held)


def test_odd_rows(spark):
    rows = [(None, "the dog", None, "p", 1), (1, None, "en", "p", 1), (0, "the dog", "en", "p", 1), (0, "the dog", "en", "p", 1), (2, "x" * 200_000, "en", "p", 1)]
    got = L.identify(docs(spark, rows)).collect()
    assert len(got) == 5 and sorted(r.lang_pred for r in got) == ["en", "en", "en", "en", "und"]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert L.identify(docs(spark, [])).count() == 0
    untaught = L.identify(docs(spark, [(0, "the dog", None, "p", 1)])).first()
    assert (untaught.lang_pred, untaught.score) == ("und", 0)
    assert L.identify(docs(spark, rows)).where(F.col("score").isNull()).count() == 0
