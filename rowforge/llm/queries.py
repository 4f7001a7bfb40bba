"""The registered queries of this package and the SQL some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import decontaminate, extract, langid, neardup, packing, phrases, pii, quality, secrets, spotsigs, substrings, variants, warc
from rowforge.plans.catalog import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_warc",
    """
    WITH p AS (
        SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op1_warc(t: Tables) -> DataFrame:
    index, folder = warc.archive(t.spark, t.pages)
    return warc.read_bundles(index, folder)


@query("op2_language")
def op2_language(t: Tables) -> DataFrame:
    return langid.identify(t.documents)


@query("op3_decontamination")
def op3_decontamination(t: Tables) -> DataFrame:
    return decontaminate.find(t.documents, t.benchmark)


@query("op4_quality")
def op4_quality(t: Tables) -> DataFrame:
    return quality.resample(t.documents, t.labels).drop("_hash")


@query("op5_secrets")
def op5_secrets(t: Tables) -> DataFrame:
    return secrets.report(t.documents)


@query("op6_extraction")
def op6_extraction(t: Tables) -> DataFrame:
    return extract.extract(t.pages)


@query("op7_packing")
def op7_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents)


@query(
    "op8_neardup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct([array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w
    ), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT b, root FROM c JOIN both_ways ON a = c.doc_id)
    SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept
    FROM s JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) USING (doc_id)
    """,
)
def op8_neardup(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents).drop("a", "b")


@query(
    "op9_substrings",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
    m AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g),
    c AS (SELECT doc_id, i, coalesce(i - lag(i) OVER o > 50, TRUE) AS fresh FROM w JOIN m USING (g) WHERE first_id < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM runs),
    cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
        string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)
    """,
)
def op9_substrings(t: Tables) -> DataFrame:
    return substrings.remove_repeats(t.documents)


@query("op10_spotsigs")
def op10_spotsigs(t: Tables) -> DataFrame:
    return spotsigs.compare_with_next(t.documents)


@query(
    "op11_variants",
    r"""
    WITH RECURSIVE bits AS (
        SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
    ), crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
    runs AS (
        SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run
    ), hashed AS (
        SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hx, 2 * i + 1, 2))::BIGINT FOR i IN range(len(hx) // 2)]),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
        FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs), crc
    ), words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), skips AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word FROM skips a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM skips a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT near.word, count(*) AS n_near, min(struct_pack(m := -o.n, other := other)) AS b
        FROM near JOIN words o ON o.word = other GROUP BY near.word
    ), judged AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.other END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
        FROM words LEFT JOIN best USING (word)
    ), up AS (SELECT word, word AS at, form AS next FROM judged UNION ALL SELECT up.word, j.word, j.form FROM up JOIN judged j ON j.word = up.next)
    SELECT word, form, up.at AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
    FROM judged JOIN up USING (word) WHERE up.next IS NULL
    """,
)
def op11_variants(t: Tables) -> DataFrame:
    return variants.variants(t.documents)


@query("op12_pii")
def op12_pii(t: Tables) -> DataFrame:
    return pii.report(t.documents)


@query(
    "op13_phrases",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
    ), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS (
        SELECT lang, size, phrase, count(*) AS f FROM (
            SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, 5) s(size)))
        GROUP BY ALL HAVING count(*) >= 30 OR size = 1
    ), totals AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang),
    cands AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 : size], ' ') AS q
        FROM (SELECT *, unnest(range(1, size)) AS k FROM cands)),
    judged AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(2000000 * c.a::HUGEINT // (x.f + y.f) AS BIGINT) AS score
        FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.p JOIN grams y ON y.lang = c.lang AND y.phrase = c.q),
    best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer
        FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM cands, range(2, 4) s(m) WHERE m < size)),
    kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 80 * b.a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13_phrases(t: Tables) -> DataFrame:
    return phrases.collocations(t.documents)
