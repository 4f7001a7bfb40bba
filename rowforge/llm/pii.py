"""Personal data in whole texts: patterns propose spans, checksums confirm them, words nearby adjust their score.

Each kind has a pattern, a check that drops what cannot be of the kind (digit counts, parts of an address, Luhn
for cards, the length of the country and mod-97 for account numbers), a score of its own, and words that raise or
lower it. Words count within ``BEFORE`` code points ahead of a span and ``AFTER`` behind it. Kinds that a pattern
alone shows (email, ip, card, phone) are always reported; the others where their score reaches ``LEAST`` and no
reported span overlaps them, the higher score first.

Every pattern is applied in one pass whose work grows with the text alone: no quantifier is retried from inside
its own run, and emails are found from their ``@`` outwards.

A null text is empty; an empty table gives an empty result; repeated rows each get their result; other columns
are ignored, or kept by ``redact``. Positions are code points, ends exclusive."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The four base patterns. They read like the plain ones, with runs that never give back.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Code points of an account number by country.
ACCOUNT_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
ACCOUNT = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(ACCOUNT_LENGTH)})[0-9]{{2}}")
ACCOUNT_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9(+.-])\(?[0-9]{3,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9-])")
BIRTH = re.compile(r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9/-])")

# Words that raise a score, in the languages of the corpus.
MAIL_WORDS = "e-?mail|mail|contact|kontakt|contacto|courriel|correo"
PHONE_WORDS = "phone|telephone|tel|mobile|cell|call|fax|handy|telefon|mobil|téléphone|portable|teléfono|móvil"
CARD_WORDS = "card|credit|visa|mastercard|amex|debit|karte|kreditkarte|carte|tarjeta"
ACCOUNT_WORDS = "iban|account|bank|konto|compte|cuenta|bic|swift"
ADDRESS_WORDS = "ip|address|host|server|login|client|adresse|dirección"
NATIONAL_WORDS = "ssn|social|security|taxpayer|national id|sozialversicherung|sécurité|seguridad"
BIRTH_WORDS = "born|birth|birthday|birthdate|dob|geboren|geburtsdatum|geburtstag|née?|naissance|nacid[oa]|nacimiento"
# Words that speak against a person's data.
OTHER_WORDS = "version|release|isbn|issn|doi|order|invoice|sku|serial|part|example|sample|dummy|test"

BEFORE, AFTER, LEAST = 40, 20, 0.5
RAISE, LOWER = 0.35, 0.25


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what its pattern alone is worth, what a passed checksum adds, and its words."""

    name: str
    prior: float
    confirmed: float
    words: re.Pattern
    always: bool = False


def _near(words: str) -> re.Pattern:
    return re.compile(rf"\b(?:{words})\b", re.I)


KINDS = (
    Kind("email", 0.85, 0.0, _near(MAIL_WORDS), True), Kind("ip", 0.5, 0.0, _near(ADDRESS_WORDS), True),
    Kind("card", 0.2, 0.5, _near(CARD_WORDS), True), Kind("phone", 0.6, 0.0, _near(PHONE_WORDS), True),
    Kind("account", 0.1, 0.6, _near(ACCOUNT_WORDS)), Kind("national", 0.3, 0.0, _near(NATIONAL_WORDS)),
    Kind("local_phone", 0.2, 0.0, _near(PHONE_WORDS)), Kind("birth", 0.2, 0.0, _near(BIRTH_WORDS)),
)
AGAINST = _near(OTHER_WORDS)
BASE = tuple(k.name for k in KINDS if k.always)
RANK = {k.name: i for i, k in enumerate(KINDS)}
FOUND = "array<struct<start:bigint,rank:int,end:bigint,score:double>>"

Proposal = tuple[int, int, bool]  # start, end, confirmed by a checksum


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of ten."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, its first four places moved to the end and letters read as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Proposal]:
    free = 0  # end of the last email
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:  # ends at the @ before, at the latest
            start -= 1
        if start < m.start():
            yield start, m.end(), False
            free = m.end()


def addresses(text: str) -> Iterator[Proposal]:
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            yield m.start(), m.end(), False


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def cards(text: str) -> Iterator[Proposal]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield m.start(), m.end(), True


def phones(text: str) -> Iterator[Proposal]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.start(), m.end(), False


def accounts(text: str) -> Iterator[Proposal]:
    for m in ACCOUNT.finditer(text):
        rest = ACCOUNT_REST.match(text, m.end())
        need = ACCOUNT_LENGTH[m[0][:2]]
        if rest is None:
            continue
        places = [k for k in range(m.start(), rest.end()) if text[k] != " "][:need]
        end = places[-1] + 1
        if len(places) == need and not text[end : end + 1].isalnum() and mod97("".join(text[k] for k in places)):
            yield m.start(), end, True


def _plain(pattern: re.Pattern):
    return lambda text: ((m.start(), m.end(), False) for m in pattern.finditer(text))


PROPOSE = dict(
    email=emails, ip=addresses, card=cards, phone=phones, account=accounts, national=_plain(NATIONAL), local_phone=_plain(LOCAL_PHONE), birth=_plain(BIRTH),
)


def score(text: str, kind: Kind, start: int, end: int, confirmed: bool) -> float:
    """What the pattern, its checksum and the words nearby say together, from 0 to 1."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    points = kind.prior + (kind.confirmed if confirmed else 0.0)
    points += RAISE if kind.words.search(before) or kind.words.search(after) else 0.0
    points -= LOWER if AGAINST.search(before) else 0.0
    return round(min(1.0, max(0.0, points)), 6)


def spans(text: str | None, least: float = LEAST) -> list[tuple[int, int, int, float]]:
    """(start, rank of the kind, end, score) of all reported spans, in order."""
    text = text or ""
    digit = re.search("[0-9]", text)
    out, weak = [], []
    for kind in KINDS:
        if digit is None and kind.name != "email":
            continue
        for start, end, confirmed in PROPOSE[kind.name](text):
            points = score(text, kind, start, end, confirmed)
            if kind.always:
                out.append((start, RANK[kind.name], end, points))
            elif points >= least:
                weak.append((-points, start, RANK[kind.name], end))
    return sorted(out + _free(weak, out)) if weak else sorted(out)


def _free(weak: list[tuple[float, int, int, int]], taken: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Weak spans (-score, start, rank, end), best first, that overlap neither a taken span nor a better weak one."""
    starts, ends, out = [], [], []
    for start, _, end, _ in sorted(taken):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for points, start, rank, end in sorted(weak):
        k = bisect_left(starts, end)
        if not k or ends[k - 1] <= start:
            starts.insert(k, start)
            ends.insert(k, end)
            out.append((start, rank, end, -points))
    return out


def scan(docs: DataFrame, *keep: str, least: float = LEAST) -> DataFrame:
    """Kept columns and ``found``, the spans of each text in order."""
    schema = docs.select(*keep).schema.add("found", DataType.fromDDL(FOUND))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "rank", "end", "score")
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in spans(t.as_py(), least)] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=schema.fieldNames())

    return docs.select(F.col("text").cast("string").alias("_text_"), *keep).mapInArrow(run, schema)


def written(found: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and the highest score (0 without any)."""
    rows = scan(docs, "doc_id")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    of = lambda rank: F.filter("found", lambda s: s["rank"] == rank)
    n = [F.size(of(RANK[kind])).cast("long").alias(f"n_{kind}") for kind in BASE]
    best = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    return rows.select("doc_id", *n, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), best.alias("score"))


def hidden(text: str | None, least: float = LEAST) -> str | None:
    """``text`` with each run of overlapping spans replaced by the kind of its first one, as ``[EMAIL]``."""
    found = spans(text, least)
    if not found:
        return text
    out, at = [], 0
    for start, rank, end, _ in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[rank].name.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all rows and other columns stay as they are."""
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([hidden(t.as_py(), least) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)
