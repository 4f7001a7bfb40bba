"""Secrets in whole texts, with weak parts reported only beside the parts that complete them.

Native expressions only. Three kinds stand alone (assign, access, hex). Three more are weak: a user or
client name, a 40-character blob, an endpoint. A weak part is reported when the parts it needs lie in
its scope: a blob needs an identifier (access or user), a user needs a secret (assign, hex or blob), an
endpoint needs an identifier and a secret. A scope is an interval of ``2 * half`` code points; scopes
overlap by half, so parts closer than ``half`` always share one. Parts meet through an equi-join on the
scopes they lie in, never as pairs.

Null texts count as empty; an empty table gives an empty result; repeated rows each get their result;
other columns are ignored. Positions are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm.store import stage
from rowforge.operators.skew import attach

# The three base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6

USER = r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
BLOB = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+"""

BASE = ("assign", "access", "hex")
WEAK = ("user", "blob", "endpoint")
RANK = {kind: k for k, kind in enumerate(BASE + WEAK)}
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
HALF = 400
PLACEHOLDER = "[SECRET]"


def _spans(text: Column, pattern: str, kind: str, least: int | None = None) -> Column:
    """Matches as spans; with ``least``, those whose second group is shorter are dropped afterwards."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else F.array().cast("array<string>")).alias("value"),
    )
    start = lambda acc, x: acc["at"] + F.char_length(x["0"])
    stop = lambda acc, x: start(acc, x) + F.char_length(F.coalesce(x["1"], F.lit("")))
    named = F.transform(parts, lambda x: F.struct(x["gap"].alias("0"), x["hit"].alias("1"), x["value"].alias("2")))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct(start(acc, x).alias("start"), F.lit(RANK[kind]).alias("rank"), stop(acc, x).alias("end")))
        counts = x["1"].isNotNull() if least is None else x["1"].isNotNull() & (F.char_length(x["2"]) >= least)
        return F.struct(stop(acc, x).alias("at"), F.when(counts, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(named, zero, step, lambda acc: acc["out"])).otherwise(empty)


def base_spans(text: Column) -> Column:
    empty = F.array().cast(SPAN)
    return F.concat(
        _spans(text, ASSIGN, "assign", ASSIGN_LEAST),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(empty),
        _spans(text, HEX, "hex"),
    )


def weak_spans(text: Column) -> Column:
    empty = F.array().cast(SPAN)
    return F.concat(
        _spans(text, USER, "user"), _spans(text, BLOB, "blob"),
        F.when(F.contains(text, F.lit("://")), _spans(text, ENDPOINT, "endpoint")).otherwise(empty),
    )


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, ``base`` and ``weak`` spans, and a text key where there are weak ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, base_spans(text).alias("base"), weak_spans(text).alias("weak"), text.alias("_text"))
    key = F.when(F.size("weak") > 0, F.struct(F.xxhash64("_text").alias("a"), F.md5("_text").alias("b")))
    return rows.select(*keep, "base", "weak", key.alias("key"))


def linked(scanned: DataFrame, half: int = HALF) -> DataFrame:
    """Weak spans that their scope completes: one row per text key with ``linked`` spans.

    Copies of a text share a key and fold into one before anything is shuffled."""
    texts = scanned.where("key is not null").groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    parts = texts.select("key", F.explode(F.concat("base", "weak")).alias("span")).withColumn("tile", F.floor(F.col("span.start") / half))
    placed = parts.withColumn("scope", F.explode(F.array(F.col("tile"), F.col("tile") - 1)))
    rank = F.col("span.rank")
    identifier, endpoint = rank.isin(RANK["access"], RANK["user"]), rank == RANK["endpoint"]
    secret = rank.isin(RANK["assign"], RANK["hex"], RANK["blob"])
    scopes = placed.groupBy("key", "scope").agg(F.bool_or(identifier).alias("identifier"), F.bool_or(secret).alias("secret"))
    met = placed.where(rank >= len(BASE)).join(scopes, ["key", "scope"])
    complete = (
        F.when(endpoint, F.col("identifier") & F.col("secret")).when(rank == RANK["blob"], F.col("identifier")).otherwise(F.col("secret"))
    )
    return met.where(complete).groupBy("key").agg(F.collect_set("span").alias("linked"))


def with_linked(scanned: DataFrame, found: DataFrame, *keep: str) -> DataFrame:
    """Scanned rows with all ``spans`` in order; rows without weak parts skip the join."""
    empty = F.array().cast(SPAN)
    plain = scanned.where("key is null").select(*keep, "base", empty.alias("linked"))
    keyed = scanned.where("key is not null").withColumn("_a", F.col("key.a")).withColumn("_b", F.col("key.b"))
    facts = found.select(F.col("key.a").alias("_a"), F.col("key.b").alias("_b"), "linked")
    joined = attach(keyed, facts, ["_a", "_b"]).select(*keep, "base", F.coalesce("linked", empty).alias("linked"))
    rows = plain.unionByName(joined)
    own = F.filter("linked", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select(*keep, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", own)).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in RANK])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    scanned = stage(scan(docs, "doc_id"), "secret-scan")
    rows = with_linked(scanned, linked(scanned), "doc_id")
    of = lambda kind: F.filter("base", lambda s: s["rank"] == RANK[kind])
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redacted(text: Column, spans: str, placeholder: str = PLACEHOLDER) -> Column:
    """``text`` with each maximal run of spans replaced by ``placeholder``."""

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(placeholder)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.lit(2147483647)))
    return F.aggregate(spans, zero, step, rest)


def redact(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every secret replaced; ``n_chars``, where present, follows the new text. No row goes."""
    found = stage(linked(scan(docs)), "secret-links")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # own names can't clash
    rows = with_linked(scan(whole, "row"), found, "row")
    hit = F.size("spans") > 0
    text = F.when(hit, redacted(F.col("row.text"), "spans", placeholder)).otherwise(F.col("row.text"))
    rows = rows.select("row", hit.alias("hit"), text.alias("new"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in out:
        size = F.when(F.col("hit"), F.char_length("new")).otherwise(out["n_chars"])
        out["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(name) for name, c in out.items()])
