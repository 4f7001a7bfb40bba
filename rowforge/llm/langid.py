"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary and the 256 single bytes. Per language, piece
probabilities are expected counts over all segmentations of the training words (forward and backward
sums). A text's score in a language is the sum over its words of the log of the forward sum, which holds
every segmentation. Words are lower-cased (A-Z) and begin with a space; one longer than ``CHUNK`` bytes is
cut into chunks of that size and segmentations don't cross a cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm import text as T
from rowforge.llm.store import stage

VOCABULARY = "piece_bpe_32k.model"
LONGEST = 12
CHUNK = 24
MOST_LANGUAGES = 2000
SPREAD = 0.1
UNKNOWN = "und"
LETTER = r"\p{L}"
BYTES = 3 << 20
REMEMBERED = 2_000_000  # scores a task keeps
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def vocabulary(path: str | None = None) -> list[bytes]:
    """Distinct pieces as bytes, lower case, at most ``LONGEST`` long, word starts as a space; then all bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            piece = bytes(LOWER[np.frombuffer(model.id_to_piece(k).replace("▁", " ").encode(), np.uint8)])
            if len(piece) <= LONGEST:
                found[piece] = None
    found.update((bytes([b]), None) for b in range(256))
    return list(found)


class Pieces:
    """Vectorised lookup of byte strings: polynomial hash to piece number, ``len(pieces)`` for none."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        codes = np.array([int(self.code(np.frombuffer(p, np.uint8))) for p in pieces], np.uint64)
        self.bits = 22
        slots = codes >> np.uint64(64 - self.bits)
        self.first = np.full(1 << self.bits, self.size, np.int32)
        self.first[slots] = np.arange(self.size)
        rest = np.flatnonzero(self.first[slots] != np.arange(self.size))
        order = rest[np.argsort(codes[rest])]
        self.rest, self.rest_codes = order.astype(np.int32), codes[order]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slots[rest]] = True
        self.codes = np.append(codes, np.uint64(0))

    @staticmethod
    def code(data: np.ndarray) -> np.uint64:
        return T.mix(Pieces.sums(data[None, :])[:, -1])[0]

    @staticmethod
    def sums(data: np.ndarray) -> np.ndarray:
        """Prefix sums per row, one more column than bytes."""
        up, _ = T.powers(max(CHUNK, data.shape[1]) + 2)
        out = np.zeros((data.shape[0], data.shape[1] + 1), np.uint64)
        np.cumsum(T.EXACT[data] * up[: data.shape[1]], axis=1, out=out[:, 1:])
        return out

    def find(self, codes: np.ndarray) -> np.ndarray:
        slots = codes >> np.uint64(64 - self.bits)
        out = self.first[slots]
        wrong = self.codes[out] != codes
        again = np.flatnonzero(wrong & self.crowded[slots])
        out[wrong] = self.size
        if len(again):
            at = np.searchsorted(self.rest_codes, codes[again])
            at[at == len(self.rest)] = 0
            hit = self.rest_codes[at] == codes[again]
            out[again[hit]] = self.rest[at[hit]]
        return out

    def grid(self, data: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end, (start, piece numbers of the rows' bytes between), for words of one length."""
        n = data.shape[1]
        sums, (_, down) = self.sums(data), T.powers(CHUNK + 2)
        return [[(i, self.find(T.mix((sums[:, j] - sums[:, i]) * down[i]))) for i in range(max(0, j - LONGEST), j)] for j in range(1, n + 1)]


def forward(grid: list, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of every prefix: (length + 1, words, languages). ``prob``: (pieces + 1, languages)."""
    rows = len(grid[0][0][1])
    out = np.zeros((len(grid) + 1, rows, prob.shape[1]))
    out[0] = 1
    for j, column in enumerate(grid, 1):
        for i, piece in column:
            out[j] += out[i] * prob[piece]
    return out


def expected(grid: list, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of weighted words; ``prob``: (pieces + 1, 1)."""
    ahead = forward(grid, prob)[:, :, 0]
    n = len(grid)
    behind = np.zeros_like(ahead)
    behind[n] = 1
    total, found = weight / ahead[n], np.zeros(len(prob))
    p = prob[:, 0]
    for j in range(n, 0, -1):
        for i, piece in grid[j - 1]:
            both = p[piece] * behind[j]
            behind[i] += both
            found += np.bincount(piece, weights=ahead[i] * both * total, minlength=len(prob))
    return found


def distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row and word number of each word chunk, hashes of the distinct ones, and their bytes by length as (numbers, bytes)."""
    found = T.words(column)
    row, start, end, code = found.row, found.start, found.end, found.hash
    room = CHUNK - 1
    if len(start) and (end - start).max() > room:
        many = -(-(end - start) // room)
        pick = np.repeat(np.arange(len(start)), many)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
        row, start, end = row[pick], start[pick] + step * room, np.minimum(start[pick] + (step + 1) * room, end[pick])
        sums, (_, down) = T.prefix_hash(found.data, T.FOLDED), T.powers(len(found.data) + 1)
        code = T.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    codes, first, number = np.unique(code, return_index=True, return_inverse=True)
    size = (end - start)[first]
    groups = []
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        data = LOWER[found.data[start[first[which]][:, None] + np.arange(n)]]
        groups.append((which, np.concatenate([np.full((len(which), 1), 32, np.uint8), data], axis=1)))
    return row, number, codes, groups


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, path: str | None = None) -> DataFrame:
    """lang, piece, n: expected piece counts of each language over all training texts (text, lang; nulls left out).

    Each task adds up its texts first: at most one row per language and piece leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary(path))
        prob = np.full((pieces.size + 1, 1), 1.0 / pieces.size)
        prob[-1] = 0
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.columns[:2]
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                for a, b in T.pieces(own, BYTES):
                    _, number, codes, groups = distinct(own.slice(a, b - a))
                    weight = np.bincount(number, minlength=len(codes)).astype(float)
                    for which, data in groups:
                        for c in range(0, len(which), 20_000):
                            part = slice(c, c + 20_000)
                            total[lang] = total.get(lang, 0) + expected(pieces.grid(data[part]), prob, weight[which[part]])
        for lang, n in total.items():
            at = np.flatnonzero(n[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "piece", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, piece int, n double")
    return parts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def model(counted: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order and (pieces + 1, languages) probabilities.

    What reaches the driver holds a row per language and piece of the fixed vocabulary; more than
    ``MOST_LANGUAGES`` languages are refused."""
    langs = [r.lang for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    langs.sort()
    out = np.zeros((len(vocabulary(path)) + 1, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for lang, piece, n in counted.collect():
        out[piece, place[lang]] = n
    out[:-1] += SPREAD
    if langs:
        out[:-1] /= out[:-1].sum(axis=0)
    return langs, out


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, *keep: str, path: str | None = None) -> DataFrame:
    """Kept columns, ``lang_pred`` and ``score`` (the language's share of the summed likelihoods) of each text.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. Equal scores go to the
    first language in order. Only the text is looked at."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, names = Pieces(vocabulary(path)), np.array([*langs, UNKNOWN], object)
        known, values = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            texts, best, score = batch.column(0), np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, LETTER), False))
            for a, b in T.pieces(texts, BYTES) if langs else ():
                row, number, codes, groups = distinct(texts.slice(a, b - a))
                logs = np.zeros((len(codes), len(langs)))
                at = np.searchsorted(known, codes)
                at[at == len(known)] = 0
                old = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                logs[old] = values[at[old]]
                for which, data in groups:
                    new = np.flatnonzero(~old[which])
                    for c in range(0, len(new), 20_000):
                        part = new[c : c + 20_000]
                        logs[which[part]] = np.log(forward(pieces.grid(data[part]), prob)[-1])
                if (len(known) + len(codes)) * len(langs) > REMEMBERED:
                    known, values = codes, logs
                else:
                    known, values = np.concatenate([known, codes[~old]]), np.concatenate([values, logs[~old]])
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                total = np.stack([np.bincount(row, weights=logs[number, k], minlength=b - a) for k in range(len(langs))], axis=1)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best[a:b], score[a:b] = share.argmax(axis=1), share.max(axis=1)
            best[~letters], score[~letters] = len(langs), 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(score)], names=schema.fieldNames())

    return docs.select(F.col("text").cast("string").alias("_text_"), *keep).mapInArrow(run, schema)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learn from the documents that aren't held out, predict all of them."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    langs, prob = model(stage(train(marked.where("NOT held_out"), path), "pieces-by-language"), path)
    return predict(marked, langs, prob, "doc_id", "held_out", path=path)
