"""Removal of byte strings that an earlier document also holds, by shards of suffixes.

Every window of ``length`` bytes is filed under its anchor, the smallest hash among its ``GRAM``-byte strings,
so equal windows share it. Anchors seen in one document only are settled at once. The others are cut out
with the bytes of all windows filed under them and meet in shards by anchor. There the suffixes are sorted
by induction; runs with ``length`` bytes in common are equal windows, and all but those of the smallest doc_id
are covered.

Rows are written once in chunks. What concerns a chunk (copies, shared anchors, covered bytes) is written
under its number and read back by the task that holds the chunk, so texts are never shuffled. Equal
anchors and equal cuts fold within a task before they move, so a passage of any number of documents costs a
shard one entry a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm import suffixes
from rowforge.llm import text as T
from rowforge.llm.store import shared_folder, stage
from rowforge.operators.skew import attach

LENGTH = 50
GRAM = 20
BLOCK = 3 << 20  # bytes of text handled together
SEGMENT = 1 << 20
RANGE_ANCHORS = 1 << 20
SHARD_BYTES = 1 << 20
PLACE = 24  # low bits of a sort key that hold a position
LAST = (1 << 63) - 1
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, byte planes apart; the empty planes vanish when compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


@dataclass
class Cuts:
    """Anchors of some rows' windows: row, first window start and past the last (bytes of the row), anchor code,
    and a hash of the bytes that the windows cover."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    code: np.ndarray
    content: np.ndarray


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(column: pa.Array, length: int = LENGTH, gram: int = GRAM) -> Cuts:
    """Windows of every row, grouped by anchor. Long rows are taken in overlapping segments."""
    data, offsets = T.utf8(column)
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    rows = len(column)
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1)
        to = min(to, rows)
        low, high = int(offsets[at]), int(offsets[to])
        for begin in range(low, max(high - length + 1, low), SEGMENT * 2):
            end = min(begin + SEGMENT * 2 + length - 1, high)
            found.append(_anchors(data[begin:end], np.clip(offsets[at : to + 1] - begin, 0, end - begin), begin - offsets[at:to], at, length, gram))
        at = to
    if not found:
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    return Cuts(*[np.concatenate(c) for c in zip(*found, strict=True)])


def _anchors(data: np.ndarray, offsets: np.ndarray, shift: np.ndarray, first_row: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    sums, (_, down) = T.prefix_hash(data, T.EXACT), T.powers(len(data) + 1)
    code = T.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    low = np.uint64((1 << PLACE) - 1)
    best = smallest((code & ~low) | np.arange(len(code), dtype=np.uint64), length - gram + 1) & low
    windows = np.zeros(len(data) + 1, np.int32)
    wide = offsets[1:] - offsets[:-1] >= length
    np.add.at(windows, offsets[:-1][wide], 1)
    np.add.at(windows, offsets[1:][wide] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(windows[: len(best)]) > 0)
    if not len(start):
        return none
    row = np.searchsorted(offsets, start, "right") - 1
    anchor = best[start].astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    a, b = start[head], np.append(start[head[1:] - 1], start[-1]) + 1
    row = row[head]
    content = T.mix((sums[b + length - 1] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return row + first_row, a + shift[row], b + shift[row], T.mix(code[anchor[head]] + np.uint64(1)), content


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, row, doc_id, order, text: the rows as written once; null ids come last and null texts are empty."""
    number = F.monotonically_increasing_id()
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("order"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stage(rows.select(F.spark_partition_id().cast("long").alias("chunk"), number.alias("row"), "doc_id", "order", "text"), "chunks")


def by_chunk(df: DataFrame, name: str) -> str:
    """Write ``df`` under its chunk numbers; the folder."""
    path = shared_folder(df.sparkSession, name) + "/table"
    df.repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    return path


def of_chunk(path: str, chunk: int) -> pa.Table | None:
    """What was written for ``chunk``."""
    files, root = pa.fs.FileSystem.from_uri(path)
    where = f"{root}/chunk={chunk}"
    if files.get_file_info(where).type != pa.fs.FileType.Directory:
        return None
    return pa.dataset.dataset(where, filesystem=files, format="parquet").to_table()


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one chunk, about ``most`` bytes of text at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column("chunk")[0].as_py() != chunk[a]:
                yield held[0].column("chunk")[0].as_py(), pa.Table.from_batches(held)
                held, size = [], 0
            part = batch.slice(a, b - a)
            for low, high in T.pieces(part.column("text"), most, 1 << 30):
                piece = part.slice(low, high - low)
                held.append(piece)
                size += int(T.utf8(piece.column("text"))[1][-1])
                if size >= most:
                    yield int(chunk[a]), pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield held[0].column("chunk")[0].as_py(), pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    joined = table.column(name).combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], joined.type)


class Side:
    """Per-chunk tables, read when the chunk changes."""

    def __init__(self, path: str, make: Callable[[pa.Table | None], object]):
        self.path, self.make, self.chunk, self.value = path, make, None, None

    def __call__(self, chunk: int):
        if chunk != self.chunk:
            self.chunk, self.value = chunk, self.make(of_chunk(self.path, chunk))
        return self.value


def _copies(table: pa.Table | None) -> np.ndarray:
    return np.sort(np.asarray(table.column("row"))) if table is not None else np.zeros(0, np.int64)


def _shared(table: pa.Table | None) -> np.ndarray:
    return np.unique(np.concatenate([unpacked(b.as_py()) for b in table.column("codes")])) if table is not None else np.zeros(0, np.uint64)


def _covered(table: pa.Table | None) -> tuple[np.ndarray, ...]:
    if table is None:
        return (np.zeros(0, np.int64),) * 3
    parts = [np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column(c)]) for c in ("rows", "starts", "stops")]
    order = np.argsort(parts[0], kind="stable")
    return tuple(p[order] for p in parts)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def find_copies(chunks: DataFrame) -> DataFrame:
    """chunk, row of rows whose whole text an earlier document has."""
    digest = chunks.select("chunk", "row", "order", F.xxhash64("text").alias("a"), F.md5("text").alias("b"), F.octet_length("text").alias("n"))
    digest = stage(digest.where("n > 0").drop("n"), "digests")
    first = digest.groupBy("a", "b").agg(F.min("order").alias("_first"), F.max("order").alias("_last")).where("_first < _last").drop("_last")
    return attach(digest, first, ["a", "b"], "inner").where("order > _first").select("chunk", "row")


def shared_anchors(chunks: DataFrame, copies: str, ranges: int, length: int, gram: int) -> DataFrame:
    """chunk, codes, n: the anchors of each chunk that more than one document holds."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = Side(copies, _copies)
        for chunk, table in blocks(batches):
            keep = ~member(np.asarray(column(table, "row")), skip(chunk))
            table = table.filter(pa.array(keep))
            cuts, order = anchors(column(table, "text"), length, gram), np.asarray(column(table, "order"))
            both = np.lexsort((order[cuts.row], cuts.code >> np.uint64(16)))
            code, owner = (cuts.code >> np.uint64(16))[both], order[cuts.row][both]
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            head = np.flatnonzero(new)
            many = np.zeros(len(code), bool)
            many[1:] = ~new[1:] & (owner[1:] != owner[:-1])
            several = np.add.reduceat(many, head) > 0 if len(head) else np.zeros(0, bool)
            code = code[head]
            place = ((code >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            for r in np.unique(place):
                own = place == r
                yield pa.RecordBatch.from_arrays([pa.array([int(r)], pa.int64()), pa.array([chunk], pa.int64()), pa.array([packed(code[own])]), pa.array([np.packbits(several[own]).tobytes()])], names=["range", "chunk", "codes", "several"])

    def meet(table: pa.Table) -> pa.Table:
        lists = [unpacked(b.as_py()) for b in table.column("codes")]
        flags = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[: len(c)] for b, c in zip(table.column("several"), lists, strict=True)]
        values, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        twice = (count > 1) | (np.bincount(place, weights=np.concatenate(flags), minlength=len(values)) > 0)
        found = [c[member(c, values[twice])] for c in lists]
        return pa.table({"chunk": table.column("chunk"), "codes": pa.array([packed(f) for f in found], pa.binary()), "n": pa.array([len(f) for f in found], pa.int64())})

    parts = chunks.select("chunk", "row", "order", "text").mapInArrow(gather, "range long, chunk long, codes binary, several binary")
    return parts.groupBy("range").applyInArrow(meet, "chunk long, codes binary, n long").where("n > 0")


def _same(code: np.ndarray, content: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cut, a number of its content and the smallest order that has it."""
    _, number = np.unique(np.stack([code, content], axis=1), axis=0, return_inverse=True) if len(code) else (None, np.zeros(0, np.int64))
    number = number.ravel()
    least = np.full(number.max() + 1 if len(number) else 0, LAST, np.int64)
    np.minimum.at(least, number, order)
    return number, least[number]


def _cuts(table: pa.Table, known: np.ndarray, length: int, gram: int) -> tuple[Cuts, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of shared anchors, the order of each, its content number, and the smallest order of that content here."""
    cuts, order = anchors(column(table, "text"), length, gram), np.asarray(column(table, "order"))
    own = np.flatnonzero(member(cuts.code >> np.uint64(16), known))
    cuts = Cuts(*[c[own] for c in (cuts.row, cuts.start, cuts.stop, cuts.code, cuts.content)])
    number, least = _same(cuts.code, cuts.content, order[cuts.row])
    return cuts, order[cuts.row], number, least


SHARDS = "shard long, chunk long, rows binary, orders binary, starts binary, sizes binary, data binary"
COVERS = "chunk long, rows binary, starts binary, stops binary"


def cut_out(chunks: DataFrame, copies: str, shared: str, shards: int, length: int, gram: int) -> DataFrame:
    """SHARDS: the cuts of shared anchors; of equal ones in a block only those of its smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, known = Side(copies, _copies), Side(shared, _shared)
        for chunk, table in blocks(batches):
            table = table.filter(pa.array(~member(np.asarray(column(table, "row")), skip(chunk))))
            cuts, order, _, least = _cuts(table, known(chunk), length, gram)
            rows, (data, offsets) = np.asarray(column(table, "row")), T.utf8(column(table, "text"))
            shard = (cuts.code % np.uint64(shards)).astype(np.int64)
            go = np.flatnonzero(order == least)
            go = go[np.argsort(shard[go], kind="stable")]
            for own in np.split(go, np.flatnonzero(np.diff(shard[go])) + 1) if len(go) else ():
                begin = offsets[cuts.row[own]] + cuts.start[own]
                size = cuts.stop[own] - cuts.start[own] + length - 1
                where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                values = (rows[cuts.row[own]], order[own], cuts.start[own], size.astype(np.int64), data[where])
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[own[0]])], pa.int64()), pa.array([chunk], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=["shard", "chunk", "rows", "orders", "starts", "sizes", "data"])

    return chunks.select("chunk", "row", "order", "text").mapInArrow(run, SHARDS)


def covered_windows(texts: list[bytes], orders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of each window that a text of a smaller order also holds, by the sorted suffixes of all texts."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    order = suffixes.suffix_array(data)
    owner = np.searchsorted(begin, order, "right") - 1
    whole = order + length <= begin[owner] + size[owner]
    order, owner = order[whole], owner[whole]
    run = np.concatenate([[0], np.cumsum(~suffixes.shares(data, order, length))]) if len(order) else np.zeros(0, np.int64)
    least = np.full(run[-1] + 1 if len(run) else 0, LAST, np.int64)
    np.minimum.at(least, run, orders[owner])
    hit = orders[owner] > least[run]
    return owner[hit], order[hit] - begin[owner[hit]]


def joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of intervals per row, sorted."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    group = np.cumsum(np.concatenate([[True], row[1:] != row[:-1]]))
    span = np.int64(max(int(stop.max()), 1) + 1)
    reach = np.maximum.accumulate(stop + group * span) - group * span
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(fresh)
    return row[head], start[head], np.maximum.reduceat(stop, head)


def settle(table: pa.Table, length: int) -> pa.Table:
    """COVERS of one shard."""
    get = lambda name: np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column(name)])
    rows, orders, starts, sizes = (get(n) for n in ("rows", "orders", "starts", "sizes"))
    chunk = np.repeat(np.asarray(table.column("chunk")), [len(b.as_py()) // 8 for b in table.column("rows")])
    data = b"".join(b.as_py() for b in table.column("data"))
    ends = np.cumsum(sizes)
    texts = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in texts])
    least = np.full(len(number), LAST, np.int64)
    np.minimum.at(least, which, orders)
    later = orders > least[which]
    owner, at = covered_windows(list(number), least, length)
    # Covered windows of a text count for every cut of it by its smallest document.
    first = np.flatnonzero(~later)
    first = first[np.argsort(which[first], kind="stable")]
    low, high = np.searchsorted(which[first], owner, "left"), np.searchsorted(which[first], owner, "right")
    many = high - low
    cut = first[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
    at = np.repeat(at, many)
    c = np.concatenate([chunk[later], chunk[cut]])
    r = np.concatenate([rows[later], rows[cut]])
    a = np.concatenate([starts[later], starts[cut] + at])
    b = np.concatenate([(starts + sizes)[later], starts[cut] + at + length])
    out = []
    for k in np.unique(c):
        parts = joined(r[c == k], a[c == k], b[c == k])
        out.append((int(k), *[p.astype(np.int64).tobytes() for p in parts]))
    names, kinds = ["chunk", "rows", "starts", "stops"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """REMOVED of every row: what is left of a text without each byte that lies in a string of ``length`` bytes
    which also starts in a document with a smaller doc_id. Null ids count as larger than all others and as equal
    to each other; rows of one doc_id don't remove from each other."""
    chunks = chunked(docs)
    total, _ = chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    copies = by_chunk(find_copies(chunks), "copies")
    ranges = max(1, total * 2 // (length - gram + 2) // RANGE_ANCHORS)
    found = stage(shared_anchors(chunks, copies, ranges, length, gram), "anchors")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = by_chunk(found, "shared")
    shards = max(1, n * (length + (length - gram + 1) // 2) // SHARD_BYTES)
    cuts = cut_out(chunks, copies, shared, shards, length, gram)
    covers = by_chunk(cuts.groupBy("shard").applyInArrow(lambda t: settle(t, length), COVERS), "covers")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, known, far = Side(copies, _copies), Side(shared, _shared), Side(covers, _covered)
        for chunk, table in blocks(batches):
            row, (data, offsets) = np.asarray(column(table, "row")), T.utf8(column(table, "text"))
            size = np.diff(offsets)
            copy = np.flatnonzero(member(row, skip(chunk)) & (size >= length))
            own = np.flatnonzero(~member(row, skip(chunk)))
            cuts, order, _, least = _cuts(table.take(pa.array(own)), known(chunk), length, gram)
            near = order > least
            rows, starts, stops = far(chunk)
            place = np.argsort(row)
            at = np.searchsorted(row[place], rows)
            at[at == len(row)] = 0
            here = row[place][at] == rows
            begin = [offsets[copy], (offsets[own[cuts.row]] + cuts.start)[near], offsets[place[at[here]]] + starts[here]]
            end = [offsets[copy + 1], (offsets[own[cuts.row]] + cuts.stop)[near] + length - 1, offsets[place[at[here]]] + stops[here]]
            marks = np.zeros(len(data) + 1, np.int32)
            np.add.at(marks, np.concatenate(begin), 1)
            np.add.at(marks, np.concatenate(end), -1)
            gone = np.cumsum(marks[:-1]) > 0
            heads = gone.copy()
            if len(data):
                heads[1:] &= ~gone[:-1]
                full = offsets[:-1][size > 0]
                heads[full] = gone[full]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, heads))
            left = data[~gone].tobytes()
            cut = offsets - removed[offsets]
            digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(table, "doc_id"), pa.array(size.astype(np.int64)), pa.array(np.diff(removed[offsets]).astype(np.int64)), pa.array(np.diff(spans[offsets]).astype(np.int64)), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return chunks.select("chunk", "row", "order", "doc_id", "text").mapInArrow(finish, REMOVED)
