"""Lines stored by split: quote state, numbers, hashes and character sets against a reader that sees whole files."""

import contextlib
import hashlib
import os
import random

import pytest

from rowforge.sources import csv as S
from rowforge.sources import files as L
from rowforge.sources import stored
from rowforge.sources.lines import read_lines


@contextlib.contextmanager
def split_size(spark, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def brute(text):
    """Records by one pass over all characters, and the record in which a quote stays open."""
    records, at, state = [], 0, "start"
    for k, c in enumerate(text):
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
            continue
        if state == "closing" and c == '"':
            state = "quoted"
        elif c == "\n":
            records.append(text[at:k])
            at, state = k + 1, "start"
        elif c == ",":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "plain"
    rest = text[at:]
    opened = state == "quoted"
    if not opened and rest:
        records.append(rest)
    kept = [r[:-1] if r.endswith("\r") else r for r in records if r not in ("", "\r")]
    return kept, len(kept) if opened else None  # the header is no numbered record


def random_file(rng):
    cell = lambda: rng.choice(["", "a", "é", "ab", '5"6', '"x"', '"a,b"', '"p\nq"', '"say ""hi"""', '"\n\n"', '"x"y', '"\r\n"'])
    text = "".join(",".join(cell() for _ in range(rng.randint(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randint(1, 25)))
    noise = "".join(rng.choice('",\n"ab\r\né') for _ in range(rng.randint(0, 12)))
    cut = rng.randint(0, len(text))
    return rng.choice([text, text.rstrip("\r\n"), text + noise, text[:cut] + noise + text[cut:]])


@pytest.mark.parametrize(("seed", "size"), [(1, 23), (3, 128), (4, 1 << 20)])
def test_records_against_one_pass(spark, tmp_path, seed, size):
    rng, want = random.Random(seed), {}
    for k in range({23: 5, 128: 20}.get(size, 60)):
        text = random_file(rng)
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want[f"f{k}.csv"] = brute(text)
    with split_size(spark, size):
        snapshot = L.snapshot_files(spark, str(tmp_path))
    got = {}
    for r in stored.texts(snapshot.lines, snapshot.splits).collect():
        got.setdefault(os.path.basename(r.file), []).append((r._block, r._pos, r.record))
    opened = {os.path.basename(r.file): int(r.last_error.rsplit(" ", 1)[1]) for r in S.unclosed(snapshot).collect()}
    for name, (records, broken) in want.items():
        rows = sorted(got.get(name, []))
        assert [r[2] for r in rows] == records, name
        for block in {r[0] for r in rows}:
            assert [r[1] for r in rows if r[0] == block] == list(range(1, 1 + sum(r[0] == block for r in rows)))
        assert opened.get(name) == broken, name
    hashed = {os.path.basename(r.path): r.sha256 for r in snapshot.files.collect()}
    assert hashed == {name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in want}


def test_state_is_carried_over_batches(spark, tmp_path):
    text = "h1,h2\n" + "".join(f'{k},"line\nof {k}\n"\n{k},x\n' for k in range(500))
    (tmp_path / "a.csv").write_text(text)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        with split_size(spark, 1000):
            landed = S.land(spark, str(tmp_path))
            assert landed.select("_block").distinct().count() > 8
            rows = S.records(landed, S.headers(landed), [("h1", "a"), ("h2", "b")]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.row_number, r.a, r.b) for r in rows) == sorted((2 * k + j + 1, str(k), "x" if j else f"line\nof {k}\n") for k in range(500) for j in (0, 1))


def test_hashes_of_marks_and_ends(spark, tmp_path):
    cases = [b"a", b"a\n", b"\n", b"\n\n", b"a\r\nb", b"\xef\xbb\xbfa\n", b"\xef\xbb\xbfa", b"\xef\xbb\xbfa\nb\n\n", "ก,ข\n".encode("cp874"), b"x" * 10_000 + b"\n" + b"y" * 7_000]
    for k, data in enumerate(cases):
        (tmp_path / f"f {k}+%41.csv").write_bytes(data)
    with split_size(spark, 4096):
        live = {os.path.basename(r.path): r.live_hash for r in L.live_hashes(spark, str(tmp_path)).collect()}
    names = {os.path.basename(n).replace("%20", " "): h for n, h in live.items()}
    assert names == {f"f {k}+%41.csv": hashlib.sha256(data).hexdigest() for k, data in enumerate(cases)}


def test_character_sets(spark, tmp_path):
    lines = ["ชื่อ,\"บรรทัด\nสอง\"", "ก,ข"]
    (tmp_path / "a.csv").write_bytes("\r\n".join(lines).encode("cp874"))
    with split_size(spark, 5):
        landed = S.land(spark, str(tmp_path), 2, charset="x-windows-874")
        assert sorted(tuple(r.cells) for r in landed.collect()) == [("ก", "ข"), ("ชื่อ", "บรรทัด\nสอง")]
        text = read_lines(stored.raw_lines(spark, str(tmp_path)), partner=S.F.lit("KK")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in text] == [(1, 'ชื่อ,"บรรทัด'), (2, 'สอง"'), (3, "ก,ข")]
    with pytest.raises(ValueError, match="UTF-16"):
        S.land(spark, str(tmp_path), 2, charset="UTF-16")
