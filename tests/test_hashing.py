import hashlib
import random

import pytest

from paperloom.sources import hashing, tables


def parts(seed, size, often=20):
    rng = random.Random(seed)
    data = bytearray(rng.randbytes(size))
    for _ in range(size // often):
        data[rng.randrange(size)] = rng.choice(b"\n\r\0")
    return bytes(data)


@pytest.mark.parametrize("digest", [hashing.compress, hashing.compressor()])
def test_state_goes_on(digest):
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 1000):
        data = parts(size, size)
        whole = size & ~63 if size < 128 else 128
        state = digest(hashing._START, data[:whole]) if whole else hashing._START
        assert digest(state, hashing.padded(data[whole:], size)).hex() == hashlib.md5(data).hexdigest()


def test_large_files_are_hashed_by_slices(spark, tmp_path):
    """Several splits and slices a file, whatever its lines, its ends and its name; no task holds a file."""
    folder = tmp_path / "in" / "sub ü%20"
    folder.mkdir(parents=True)
    files = {
        "a.pdf": parts(1, 70_001), "a b%20ü.pdf": parts(2, 64_000) + b"\n", "lines.pdf": b"\n" * 20_000,
        "mark.pdf": b"\xef\xbb\xbf" + parts(3, 30_000) + b"\n", "mark2.pdf": b"\xef\xbb\xbf" * 7_000, "twice.pdf": parts(1, 70_001),
        "one.pdf": b"x" * 50_000, "end.pdf": b"\r\n" + parts(4, 40_000) + b"\r", "small.pdf": b"\xef\xbb\xbfq\n",
        "at.pdf": b"y" * 4_000, "over.pdf": b"y" * 4_000 + b"\n", "packed.gz.pdf": parts(5, 9_000), "no.txt": parts(6, 9_000),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    (folder / "b.pdf.gz").write_bytes(parts(7, 9_000))
    wanted = {name: (len(data), hashlib.md5(data).hexdigest()) for name, data in files.items() if name.endswith(".pdf")}
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.sources.binaryFile.maxLength"]
    before = [spark.conf.get(name) for name in names]
    try:
        # Spark's binary source, which takes files whole, refuses any that is over a slice.
        spark.conf.set(names[2], "4000")
        for split in ("7919", "128m"):
            spark.conf.set(names[0], split)
            spark.conf.set(names[1], "1")
            rows = tables.scan_objects(spark, str(tmp_path / "in"), slice_bytes=4_000).collect()
            assert len(rows) == len(wanted)
            assert {r.uri.rsplit("/", 1)[1]: (r.size, r.md5_hash) for r in rows} == wanted
            assert all("/sub ü%20/" in r.uri and r.metadata == [] for r in rows)
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    packed = tables.scan_objects(spark, str(tmp_path / "in"), "*.gz", slice_bytes=4_000).first()
    assert packed.md5_hash == hashlib.md5(parts(7, 9_000)).hexdigest()


def test_slices_meet_a_sidecar(spark, tmp_path):
    data = parts(8, 10_000)
    (tmp_path / "a.pdf").write_bytes(data)
    sidecar = spark.createDataFrame([(f"file:{tmp_path}/a.pdf", "known", [("n", "v")])], "uri string, md5_hash string, metadata array<struct<name:string,value:string>>")
    row = tables.scan_objects(spark, str(tmp_path), sidecar=sidecar, hash_content=True, slice_bytes=1_000).first()
    assert (row.md5_hash, row.metadata[0].value) == (hashlib.md5(data).hexdigest(), "v")
    assert tables.scan_objects(spark, str(tmp_path), sidecar=sidecar, slice_bytes=1_000).first().md5_hash == "known"
    whole = tables.scan_objects(spark, str(tmp_path), content=True, slice_bytes=1_000).first()
    assert (whole.content, whole.md5_hash) == (data, hashlib.md5(data).hexdigest())


def test_pieces_follow_slices():
    """A piece holds no more than asked for, and its slice never falls within a file."""
    import pyarrow as pa

    lines = [b"ab", b"", b"c" * 25, b"d"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"] * 4), pa.array([0, 0, 40, 40]), pa.array([40, 40, 40, 40]), pa.array(lines, pa.binary())], ["file", "start", "length", "line"]
    )
    rows = pa.Table.from_batches(hashing._cut(16, 10)([batch])).to_pylist()
    assert b"".join(r["bytes"] for r in rows) == b"\n".join(lines) and max(len(r["bytes"]) for r in rows) == 10
    assert [r["slice"] for r in rows] == sorted(r["slice"] for r in rows)
    assert [(r["start"], r["seq"]) for r in rows] == [(0, 0), (40, 0), (40, 1), (40, 2)]


def test_slice_counts(table):
    sizes = table([(1,), (4,), (5,), (8,), (13,)], "size long")
    assert hashing.slice_counts(sizes, 4) == [5, 3, 1, 1]
    assert hashing.slice_counts(sizes.where("size > 99"), 4) == []
