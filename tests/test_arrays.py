"""Arrays from files, dense numbers, and noise by blocks, against NumPy."""

import numpy as np
import pytest

from zonecast.operators import noise, numbering
from zonecast.sources import arrays


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f8", "<f2", "<i4", ">i2", "<i8", "|u1", "<u4", "|b1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_elements_with_their_indices(spark, tmp_path, dtype, order):
    array = (np.arange(7 * 5).reshape(7, 5) % 11).astype(dtype)
    np.save(tmp_path / "a.npy", np.asarray(array, order=order))
    df = arrays.read_array(spark, f"file://{tmp_path}/a.npy", ("t", "edge"), "speed", partition=24)
    assert df.columns == ["t", "edge", "speed"] and df.rdd.getNumPartitions() > 1
    assert {(r.t, r.edge): r.speed for r in df.collect()} == {(i, j): array[i, j] for i, j in np.ndindex(7, 5)}
    first = arrays.read_array(spark, f"{tmp_path}/a.npy", rows=3)
    assert {(r.i0, r.i1): r.value for r in first.collect()} == {(i, j): array[i, j] for i, j in np.ndindex(3, 5)}


def test_other_dimensions_and_versions(spark, tmp_path):
    for array in (np.float64(3.5).reshape(()), np.arange(3), np.arange(24.0).reshape(2, 3, 4), np.empty((0, 4))):
        with open(tmp_path / "b.npy", "wb") as file:
            np.lib.format.write_array(file, np.asarray(array), version=(2, 0))
        got = {tuple(r)[:-1]: r.value for r in arrays.read_array(spark, f"{tmp_path}/b.npy").collect()}
        assert got == {i: x for i, x in np.ndenumerate(array)}


def test_what_is_no_array_of_numbers(spark, tmp_path):
    (tmp_path / "pointer.npy").write_text("version https://git-lfs\n")
    np.save(tmp_path / "words.npy", np.array(["a", "b"]))
    np.save(tmp_path / "cut.npy", np.zeros(100))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    for name, said in (("pointer", "no .npy"), ("words", "not numbers"), ("cut", "cut short")):
        with pytest.raises(ValueError, match=said):
            arrays.header(f"{tmp_path}/{name}.npy")
    np.save(tmp_path / "c.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="names"):
        arrays.read_array(spark, f"{tmp_path}/c.npy", ("only",)).collect()


def test_four_gigabytes_are_read_by_offset(tmp_path):
    whole = np.lib.format.open_memmap(tmp_path / "large.npy", "w+", np.float32, (1 << 20, 1024))  # sparse: it takes no disk
    whole[-1, -1], whole[12345, 678] = 7, 5
    whole.flush()
    del whole
    source = arrays.ArraySource({"path": f"{tmp_path}/large.npy"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert len(parts) == 256 and parts[-1].high == 1 << 30
    last = list(reader.read(parts[-1]))
    assert last[-1].column(2)[-1].as_py() == 7 and last[-1].column(0)[-1].as_py() == (1 << 20) - 1 and max(x.nbytes for x in last) < 2 << 20
    own = next(p for p in parts if p.low <= 12345 * 1024 + 678 < p.high)
    assert [r for b in reader.read(own) for r in b.filter(np.asarray(b.column(2)) == 5).to_pylist()] == [{"i0": 12345, "i1": 678, "value": 5.0}]


def test_numbers_are_those_of_the_order(spark):
    r = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in np.concatenate([r.integers(-100, 100, (300, 2)), r.integers(-(2**31), 2**31, (300, 2)), np.stack([np.full(500, 7), r.integers(0, 2**20, 500)], 1)])})
    shuffled = [pairs[i] for i in r.permutation(len(pairs))]
    got = {(x.src, x.dst): x.n for x in numbering.numbered(spark.createDataFrame(shuffled, "src int, dst int"), ["src", "dst"], "n").collect()}
    assert got == {p: i for i, p in enumerate(pairs)}
    wide = [(int(x), int(y)) for x, y in zip(r.integers(-(2**63), 2**63, 50, np.int64).tolist() + [5] * 20, range(70), strict=True)]
    got = {(x.k, x.y): x.n for x in numbering.numbered(spark.createDataFrame(wide, "k long, y int"), ["k"], "n", ["y"]).collect()}
    assert got == {p: i for i, p in enumerate(sorted(wide))}
    assert numbering.numbered(spark.createDataFrame([], "k long"), ["k"], "n").count() == 0


def test_numbers_in_file_order(spark, tmp_path):
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.csv").write_text("x\n" + "\n".join(map(str, range(5000))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbering.in_file_order(spark.read.csv(f"file://{tmp_path}/z", header=True), "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(int(r.x) == r.n for r in got)


def test_noise_is_one_sequence_over_blocks(spark):
    assert len(noise.exponents()) == 135 and max(noise.exponents()) == noise.DEGREE
    for seed, place in ((42, 0), (42, 1), (7, 623), (7, 624), (42, 100_003)):
        want = np.random.RandomState(seed)
        want.tomaxint(0)
        want.random_sample(place // 2)
        if place % 2:
            want.randint(0, 2**32, dtype=np.uint32)
        assert (noise.started(seed, place, noise.exponents()).random_sample(50) == want.random_sample(50)).all()
    whole = np.random.RandomState(42).uniform(0.7, 1.3, (37, 41))
    for block in (100, 1000, 5000):
        got = {(r.edge_id, r.slot): r.noise for r in noise.uniform(spark, 37, 41, block=block).collect()}
        assert got == {i: x for i, x in np.ndenumerate(whole)}
    assert noise.uniform(spark, 0, 5).count() == 0
