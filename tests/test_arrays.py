"""Stored arrays by ranges of rows."""

import numpy as np
import pytest

from skyweave.sources import arrays, products, snapshots


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(1)
    made = {"xyz_part0_of2": r.random((1000, 3)), "xyz_part1_of2": r.random((700, 3)).astype("f4"), "xyz_part2_of2": np.asfortranarray(r.random((500, 3))), "xyz_part3_of2": np.zeros((0, 3))}
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    nested = {"PartType0/Masses": r.random(3000), "PartType0/IDs": np.arange(10, dtype="i8"), "Header/z": np.array(0.5)}
    np.savez(tmp_path / "stored.npz", **nested)
    np.savez_compressed(tmp_path / "packed.npz", **nested, wide=r.random((40, 2)), tall=np.asfortranarray(r.random((30, 2))))
    return tmp_path, made, nested


def test_several_tasks_a_file_in_order(spark, folder):
    path, made, _ = folder
    tasks = [r for f in arrays.files_of(f"{path}/xyz*.npy") for a in arrays.arrays_of(f) for r in arrays.ranges_of(a, 2000)]
    assert len(tasks) > 15
    df = snapshots.array_parts(spark, f"{path}/xyz*.npy", ("x", "y", "z"), task_bytes=2000)
    assert df.rdd.getNumPartitions() == len(tasks)
    got = np.array([r[:] for r in df.orderBy("part", "idx").select("x", "y", "z").collect()])
    assert np.allclose(got, np.concatenate([a for a in made.values()]))
    z = arrays.arrays(spark, f"{path}/xyz*.npy", "z double, idx long", ("x", "y", "z"))  # one of three columns
    assert sorted(r["z"] for r in z.collect()) == sorted(float(x) for a in made.values() for x in a[:, 2])
    with pytest.raises(Exception, match="has 3 columns"):
        arrays.arrays(spark, f"{path}/xyz*.npy", "a double, b double, c double, d double").collect()


@pytest.mark.parametrize("name", ["stored", "packed"])
def test_nested_archives(spark, folder, monkeypatch, name):
    path, _, nested = folder
    monkeypatch.setattr(arrays, "BATCH_BYTES", 1000)
    whole = list(arrays.arrays_of(f"{path}/{name}.npz"))
    ranges = [r for a in whole for r in arrays.ranges_of(a, 4000)]
    assert (len(ranges) > len(whole)) == (name == "stored")
    df = arrays.arrays(spark, f"{path}/{name}.npz", "path string, idx long, value double", task_bytes=4000)
    tree = products.nested(df)
    assert np.allclose(tree["PartType0"]["Masses"], nested["PartType0/Masses"]) and tree["PartType0"]["IDs"].tolist() == list(range(10)) and tree["Header"]["z"].tolist() == [0.5]
    for a in whole:
        if a.path in ("wide", "tall"):
            want = np.load(f"{path}/{name}.npz")[a.path]
            assert np.array_equal(np.concatenate([x for r in arrays.ranges_of(a, 4000) for _, x in arrays.read(r, [1])]), want[:, 1:])


def test_a_folder(spark, folder):
    path, made, _ = folder
    assert len(arrays.files_of(str(path))) == 6 and arrays.files_of(f"{path}/nothing*") == []
    assert arrays.arrays(spark, f"{path}/xyz_part1*.npy", "x double").count() == 700
