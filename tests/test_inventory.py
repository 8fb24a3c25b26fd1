"""The file inventory: hashes in chunks, files far larger than memory is needed for, and differences from a manifest."""

import hashlib
import resource

import pytest

from peerscope.sources import inventory


def test_hashes_names_and_sizes(spark, tmp_path):
    content = {"a.txt": b"", "b.bin": bytes(range(256)) * 1000, "sub/c.txt": "é\n".encode(), "sub/deeper/a.txt": b"again"}
    for name, raw in {**content, "_SUCCESS": b"", ".hidden": b"x", "sub/_x/y.txt": b"left out"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    want = sorted((f"{tmp_path}/{n}", n.rsplit("/", 1)[-1], len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in content.items())
    for path in (str(tmp_path), f"file://{tmp_path}"):
        for chunk in (7, 1 << 20):
            assert sorted(tuple(r) for r in inventory.read_file_inventory(spark, path, chunk=chunk).collect()) == want
    assert [r.name for r in inventory.read_file_inventory(spark, str(tmp_path), "*.bin").collect()] == ["b.bin"]
    assert [r.bytes for r in inventory.read_file_inventory(spark, f"{tmp_path}/b.bin").collect()] == [256_000]
    (tmp_path / "none").mkdir()
    assert inventory.read_file_inventory(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        inventory.read_file_inventory(spark, f"{tmp_path}/nowhere").count()


def test_three_gigabytes_in_bounded_memory(tmp_path):
    size = 3 << 30
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(size)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (part,) = inventory.InventoryReader({"path": str(tmp_path)}).partitions()
    (batch,) = inventory.InventoryReader({"path": str(tmp_path)}).read(part)
    zeros, want = bytes(1 << 20), hashlib.sha256()
    for _ in range(size >> 20):
        want.update(zeros)
    assert batch.to_pylist() == [{"path": f"{tmp_path}/sparse", "name": "sparse", "bytes": size, "sha256": want.hexdigest()}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10  # kilobytes


def test_files_are_dealt_to_partitions():
    big, small = inventory.PARTITION, [(f"s{i:05}", 10) for i in range(12_000)]
    parts = inventory.grouped([("x", 3 * big), ("y", big), *small])
    assert [p.paths for p in parts[:2]] == [["x"], ["y"]] and [len(p.paths) for p in parts[2:]] == [5000, 5000, 2000]
    assert [p.paths for p in inventory.grouped([])] == [[]]


def test_differences(spark):
    found = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 3, "x"), ("d", 4, "h"), ("e", 5, "h"), ("e", 5, "h")], "name string, bytes long, sha256 string")
    manifest = spark.createDataFrame([("a", 1, "H"), ("b", 3, "h"), ("c", 3, "h"), ("e", 5, "h"), ("f", 6, "h")], "name string, bytes long, sha256 string")
    assert sorted(map(tuple, inventory.inventory_differences(found, manifest).collect())) == [("b", "size"), ("c", "hash"), ("d", "unlisted"), ("e", "repeated"), ("f", "missing")]
