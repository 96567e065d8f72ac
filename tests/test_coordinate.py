import gzip
import random

import pytest

from coexnet.sources.coordinate import read_coordinate_matrix, read_names

BANNER = "%%MatrixMarket matrix coordinate {} {}\n% a comment\n"


def put(tmp_path, name, text, packed=False):
    path = tmp_path / (name + ".gz" * packed)
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    return f"file://{path}"


def names(tmp_path, genes=30, cells=200, packed=False):
    return put(tmp_path, "genes.tsv", "".join(f"ID{i}\tgene{i}\n" for i in range(1, genes + 1)), packed), put(tmp_path, "cells.tsv", "".join(f"c{i}-1\n" for i in range(1, cells + 1)), packed)


@pytest.mark.parametrize("packed", [False, True])
def test_a_file_in_many_parts(spark, tmp_path, packed):
    rng = random.Random(1)
    entries = {(rng.randrange(1, 31), rng.randrange(1, 201)): rng.randrange(1, 50) for _ in range(3000)}
    entries[30, 200] = len(entries | {(30, 200): 0})  # an entry that reads as the line of sizes
    rows = [f"{i} {j} {v}\n" for (i, j), v in entries.items()]
    rng.shuffle(rows)
    rows.insert(1000, "% within\n\n")
    path = put(tmp_path, "m.mtx", BANNER.format("integer", "general") + f"30 200 {len(entries)}\n" + "".join(rows), packed)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert packed or spark.read.text(path).rdd.getNumPartitions() > 5
        got = read_coordinate_matrix(spark, path, *names(tmp_path, packed=packed), gene_column=1).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got)) == sorted((f"c{j}-1", f"gene{i}", float(v)) for (i, j), v in entries.items())


def test_kinds_of_matrices(spark, tmp_path):
    g, c = names(tmp_path, 3, 3)
    read = lambda kind, text, **kw: sorted(map(tuple, read_coordinate_matrix(spark, put(tmp_path, "k.mtx", BANNER.format(*kind) + text), g, c, **kw).collect()))
    assert read(("pattern", "general"), "3 3 2\n1 2\n3 3\n") == [("c2-1", "ID1", 1.0), ("c3-1", "ID3", 1.0)]
    assert read(("real", "symmetric"), "3 3 2\n2 1 -1.5e0\n3 3 2\n") == [("c1-1", "ID2", -1.5), ("c2-1", "ID1", -1.5), ("c3-1", "ID3", 2.0)]
    assert read(("real", "general"), "3 3 3\n1 2 1\n1 2 2\n2 2 0\n", genes_in_rows=False) == [("c1-1", "ID2", 3.0)]
    assert read(("real", "general"), "3 3 0\n") == []


@pytest.mark.parametrize("text,told", [("3 3 1\n4 1 1\n", "bad entry"), ("3 3 1\n1 0 1\n", "bad entry"), ("3 3 1\n1 x 1\n", "bad entry"), ("3 3 2\n1 1 1\n", "1 entries"), ("3 4 1\n1 1 1\n", "names of cells"), ("1 1\n", "sizes"), ("", "sizes")])
def test_bad_files_are_refused(spark, tmp_path, text, told):
    with pytest.raises(Exception, match=told):
        read_coordinate_matrix(spark, put(tmp_path, "b.mtx", BANNER.format("real", "general") + text), *names(tmp_path, 3, 3)).collect()


def test_other_banners_are_refused(spark, tmp_path):
    for banner in ("%%MatrixMarket matrix array real general\n", "1 1 1\n", "%%MatrixMarket matrix coordinate complex general\n", ""):
        with pytest.raises(ValueError, match="coordinate|not read"):
            read_coordinate_matrix(spark, put(tmp_path, "o.mtx", banner + "1 1 1\n1 1 1\n"), *names(tmp_path, 1, 1))


def test_names_with_a_header(spark, tmp_path):
    path = put(tmp_path, "n.tsv", "name\nb\n\na\n")
    assert sorted(map(tuple, read_names(spark, path, header=True).collect())) == [(1, "b"), (2, "a")]
