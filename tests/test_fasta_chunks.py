"""FASTA records read as chunks from file blocks."""

from __future__ import annotations

import collections
import gzip
import random

import pytest

from codonlake.operators.orfs import find_orfs, find_orfs_in_chunks
from codonlake.sources.fasta import read_fasta, read_fasta_chunks


@pytest.fixture
def small_blocks(spark):
    """File blocks of 300 bytes, so that records begin, go on and end in other tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def write(path, seed):
    rng = random.Random(seed)
    bases = lambda n: "".join(rng.choice("ACGTacgtN") for _ in range(n))
    path.mkdir()
    for k in range(3):
        lines = []
        for r in range(6):
            lines.append(f"{rng.choice(['>', '  >', '>'])}rec{rng.randrange(14)} note")
            lines += [bases(rng.randrange(0, 60)) + rng.choice(["", " ", "\r"]) for _ in range(rng.choice([0, 1, 3, 30]))]
            lines += [""] * rng.randrange(2)
        (path / f"f{k}.fa").write_text("\n".join(lines) + "\n")
    with gzip.open(path / "packed.fa.gz", "wt") as file:
        file.write(">zipped\n" + "ACGT\n" * 200 + ">\nTTT\n")
    return str(path)


def together(rows, size, overlap):
    """Sequences from chunks, each chunk being checked."""
    found = collections.defaultdict(dict)
    for r in rows:
        assert r["chunk"] not in found[r["row"]]
        found[r["row"]][r["chunk"]] = r
    out = []
    for chunks in found.values():
        assert sorted(chunks) == list(range(chunks[0]["chunks"]))
        seq = "".join(chunks[c]["bases"][:size] for c in sorted(chunks))
        assert len(seq) == chunks[0]["length"]
        assert all(chunks[c]["bases"] == seq[c * size : (c + 1) * size + overlap] for c in chunks)
        out.append((chunks[0]["seq_id"], seq))
    return sorted(out)


@pytest.mark.parametrize("size,overlap,dedup", [(21, 2, True), (30, 30, False), (100_000, 2, True)])
def test_chunks_hold_the_records(spark, small_blocks, tmp_path, size, overlap, dedup):
    path = write(tmp_path / "in", size)
    got = read_fasta_chunks(spark, path, size, overlap, dedup=dedup).collect()
    want = sorted(map(tuple, read_fasta(spark, path, dedup=dedup).select("seq_id", "seq").collect()))
    assert together(got, size, overlap) == want and len(want) > 8


def test_orfs_of_chunks(spark, small_blocks, tmp_path):
    path = write(tmp_path / "in", 5)
    got = find_orfs_in_chunks(read_fasta_chunks(spark, path, 63, 2), 63, min_nt_length=30).collect()
    want = find_orfs(read_fasta(spark, path), min_nt_length=30).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_refused_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(ValueError, match="before header"):
        read_fasta_chunks(spark, str(tmp_path), 9)
    rows = read_fasta_chunks(spark, str(tmp_path), 9, validate=False).collect()
    assert [(r["seq_id"], r["bases"]) for r in rows] == [("x", "AC")]
