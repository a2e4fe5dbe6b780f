import random
import uuid

import pytest
from pyspark.sql import functions as F

from codonlake.alphabets import genetic_code, stop_codons
from codonlake.operators.matching import match_annotated
from codonlake.operators.chunks import chunked, store_chunk_index
from codonlake.operators.orfs import annotate_orfs, attach_orf_sequences, find_orfs, sequences_without_orfs, six_frames
from codonlake.operators.proteins import derive_proteins, translate_orfs, translation_mismatches
from codonlake.operators.validation import orf_problem, protein_problem, split_valid

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def brute_orfs(seq_id, seq, min_nt, table_id=11):
    """Walk every frame codon by codon."""
    stops, found = set(stop_codons(table_id)), []
    for strand, bases in (("+", seq), ("-", seq.translate(COMPLEMENT)[::-1])):
        for frame in (1, 2, 3):
            start = at = frame - 1
            while at + 3 <= len(bases):
                at += 3
                last = at + 3 > len(bases)
                if bases[at - 3 : at] in stops or last:
                    if at - start >= min_nt:
                        found.append((seq_id, start + 1, at, strand, frame, bases[start:at]))
                    start = at
    return found


def random_sequences(n=40, seed=3):
    rng = random.Random(seed)
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 400))) for i in range(n)}
    # Runs of N have no stop and may cover whole tiles.
    seqs["gap"] = "ATGTAA" + "N" * 200 + "TAACCC" + "N" * 91
    seqs["all_n"] = "N" * 250
    seqs["stops"] = "TAA" * 60
    return seqs


def frame_of(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")


COLUMNS = ["parent_id", "start", "end", "strand", "frame", "nt_sequence"]


@pytest.mark.parametrize("tile_bases", [3, 9, 30, 63, 300, 3_000_000])
@pytest.mark.parametrize("min_nt", [3, 90])
def test_orfs_against_brute_force(spark, tile_bases, min_nt):
    seqs = random_sequences()
    got = find_orfs(frame_of(spark, seqs), min_nt_length=min_nt, tile_bases=tile_bases)
    rows = got.collect()
    want = [orf for seq_id, seq in seqs.items() for orf in brute_orfs(seq_id, seq, min_nt)]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(want)
    assert len({(r["parent_id"], r["orf_id"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("table_id", [2, 4, 6, 27])
def test_other_codes(spark, table_id):
    seqs = random_sequences(10)
    got = find_orfs(frame_of(spark, seqs), table_id, 60, tile_bases=90).select(*COLUMNS).collect()
    want = [orf for seq_id, seq in seqs.items() for orf in brute_orfs(seq_id, seq, 60, table_id)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("tile_bases", [3, 63, 300])
def test_ids_do_not_depend_on_tiles(spark, tile_bases):
    seqs = frame_of(spark, random_sequences())
    whole, tiled = (find_orfs(seqs, tile_bases=n).collect() for n in (3_000_000, tile_bases))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, tiled))


def test_dense_ids_and_lower_case(spark):
    orfs = find_orfs(frame_of(spark, {"s": "atgaaacccgggtaaatg" * 20})).orderBy(F.desc("strand"), "frame", "start")
    rows = orfs.collect()
    assert sorted(r["orf_id"] for r in rows) == sorted(f"orf{i + 1}" for i in range(len(rows)))
    by_place = sorted(rows, key=lambda r: (r["strand"], r["frame"], r["start"]))
    assert [r["orf_id"] for r in by_place] == [f"orf{i + 1}" for i in range(len(rows))]


def test_one_scan_and_no_shuffle_without_long_sequences(spark, tmp_path, capsys):
    frame_of(spark, random_sequences()).write.parquet(str(tmp_path / "seqs"))
    annotate_orfs(find_orfs(spark.read.parquet(str(tmp_path / "seqs")))).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Exchange" not in plan and plan.count("Scan parquet") == 1


def test_long_sequences_share_ids_and_letters(spark):
    """Repeated and null ids, and letters of more than one byte, across chunks."""
    rng = random.Random(8)
    rows = [("twice", "".join(rng.choice("ACGTNé") for _ in range(n))) for n in (100, 137)]
    rows += [(None, "".join(rng.choice("acgtACGT") for _ in range(200))), ("none", None), ("empty", "")]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string")
    whole, cut = (find_orfs(seqs, min_nt_length=9, tile_bases=n).collect() for n in (300, 21))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, whole), key=order) == sorted(map(tuple, cut), key=order) and len(whole) > 20


def test_chunks(spark):
    rows = [("a", "acgtacg"), ("b", "éßACG"), ("e", ""), ("n", None)]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string")
    got = {(r["seq_id"], r["chunk"]): (r["chunks"], r["length"], r["bases"]) for r in chunked(seqs, 3, 2).collect()}
    assert got == {
        ("a", 0): (3, 7, "acgta"), ("a", 1): (3, 7, "tacg"), ("a", 2): (3, 7, "g"),
        ("b", 0): (2, 5, "éßACG"), ("b", 1): (2, 5, "CG"), ("e", 0): (1, 0, ""), ("n", 0): (1, None, None),
    }


def test_require_start(spark):
    seq = "CCC" * 5 + "ATG" + "GCA" * 30 + "TAA" + "CCC" * 40
    rows = find_orfs(frame_of(spark, {"s": seq}), require_start=True).where("strand = '+' and frame = 1").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(16, 111)]
    assert rows[0]["nt_sequence"] == seq[15:111]


def test_frame_lengths(spark):
    rows = six_frames(frame_of(spark, {"s": "ACGTACG"})).collect()
    assert sorted(len(r["bases"]) for r in rows) == [5, 5, 6, 6, 7, 7]


@pytest.mark.parametrize("tile_bases", [7, 50, 100_000])
def test_lookup_by_coordinate(spark, tile_bases):
    seqs = frame_of(spark, random_sequences(15))
    orfs = find_orfs(seqs, min_nt_length=30)
    extra = spark.createDataFrame(
        [("s1", "orf900", 5, 100_000, "-", 1, "", 11), ("nowhere", "orf1", 1, 9, "+", 1, "", 11)], orfs.schema
    )
    found, orphans = attach_orf_sequences(orfs.union(extra), seqs, tile_bases)
    truth = {(r["parent_id"], r["orf_id"]): r["nt_sequence"] for r in orfs.collect()}
    s1 = seqs.where("seq_id = 's1'").first()["seq"]
    truth["s1", "orf900"] = s1.translate(COMPLEMENT)[::-1][4:]
    assert {(r["parent_id"], r["orf_id"]): r["nt_sequence"] for r in found.collect()} == truth
    assert [(r["parent_id"], r["orf_id"]) for r in orphans.collect()] == [("nowhere", "orf1")]


def test_lookup_in_a_stored_index(spark, capsys):
    """The bases are read from the buckets of the index and not shuffled."""
    seqs = frame_of(spark, random_sequences(15))
    orfs = find_orfs(seqs, min_nt_length=30)
    name = f"chunk_index_{uuid.uuid4().hex}"
    index = store_chunk_index(seqs, name, 50, buckets=4)
    try:
        found, _ = attach_orf_sequences(orfs, seqs, 50, index)
        truth = {(r["parent_id"], r["orf_id"]): r["nt_sequence"] for r in orfs.collect()}
        assert {(r["parent_id"], r["orf_id"]): r["nt_sequence"] for r in found.collect()} == truth
        capsys.readouterr()
        found.explain()
        lines = capsys.readouterr().out.splitlines()
        scan = next(k for k, line in enumerate(lines) if name in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        above, at = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        join = next(k for k, line in enumerate(above) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in above[:join])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_sequences_without_orfs(spark):
    seqs = frame_of(spark, {"short": "ATGTAA", "long": "ATG" + "GCA" * 40})
    assert [r["seq_id"] for r in sequences_without_orfs(seqs, find_orfs(seqs)).collect()] == ["short"]


def test_translation_contract(spark):
    orfs = annotate_orfs(find_orfs(frame_of(spark, random_sequences())))
    code = genetic_code(11)
    for r in derive_proteins(orfs).collect():
        aa = "".join(code.get(r["nt_sequence"][i : i + 3], "X") for i in range(0, len(r["nt_sequence"]), 3))
        assert r["aa_sequence"] == aa and "*" not in aa[:-1]
        assert r["protein_aa"] == aa.removesuffix("*") and r["aa_length"] == len(r["protein_aa"])
        assert r["has_start_codon"] == ("M" in aa) and r["has_stop_codon"] == ("*" in aa)
    assert translate_orfs(orfs).count() == orfs.count()
    wrong = orfs.withColumn("aa_sequence", F.lit("MK"))
    assert translation_mismatches(wrong).count() == orfs.count()
    assert translate_orfs(wrong, on_mismatch="reject").count() == 0
    with pytest.raises(Exception, match="translation mismatch"):
        translate_orfs(wrong).collect()


CDS = "MTRWPEHVDLNYIGACFSQKHPWDRT"


@pytest.mark.parametrize(
    "orf, cds, hit",
    [
        (CDS, [CDS], True),
        ("MMMM" + CDS[6:], [CDS], True),
        (CDS + "*", [CDS], True),
        (CDS, [CDS + "**"], True),
        ("MTRWPEHVDLNYIGACFSQKHPWDRA", [CDS], False),
        ("", [CDS], False),
        (CDS, [], False),
        (CDS, [""], False),
        ("MTRWP", ["MTRWP"], True),
        ("WDRT", [CDS], False),
        ("*", ["*"], True),
        (CDS, ["MWKHDREYTF", "XX", CDS], True),
    ],
)
def test_c_terminal_match(spark, orf, cds, hit):
    orfs = spark.createDataFrame([("p", "orf1", orf)], "parent_id string, orf_id string, aa_sequence string")
    table = spark.createDataFrame([("q", c) for c in cds], "parent_id string, protein_sequence string")
    assert [r["in_genbank"] for r in match_annotated(orfs, table).collect()] == [hit]
    same = match_annotated(orfs, table, same_parent=True)
    assert [r["in_genbank"] for r in same.collect()] == [False]


def test_hot_tail_keeps_every_orf(spark):
    orfs = spark.range(3000).selectExpr(
        "'p' as parent_id", "concat('orf', id) as orf_id", "if(id % 3 = 0, 'MAAAAAAAAAAA', concat('M', id, 'CCCCCCCCCC')) as aa_sequence"
    )
    cds = spark.range(500).selectExpr("'q' as parent_id", "'KKAAAAAAAAAAA' as protein_sequence")
    matched = match_annotated(orfs, cds)
    assert matched.count() == 3000 and matched.where("in_genbank").count() == 1000


def test_validation(spark):
    rows = spark.createDataFrame(
        [("+", 1, 0, 5), ("x", 1, 0, 5), ("-", 4, 0, 5), ("-", 3, -1, 5), ("+", 0, 5, 5), ("+", None, 0, 5)],
        "strand string, frame int, start int, end int",
    )
    valid, rejected = split_valid(rows, orf_problem())
    assert valid.count() == 1
    assert sorted(r["problem"] for r in rejected.collect()) == [
        "invalid end", "invalid frame", "invalid frame", "invalid start", "invalid strand",
    ]
    proteins = spark.createDataFrame([("MK", 2), ("MK", 3)], "protein_aa string, aa_length int")
    assert split_valid(proteins, protein_problem())[1].count() == 1


def test_orfs_on_a_stream(spark, tmp_path):
    frame_of(spark, random_sequences(5)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id string, seq string").parquet(str(tmp_path / "in"))
    query = (
        annotate_orfs(find_orfs(stream)).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    batch = annotate_orfs(find_orfs(spark.read.parquet(str(tmp_path / "in"))))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_very_long_runs(spark):
    """Runs of a million codons must neither overflow the matcher nor be cut."""
    seqs = {"n": "N" * 7_000_000, "open": "ATG" + "GCA" * 2_400_000 + "TAA" + "GCA" * 40}
    orfs = find_orfs(frame_of(spark, seqs), min_nt_length=1_000)
    rows = orfs.select("parent_id", "strand", "frame", "start", "end", F.length("nt_sequence").alias("n")).collect()
    plus = [r for r in rows if r["parent_id"] == "open" and r["strand"] == "+" and r["frame"] == 1]
    assert [(r["start"], r["end"]) for r in plus] == [(1, 7_200_006)]
    assert all(r["end"] - r["start"] + 1 == r["n"] for r in rows)
    assert sorted((r["strand"], r["frame"], r["n"]) for r in rows if r["parent_id"] == "n") == [
        (s, f, (7_000_000 - f + 1) // 3 * 3) for s in "+-" for f in (1, 2, 3)
    ]


def test_orfs_inside_chunks_come_in_one_batch_for_each_read():
    """Not one batch for each chunk, strand and frame, whose cost was most of the search."""
    import pyarrow as pa

    from codonlake.operators import chunks

    bases = "TAAATGGCATAGCCCTAAGGGTGA"
    rows = [{"row": r, "seq_id": f"s{r}", "chunk": 0, "chunks": 1, "length": 24, "bases": bases} for r in range(50)]
    made = list(chunks._insides(iter([pa.RecordBatch.from_pylist(rows)]), 24, 11, 6))
    assert len(made) == 1
    found = {(r["row"], r["strand"], r["frame"], r["place"], r["start"], r["bases"]) for r in made[0].to_pylist() if r["strand"] == "+"}
    wanted = [(0, 4, "ATGGCATAG"), (1, 13, "CCCTAA"), (2, 19, "GGGTGA")]
    assert found == {(r, "+", 1, *w) for r in range(50) for w in wanted}


def test_residues_come_with_the_search(spark):
    """Sequences of every length beside null, empty, lower-case and non-ASCII ones, searched at once."""
    rng = random.Random(8)
    seqs = {f"s{i}": "".join(rng.choice("ACGTN") for _ in range(i)) for i in range(60)} | {"none": None, "low": "atgaaataa" * 9}
    seqs["odd"] = "ATGÅ\U0001f600A" * 4 + "TAAGGGCCC"
    frame = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string").coalesce(1)
    for table_id in (11, 4):
        got = find_orfs(frame, table_id, min_nt_length=3, residues=True)
        assert "regexp" not in got._jdf.queryExecution().toString() and "translate" not in got._jdf.queryExecution().toString()
        code = genetic_code(table_id)
        want = [
            (*orf, "".join(code.get(orf[5][k : k + 3], "X") for k in range(0, len(orf[5]), 3)))
            for seq_id, seq in seqs.items()
            if seq is not None
            for orf in brute_orfs(seq_id, seq.upper(), 3, table_id)
        ]
        assert sorted(tuple(r[c] for c in [*COLUMNS, "aa_sequence"]) for r in got.collect()) == sorted(want)
    plain = annotate_orfs(find_orfs(frame, min_nt_length=3)).select("parent_id", "orf_id", "aa_sequence")
    assert plain.exceptAll(find_orfs(frame, min_nt_length=3, residues=True).select("parent_id", "orf_id", "aa_sequence")).isEmpty()


def test_search_without_bases_and_with_known_lengths(spark):
    """ORFs that need no bases carry none, and a bound on the lengths saves deriving the sequences to ask for long ones."""
    frame = frame_of(spark, random_sequences())
    for tile in (3_000_000, 90):
        whole = find_orfs(frame, min_nt_length=30, tile_bases=tile, residues=True)
        bare = find_orfs(frame, min_nt_length=30, tile_bases=tile, residues=True, bases=False, lengths=frame.select(F.length("seq") + 7))
        assert "nt_sequence" not in bare.columns and bare.count() > 0
        assert whole.drop("nt_sequence").exceptAll(bare).isEmpty() and bare.exceptAll(whole.drop("nt_sequence")).isEmpty()
    derived = frame.withColumn("seq", F.raise_error(F.lit("derived")).cast("string"))
    find_orfs(derived, lengths=frame.select(F.length("seq")))
