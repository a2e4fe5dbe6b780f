import gzip
import json

import pytest
from pyspark.sql import functions as F

from codonlake.plans import jobs
from codonlake.sources import fasta, genbank, orf_fasta, results, stages


def pairs(df):
    return sorted((r["seq_id"], r["seq"]) for r in df.collect())


FASTA = ">a first one\nacgt\nAC GT\n\n>b\r\nTTTT  \r\n  gg\n  >c indented\nAA\n>empty\n>b again\nCCC\n"
WANT = [("a", "ACGTAC GT"), ("b", "CCC"), ("c", "AA"), ("empty", "")]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    assert pairs(fasta.read_fasta(spark, tmp_path / "x.fa")) == WANT
    everything = pairs(fasta.read_fasta(spark, tmp_path / "x.fa", dedup=False))
    assert everything == sorted(WANT + [("b", "TTTTGG")])


def test_fasta_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(FASTA)
    assert pairs(fasta.read_fasta(spark, tmp_path / "x.fa.gz")) == WANT


def test_fasta_splits_lose_nothing(spark, tmp_path):
    records = [(f"r{i % 500}", "ACGT" * (i % 37 + 1)) for i in range(1500)]
    (tmp_path / "big.fa").write_text("".join(f">{k}\n{v}\n" for k, v in records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = fasta.read_fasta(spark, tmp_path / "big.fa")
        assert pairs(read) == sorted(dict(records).items())
        assert fasta.read_fasta(spark, tmp_path / "big.fa", dedup=False).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_fasta(spark, tmp_path):
    (tmp_path / "headless.fa").write_text("ACGT\n>a\nAC\n")
    (tmp_path / "empty.fa").write_text("\n\n")
    with pytest.raises(ValueError, match="sequence before header"):
        fasta.read_fasta(spark, tmp_path / "headless.fa")
    with pytest.raises(ValueError, match="no sequences"):
        fasta.read_fasta(spark, tmp_path / "empty.fa")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fasta.read_fasta(spark, tmp_path / "none.fa")


def test_fasta_wrap_and_round_trip(spark, tmp_path):
    rows = [("a", "ACGT" * 41), ("b", "A" * 80), ("c", "A" * 81)]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string")
    fasta.write_fasta(seqs, str(tmp_path / "out"))
    lines = [line for part in (tmp_path / "out").glob("part*") for line in part.read_text().splitlines()]
    assert max(map(len, lines)) == 80 and "" not in lines
    assert pairs(fasta.read_fasta(spark, tmp_path / "out")) == rows
    fasta.write_fasta(seqs, str(tmp_path / "gz"), compression="gzip")
    assert list((tmp_path / "gz").glob("*.gz")) and pairs(fasta.read_fasta(spark, tmp_path / "gz")) == rows


GENBANK = """LOCUS       ONE                       60 bp    DNA     linear   BCT 01-JAN-2024
DEFINITION  Made for this test; the word CDS and // stand here.
ACCESSION   ONE
VERSION     ONE.1
FEATURES             Location/Qualifiers
     source          1..60
                     /organism="Something"
     CDS             10..36
                     /codon_start=1
                     /product="a protein with a
                     long name"
                     /translation="MTRWPEHVDL
                     NYIGACFSQKHPWDRT"
     gene            complement(40..58)
                     /locus_tag="g2"
     CDS             complement(join(<4..9,
                     20..>30))
                     /translation="MWKH"
     CDS             join(5..7,AB1234.1:900..1000,12..14)
                     /pseudo
ORIGIN
        1 ggatcctaac gtacatgacc cgatggcctg aacacgtaga tctaaattat attggagctt
//
LOCUS       TWO                        9 bp    ds-RNA     linear   VRL 01-JAN-2024
VERSION     TWO.3
FEATURES             Location/Qualifiers
     source          1..9
ORIGIN
        1 acgtnnacg
//
"""


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_genbank(spark, tmp_path, suffix):
    path = tmp_path / f"x.gb{suffix}"
    (gzip.open(path, "wt") if suffix else open(path, "w")).write(GENBANK)
    seqs = dict(pairs(genbank.read_genbank(spark, path)))
    assert seqs["TWO.3"] == "ACGTNNACG" and len(seqs["ONE.1"]) == 60 and len(seqs) == 2
    cds = [tuple(r) for r in genbank.read_cds(spark, path).collect()]
    assert cds == [
        ("ONE.1", 9, 36, "+", "MTRWPEHVDLNYIGACFSQKHPWDRT"),
        ("ONE.1", 3, 30, "-", "MWKH"),
        ("ONE.1", 4, 1000, "+", ""),
    ]


def test_last_genbank_record_counts(spark, tmp_path):
    again = GENBANK + GENBANK.split("//\n")[1].replace("acgtnnacg", "ttttttttt") + "//\n"
    (tmp_path / "x.gb").write_text(again)
    seqs = pairs(genbank.read_genbank(spark, tmp_path / "x.gb"))
    assert len(seqs) == 2 and dict(seqs)["TWO.3"] == "TTTTTTTTT"
    (tmp_path / "y.gb").write_text(GENBANK + GENBANK)
    assert genbank.read_cds(spark, tmp_path / "y.gb").count() == 3


def test_an_empty_file_among_others_is_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">q\nACGT\n")
    (tmp_path / "b.fa").write_text("")
    with pytest.raises(ValueError, match="no sequences"):
        fasta.read_fasta(spark, tmp_path)
    (tmp_path / "b.fa").write_text("\n \n")
    with pytest.raises(ValueError, match="no sequences"):
        fasta.read_fasta(spark, [tmp_path / "a.fa", tmp_path / "b.fa"])


def test_unique_ids_shuffle_no_sequence(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">q\nACGT\n>r\nAC\n")
    fasta.read_fasta(spark, tmp_path / "a.fa").explain()
    assert "Exchange" not in capsys.readouterr().out


def test_input_choice(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GENBANK)
    (tmp_path / "x.fa").write_text(">q\nACGT\n")
    seqs, cds = genbank.read_inputs(spark, genbank=tmp_path / "x.gb")
    assert seqs.count() == 2 and cds.count() == 3
    seqs, cds = genbank.read_inputs(spark, fasta=tmp_path / "x.fa", genbank=tmp_path / "x.gb")
    assert pairs(seqs) == [("q", "ACGT")] and cds.count() == 3
    assert genbank.read_inputs(spark, fasta=tmp_path / "x.fa")[1] is None
    with pytest.raises(ValueError):
        genbank.read_inputs(spark)


def test_orf_fasta(spark, tmp_path):
    text = (
        ">c77-orf58 [c77 frame -3 3 11]\nMK*\n"
        ">orf4 [c77 frame +1 1 6]\nKT\n"
        ">apart-orf4 [c77 frame +1 1 6]\nKT\n"
        ">orf9 [missing frame +1 1 6]\nKT\n"
        ">noplace\nKT\n"
        ">c77-orf6 c77 frame 1 1 6\nKT\n"
    )
    (tmp_path / "orfs.fa").write_text(text)
    seqs = spark.createDataFrame([("c77", "AAAACCGGTTTT")], "seq_id string, seq string")
    found, rejected = orf_fasta.read_orf_fasta(spark, tmp_path / "orfs.fa", seqs)
    rows = {r["orf_id"]: r for r in found.collect()}
    minus = rows["orf58"]
    assert (minus["strand"], minus["frame"], minus["start"], minus["end"]) == ("-", 3, 3, 11)
    assert minus["nt_sequence"] == "AAACCGGTTTT"[1:10] and minus["has_start_codon"] and minus["has_stop_codon"]
    assert rows["orf4"]["nt_sequence"] == "AAAACC" and not rows["orf4"]["has_stop_codon"]
    assert sorted(r["problem"] for r in rejected.collect()) == [
        "header form", "header form", "two parents", "unknown parent",
    ]


def orf(orf_id, **other):
    return {
        "parent_id": "p", "orf_id": orf_id, "start": 10, "end": 19, "strand": "+", "frame": 1, "nt_sequence": "ATGAAATAG",
        "aa_sequence": "MK*", "table_id": 11, "has_start_codon": True, "has_stop_codon": True, **other,
    }


def protein(o):
    return {"orf": o, "aa_sequence": "MK", "aa_length": 2}


def three_di(o):
    return {"protein": protein(o), "three_di": "dv", "method": "m", "model_name": "n", "inference_device": "cpu"}


def list_result(input_id, ids, missing=()):
    orfs = [orf(i, in_genbank=i == "orf1") for i in ids]
    return {
        "input_id": input_id, "input_dna_length": 100, "orfs": orfs, "proteins": [protein(o) for o in orfs],
        "three_dis": [three_di(o) for o in orfs if o["orf_id"] not in missing],
        "entropy": {
            "dna_entropy_global": 1.9, "orf_nt_entropy": {"orf1": 1.5}, "protein_aa_entropy": {i: 1.0 for i in ids},
            "three_di_entropy": {i: 1.0 for i in ids}, "alphabet_sizes": {"dna": 4, "protein": 20, "three_di": 20},
        },
    }


def unified_result(input_id, ids):
    def feature(i):
        return {
            "orf_id": i, "location": {"start": 1, "end": 9, "strand": "-", "frame": 2},
            "dna": {"nt_sequence": "ATGAAATAG", "length": 9}, "protein": {"aa_sequence": "MK", "length": 2},
            "three_di": {"encoding": "dv", "length": 2, "method": "m", "model_name": "n", "inference_device": "cpu"},
            "metadata": {
                "parent_id": input_id, "table_id": 11, "has_start_codon": True, "has_stop_codon": False, "in_genbank": True,
            },
            "entropy": {"dna_entropy": 1.5, "protein_entropy": 1.0, "three_di_entropy": 1.0},
        }

    return {
        "schema_version": "2.0.0", "input_id": input_id, "input_dna_length": 9, "dna_entropy_global": 1.0,
        "alphabet_sizes": {"dna": 4}, "features": {i: feature(i) for i in ids},
    }


@pytest.fixture
def result_dir(tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "lists.json").write_text(json.dumps([list_result("v1", ["orf1", "orf2", "orf3"], missing=["orf3"])], indent=2))
    with gzip.open(folder / "unified.json.gz", "wt") as f:
        json.dump([unified_result("v2", ["orf1", "orf9"])], f)
    (folder / "bare.json").write_text(json.dumps(unified_result("bare", ["orf1"])))
    broken = unified_result("gap", ["orf1", "orf2"])
    del broken["features"]["orf2"]["entropy"], broken["features"]["orf2"]["location"]["strand"]
    (folder / "gap.json").write_text(json.dumps([broken]))
    (folder / "broken.json").write_text("[{ not json")
    (folder / "other.json").write_text(json.dumps([{"something": 1}]))
    (folder / "notes.txt").write_text("ignored")
    return folder


def test_results_of_both_forms(spark, result_dir):
    read = results.read_results(spark, result_dir)
    kinds = {r["source_file"]: r["format"] for r in read.select("source_file", "format").collect()}
    assert kinds == {
        "lists.json": "lists", "unified.json.gz": "unified", "bare.json": "unified", "gap.json": "unified",
        "broken.json": "broken", "other.json": "unknown",
    }
    assert [r[0] for r in results.source_files(read).collect()] == sorted(kinds)
    flat = results.flat_features(read)
    got = {(r["input_id"], r["orf_id"]): r for r in flat.collect()}
    assert set(got) == {
        ("v1", "orf1"), ("v1", "orf2"), ("v2", "orf1"), ("v2", "orf9"), ("bare", "orf1"), ("gap", "orf1"), ("gap", "orf2"),
    }
    assert got["v1", "orf1"]["dna_entropy"] == 1.5 and got["v1", "orf2"]["dna_entropy"] == 0.0
    assert got["v1", "orf1"]["in_genbank"] and not got["v1", "orf2"]["in_genbank"]
    counts = results.conversion_counts(read).first()
    assert (counts["expected"], counts["actual"]) == (3, 2)
    matrix = jobs.result_features(read)
    assert matrix.count() == 6
    row = matrix.where("orf_id = 'orf9'").first()
    assert (row["strand_plus"], row["frame"], row["has_start_codon"], row["has_stop_codon"], row["label"]) == (0, 2, 1, 0, 1)


def test_duplicate_parts_last_wins(spark, tmp_path):
    result = list_result("v1", ["orf1"])
    result["proteins"].append({**result["proteins"][0], "aa_sequence": "MKK", "aa_length": 3})
    (tmp_path / "a.json").write_text(json.dumps([result]))
    flat = results.flat_features(results.read_results(spark, tmp_path))
    assert [r["protein_aa"] for r in flat.collect()] == ["MKK"]


def test_write_converts(spark, result_dir, tmp_path):
    results.write_results(results.read_results(spark, result_dir), str(tmp_path / "out"), compression="gzip")
    again = results.read_results(spark, tmp_path / "out", json_lines=True)
    assert {r["format"] for r in again.collect()} == {"unified"}
    before = results.flat_features(results.read_results(spark, result_dir)).drop("source_file")
    after = results.flat_features(again).drop("source_file")
    assert sorted(map(str, before.collect())) == sorted(map(str, after.select(*before.columns).collect()))
    found = results.lookup_feature(again, "orf9").collect()
    assert [(r["input_id"], r["orf_id"]) for r in found] == [("v2", "orf9")]


def test_one_result_for_each_sequence_unless_parts_are_asked_for(spark, result_dir):
    flat = results.flat_features(results.read_results(spark, result_dir)).where("input_id = 'v2'")
    heads = spark.createDataFrame(
        [("v2", 9, 1.0, {"dna": 4}), ("none", 3, 0.0, {})],
        "input_id string, input_dna_length long, dna_entropy_global double, alphabet_sizes map<string,int>",
    )
    for parts in (1, 50):
        nested = results.nest_features(flat, heads, parts=parts)
        sizes = nested.groupBy("input_id").agg(F.sum(F.size("features")).alias("n"), F.count("*").alias("rows")).collect()
        assert {r["input_id"]: (r["n"], r["rows"]) for r in sizes} == {"v2": (2, min(parts, 2)), "none": (0, 1)}


def test_runs_and_conversions_split_every_sequence_alike(spark, result_dir, tmp_path):
    read = results.read_results(spark, result_dir)
    whole, split = results.to_unified(read), results.to_unified(read, parts=50)
    assert split.count() > whole.count()
    features = lambda df: sorted(map(str, df.select("input_id", F.explode("features")).collect()))
    assert features(whole) == features(split)
    (tmp_path / "x.fa").write_text(">s\n" + ("ATG" + "GCA" * 40 + "TAA") * 6 + "\n")
    flat, nested = jobs.run(spark, str(tmp_path / "run"), fasta=tmp_path / "x.fa", parts=8)
    assert 1 < nested.count() <= 8
    assert results.flat_features(nested).select("orf_id").distinct().count() == flat.count()


def test_no_results(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{ no")
    with pytest.raises(ValueError, match="no valid"):
        results.read_results(spark, tmp_path)


def test_stage_files(spark, tmp_path):
    (tmp_path / "orfs.json").write_text(json.dumps([orf("orf1"), orf("orf2", in_genbank=True)], indent=1))
    assert [r["in_genbank"] for r in stages.read_orfs(spark, tmp_path / "orfs.json").orderBy("orf_id").collect()] == [False, True]
    (tmp_path / "p.json").write_text(json.dumps([protein(orf("orf1"))]))
    (tmp_path / "p.faa").write_text(">x\nMK\n")
    from_json = stages.read_proteins(spark, tmp_path / "p.json").first()
    from_fasta = stages.read_proteins(spark, tmp_path / "p.faa").first()
    assert (from_json["protein_aa"], from_json["aa_length"]) == (from_fasta["protein_aa"], from_fasta["aa_length"]) == ("MK", 2)
    assert (from_fasta["start"], from_fasta["end"], from_fasta["frame"], from_fasta["nt_sequence"]) == (0, 6, 0, "")
    (tmp_path / "t.json").write_text(json.dumps([three_di(orf("orf1"))]))
    entropy = jobs.entropy_table(stages.read_three_di(spark, tmp_path / "t.json")).first()
    assert entropy["three_di_entropy"] == 1.0 and entropy["protein_entropy"] == 1.0
    (tmp_path / "bad.json").write_text("[{ no")
    with pytest.raises(Exception):
        stages.read_orfs(spark, tmp_path / "bad.json").collect()


def test_full_run(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s\n" + "ATG" + "GCAAAA" * 30 + "TAA\n>tiny\nACG\n")
    features, read = jobs.run(spark, str(tmp_path / "run"), fasta=tmp_path / "x.fa")
    assert features.count() > 0 and not features.where("in_genbank").count()
    rows = {r["input_id"]: r for r in read.collect()}
    assert len(rows["s"]["features"]) == features.count() and rows["s"]["alphabet_sizes"]["three_di"] == 20
    assert rows["tiny"]["features"] == {} and rows["tiny"]["alphabet_sizes"] == {} and rows["tiny"]["input_dna_length"] == 3
    features, read = jobs.run(spark, str(tmp_path / "plain"), fasta=tmp_path / "x.fa", compute_entropy=False)
    assert features.where("dna_entropy <> 0").count() == 0
    assert all(r["alphabet_sizes"] == {} and r["dna_entropy_global"] == 0.0 for r in read.collect())


def test_long_genbank_record(spark, tmp_path):
    """A protein and a sequence far longer than a matcher's stack is deep."""
    residues, bases = "MKLV" * 20_000, "acgtacgtac" * 100_000
    lines = ("\n" + " " * 21).join(residues[i : i + 58] for i in range(0, len(residues), 58))
    origin = "\n".join(f"{i + 1:>9} {bases[i : i + 60]}" for i in range(0, len(bases), 60))
    text = (
        f"LOCUS       BIG {len(bases)} bp DNA\nVERSION     BIG.1\nFEATURES             Location/Qualifiers\n"
        f"     CDS             1..240003\n                     /translation=\"{lines}\"\nORIGIN\n{origin}\n//\n"
    )
    (tmp_path / "big.gb").write_text(text)
    assert genbank.read_genbank(spark, tmp_path / "big.gb").first()["seq"] == bases.upper()
    assert genbank.read_cds(spark, tmp_path / "big.gb").first()["protein_sequence"] == residues
    (tmp_path / "big.fa").write_text(f">big\n{bases}\n>long line\n" + "\n".join(["acgt" * 20] * 20_000) + "\n")
    read = {r["seq_id"]: len(r["seq"]) for r in fasta.read_fasta(spark, tmp_path / "big.fa").collect()}
    assert read == {"big": 1_000_000, "long": 1_600_000}


def test_conversion_of_lists_stays_in_the_row(spark, result_dir, tmp_path):
    """No feature of a three-list result is shuffled; results of one id in a file are converted one by one."""
    twice = [list_result("v1", ["orf1", "orf10", "orf2"]), list_result("v1", ["orf2", "orf3"], missing=["orf3"])]
    (tmp_path / "twice.json").write_text(json.dumps(twice))
    read = results.read_results(spark, tmp_path / "twice.json")
    for made in (results.features_from_lists(read), results.conversion_counts(read), results.to_unified(read)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["expected"], r["actual"]) for r in results.conversion_counts(read).collect()) == [(2, 1), (3, 3)]
    assert sorted(r["n"] for r in results.to_unified(read).select(F.size("features").alias("n")).collect()) == [1, 3]


def test_genbank_parts_are_cut_at_their_lines(spark, tmp_path):
    """Names inside a line begin nothing, an unfinished origin has no bases, and no expression walks a record."""
    text = (
        "LOCUS       L1\r\nACCESSION\n  A1\nCOMMENT x VERSION no\nFEATURES\n     CDS             join(1..3,\n                     X2.1:5..9)\n"
        '                     /note="CDS  7..8"\n     gene            1..9\n                     /translation="QQ"\nCONTIG x\n     CDS             1..2\n'
        "ORIGIN\n        1 acé gt\n xORIGIN\n//\nLOCUS       L2\nORIGIN\n//\nLOCUSX L3\nORIGIN\n acgt\n//\n"
    )
    (tmp_path / "x.gb").write_text(text, encoding="utf-8")
    seqs, cds = genbank.read_genbank(spark, tmp_path / "x.gb"), genbank.read_cds(spark, tmp_path / "x.gb")
    assert dict(pairs(seqs)) == {"A1": "ACGTXORIGIN", "L2": ""}
    assert [tuple(r) for r in cds.collect()] == [("A1", 0, 9, "+", "")]
    assert "value RLIKE" not in seqs._jdf.queryExecution().toString() and "regexp_extract(" not in seqs._jdf.queryExecution().toString()


def test_both_forms_are_read_in_one_scan(spark, tmp_path):
    """One scan of the files gives the features of either form, and maps are not shuffled between their group and their join."""
    path = str(tmp_path / "empty")
    spark.createDataFrame([("{}",)], "value string").write.text(path)
    read = results.read_results(spark, path, json_lines=True, validate=False)
    plan = results.flat_features(read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flat = results.flat_features(read)
        flat = flat.withColumn("input_id", F.col("parent_id"))
        heads = read.select("input_id", "input_dna_length", "dna_entropy_global", "alphabet_sizes")
        plan = results.nest_features(flat, heads)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
