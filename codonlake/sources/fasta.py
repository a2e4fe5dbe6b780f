"""FASTA as a splittable Spark source and as a text sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codonlake.session import stored

LINE_WIDTH = 80
_PART_FILE = r"/part-\d+-[0-9a-f-]{36}"


def _paths(path) -> list[str]:
    return [str(p) for p in path] if isinstance(path, (list, tuple)) else [str(path)]


def _records(spark: SparkSession, path) -> DataFrame:
    """One row per record, with the place it was read from."""
    text = spark.read.option("lineSep", "\n>").text(_paths(path))
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def fasta_problems(spark: SparkSession, path) -> DataFrame:
    """``(file, problem)`` of files whose first text line is no header, or that hold no text.

    Only the first record of a file still begins with ``>``, because the
    separator consumes the others; so each file's first non-blank record is
    looked at, found by a min-by that combines before its shuffle.
    """
    first = (
        _records(spark, path)
        .where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
        .groupBy("file")
        .agg(F.min_by(F.regexp_like("value", F.lit(r"^\s*>")), F.struct("block", "at")).alias("ok"))
    )
    headless = first.where(~F.col("ok")).select("file", F.lit("sequence before header").alias("problem"))
    # The driver lists the input files in any case. Spark's own sink leaves an
    # empty part file for an empty table, which is no error.
    names = [(n,) for n in spark.read.text(_paths(path)).inputFiles() if not re.search(_PART_FILE, n)]
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = spark.createDataFrame(names, "file string").select(name("file").alias("file"))
    empty = files.join(first.select(name("file").alias("file")), "file", "left_anti").select(
        "file", F.lit("no sequences").alias("problem")
    )
    return headless.unionByName(empty)


def read_fasta(spark: SparkSession, path, dedup: bool = True, validate: bool = True) -> DataFrame:
    """``seqs(seq_id, seq)`` of FASTA files, plain or ``.gz``.

    The id is the first word of the header. Lines are stripped, upper-cased
    and joined. Of several records with one id the last is kept, unless
    ``dedup`` is false. ``validate`` fails on a file that does not begin with
    a header and on input without any record; it reads the text once more,
    so trusted large input may go without.
    """
    if validate:
        bad = fasta_problems(spark, path).limit(1).collect()
        if bad:
            raise ValueError(f"FASTA {bad[0]['problem']}: {bad[0]['file']}")

    # A header may be indented; such a one is not split off by the separator.
    records = (
        _records(spark, path)
        .select("file", "block", "at", F.posexplode(F.split(F.regexp_replace("value", r"^\s*>", ""), r"\n[ \t]+>")))
        .where(F.col("col").rlike(r"\S"))
    )
    header = F.substring_index("col", "\n", 1)
    body = F.expr(r"if(locate('\n', col) > 0, substring(col, locate('\n', col) + 1), '')")
    stripped = F.regexp_replace(F.regexp_replace(body, r"\s*\n\s*", ""), r"^\s+|\s+$", "")
    # Lines are stripped one by one only where there is white space beside line ends.
    plain = F.replace(body, F.lit("\n"), F.lit(""))
    parsed = records.select(
        F.regexp_extract(header, r"^\s*(\S+)", 1).alias("seq_id"),
        F.upper(F.when(body.rlike(r"[ \t\x0B\f\r]"), stripped).otherwise(plain)).alias("seq"),
        F.struct("file", "block", "at", "pos").alias("_at"),
    )
    if validate and parsed.limit(1).isEmpty():
        raise ValueError(f"no sequences found in FASTA input: {path}")
    return _keep_last(parsed) if dedup else parsed.drop("_at")


def _keep_last(parsed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Last record of every id; ``ids`` may give the ids of ``parsed`` more cheaply.

    Repeated ids are found from ids alone and stored; without any, no record is
    joined or shuffled. Otherwise only records of repeated ids are gathered,
    and the last of them is told by places of one and the same scan.
    """
    ids = parsed if ids is None else ids
    repeated = ids.groupBy("seq_id").agg(F.count("*").alias("n")).where("n > 1").select("seq_id")
    repeated = stored(repeated, "repeated-ids")
    if repeated.isEmpty():
        return parsed.select("seq_id", "seq")
    last = parsed.join(repeated, "seq_id", "left_semi").groupBy("seq_id").agg(F.max_by("seq", "_at").alias("seq"))
    return parsed.join(repeated, "seq_id", "left_anti").select("seq_id", "seq").unionByName(last)


_PIECE = "file string, block long, at long, row long, seq_id string, pos long, bases string"
_WHITE = " \t\r\x0b\x0c"


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Lines of file blocks as pieces of records of about ``size`` bases.

    ``row`` is the place of the record's header and ``pos`` counts bases since it. Before the first
    header of a block ``row`` is null and ``pos`` counts from the block's start. ``at`` is the place of the piece.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [f.split(" ")[0] for f in _PIECE.split(", ")]
    out: list[tuple] = []
    where = row = seq_id = at = None
    parts: list[str] = []
    pos = waiting = 0

    def close() -> None:
        nonlocal at, parts, pos, waiting
        if at is not None:
            out.append((*where, at, row, seq_id, pos, "".join(parts)))
        at, parts, pos, waiting = None, [], pos + waiting, 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.record_batch(columns, names=names)

    for lines in batches:
        for file, block, place, value in zip(*(lines.column(c).to_pylist() for c in ("file", "block", "at", "value"))):
            line = value.strip(_WHITE)
            if (file, block) != where:
                close()
                where, row, seq_id, pos = (file, block), None, None, 0
            if line.startswith(">"):
                close()
                words = line[1:].split(None, 1)
                at = row = place
                seq_id, pos = (words[0] if words else ""), 0
            elif line:
                at = place if at is None else at
                parts.append(line.upper())
                waiting += len(parts[-1])
                if waiting >= size:
                    close()
        if out:
            yield batch()
    close()
    if out:
        yield batch()


def _open_records(pieces: DataFrame) -> DataFrame:
    """``(file, block, open_row, open_id, before)``: the record that each block of a file goes on with, and its bases before.

    A block is summed up by its last header and the bases behind it (all, without a header); these
    small rows are filled forward along the file.
    """
    blocks = pieces.groupBy("file", "block").agg(
        F.max("row").alias("row"),
        F.max_by("seq_id", F.when(F.col("row").isNotNull(), F.col("at"))).alias("seq_id"),
        F.max_by(F.col("pos") + F.length("bases"), "at").alias("tail"),
    )
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    filled = blocks.select(
        "file",
        "block",
        "tail",
        F.last("row", ignorenulls=True).over(earlier).alias("open_row"),
        F.last("seq_id", ignorenulls=True).over(earlier).alias("open_id"),
        F.last("row", ignorenulls=True).over(along).alias("held"),
    )
    total = F.sum("tail").over(Window.partitionBy("file", "held").orderBy("block"))
    return filled.withColumn("total", total).select(
        "file", "block", "open_row", "open_id", F.coalesce(F.lag("total").over(along), F.lit(0)).alias("before")
    )


def read_fasta_chunks(
    spark: SparkSession, path, size: int, overlap: int = 0, dedup: bool = True, validate: bool = True
) -> DataFrame:
    """``(row, seq_id, chunk, chunks, length, bases)``: records of FASTA files in chunks, whatever their length.

    No record is ever a row: every file block gives pieces of the records it holds, and a summary
    that tells the next blocks which record they go on with. Pieces are then dealt to chunks of
    ``size`` bases, each with the first ``overlap`` of the next (at most ``size``). ``row`` tells records
    apart; chunks are stored. Single lines must fit a row, and a ``.gz`` file is one block. Other rules
    are those of ``read_fasta``; bases before a file's first header are left out without ``validate``.
    """
    if validate:
        bad = fasta_problems(spark, path).limit(1).collect()
        if bad:
            raise ValueError(f"FASTA {bad[0]['problem']}: {bad[0]['file']}")
    lines = spark.read.text(_paths(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    pieces = stored(lines.mapInArrow(lambda it: _pieces(it, size), _PIECE), "fasta-pieces")
    begun = pieces.where("row IS NULL").drop("row", "seq_id").join(_open_records(pieces), ["file", "block"])
    begun = begun.where("open_row IS NOT NULL").withColumn("pos", F.col("pos") + F.col("before"))
    columns = ["row", "seq_id", "pos", "bases"]
    placed = pieces.where("row IS NOT NULL").select(*columns).unionByName(
        begun.withColumnsRenamed({"open_row": "row", "open_id": "seq_id"}).select(*columns)
    )
    lengths = placed.groupBy("row").agg(F.max(F.col("pos") + F.length("bases")).alias("length"))
    heads = pieces.where("row = at").select("row", "seq_id", F.struct("file", "block", "at").alias("place"))
    if dedup:
        heads = heads.groupBy("seq_id").agg(F.max_by("row", "place").alias("row"))
    kept = stored(heads.select("row", "seq_id").join(lengths, "row"), "fasta-records")
    if validate and kept.isEmpty():
        raise ValueError(f"no sequences found in FASTA input: {path}")
    first = f"greatest(cast(floor((pos - {overlap}) / {size}) as int), 0)"
    last = f"cast(floor((pos + length(bases) - 1) / {size}) as int)"
    dealt = placed.select("row", "pos", "bases").join(kept.select("row"), "row", "left_semi").selectExpr(
        "row", "pos", "bases", f"explode(sequence({first}, greatest({first}, {last}))) as chunk"
    )
    begin = f"(cast(chunk as long) * {size} - pos)"
    part = f"substring(bases, cast(greatest({begin}, 0) as int) + 1, cast({begin} + {size + overlap} - greatest({begin}, 0) as int))"
    cut = dealt.selectExpr("row", "chunk", "pos", f"{part} as part").groupBy("row", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "part"))).getField("part"), "").alias("bases")
    )
    chunks = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int")
    whole = cut.join(kept, "row").select("row", "seq_id", "chunk", chunks.alias("chunks"), "length", "bases")
    return stored(whole, "fasta-chunks")


def fasta_text(seq_id: str = "seq_id", seq: str = "seq", line_width: int = LINE_WIDTH):
    """One FASTA record as text, wrapped at ``line_width``."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{line_width}}})(?=.)", "$1\n")
    return F.when(F.length(seq) == 0, F.concat(F.lit(">"), F.col(seq_id))).otherwise(
        F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), wrapped)
    )


def write_fasta(
    seqs: DataFrame, path: str, line_width: int = LINE_WIDTH, compression: str = "none", mode: str = "errorifexists"
) -> None:
    """Write ``seqs`` as FASTA part files; ``compression='gzip'`` gives ``.gz``."""
    seqs.select(fasta_text(line_width=line_width).alias("value")).write.mode(mode).option(
        "compression", compression
    ).text(path)


def protein_records(seqs: DataFrame) -> DataFrame:
    """Protein table from protein sequences, with placeholders for the ORF."""
    return seqs.select(
        F.col("seq_id").alias("parent_id"),
        F.col("seq_id").alias("orf_id"),
        F.lit(0).alias("start"),
        (F.length("seq") * 3).alias("end"),
        F.lit("+").alias("strand"),
        F.lit(0).alias("frame"),
        F.lit("").alias("nt_sequence"),
        F.col("seq").alias("aa_sequence"),
        F.lit(11).alias("table_id"),
        F.lit(False).alias("has_start_codon"),
        F.lit(False).alias("has_stop_codon"),
        F.lit(False).alias("in_genbank"),
        F.col("seq").alias("protein_aa"),
        F.length("seq").alias("aa_length"),
    )


def read_protein_fasta(spark: SparkSession, path) -> DataFrame:
    return protein_records(read_fasta(spark, path))
