"""Long sequences as tables of chunks, and what chunks tell each other.

A chunk is a row of a bounded number of bases; work on a long sequence is work
on its chunks, dealt out like any rows. What a search of ORFs has to know of the
rest of the sequence is an associative summary: a chunk reports, for each strand and
frame, the bases before its first stop, those after its last stop and the number of
ORFs between. Summaries are small rows, combined by running sums over the chunks of
a sequence; no task reads bases of another chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codonlake.alphabets import stop_codons
from codonlake.session import stored

_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_EDGES = "row long, seq_id string, strand string, frame int, at int, role int, start long, bases string, inside long"
_INSIDE = "row long, seq_id string, strand string, frame int, at int, place long, start long, bases string"
HEAD, TAIL, THROUGH = 0, 1, 2
LOOKUP_BASES = 100_000


def chunked(seqs: DataFrame, size: int, overlap: int = 0, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``(key, chunk, chunks, length, bases)``: every sequence in pieces of ``size`` symbols.

    Each piece also holds the first ``overlap`` symbols of the next. An empty or null sequence is
    one empty chunk or a null one. Bytes are cut where they are symbols, so the time is linear in the length.
    """
    rows = seqs.select(key, F.col(seq).alias("_seq")).selectExpr(
        f"`{key}`",
        "_seq",
        "cast(_seq as binary) as _raw",
        "length(_seq) as length",
        "octet_length(_seq) = length(_seq) as _bytes",
        f"cast(greatest(1, ceil(length(_seq) / {size})) as int) as chunks",
    )
    cut = f"chunk * {size} + 1, {size + overlap}"
    return rows.selectExpr("*", "explode(sequence(0, chunks - 1)) as chunk").selectExpr(
        f"`{key}`",
        "chunk",
        "chunks",
        "length",
        f"if(_bytes, cast(substring(_raw, {cut}) as string), substring(_seq, {cut})) as bases",
    )


def store_chunk_index(seqs: DataFrame, table: str, size: int = LOOKUP_BASES, buckets: int = 200) -> DataFrame:
    """Save the chunks of ``seqs`` as a table bucketed by sequence and chunk, for lookups that read only it.

    Bases are written where they are read, without a shuffle; a lookup joins on the buckets, so
    they are not shuffled then either. The table goes to the session's warehouse.
    """
    chunks = chunked(seqs, size).where("length(bases) > 0")
    chunks.write.bucketBy(buckets, "seq_id", "chunk").sortBy("seq_id", "chunk").saveAsTable(table)
    return seqs.sparkSession.table(table)


class _Stops:
    """Which triplets of bases are a stop codon, as read on either strand."""

    def __init__(self, table_id: int):
        self.code = np.full(129, 4, np.int16)
        self.code[[ord(c) for c in "ACGT"]] = range(4)
        self.tables = {}
        for strand in "+-":
            table = np.zeros(125, bool)
            for codon in stop_codons(table_id):
                read = codon if strand == "+" else codon.translate(_COMPLEMENT)[::-1]
                a, b, c = ("ACGT".index(x) for x in read)
                table[25 * a + 5 * b + c] = True
            self.tables[strand] = table

    def at(self, bases: str) -> dict[str, np.ndarray]:
        letters = np.frombuffer(bases.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[np.minimum(letters, 128)]
        triplets = 25 * codes[:-2] + 5 * codes[1:-1] + codes[2:]
        return {strand: table[triplets] for strand, table in self.tables.items()}


class _Batch:
    """The chunks of a batch end to end, and the stops of all of them at once."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        names = ("row", "seq_id", "chunk", "chunks", "length", "bases")
        self.rows, self.ids, self.places, self.n_chunks, self.lengths, texts = (batch.column(c).to_pylist() for c in names)
        self.offsets = [place * size for place in self.places]
        self.begins = np.cumsum([0] + [len(text) for text in texts])
        self.whole = "".join(texts)

    def stops(self, stops: _Stops) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """For each strand: stops by place in ``whole``, ordered by frame, and their frame: three times the chunk plus its phase."""
        if len(self.whole) < 3:
            return
        for strand, stop in stops.at(self.whole).items():
            found = np.flatnonzero(stop)
            chunk = np.searchsorted(self.begins, found, side="right") - 1
            inside = found + 3 <= self.begins[chunk + 1]  # no codon reaches into the next chunk of the batch
            found, chunk = found[inside], chunk[inside]
            line = 3 * chunk + (found - self.begins[chunk]) % 3
            order = np.lexsort((found, line))
            yield strand, found[order], line[order]

    def key(self, line: int, strand: str) -> tuple:
        c, phase = divmod(line, 3)
        if strand == "+":
            return self.rows[c], self.ids[c], strand, phase + 1, self.places[c]
        frame = (self.lengths[c] - self.offsets[c] - phase) % 3 + 1
        return self.rows[c], self.ids[c], strand, frame, self.n_chunks[c] - 1 - self.places[c]

    def piece(self, line: int, strand: str, first: int, last: int) -> tuple[int, str]:
        """The start and the bases, as read, of places ``first`` to ``last`` of ``whole``."""
        c, bases = line // 3, self.whole[first:last]
        shift = self.offsets[c] - int(self.begins[c])
        if strand == "+":
            return shift + first + 1, bases
        return self.lengths[c] - shift - last + 1, bases.translate(_COMPLEMENT)[::-1]


def _summaries(batches: Iterator[pa.RecordBatch], size: int, table_id: int, least: int) -> Iterator[pa.RecordBatch]:
    """Edge pieces and counts of the chunks of a batch."""
    stops = _Stops(table_id)
    for batch in batches:
        held, out = _Batch(batch, size), []
        begins = held.begins[:-1].repeat(3) + np.tile(np.arange(3), batch.num_rows)
        codons = (held.begins[1:].repeat(3) - begins) // 3
        ends = (begins + 3 * codons).tolist()
        lines = np.flatnonzero(codons > 0)
        for strand, found, line in held.stops(stops):
            long = np.concatenate([[0], np.cumsum((np.diff(line) == 0) & (np.diff(found) >= least))]) if len(found) else found
            low, high = np.searchsorted(line, lines), np.searchsorted(line, lines, side="right") - 1
            for g, a, z in zip(lines.tolist(), low.tolist(), high.tolist()):
                key, begin, end = held.key(g, strand), int(begins[g]), ends[g]
                if a > z:
                    out.append((*key, THROUGH, *held.piece(g, strand, begin, end), 0))
                    continue
                first, last = int(found[a]), int(found[z])
                before = (begin, first + 3) if strand == "+" else (last, end)
                after = (last + 3, end) if strand == "+" else (begin, first)
                out.append((*key, HEAD, *held.piece(g, strand, *before), int(long[z] - long[a])))
                out.append((*key, TAIL, *held.piece(g, strand, *after), 0))
        yield _batch(out, _EDGES)


def _insides(batches: Iterator[pa.RecordBatch], size: int, table_id: int, least: int) -> Iterator[pa.RecordBatch]:
    """ORFs that begin after a stop of their chunk and end with another: between neighbouring stops of a frame.

    One batch for each that came in; only the ORFs that are long enough are cut.
    """
    stops = _Stops(table_id)
    for batch in batches:
        held, out = _Batch(batch, size), []
        for strand, found, line in held.stops(stops):
            long = np.flatnonzero((np.diff(line) == 0) & (np.diff(found) >= least))
            before, place = None, 0
            for k in (long if strand == "+" else long[::-1]).tolist():
                g, ahead = int(line[k]), 3 * (strand == "+")
                place = place + 1 if g == before else 0
                before = g
                out.append((*held.key(g, strand), place, *held.piece(g, strand, int(found[k]) + ahead, int(found[k + 1]) + ahead)))
        yield _batch(out, _INSIDE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [field.split(" ") for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(list(x), kinds[k]) for x, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def orfs_of_long_sequences(seqs: DataFrame, size: int, table_id: int, min_nt_length: int) -> DataFrame:
    """``(seq_id, number, start, strand, frame, nt_sequence)`` of ORFs, numbered by strand, frame and start.

    The chunks are dealt out and stored once.
    """
    numbered = seqs.select(F.monotonically_increasing_id().alias("row"), F.col("seq_id").cast("string").alias("seq_id"), "seq")
    rows = numbered.select(F.struct("row", "seq_id").alias("id"), "seq")
    chunks = chunked(rows, size, 2, key="id").select(
        "id.row", "id.seq_id", "chunk", "chunks", "length", F.upper("bases").alias("bases")
    )
    return orfs_of_chunks(stored(chunks.repartition("row", "chunk"), "sequence-chunks"), size, table_id, min_nt_length)


def orfs_of_chunks(chunks: DataFrame, size: int, table_id: int, min_nt_length: int) -> DataFrame:
    """``(seq_id, number, start, strand, frame, nt_sequence)`` of ``chunks (row, seq_id, chunk, chunks, length, bases)``.

    ``size`` is a multiple of 3 and chunks hold two symbols more than it. ``row`` tells sequences apart.
    A stored table is read twice, for the summaries and for the ORFs inside chunks. ORFs across chunks
    are put together from their pieces, one group each; only those and the summaries are shuffled, and the
    ORFs inside for their numbers if there are more summaries than Spark broadcasts.
    """
    edges = stored(chunks.mapInArrow(lambda it: _summaries(it, size, table_id, min_nt_length), _EDGES), "chunk-edges")

    line = ["row", "strand", "frame"]
    along = Window.partitionBy(*line).orderBy("at", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.sum((F.col("role") == HEAD).cast("int")).over(along)
    pieces = edges.withColumn("run", closed - (F.col("role") == HEAD).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "bases")))
    across = pieces.groupBy(*line, "run").agg(
        F.first("seq_id").alias("seq_id"), F.min("start").alias("start"), F.array_join(parts.getField("bases"), "").alias("nt_sequence")
    )
    across = stored(across.where(F.length("nt_sequence") >= F.greatest(F.lit(min_nt_length), F.lit(1))), "orfs-across-chunks")

    one, none = F.lit(1).cast("long"), F.lit(None).cast("int")
    counts = across.select(*line, "run", F.lit(0).alias("kind"), one.alias("n"), none.alias("at")).unionByName(
        pieces.where(F.col("role") == HEAD).select(*line, "run", F.lit(1).alias("kind"), F.col("inside").alias("n"), "at")
    )
    before = Window.partitionBy("row").orderBy("strand", "frame", "run", "kind").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "orf-offsets")

    columns = ["seq_id", "number", "start", "strand", "frame", "nt_sequence"]
    first = across.join(offsets.where("kind = 0").select(*line, "run", "offset"), [*line, "run"])
    inside = chunks.mapInArrow(lambda it: _insides(it, size, table_id, min_nt_length), _INSIDE)
    inside = inside.join(offsets.where("kind = 1").select(*line, "at", "offset"), [*line, "at"])
    return first.withColumn("number", F.col("offset") + 1).select(*columns).unionByName(
        inside.withColumn("number", F.col("offset") + F.col("place") + 1).withColumnRenamed("bases", "nt_sequence").select(*columns)
    )
