"""Batched encoding of proteins by a user-supplied function.

The library brings no structural model. ``encoder_factory()`` returns a
function from a list of texts to a list of equally many strings; it is called
once per Python worker task, so that a model is loaded once and then reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codonlake.alphabets import DEFAULT_ENCODING_SIZE
from codonlake.functions import trim_to_length
from codonlake.operators.batching import token_budget_batches
from codonlake.operators.labels import encoding_method

Encoder = Callable[[list[str]], list[str]]
KEYS = ["parent_id", "orf_id"]


def constant_encoder() -> Encoder:
    """Stand-in for tests: as many ``a`` as the text is long. Not a structure."""
    return lambda texts: ["a" * len(text) for text in texts]


def _encode(encode: Encoder, texts: list[str]) -> list[str]:
    encoded = encode(texts)
    if len(encoded) != len(texts):
        raise ValueError(f"encoder returned {len(encoded)} results for a batch of {len(texts)} sequences")
    if any(x is None for x in encoded):
        raise ValueError("encoder left a sequence without an encoding")
    return encoded


def _within_task(encoder_factory: Callable[[], Encoder], budget: int):
    """A column function that encodes each Arrow chunk of texts in length-sorted batches; rows keep their order.

    Only the texts go to Python. It counts as not deterministic, so that no filter copies it.
    """

    @F.arrow_udf("string")
    def run(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder_factory()
        for chunk in chunks:
            texts = chunk.to_pylist()
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            encoded, at = [""] * len(texts), 0
            while at < len(order):
                longest = len(texts[order[at]])
                batch = order[at : at + max(1, budget // longest)] if longest else order[at:]
                for i, result in zip(batch, _encode(encode, [texts[i] for i in batch])):
                    encoded[i] = result
                at += len(batch)
            yield pa.array(encoded, pa.string())

    return run.asNondeterministic()


def _by_batch_id(encoder_factory: Callable[[], Encoder]):
    """Encode rows that arrive sorted by batch; a batch may span Arrow chunks."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting = encoder_factory(), []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            edges = np.flatnonzero(np.diff(rows["batch_id"].to_numpy(), prepend=-1, append=-1)).tolist()
            texts = rows["text"].to_pylist()
            encoded = [x for a, b in zip(edges, edges[1:]) for x in _encode(encode, texts[a:b])]
            yield from rows.select(KEYS).append_column("three_di", pa.array(encoded, pa.string())).to_batches()

        for chunk in chunks:
            if not chunk.num_rows:
                continue
            ids = chunk.column("batch_id").to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))
            if last or (waiting and waiting[0].column("batch_id")[0].as_py() != ids[0]):
                yield from flush([*waiting, chunk.slice(0, last)])
                waiting.clear()
            waiting.append(chunk.slice(last))
        if waiting:
            yield from flush(waiting)

    return run


def encode_proteins(
    proteins: DataFrame,
    encoder_factory: Callable[[], Encoder] = constant_encoder,
    encoding_size: int = DEFAULT_ENCODING_SIZE,
    text: Column | None = None,
    model_name: str = "",
    device: str = "cpu",
    batching: str = "task",
) -> DataFrame:
    """Add ``three_di``, ``method``, ``model_name`` and ``inference_device``.

    ``text`` is what the encoder receives, by default the residues. ``task``
    batches the rows a task holds and shuffles nothing. ``global`` uses the
    exact batches of the whole table: it wastes the least padding, but reads
    ``proteins`` several times and shuffles the texts, so give it a stored
    table; rows of keys that are null get no encoding. Output is cut to the length of the protein.
    """
    if encoding_size <= 0:
        raise ValueError("token budget must be > 0")
    if batching not in ("task", "global"):
        raise ValueError("batching must be 'task' or 'global'")
    prepared = proteins.withColumn("text", F.col("protein_aa") if text is None else text)
    if batching == "task":
        encoded = prepared.withColumn("three_di", _within_task(encoder_factory, encoding_size)("text")).drop("text")
    else:
        texts = prepared.select(*KEYS, "text")
        batches = token_budget_batches(texts.withColumn("n", F.length("text")), "n", encoding_size, KEYS, ["text"])
        three_di = (
            batches.select("batch_id", *KEYS, "text")
            .repartition("batch_id")
            .sortWithinPartitions("batch_id")
            .mapInArrow(_by_batch_id(encoder_factory), "parent_id string, orf_id string, three_di string")
        )
        encoded = proteins.join(three_di, KEYS, "left")
    return (
        encoded.withColumn("three_di", trim_to_length("three_di", "aa_length"))
        .withColumn("method", encoding_method(F.lit(model_name)))
        .withColumn("model_name", F.lit(model_name))
        .withColumn("inference_device", F.lit(device))
    )


def unencoded(proteins: DataFrame, encoded: DataFrame) -> DataFrame:
    """Proteins without an encoding; empty after a complete run."""
    return proteins.join(encoded.where(F.col("three_di").isNotNull()), KEYS, "left_anti")
