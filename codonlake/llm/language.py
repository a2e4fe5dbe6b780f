"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 3 to 0, with counts from all
training documents. A symbol's code length comes from the longest stored context;
symbols new there escape (method C: distinct symbols over total plus distinct),
leave out the symbols already offered and go on in the next shorter context; at the end all
bytes left are equally likely. Counts are frozen, so a context's code lengths
are a fixed row, and a text's code length is a sum of looked-up entries. The
language with the shortest code wins.

Spark adds up the four-byte counts of every training document and builds one table
for each language: all bytes and contexts seen, and no others. Every count stays.
Languages do not depend on each other, so tasks hold the tables of a group of languages
at a time, of about ``GROUP`` bytes; the grouping changes no result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codonlake.session import stored

UNKNOWN = "und"
GROUP = 1 << 27
_HELD = 1 << 22
_AT_ONCE = 1 << 21
_ROWS = 5_000
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text is 2 modulo 4. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _codes(data: np.ndarray) -> np.ndarray:
    """Four-byte codes ending at each byte."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


def _bytes(text: str) -> bytes:
    return b"\0\0\0" + text.lower().encode()


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, gram, n)``: how often each four bytes occur in the lower-cased texts of each language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pd.DataFrame]:
            for k, (g, n) in sums.items():
                for a in range(0, len(g), _ROWS):
                    yield pd.DataFrame({"lang": k, "gram": g[a : a + _ROWS].astype(np.int64), "n": n[a : a + _ROWS]})
            sums.clear()

        for batch in batches:
            for name, rows in batch.groupby("lang")["text"]:
                part, size = [], 0
                for t in [*rows, None]:
                    if t is not None:
                        part.append(_bytes(t))
                        size += len(part[-1])
                    if size >= _AT_ONCE or t is None and part:
                        codes = _codes(np.frombuffer(b"".join(part), np.uint8))
                        new = np.unique(codes, return_counts=True)
                        sums[name] = _added(sums[name], new) if name in sums else new
                        part, size = [], 0
            if sum(len(g) for g, _ in sums.values()) > _HELD:
                yield from told()
        yield from told()

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInPandas(count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Table:
    """One language: symbols and contexts seen in each order, and what they cost in bits.

    A context offers a part of what its shorter context does. So what a symbol costs
    there depends only on whether the search began in this context or came from the
    next longer one: ``first`` and ``after`` hold the bits of the total and of the
    escape for both, ``after`` beside the longer context.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.symbols, self.contexts, self.bits, self.first, self.after = [], [], [], [], []
        shorter = None
        for order in range(4):
            keys, of = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(of, n, len(keys)).astype(np.int64)
            contexts, owner, distinct = np.unique(keys >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(owner, counts, len(contexts)).astype(np.int64)
            self.first.append(self._costs(total, distinct))
            if shorter:
                s_keys, s_counts, s_contexts, s_total, s_distinct = shorter
                again = s_counts[np.searchsorted(s_keys, keys & ((1 << 8 * order) - 1))]
                at = np.searchsorted(s_contexts, contexts & ((1 << 8 * (order - 1)) - 1))
                offered = np.bincount(owner, again, len(contexts)).astype(np.int64)
                self.after.append(self._costs(s_total[at] - offered, s_distinct[at] - distinct))
            else:
                self.after.append(None)
            self.symbols.append(keys.astype(np.uint32))
            self.contexts.append(contexts.astype(np.uint32))
            self.bits.append(np.log2(counts).astype(np.float32))
            shorter = keys, counts, contexts, total, distinct
        self.rest = float(np.log2(max(1, 256 - len(self.symbols[0]))))

    @staticmethod
    def _costs(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Bits of total plus distinct, and of an escape; no cost if nothing is left to offer."""
        some = distinct > 0
        whole = np.log2(np.where(some, total + distinct, 1))
        return np.stack([whole, whole - np.log2(np.where(some, distinct, 1))]).astype(np.float32)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last of each four bytes after the three before it."""
        bits = np.zeros(len(grams))
        open_, begun, longer = np.ones(len(grams), bool), np.zeros(len(grams), bool), None
        for order in (3, 2, 1, 0):
            at, seen = _found(self.contexts[order], grams >> 8 & np.uint32((1 << 8 * order) - 1))
            place, known = _found(self.symbols[order], grams & np.uint32((1 << 8 * (order + 1)) - 1))
            whole, escape = self.first[order][:, at]
            if longer is not None:
                whole, escape = np.where(begun, self.after[order + 1][:, longer], (whole, escape))
            known &= seen
            bits += np.where(open_ & seen, np.where(known, whole - self.bits[order][place], escape), 0.0)
            open_ &= ~known
            begun |= seen
            longer = at
        return bits + np.where(open_, self.rest, 0.0)


class Model:
    """Tables of some languages."""

    def __init__(self, counts: pd.DataFrame | None = None, tables: dict[str, _Table] | None = None):
        if tables is None:
            tables = {
                name: _Table(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
                for name, rows in counts.groupby("lang")
            }
        self.languages = sorted(tables)
        self.tables = [tables[k] for k in self.languages]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        data = [_bytes(t) for t in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(data):
            upto, size = at, 0
            while upto < len(data) and (size == 0 or size + len(data[upto]) <= _AT_ONCE):
                size += len(data[upto])
                upto += 1
            sums[at:upto] = self._sums(data[at:upto])
            at = upto
        return sums

    def _sums(self, data: list[bytes]) -> np.ndarray:
        whole = np.frombuffer(b"".join(data), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
        out = np.zeros((len(data), len(self.languages)))
        for a in range(3, len(whole), _AT_ONCE):  # very long texts go through in parts
            b = min(len(whole), a + _AT_ONCE)
            grams, of = np.unique(_codes(whole[a - 3 : b]), return_inverse=True)
            owner = np.searchsorted(starts, np.arange(a, b), "right") - 1
            padding = np.arange(a, b) - starts[owner] < 3
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            for k, table in enumerate(self.tables):
                cost = table.costs(grams)[of]
                cost[padding] = 0
                out[owner[cuts], k] += np.add.reduceat(cost, cuts)
        return out


def trained(df: DataFrame, text: str = "text", lang: str = "lang", group: int = GROUP) -> list[Broadcast]:
    """Models of all languages that rows with a text have, in groups of about ``group`` bytes; in order of their names."""

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        data = pickle.dumps(_Table(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "size": [len(data)], "data": [data]})

    tables = stored(
        gram_counts(df, text, lang).groupBy("lang").applyInPandas(table, "lang string, size long, data binary"), "languages"
    )
    groups, room = [], 0
    for name, size in sorted(tuple(r) for r in tables.select("lang", "size").collect()):
        if not groups or size > room:
            groups.append([])
            room = group
        groups[-1].append(name)
        room -= size
    models = []
    for names in groups:
        rows = tables.filter(F.col("lang").isin(names)).select("lang", "data").toLocalIterator()
        model = Model(tables={r["lang"]: pickle.loads(r["data"]) for r in rows})
        models.append(df.sparkSession.sparkContext.broadcast(model))
        vars(models[-1]).pop("_value", None)  # the driver holds one group at a time
    return models


def identified(df: DataFrame, models: list[Broadcast], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; ``und`` and 0 for null texts and texts without letters, or without a model.

    The score is the share of the language when all are equally likely
    beforehand; of equal languages the first by name wins.
    """
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
            can = [i for i, t in enumerate(texts) if models and t is not None and _LETTER.search(t)]
            if can:
                languages, columns = [], []
                for shared in models:
                    languages += shared.value.languages
                    columns.append(shared.value.lengths([texts.iloc[i] for i in can]))
                    if len(models) > 1:
                        vars(shared).pop("_value", None)  # read again for the next batch
                bits = np.concatenate(columns, axis=1)
                chance = np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits))
                best = bits.argmin(axis=1)
                out.loc[can, "lang_pred"] = [languages[b] for b in best]
                out.loc[can, "score"] = chance[np.arange(len(can)), best] / chance.sum(axis=1)
            yield out

    return df.withColumn("__guess", guess(F.col(text))).select(
        *[F.col(f"`{c}`") for c in df.columns], "__guess.lang_pred", "__guess.score"
    )


def language_table(df: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learnt from rows that are not held out."""
    rows = df.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    models = trained(rows.filter(~F.col("held_out")))
    return identified(rows.select("doc_id", "text", "held_out"), models).select("doc_id", "held_out", "lang_pred", "score")
