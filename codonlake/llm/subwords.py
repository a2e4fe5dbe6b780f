"""BPE encoding and decoding by speculation: greedy longest matches that are verified, and merged exactly where they fail.

A text is cut into words (special tokens first, then normal form, lower case and
the word pattern). For each distinct word of a batch

1. greedy longest match proposes tokens;
2. one vectorised check tests every adjacent pair of all proposals: a pair stands
   if undoing the later of its two merges, again and again, never meets a merge
   across the border that would have come first. A proposal all of whose pairs
   stand, made of tokens that are their own encoding, is the encoding;
3. words with a failing pair go through exact merging with a queue of merges,
   near n log n for a word of n bytes.

Tokens end words with ``</w>``; the alphabet is that of byte-level models. The
file is read by the driver, its path is a parameter, and what it holds is
broadcast: its size is that of the vocabulary, not of the data.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

END = "</w>"
_CACHE = 500_000
_CHARS_AT_ONCE = 1 << 20
_IDS_AT_ONCE = 1 << 21
_NEVER = 1 << 40
_SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_WORD = re.compile(_SHORT + r"|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
_WORD = regex.compile(_SHORT + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and what the check needs. Plain data, so tasks get it as it is."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = special
        self.size = max([*tokens.values(), *special.values()]) + 1
        self.strings: list[str | None] = [None] * self.size
        for token, i in (tokens | special).items():
            self.strings[i] = token
        self.inner_byte = [tokens[c] for c in letters]
        self.final_byte = [tokens[c + END] for c in letters]
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made, pair = tokens[a + b], (tokens[a], tokens[b])
            self.merges.setdefault(pair, (rank, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, *pair
        pairs = sorted((a * self.size + b, r) for (a, b), (r, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [_NEVER], np.int64)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in tokens.items():
            last = token.endswith(END) and token != END
            spelled = token[: -len(END)] if last else token
            if all(c in byte_of for c in spelled):
                data = bytes(byte_of[c] for c in spelled)
                if self.merged(data, last) == [i]:  # its own encoding; others are never an answer
                    (self.final if last else self.inner)[data] = i
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        sizes: dict[bytes, set[int]] = {}
        for data in self.inner:
            if len(data) > 1:
                sizes.setdefault(data[:3] if len(data) > 2 else data, set()).add(len(data))
        for start in sizes:
            found = sizes[start] | (sizes.get(start[:2], set()) if len(start) > 2 else set())
            self.lengths[start] = tuple(sorted(found, reverse=True))
        self.longest_final = max(map(len, self.final))

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """From a ``tokenizers`` file; by default the public one with word ends."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only byte-level BPE models with word ends, NFC and lower case are supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def merged(self, word: bytes, last: bool = True) -> list[int]:
        """Exact BPE of the bytes of a word: lowest rank first, of equal ones the leftmost."""
        ids = [self.inner_byte[b] for b in word]
        if last and word:
            ids[-1] = self.final_byte[word[-1]]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, k) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, made, k = heapq.heappop(queue)
            right = after[k]
            if ids[k] < 0 or right >= n or (found := get((ids[k], ids[right]))) is None or found[1] != made:
                continue
            ids[k], ids[right] = made, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if m := get((made, ids[after[k]])):
                    heapq.heappush(queue, (*m, k))
            if before[k] >= 0 and (m := get((ids[before[k]], made))):
                heapq.heappush(queue, (*m, before[k]))
        return [i for i in ids if i >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        inner, final, lengths, most = self.inner, self.final, self.lengths, self.longest_final
        while True:
            if n - at <= most:
                token = final.get(word[at:] if at else word)
                if token is not None:
                    out.append(token)
                    return out
            for length in lengths.get(word[at : at + 3]) or lengths.get(word[at : at + 2], ()):
                if length < n - at:
                    token = inner.get(word[at : at + length])
                    if token is not None:
                        break
            else:
                token, length = self.inner_byte[word[at]], 1
            out.append(token)
            at += length

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of adjacent tokens as it is."""
        good = np.zeros(len(left), bool)
        at, before = np.arange(len(left)), np.full(len(left), _NEVER)
        while len(at):
            key = left * self.size + right
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[spot] == key, self.pair_ranks[spot], _NEVER)
            a, b = self.rank[left], self.rank[right]
            split = (a >= 0) | (b >= 0)
            whole = across >= before
            good[at[whole & ~split]] = True
            on = whole & split
            at, left, right, before, a, b = at[on], left[on], right[on], before[on], a[on], b[on]
            undo = a >= b  # the left token was made last, or first of equal merges: look at the time before
            before = np.minimum(before, np.where(undo, a, b + 1))
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words that are not empty."""
        out = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for tokens in out for t in tokens), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        wrong = ~self.stand(pairs // self.size, pairs % self.size)[back]
        for w in np.unique(owner[inside[wrong]]).tolist():
            out[w] = self.merged(words[w])
        return out


_known_letters: set[str] = set()


def _has_recent(text: str) -> bool:
    """Whether a code point has no category in the Unicode tables of this Python; newer tables may give it one."""
    new = set(text) - _known_letters
    recent = {c for c in new if unicodedata.category(c) == "Cn"}
    _known_letters.update(new - recent)
    return bool(recent)


@functools.cache
def _library_cut() -> Callable[[str], list[str]]:
    """Normal form and word pattern by the tokenizers library, whose Unicode tables count in the end."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    form = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    split = pre_tokenizers.Split(Regex(_SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
    return lambda text: [word for word, _ in split.pre_tokenize_str(form.normalize_str(text))]


def cut(text: str, special: dict[str, int]) -> list[str]:
    """Words of a text in the normal form, and special tokens as they are."""
    if "<" in text and any(s in text for s in special):
        parts = re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else cut(part, {}))]
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if _has_recent(text):
        return _library_cut()(text)
    # Sigma is lower-cased without regard to where it stands.
    return _WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class Encoder:
    """Encodes texts of one task, keeping a bounded table of words seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seen = vocabulary, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as 32-bit integers."""
        words = [cut(t, self.v.special) for t in texts]
        new = {w for ws in words for w in ws}.difference(self.seen)
        if len(self.seen) + len(new) > _CACHE:
            self.seen, new = {}, {w for ws in words for w in ws}
        plain = [w for w in new if w not in self.v.special]
        for word, ids in zip(plain, self.v.encode_words([w.encode() for w in plain])):
            self.seen[word] = np.array(ids, np.int32).tobytes()
        for word in new & self.v.special.keys():
            self.seen[word] = np.array([self.v.special[word]], np.int32).tobytes()
        return [b"".join(map(self.seen.__getitem__, ws)) for ws in words]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row is a part of its own."""
    start = total = 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", model: str | Vocabulary | None = None) -> DataFrame:
    """Add ``ids``, an array of integers, to every row; other columns stay as they are.

    Null and empty texts have no ids. Texts of any length are encoded whole. An
    empty table stays empty. Row by row, no shuffle.
    """
    if ids in df.columns:
        raise ValueError(f"there is a column {ids} already")
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes, _CHARS_AT_ONCE):
                rows = batch.slice(lo, hi - lo)
                packed = encoder.texts([t or "" for t in rows.column(text).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                column = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, ids])

    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | Vocabulary | None = None) -> DataFrame:
    """Add ``text``: the tokens of an array of ids, joined by one space, as the library joins them without a decoder.

    Special tokens are kept, ids the vocabulary does not have (nulls too) are
    left out, and null stays null.
    """
    if text in df.columns:
        raise ValueError(f"there is a column {text} already")
    vocabulary = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.string())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _parts(sizes, _IDS_AT_ONCE):
                rows = batch.slice(lo, hi - lo)
                lists, counts = rows.column(ids), sizes[lo:hi]
                flat = pc.cast(lists.flatten(), pa.int64())
                known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
                found = pc.take(tokens, pc.if_else(known, flat, None))
                there = pc.is_valid(found).to_numpy(zero_copy_only=False)
                before = np.concatenate([[0], np.cumsum(there)])
                offsets = before[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), found.drop_null()), " ")
                column = pc.if_else(pc.is_valid(lists), joined, None)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, text])

    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of ids and of the decoded text, for every row; repeated rows stay."""
    vocabulary = Vocabulary.load(model)
    rows = encoded(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model=vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return with_text(rows.drop("text"), model=vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
