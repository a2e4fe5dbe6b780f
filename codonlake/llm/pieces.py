"""SentencePiece encoding and decoding by a forward pass that shares prefixes.

Texts are cut into marked words: a run of spaces (the mark) with what follows up
to the next space, line ends alone. No piece of the vocabularies at hand reaches
across such a cut, which is checked on loading. The distinct words of a
batch are sorted, which lists the nodes of their trie depth-first, and each node
has a forward entry, found once and reused by all words below it:

* unigram models: the best score of a path to the node and its last piece;
* BPE models: the one piece that ends the BPE encoding of the prefix. Scores
  of a BPE model are merge ranks, and the path of best total score would not be
  the model's own encoding. A piece may follow another only if BPE would not have
  merged across them, so the forward entry is that of the only piece that may.

Going back along the entries gives the pieces. Characters without a piece become
byte pieces. Vocabulary files are read by the driver; their path is a parameter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CACHE = 300_000
_AT_ONCE = 1 << 20
_CUT = re.compile(r" *[^ \n]+| +|\n")
_NEVER = 1 << 40


class Vocabulary:
    """Pieces of a model with what the forward pass needs. Holds plain data, so tasks get it as it is."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool):
        self.pieces, self.bpe = pieces, bpe
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == "byte"}
        self.unknown = kinds.index("unknown")
        plain = [i for i, k in enumerate(kinds) if k == "normal"]
        if any("\n" in pieces[i] or MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces reach across words")
        self.ids = {pieces[i]: i for i in plain}
        self.scores = dict(zip(range(len(pieces)), scores))
        self.least = min((scores[i] for i in plain), default=0.0) - 10
        self.ranks: dict[int, int] = {}
        self.splits: dict[int, tuple[int, int]] = {}
        if bpe:
            order = sorted({scores[i] for i in plain}, reverse=True)
            place = {s: r for r, s in enumerate(order)}
            self.ranks = {i: place[scores[i]] for i in plain}
            whole = {}
            for piece, i in self.ids.items():
                if len(piece) > 1:
                    parts, last = self._merged(piece)
                    if len(parts) == 1 and last is not None:
                        self.splits[i] = last
                    else:
                        continue
                whole[piece] = i
            self.reached = whole
        else:
            self.reached = self.ids
        ends: dict[str, set[int]] = {}
        for piece in self.reached:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
        spec = model.trainer_spec
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave text as it is are supported")
        return cls(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            [kinds[p.type] for p in model.pieces],
            spec.model_type == 2,
        )

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """BPE of a text by merging, lowest rank first and of equal ones the leftmost, and the last merge.

        Merges wait in a queue, so the time is near n log n. Characters without a piece are negative.
        """
        parts, last, n = [self.ids.get(c, -1 - ord(c)) for c in text], None, len(text)
        words, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))

        def ask(k: int) -> None:
            made = self.ids.get(words[k] + words[after[k]])
            if made is not None:
                heapq.heappush(queue, (self.ranks[made], k, made))

        queue: list[tuple[int, int, int]] = []
        for k in range(n - 1):
            ask(k)
        while queue:
            _, k, made = heapq.heappop(queue)
            right = after[k]
            if not words[k] or right >= n or self.ids.get(words[k] + words[right]) != made:
                continue  # one of the two has been merged since
            last = (parts[k], parts[right])
            words[k], words[right], parts[k] = words[k] + words[right], "", made
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                ask(k)
            if before[k] >= 0:
                ask(before[k])
        return [p for p, w in zip(parts, words) if w], last


class Encoder:
    """Encodes words of one task, keeping a bounded table of those seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seen, self.allowed = vocabulary, {}, {}

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left right`` as it is: no merge across them comes before those that made them."""
        known = self.allowed.get((left, right))
        if known is None:
            if len(self.allowed) > _CACHE:
                self.allowed.clear()
            known = self.allowed[left, right] = left < 0 or right < 0 or self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        ids, pieces, ranks, splits, before = self.v.ids, self.v.pieces, self.v.ranks, self.v.splits, _NEVER
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and ranks[across] < before:
                return False
            a, b = (ranks[left] if left in splits else -1), (ranks[right] if right in splits else -1)
            if a < 0 and b < 0:
                return True
            if a >= b:  # the left one was made last: look at the time before
                before, left = min(before, a), splits[left][1]
            else:  # of equal merges the leftmost goes first, and the one across is further left
                before, right = min(before, b + 1), splits[right][0]

    def words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids, packed as 32-bit integers, of marked words. Words go through the trie in sorted order."""
        out, above, entries = {}, "", []
        step = self._ranked if self.v.bpe else self._scored
        for word in sorted(words):
            shared, most = 0, min(len(word), len(above))
            while shared < most and word[shared] == above[shared]:
                shared += 1
            del entries[shared:]
            for end in range(shared + 1, len(word) + 1):
                entries.append(step(word, end, entries))
            above = word
            out[word] = self._back(word, entries)
        return out

    def _ranked(self, word: str, end: int, entries: list) -> tuple[int, int]:
        """(last piece, its length) of the BPE encoding of a prefix."""
        reached, allowed = self.v.reached, self.allowed
        for length in self.v.lengths.get(word[max(0, end - 2) : end], ()):
            if length > end:
                continue
            piece = reached.get(word[end - length : end])
            if piece is not None:
                if length == end:
                    return piece, length
                left = entries[end - length - 1][0]
                known = allowed.get((left, piece))
                if known or known is None and self.follows(left, piece):
                    return piece, length
        return reached.get(word[end - 1], -1 - ord(word[end - 1])), 1

    def _scored(self, word: str, end: int, entries: list) -> tuple[int, int, float]:
        """(last piece, its length, score) of the best path to a prefix."""
        best = None
        for length in (*self.v.lengths.get(word[max(0, end - 2) : end], ()), 1):
            if length > end:
                continue
            piece = self.v.reached.get(word[end - length : end])
            if piece is None and length > 1:
                continue
            score = self.v.least if piece is None else self.v.scores[piece]
            total = score + (entries[end - length - 1][2] if end > length else 0.0)
            if best is None or total > best[2]:
                best = (-1 - ord(word[end - 1]) if piece is None else piece, length, total)
        return best

    def _back(self, word: str, entries: list) -> bytes:
        ids, at = [], len(word)
        while at:
            piece, length = entries[at - 1][:2]
            if piece >= 0:
                ids.append(piece)
            elif self.v.bytes:
                ids += [self.v.bytes[b] for b in reversed(chr(-1 - piece).encode())]
            elif not ids or ids[-1] != self.v.unknown:
                ids.append(self.v.unknown)
            at -= length
        return np.array(ids[::-1], np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """Of a word with two or more marks, where equal merges may be many: by merging, not on the trie."""
        ids = []
        for piece in self.v._merged(word)[0]:
            ids += [piece] if piece >= 0 else [self.v.bytes.get(b, self.v.unknown) for b in chr(-1 - piece).encode()]
        return np.array(ids, np.int32).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts; an empty text has none."""
        cut = [_CUT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self.seen}
        if len(self.seen) + len(new) > _CACHE:
            self.seen, new = {}, {w for words in cut for w in words}
        marked = {w.replace(" ", MARK): w for w in new}
        many = [m for m in marked if self.v.bpe and m.startswith(MARK * 2)]
        found = self.words(marked.keys() - many) | {m: self._word(m) for m in many}
        for word, ids in found.items():
            self.seen[marked[word]] = ids
        return [b"".join(map(self.seen.__getitem__, words)) for words in cut]


def decoded(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """Text of ids: marks become spaces, byte pieces join to characters, the space put in front goes."""
    data = b"".join(map(_as_bytes(vocabulary).__getitem__, ids))
    text = data.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _as_bytes(v: Vocabulary) -> list[bytes]:
    if not hasattr(v, "_table"):
        byte = {i: bytes([b]) for b, i in v.bytes.items()}
        v._table = [byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(v.pieces)]
        for i, p in enumerate(v.pieces):
            if i not in byte and i not in v.scores or p in ("<s>", "</s>"):
                v._table[i] = b""
        v._table[v.unknown] = " ⁇ ".encode()
    return v._table


def _of_size(batch: pa.RecordBatch, column: str) -> Iterator[list[str]]:
    """Texts of a batch in parts of about a million characters; nulls become empty."""
    part, size = [], 0
    for value in batch.column(column):
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= _AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", model: str | Vocabulary = MODEL) -> DataFrame:
    """Add ``ids``, an array of integers, to every row. Null and empty texts have no ids. Row by row, no shuffle."""
    vocabulary = Vocabulary.load(model) if isinstance(model, str) else model
    if ids in df.columns:
        raise ValueError(f"there is a column {ids} already")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            packed = [p for part in _of_size(batch, text) for p in encoder.texts(part)]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | Vocabulary = MODEL) -> DataFrame:
    """Add ``text``, what an array of ids decodes to; null for null."""
    vocabulary = Vocabulary.load(model) if isinstance(model, str) else model
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.column(ids):
                texts.append(None if not row.is_valid else decoded(shared.value, row.values.to_numpy(zero_copy_only=False).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    return df.mapInArrow(run, schema)


def token_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and whether decoding them gives the text back, for every row."""
    vocabulary = Vocabulary.load(model)
    rows = encoded(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model=vocabulary)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return with_text(rows, model=vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )
