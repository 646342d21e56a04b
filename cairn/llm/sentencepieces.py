"""Operator 10: SentencePiece encoding and decoding, exact for merge-type models.

The encoder never runs the library.  A text becomes symbols, and the answer is the
one sequence of pieces in which every two neighbours are *compatible*: merging their
joint characters from scratch gives the same two pieces again.  An Aho-Corasick pass
finds the longest piece that starts at every position; a walk from the left takes the
longest piece, falls back to the next shorter one where it isn't compatible with its
left neighbour, and steps back where none is left.  A bitfield holds the positions
from which no encoding exists, so no position is tried twice.

Texts are cut where no piece of the vocabulary has the two adjacent characters in
this order (no merge can cross such a place), and the encodings of the cuts are kept
in a bounded table per worker.  That changes the cost, never the result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries of each half of a worker's tables of encoded cuts and of compared pairs.
KEPT = 1 << 17
#: Rows that are encoded at a time: bounds a worker's memory beside the incoming batch.
SLICE = 256


class Recent(dict):
    """A dict of what was lately asked for: once it holds `most` entries it becomes the older
    half and begins anew; what is found in the older half is taken over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        known = self.older.get(key)
        if known is not None:
            self.keep(key, known)
        return known

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class MergeEncoder:
    """Encoder and decoder of one SentencePiece model of the merge (BPE) type."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte fallback and without normalisation are supported")
        kinds = {p.type for p in model.pieces}
        if kinds & {4, 5}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.out: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.out.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.out.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.out.append(b"")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(a[1] == SPACE and a[0] != SPACE for a in inner):
            raise ValueError("pieces that go on over a space are not supported")
        self.inner = inner
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        #: The piece that a piece falls back to: its longest proper prefix in the vocabulary.
        self.shorter: dict[str, str | None] = {}
        #: The two parts that a piece was last merged from.
        self.parts: dict[str, tuple[str, str]] = {}
        reachable = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        for p in reachable:
            self.automaton.add_word(p, p)
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in reachable), None)
        self.automaton.make_automaton()
        self.cuts: dict[str, bytes | None] = Recent(KEPT)
        self.pairs: dict[tuple[str, str], bool | None] = Recent(KEPT)

    def merged(self, text: str) -> list[str]:
        """Merge from scratch: the best-scored adjacent pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.score
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                s = score.get(both := parts[i] + parts[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue
            self.parts.setdefault(both, (parts[i], parts[j]))
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """(part, made at, gone at) of each part that ever stands at this side of the piece
        while it is merged; times are negated scores.  None if a part is made later than
        what it becomes, where times would not tell the order."""
        found, gone = [], float("inf")
        while len(piece) > 1:
            made = -self.score[piece]
            if made >= gone:
                return None
            found.append((piece, made, gone))
            gone, piece = made, self.parts[piece][side]
        return [*found, (piece, float("-inf"), gone)]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b from scratch gives a and b again: no part at a's right
        side and part at b's left side, present together, may merge before either goes."""
        key = (a, b)
        known = self.pairs[key]
        if known is None:
            known = self.remerged(a, b)
            self.pairs.keep(key, known)
        return known

    def remerged(self, a: str, b: str) -> bool:
        right, left, score = self.edge(a, 1), self.edge(b, 0), self.score
        if right is None or left is None:
            return self.merged(a + b) == [a, b]
        for x, made_x, gone_x in right:
            for y, made_y, gone_y in left:
                s = score.get(x + y)
                if s is not None and -s < gone_x and -s <= gone_y and made_x < gone_y and made_y < gone_x:
                    return False
        return True

    def backtracked(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, p in self.automaton.iter(text):
            start = end - len(p) + 1
            if longest[start] is None or len(p) > len(longest[start]):
                longest[start] = p
        open_ = bytearray(b"\1") * (n + 1)
        taken: list[str] = []
        pos, piece = 0, longest[0]
        while True:
            end = pos + len(piece)
            if open_[end] and (not taken or self.compatible(taken[-1], piece)):
                taken.append(piece)
                pos = end
                if pos == n:
                    return taken
                piece = longest[pos]
                continue
            piece = self.shorter[piece]
            while piece is None:
                open_[pos] = 0
                last = taken.pop()
                pos -= len(last)
                piece = self.shorter[last]

    def cut(self, text: str) -> bytes:
        """32-bit ids of a text without a place where it could be cut."""
        if len(text) == 1:
            i = self.id.get(text)
            ids = [self.byte[b] for b in text.encode()] if i is None else [i]
        elif text.startswith(SPACE * 2):  # runs of spaces have equal scores, so order decides: merge plainly
            ids = [self.id[p] for p in self.merged(text)]
        else:
            ids = [self.id[p] for p in self.backtracked(text)]
        return array("i", ids).tobytes()

    def word(self, text: str) -> bytes:
        inner, parts, start = self.inner, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inner:
                parts.append(text[start:i])
                start = i
        parts.append(text[start:])
        if len(parts) == 1:
            known = self.cut(text)
        else:
            got = []
            for p in parts:
                ids = self.cuts[p]
                if ids is None:
                    ids = self.cut(p)
                    if len(p) < 100:
                        self.cuts.keep(p, ids)
                got.append(ids)
            known = b"".join(got)
        if len(text) < 100:
            self.cuts.keep(text, known)
        return known

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE))
        cuts, word = self.cuts, self.word
        return np.frombuffer(b"".join([cuts[w] or word(w) for w in words]), np.int32)

    def decode(self, ids) -> str:
        """What the library's decode() returns for ids that encode() made.  Of the first
        piece one leading space goes, for it is the one that encoding put there."""
        if len(ids) == 0:
            return ""
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(model_file: str) -> MergeEncoder:
    """One encoder per worker and model."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = MergeEncoder(model_file)
    return _ENCODERS[model_file]


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns (id_col, ids array<int>, decoded string), a row per input row; other columns,
    whatever their names, are not carried.  A null text counts as empty: no ids and an
    empty decoded text.  Null and repeated ids keep their rows.  An empty table gives an
    empty result.  No shuffle: each task reads its rows, and memory is bounded by a
    slice of the Arrow batch, so one very long text is the largest thing held.

    model_file must exist on every executor (a path parameter, as for any native model).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = [enc.encode(t or "") for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                decoded = pa.array([enc.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=[id_col, "ids", "decoded"])

    both = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    return both.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of what encode_decode() returns."""
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
