"""Operator 9, SentencePiece encoding and decoding: Viterbi along an Aho-Corasick automaton.

The pieces of a vocabulary form one automaton over bytes.  A text is read once;
at each position the automaton's state and its output links name every piece
that ends there, longest first, and each relaxes the best score at that
position.  A single byte is always possible through its byte piece, at
BYTE_PENALTY below the worst score.  On equal scores the longer last piece
wins.

A text's best segmentation splits wherever no piece holds the two bytes side
by side (before every space, for one).  The stretches between are units; tasks
run the Viterbi over all new units of a block side by side and remember their
ids.

A space is the piece mark U+2581, one more stands before the text; a U+2581 of
the text itself goes through byte pieces.  So decoding gives back every text
byte for byte.

The vocabulary is read on the driver and broadcast (its size bounds it); each
worker builds the automaton once (1 KiB a state).  One narrow pass over the
texts.  Null texts give null ids, empty texts none.  Repeated rows give equal
results.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrays import Block, blocks, ragged
from siftline.llm.frames import keyed_texts, per_batch, table
from siftline.llm.units import Memo, per_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for the mark inside; no UTF-8 text holds this byte.
SPACE = 0xFF
BYTE_PENALTY = 10.0
#: Units that go through the Viterbi side by side.
UNITS_AT_ONCE = 1 << 13
#: Units of more bytes are walked one by one.
LONG_UNIT = 1 << 10

ENCODED = "doc_id long, n_bytes long, n_tokens long, ids array<int>"


class Vocabulary:
    """Pieces as bytes (marks as SPACE), their ids and scores, and the ids of the byte pieces."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [-1] * 256
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((text.replace(MARK, "\0").encode().replace(b"\0", bytes([SPACE])), i, model.get_score(i)))
        if min(byte_ids) < 0:
            raise ValueError("the vocabulary has no piece for every byte, so not every text can be encoded")
        if bytes([SPACE]) not in {p for p, _, _ in pieces}:
            raise ValueError("the vocabulary has no piece for a space")
        return cls(pieces, byte_ids)


class Automaton:
    """Transitions, output links and scores of all states, over bytes."""

    def __init__(self, vocabulary: Vocabulary):
        levels: dict[bytes, int] = {b"": 0}
        for piece, _, _ in sorted(vocabulary.pieces, key=lambda p: len(p[0])):
            for k in range(1, len(piece) + 1):
                levels.setdefault(piece[:k], len(levels))
        states = sorted(levels, key=len)
        number = {s: i for i, s in enumerate(states)}
        n = len(states)
        self.next = np.zeros((n, 256), np.int32)
        self.link = np.zeros(n, np.int32)
        self.piece = np.full(n, -1, np.int32)
        self.length = np.array([len(s) for s in states], np.int64)
        self.score = np.zeros(n)
        for piece, i, score in vocabulary.pieces:
            self.piece[number[piece]], self.score[number[piece]] = i, score
        parent = np.array([0] + [number[s[:-1]] for s in states[1:]])
        byte = np.array([0] + [s[-1] for s in states[1:]])
        fail = np.zeros(n, np.int32)
        for depth in range(1, int(self.length.max(initial=0)) + 1):
            at = np.flatnonzero(self.length == depth)
            if depth > 1:
                fail[at] = self.next[fail[parent[at]], byte[at]]
            self.next[parent[at], byte[at]] = at
            # the rows they fall back to are shallower, and now final
            self.next[at] = self.next[fail[at]]
            self.link[at] = np.where(self.piece[fail[at]] >= 0, fail[at], self.link[fail[at]])
        self.beside = np.zeros((256, 256), bool)
        for piece, _, _ in vocabulary.pieces:
            row = np.frombuffer(piece, np.uint8)
            self.beside[row[:-1], row[1:]] = True
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        self.byte_score = min((s for _, _, s in vocabulary.pieces), default=0.0) - BYTE_PENALTY
        size = 1 + max([i for _, i, _ in vocabulary.pieces] + vocabulary.byte_ids)
        table_ = [b""] * size
        for piece, i, _ in vocabulary.pieces:
            table_[i] = piece.replace(bytes([SPACE]), b" ")
        for b, i in enumerate(vocabulary.byte_ids):
            table_[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(table_), np.uint8)
        self.spelt_size = np.array([len(x) for x in table_], np.int64)
        self.spelt_start = np.cumsum(self.spelt_size) - self.spelt_size

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and the number of ids of each."""
        sizes = np.array([len(u) for u in units], np.int64)
        by_size = np.argsort(sizes, kind="stable")
        out: list[np.ndarray | None] = [None] * len(units)
        for k in np.flatnonzero(sizes > LONG_UNIT).tolist():
            out[k] = self._walk(units[k])
        by_size, lo = by_size[sizes[by_size] <= LONG_UNIT], 0
        while lo < len(by_size):
            hi = min(lo + UNITS_AT_ONCE, len(by_size))
            # long units go in smaller company, so that the tables stay small
            while hi - lo > 1 and (hi - lo) * int(sizes[by_size[hi - 1]]) > 1 << 21:
                hi = lo + max(1, (hi - lo) // 2)
            part = by_size[lo:hi]
            for k, ids in zip(part.tolist(), self._viterbi([units[i] for i in part], sizes[part]), strict=True):
                out[k] = ids
            lo = hi
        counts = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def _viterbi(self, units: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        n, width = len(units), int(sizes[-1])
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(units), np.uint8)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        token = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        for t in range(width):
            byte = text[:, t]
            live = np.flatnonzero(sizes > t)
            state = self.next[state, byte]
            score, step, chosen = best[t] + self.byte_score, np.ones(n, np.int32), self.byte_ids[byte]
            better = np.full(n, -np.inf)
            at = live
            ends = np.where(self.piece[state[at]] >= 0, state[at], self.link[state[at]])
            while True:
                keep = ends > 0
                at, ends = at[keep], ends[keep]
                if not len(at):
                    break
                length = self.length[ends]
                found = best[t + 1 - length, at] + self.score[ends]
                gain = found > better[at]
                who = at[gain]
                better[who], step[who], chosen[who] = found[gain], length[gain], self.piece[ends[gain]]
                ends = self.link[ends]
            by_byte = score > better
            step[by_byte], chosen[by_byte] = 1, self.byte_ids[byte[by_byte]]
            best[t + 1] = np.maximum(score, better)
            back[t + 1], token[t + 1] = step, chosen
        at, who, reverse, owners = sizes.copy(), np.arange(n), [], []
        while len(who):
            who = who[at[who] > 0]
            reverse.append(token[at[who], who])
            owners.append(who)
            at[who] -= back[at[who], who]
        owner, reversed_ids = np.concatenate(owners), np.concatenate(reverse)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        return [x[::-1] for x in np.split(reversed_ids[order], np.cumsum(counts)[:-1])]

    def _walk(self, unit: bytes) -> np.ndarray:
        """The same for one long unit, byte by byte: its cost is in proportion to its length, whatever its company."""
        to, width = memoryview(np.ascontiguousarray(self.next).reshape(-1)), self.next.shape[1]
        if not hasattr(self, "lists"):
            self.lists = [np.asarray(x).tolist() for x in (self.piece, self.link, self.length, self.score)]
        piece, link, length, score = self.lists
        byte_ids, byte_score, none = self.byte_ids.tolist(), float(self.byte_score), float("-inf")
        best, back, token, state = [0.0], [0], [0], 0
        for t, byte in enumerate(unit):
            state = to[state * width + byte]
            found, step, chosen = none, 1, -1
            end = state if piece[state] >= 0 else link[state]
            while end > 0:
                value = best[t + 1 - length[end]] + score[end]
                if value > found:
                    found, step, chosen = value, length[end], piece[end]
                end = link[end]
            single = best[t] + byte_score
            if single > found:
                found, step, chosen = single, 1, byte_ids[byte]
            best.append(found)
            back.append(step)
            token.append(chosen)
        out, at = [], len(unit)
        while at:
            out.append(token[at])
            at -= back[at]
        return np.array(out[::-1], np.int32)

    def units(self, block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        """The block with marks for spaces and before each text, and the units' starts, ends and texts."""
        texts = len(block)
        filled = np.diff(block.offsets) > 0
        offsets = block.offsets + np.concatenate(([0], np.cumsum(filled)))
        data = np.full(int(offsets[-1]), SPACE, np.uint8)
        size = np.diff(block.offsets)
        place = ragged(offsets[:-1] + filled, size)
        data[place] = np.where(block.data == 0x20, SPACE, block.data)
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.beside[data[:-1], data[1:]]
        begins[offsets[:-1][filled]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        return Block(data, offsets, block.rows), start, end, np.searchsorted(offsets, start, "right") - 1 if texts else start

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids stand one after the other, and the texts' bounds."""
        size = self.spelt_size[ids]
        data = self.spelt[ragged(self.spelt_start[ids], size)]
        bounds = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        keep = np.ones(len(data), bool)
        keep[bounds[:-1][counts > 0]] = False  # the mark before the text
        return data[keep], bounds - np.concatenate(([0], np.cumsum(counts > 0)))


_BUILT: dict[str, tuple[Automaton, Memo]] = {}


def _automaton(name: str, shared) -> tuple[Automaton, Memo]:
    """The worker's automaton for a broadcast vocabulary, built at its first use."""
    if name not in _BUILT:
        _BUILT.clear()
        automaton = Automaton(shared.value)
        _BUILT[name] = automaton, Memo(automaton.encode)
    return _BUILT[name]


def _list_column(ids: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
    return lists if valid.all() else pa.compute.if_else(pa.array(valid), lists, pa.scalar(None, lists.type))


def encode_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, check: bool = True) -> DataFrame:
    """One row per row of ``docs``: ids of its pieces; with ``check`` also whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        automaton, memo = _automaton(name, shared)
        for block in blocks(batch.column("text")):
            marked, start, end, owner = automaton.units(block)
            ids, count = memo.ids_of(marked, start, end)
            tokens = per_text(count, owner, len(block))
            valid = batch.column("text")[block.rows].is_valid().to_numpy(zero_copy_only=False)
            row = {
                "doc_id": batch.column("doc_id")[block.rows], "n_bytes": pa.array(np.diff(block.offsets)), "n_tokens": pa.array(tokens),
                "ids": _list_column(ids, tokens, valid),
            }
            if check:
                data, bounds = automaton.decode(ids, tokens)
                same = np.array_equal(bounds, block.offsets) and np.array_equal(data, block.data)
                equal = [same or data[a:b].tobytes() == block.text(i) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                row["round_trip"] = pa.array(equal, pa.bool_())
            yield pa.RecordBatch.from_pydict(row)

    return keyed_texts(docs, text, key).mapInArrow(per_batch(run), ENCODED + ", round_trip boolean" * check)


def decode_pieces(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from ids; null ids give null texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        automaton, _ = _automaton(name, shared)
        lists = batch.column("ids")
        counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
        data, bounds = automaton.decode(lists.flatten().to_numpy(), counts)
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(
        per_batch(run), "doc_id long, text string"
    )


def op9_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    """Piece ids of every text of ``documents``, and whether they decode to it."""
    return encode_pieces(table(spark, sf_dir, "documents"))
