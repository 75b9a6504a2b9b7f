"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 7).

A text's spaces become marks, and the marked text falls into units (a run of
marks and the word after it) that no piece crosses. The distinct units of a
slice are sorted, which lays their trie out depth-first: each unit keeps the
forward states of the prefix that it shares with the unit before and only
extends them. For a BPE model the nodes of one depth are extended at once, with
an automaton that tells the pieces that end there.

A forward state says what a prefix's best segmentation ends in. For a unigram
model that is the piece with the best sum of scores, the classic recursion. For
a BPE model the sum of scores doesn't give the library's result; there the state
is the last piece of the prefix's BPE encoding. It depends on the prefix alone,
too: a piece may end a prefix exactly if the encoding before it is unchanged by
it, that is if the pair of its neighbour and itself encodes as that pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, per_text

MARK = "▁"
#: Distinct units that a worker remembers beyond its slice, pairs of pieces that it remembers, bytes of text in a slice.
REMEMBERED, PAIRS, SLICE = 100_000, 200_000, 1_000_000
#: Characters of a unit that is encoded in a block, units in a block, slots (as powers of two) for pairs of pieces and for steps of the automaton.
SHORT, BLOCK, PAIR_SLOTS, STEP_SLOTS = 64, 4_096, 20, 17

#: SentencePiece's types of pieces and models, as the format numbers them.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM, _BPE = 1, 2


class Pieces:
    """A vocabulary as plain tables: what a task needs to encode and decode."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normal = proto.normalizer_spec
        self.bpe = proto.trainer_spec.model_type == _BPE
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE) or len(normal.precompiled_charsmap) or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only unigram and BPE models without character maps and user-defined pieces are supported")
        self.prefix, self.collapse = normal.add_dummy_prefix, normal.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.unknown_score = min(p.score for p in proto.pieces if p.type == _NORMAL) - 10
        self.bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        #: The lengths, from 3 on, that pieces ending in these three characters have, longest first.
        self.lengths: dict[str, list[int]] = {}
        for n in sorted({len(p) for p in self.ids if len(p) > 2}, reverse=True):
            for tail in {p[-3:] for p in self.ids if len(p) == n}:
                self.lengths.setdefault(tail, []).append(n)
        self.surfaces = [b"" if p.type == _CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        alone = re.escape("".join(c for c in "\n\t\r" if not any(c in piece for piece in self.ids)))
        self.units = re.compile(f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

        self._automaton()

    def _automaton(self) -> None:
        """The trie of all pieces with links: (node, character) to node in ``edges`` and ``targets``, and of each node its longest proper suffix, its longest piece, and that node's depth and id.

        Node 0 is the root; as a longest piece it says that there is none.
        """
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        for name, i in self.ids.items():
            node = 0
            for c in map(ord, name):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    piece.append(-1)
                node = children[node][c]
            piece[node] = i
        suffix, longest, level = [0] * len(children), [0] * len(children), [0]
        while level:
            for node in level:
                longest[node] = node if piece[node] >= 0 else longest[suffix[node]]
                for c, child in children[node].items():
                    back = suffix[node]
                    while back and c not in children[back]:
                        back = suffix[back]
                    suffix[child] = children[back].get(c, 0) if node else 0
            level = [child for node in level for child in children[node].values()]
        edges = sorted(((node << 21) + c, child) for node, ways in enumerate(children) for c, child in ways.items())
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.targets, self.suffix, self.longest_piece, self.depth, self.piece = (np.array(v, np.int32) for v in ([t for _, t in edges], suffix, longest, depth, piece))

    def step(self, key: np.ndarray) -> np.ndarray:
        """The nodes that the automaton goes to, of keys (node << 21) + character."""
        node, c, to = key >> 21, key & 0x1FFFFF, np.zeros(len(key), np.int64)
        rows = np.arange(len(key) if len(self.edges) else 0)
        while len(rows):
            own = (node[rows] << 21) + c[rows]
            place = np.minimum(np.searchsorted(self.edges, own), len(self.edges) - 1)
            there = self.edges[place] == own
            to[rows[there]] = self.targets[place[there]]
            rows = rows[~there & (node[rows] > 0)]
            node[rows] = self.suffix[node[rows]]
        return to

    def marked(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)


class Slots:
    """Values of whole numbers, computed by ``work`` from an array of them and remembered in a fixed number of slots, where a later one takes the place of another."""

    def __init__(self, work: Callable[[np.ndarray], np.ndarray], bits: int, kind: type = np.int32):
        self.work, self.shift = work, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        value, new = self.values[slot], np.flatnonzero(self.keys[slot] != key)
        if len(new):
            own, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            made = self.work(own)
            value[new] = made[back]
            # One row writes a slot, so its key and value belong together.
            to, one = np.unique(slot[new[first]], return_index=True)
            self.keys[to], self.values[to] = own[one], made[one]
        return value


class Encoder:
    """Encodes units; one for each Python worker, see :func:`encoder_of`."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.pairs: dict[tuple[int, int], bool] = {}
        self.names: dict[int, str] = {i: p for p, i in pieces.ids.items()}
        self.memo: dict[str, bytes] = {}
        self.steps, self.stays = Slots(pieces.step, STEP_SLOTS), Slots(self._pairs_stay, PAIR_SLOTS, bool)

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging of the best, then leftmost, adjacent pair."""
        ids, scores = self.pieces.ids, self.pieces.scores
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay(self, left: int, right: int) -> bool:
        """Whether two pieces next to each other stay as they are; a negative left piece is the start."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_of(left, right)
        return known

    def _stay_of(self, left: int, right: int) -> bool:
        b = self.names[right]
        return self._merged(b) == [b] if left < 0 else self._merged(self.names[left] + b) == [self.names[left], b]

    def _pairs_stay(self, keys: np.ndarray) -> np.ndarray:
        """As :meth:`_stay`, of keys (left + 1) * number of pieces + right."""
        n = len(self.pieces.scores)
        return np.array([self._stay_of(key // n - 1, key % n) for key in keys.tolist()], bool)

    def _bpe_block(self, units: list[str]) -> Iterator[bytes]:
        """The ids of each sorted unit: as :meth:`_bpe_units`, but all nodes of one depth of their trie at once."""
        pieces, rows = self.pieces, np.arange(len(units))
        size = np.fromiter(map(len, units), np.int64, len(units))
        chars, first = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum(size) - size
        width = int(size.max(initial=0))
        # By depth and unit: the last piece of the prefix and its length.
        last, length = np.full((width + 1, len(units)), -1, np.int32), np.ones((width + 1, len(units)), np.uint8)
        own, at = np.zeros(len(units), bool), np.zeros(len(units), np.int64)
        here = rows
        for end in range(1, width + 1):
            here = here[size[here] >= end]
            c = chars[first[here] + end - 1]
            own[here[:1]] = True
            own[here[1:]] |= (c[1:] != c[:-1]) | (np.diff(here) > 1)
            heads = np.flatnonzero(own[here])
            unit, to = here[heads], self.steps((at[here[heads]] << 21) + c[heads])
            found, long = np.full(len(heads), -1, np.int32), np.ones(len(heads), np.uint8)
            open_, node = np.arange(len(heads)), pieces.longest_piece[to]
            while len(open_):
                open_, node = open_[node > 0], node[node > 0]
                piece, n = pieces.piece[node], pieces.depth[node]
                # After an unknown character, as at the start, nothing can merge to the left.
                stays = self.stays((last[end - n, unit[open_]] + np.int64(1)) * len(pieces.scores) + piece)
                found[open_[stays]], long[open_[stays]] = piece[stays], n[stays]
                open_, node = open_[~stays], pieces.longest_piece[pieces.suffix[node[~stays]]]
            like = np.cumsum(own[here]) - 1
            last[end, here], length[end, here], at[here] = found[like], long[like], to[like]
        ends, count, walked = size.copy(), np.zeros(len(units), np.int64), []
        while len(rows := rows[ends[rows] > 0]):
            walked.append((rows, last[ends[rows], rows]))
            ends[rows] -= length[ends[rows], rows]
            count[rows] += 1
        stop = np.cumsum(count)
        flat = np.zeros(int(count.sum()), np.int32)
        for i, (unit, piece) in enumerate(walked):
            flat[stop[unit] - 1 - i] = piece
        raw, odd = flat.tobytes(), np.zeros(len(units), bool)
        odd[np.repeat(np.arange(len(units)), count)[flat < 0]] = True
        for i, (a, b) in enumerate(zip((4 * (stop - count)).tolist(), (4 * stop).tolist(), strict=True)):
            yield self._ids(units[i], lambda end, i=i: (end - int(length[end, i]), int(last[end, i]))) if odd[i] else raw[a:b]

    def _bpe_units(self, units: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        """For each sorted unit its forward states: by prefix length, (start of the last piece, its id or -1)."""
        ids, lengths, pairs = self.pieces.ids.get, self.pieces.lengths.get, self.pairs.get
        before, states = "", [(0, -1)]
        for unit in units:
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(unit) + 1):
                for n in (*lengths(unit[end - 3 : end], ()), 2, 1) if end > 2 else range(end, 0, -1):
                    start = end - n
                    if start < 0:
                        continue
                    piece = ids(unit[start:end])
                    if piece is None:
                        continue
                    # After an unknown character, as at the start, nothing can merge to the left.
                    left = states[start][1]
                    stays = pairs((left, piece))
                    if stays if stays is not None else self._stay(left, piece):
                        states.append((start, piece))
                        break
                else:
                    states.append((end - 1, -1))
            before = unit
            yield states

    def _unigram_units(self, units: list[str]) -> Iterator[list[tuple[int, int, float]]]:
        """For each sorted unit its forward states: by prefix length, (start of the last piece, its id or -1, best score)."""
        ids, scores, longest, unknown = self.pieces.ids, self.pieces.scores, self.pieces.longest, self.pieces.unknown_score
        before, states = "", [(0, -1, 0.0)]
        for unit in units:
            same, most = 0, min(len(before), len(unit))
            while same < most and before[same] == unit[same]:
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(unit) + 1):
                best = None
                for start in range(max(0, end - longest), end):
                    piece = ids.get(unit[start:end])
                    if piece is not None and (best is None or states[start][2] + scores[piece] > best[2]):
                        best = (start, piece, states[start][2] + scores[piece])
                if ids.get(unit[end - 1]) is None and (best is None or states[end - 1][2] + unknown > best[2]):
                    best = (end - 1, -1, states[end - 1][2] + unknown)
                states.append(best)
            before = unit
            yield states

    def learn(self, units: set[str]) -> None:
        """Encode the distinct ``units`` that are not remembered yet, in the order of their trie; too large a memory keeps those in use."""
        if len(self.memo) > REMEMBERED:
            self.memo = {unit: self.memo[unit] for unit in units & self.memo.keys()}
        new = sorted(units - self.memo.keys())
        if self.pieces.bpe:
            short = [unit for unit in new if len(unit) <= SHORT]
            for start in range(0, len(short), BLOCK):
                block = short[start : start + BLOCK]
                self.memo.update(zip(block, self._bpe_block(block), strict=True))
            new = [unit for unit in new if len(unit) > SHORT]
        walk = self._bpe_units if self.pieces.bpe else self._unigram_units
        for unit, states in zip(new, walk(new), strict=True):
            self.memo[unit] = self._ids(unit, states.__getitem__)

    def _ids(self, unit: str, state: Callable[[int], tuple]) -> bytes:
        """The ids that a unit's forward states lead to, from its end on."""
        out, end = [], len(unit)
        while end:
            start, piece = state(end)[:2]
            if piece >= 0:
                out.append(piece)
            elif self.pieces.bytes_:
                out += [self.pieces.bytes_[b] for b in reversed(unit[start:end].encode("utf-8", "replace"))]
            elif not (out and out[-1] == self.pieces.unknown):
                out.append(self.pieces.unknown)
            end = start
        return np.array(out[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        cut = [self.pieces.units.findall(self.pieces.marked(t or "")) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, units)), np.int32) for units in cut]


def encoder_of(pieces: Pieces) -> Encoder:
    """The encoder of a broadcast vocabulary: tasks of one worker share it, and what it has learned."""
    if not hasattr(pieces, "encoder"):
        pieces.encoder = Encoder(pieces)
    return pieces.encoder


def decoder(pieces: Pieces) -> Callable[[list], list[str]]:
    """The function from arrays of ids to texts; null decodes to the empty text, broken UTF-8 to replacement characters."""

    surface = pieces.surfaces.__getitem__

    def decode(rows: list) -> list[str]:
        joined = (b"".join(map(surface, ids.tolist())) if ids is not None else b"" for ids in rows)
        return [(raw[1:] if pieces.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace") for raw in joined]

    return decode


def load(spark: SparkSession, model_file: str):
    """The model's tables, read by the driver, shared with the executors: a few megabytes, bounded by the vocabulary."""
    with open(model_file, "rb") as f:
        return spark.sparkContext.broadcast(Pieces(f.read()))


def encode(docs: DataFrame, model_file: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as a last column ``into`` (array of int).

    The name is lengthened by ``_`` where the input has such a column. No begin or end pieces. Null and empty texts encode to empty arrays;
    repeated rows encode alike; an empty table stays empty.
    """
    shared = load(docs.sparkSession, model_file)

    def make():
        encoder = encoder_of(shared.value)
        return lambda texts: [encoder.encode(texts)]

    into = fresh(into, docs.columns)
    schema = StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))])
    return docs.mapInArrow(per_text(make, text_col, [into], [pa.list_(pa.int32())], most_bytes=SLICE), schema)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids as a last column ``into``; null ids decode to the empty text.

    The name is lengthened by ``_`` where the input has such a column. Repeated
    rows decode alike; an empty table stays empty.
    """
    into = fresh(into, encoded.columns)
    shared = load(encoded.sparkSession, model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = decoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [None if x is None else x.values.to_numpy() for x in (v if v.is_valid else None for v in part.column(ids_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(work(rows), pa.string())], names=[*part.schema.names, into])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(into, StringType())]))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the ids decode to the text) for every document."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    shared = load(spark, model)

    def make():
        encoder, back = encoder_of(shared.value), decoder(shared.value)

        def work(texts: list[str | None]) -> list[list]:
            ids = encoder.encode(texts)
            return [ids, [text == (t or "").replace(MARK, " ") for text, t in zip(back(ids), texts, strict=True)]]

        return work

    schema = StructType.fromDDL("ids array<int>, round_trip boolean")
    out = docs.mapInArrow(per_text(make, "text", ["ids", "round_trip"], [pa.list_(pa.int32()), pa.bool_()], ["doc_id"], SLICE), StructType([docs.schema["doc_id"], *schema.fields]))
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")
