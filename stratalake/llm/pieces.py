"""SentencePiece encoding and decoding with a given vocabulary; nothing is trained.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output
links give every piece that ends there, and each relaxes the best score of that position:
a Viterbi search for the segmentation with the highest sum of piece scores. Of equal
scores the longest last piece wins. A character without a piece of its own costs
``UNKNOWN_PENALTY`` below the lowest score and becomes its UTF-8 bytes if the vocabulary
has byte pieces, else the unknown piece (one for a run).

No piece has the space mark behind another character and none crosses a character that
is in no piece, so a text is cut there and words that recur are looked up (up to ``MEMO``
per worker; the half that was not used lately goes first). This changes the speed only, never the pieces.

Defined results: null and empty texts have no pieces and decode to the empty text;
literal space marks (U+2581) are read as spaces; ``round_trip`` says whether decoding
gives the text back; repeated rows are encoded each; other columns are passed through.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalake.llm.common import free_name, kept

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 1 << 18
MEMO_CHARS = 64
ENCODED = "struct<ids:array<int>,round_trip:boolean>"


@dataclass
class Vocabulary:
    """Pieces and scores by id; ``bytes_at`` has the id of each byte piece, or is empty."""

    pieces: list[str]
    scores: list[float]
    unknown: int = 0
    bytes_at: list[int] = field(default_factory=list)
    special: frozenset[int] = frozenset()

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece and i not in self.special:
                automaton.add_word(piece, (i, len(piece), self.scores[i]))
        automaton.make_automaton()
        return automaton

    @cached_property
    def singles(self) -> frozenset[str]:
        """Characters that are pieces."""
        usable = (p for i, p in enumerate(self.pieces) if i not in self.special)
        return frozenset(p for p in usable if len(p) == 1)

    @cached_property
    def unknown_score(self) -> float:
        usable = [s for i, s in enumerate(self.scores) if i not in self.special]
        return min(usable, default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id decodes to."""
        text = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in self.special:
            text[i] = b""
        text[self.unknown] = " ⁇ ".encode()
        for byte, i in enumerate(self.bytes_at):
            text[i] = bytes([byte])
        return text

    @cached_property
    def barriers(self) -> str:
        """Line ends that no piece contains."""
        usable = "".join(p for i, p in enumerate(self.pieces) if i not in self.special)
        return "".join(c for c in "\n\r\t" if c not in usable)

    @cached_property
    def cutter(self) -> re.Pattern:
        stop = re.escape(self.barriers)
        return re.compile(f"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" + (f"|[{stop}]" if stop else ""))


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    at = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    special = {
        i for i in ids
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    }
    return Vocabulary(
        [model.id_to_piece(i) for i in ids],
        [model.get_score(i) for i in ids],
        model.unk_id(),
        [at[f"<0x{b:02X}>"] for b in range(256)] if at else [],
        frozenset(special),
    )


def segment(vocabulary: Vocabulary, text: str) -> list[int]:
    """Ids of the best segmentation of a text that has its space marks already."""
    if vocabulary.singles.issuperset(text):
        return _all_known(vocabulary, text)
    size = len(text)
    best, back = [0.0] * (size + 1), [(0, -1)] * (size + 1)
    matches = vocabulary.automaton.iter(text)
    end_at, match = next(matches, (size, None))
    unknown = vocabulary.unknown_score
    for end in range(size):
        top, step, alone = None, None, False
        while end_at == end and match:
            piece, length, score = match
            value = best[end + 1 - length] + score
            if top is None or value > top:
                top, step = value, (end + 1 - length, piece)
            alone = alone or length == 1
            end_at, match = next(matches, (size, None))
        if not alone and (top is None or best[end] + unknown > top):
            top, step = best[end] + unknown, (end, -1)
        best[end + 1], back[end + 1] = top, step
    path, end = [], size
    while end:
        start, piece = back[end]
        path.append((piece, start, end))
        end = start
    return _ids(vocabulary, text, reversed(path))


def _all_known(vocabulary: Vocabulary, text: str) -> list[int]:
    """``segment`` where every character is a piece: no position is out of reach."""
    size = len(text)
    best, back = [0.0] + [float("-inf")] * size, [(0, 0)] * (size + 1)
    for end, (piece, length, score) in vocabulary.automaton.iter(text):
        end += 1
        value = best[end - length] + score
        if value > best[end]:
            best[end], back[end] = value, (piece, length)
    ids, end = [], size
    while end:
        piece, length = back[end]
        ids.append(piece)
        end -= length
    return ids[::-1]


def _ids(vocabulary: Vocabulary, text: str, path: Iterable[tuple[int, int, int]]) -> list[int]:
    ids: list[int] = []
    after_unknown = False
    for piece, start, end in path:
        if piece >= 0:
            ids.append(piece)
        elif vocabulary.bytes_at:
            raw = text[start:end].encode("utf-8", "surrogatepass")
            ids += [vocabulary.bytes_at[b] for b in raw]
        elif not after_unknown:
            ids.append(vocabulary.unknown)
        after_unknown = piece < 0
    return ids


class Encoder:
    """Texts to ids and back; keeps the segments of recurring words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, part: str) -> bytes:
        known = self.memo.get(part)
        if known is None:
            known = self.older.get(part)
            if known is None:
                ids = segment(self.vocabulary, part)
                known = struct.pack(f"<{len(ids)}i", *ids)
            if len(part) <= MEMO_CHARS:
                if len(self.memo) >= MEMO // 2:
                    self.older, self.memo = self.memo, {}
                self.memo[part] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array([], np.int32)
        marked = MARK + text.replace(" ", MARK)
        if not self.vocabulary.bytes_at:  # runs of unknown characters may cross a cut
            return np.array(segment(self.vocabulary, marked), np.int32)
        parts = self.vocabulary.cutter.findall(marked)
        return np.frombuffer(b"".join(map(self._packed, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        surfaces = self.vocabulary.surfaces
        raw = b"".join([surfaces[i] for i in ids.tolist()])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encoder_of(vocabulary, key: str) -> Encoder:
    """The encoder of a broadcast vocabulary; a worker keeps its last one between tasks."""
    return kept(key, lambda: Encoder(vocabulary.value))


def _encoder(vocabulary):
    key = uuid.uuid4().hex

    @F.arrow_udf(ENCODED)
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(vocabulary, key)
        for texts in parts:
            ids, same = [], []
            for text in texts:
                plain = text.as_py() or ""
                found = encoder.encode(plain)
                ids.append(found)
                same.append(encoder.decode(found) == plain)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate([np.array([], np.int32), *ids])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.StructArray.from_arrays([lists, pa.array(same)], ["ids", "round_trip"])

    return encoded


def _decoder(vocabulary):
    key = uuid.uuid4().hex

    @F.arrow_udf("string")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(vocabulary, key)
        for lists in parts:
            yield pa.array(
                [encoder.decode(np.array(x.as_py() or [], np.int32)) for x in lists], pa.string()
            )

    return decoded


def encode(docs: DataFrame, model: str = MODEL, ids: str = "piece_ids",
           round_trip: str = "round_trip") -> DataFrame:
    """``docs`` with its pieces and whether they decode to the text."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load(model))  # fixed: the model file
    both = free_name(docs, "encoded")
    rows = docs.withColumn(both, _encoder(vocabulary)(F.col("text").cast("string")))
    return rows.withColumns({ids: F.col(both)["ids"], round_trip: F.col(both)["round_trip"]}).drop(
        both
    )


def decode(rows: DataFrame, model: str = MODEL, ids: str = "piece_ids",
           text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their pieces."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(model))
    return rows.withColumn(text, _decoder(vocabulary)(F.col(ids)))
