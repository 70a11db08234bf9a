"""Byte-level BPE with given ranks, by the tokenizers library over Arrow batches.

A rank file says which byte strings are tokens and in which order pairs merge. The library
merges named pairs of strings, so each byte becomes a printable character (``CHARACTERS``) and
every division of a token into two tokens becomes a merge with the token's rank. A match of the
pattern that is a token as a whole is taken at once, special tokens do not exist.

No match of the pattern goes on from a character to white space behind it or from a letter to
a sign behind it, and none looks back, so a text is cut there; the library encodes each distinct part of a stretch of about ``STRETCH`` characters
once, and a worker keeps its parts (beyond ``MEMO`` of them only those of the last stretch). All this changes the speed, never the ids.

Decoding reverses the byte table. A token may end inside a character, so bytes are joined
before they become text; ``starts`` says in which character each token begins, and tokens
within one character have the same start. Ids that make no valid text decode with U+FFFD.

Defined results: null and empty texts have no ids and decode to no bytes; null ids and ids
outside the vocabulary decode to nothing; repeated rows are encoded each; other columns are
passed through.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from stratalake.llm.common import free_name, kept

RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = public_tokenizers.PATTERN
MEMO = 1 << 17
MEMO_CHARS = 64
STRETCH = 1 << 19
# The characters with the property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(f"[{WHITE}]?[A-Za-z]++(?=[,.;:!?])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")


def _characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


CHARACTERS = _characters()
BYTES = {c: b for b, c in enumerate(CHARACTERS)}


def shown(token: bytes) -> str:
    return "".join([CHARACTERS[b] for b in token])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, which is its id, of a file with one base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def build(ranks: dict[bytes, int]) -> str:
    """The tokenizer as the library's JSON."""
    merges = [
        (shown(t[:i]), shown(t[i:]))
        for t in sorted(ranks, key=ranks.get)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    vocabulary = {shown(t): r for t, r in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


class Codec:
    """Texts to ids and back; keeps the ids of recurring parts."""

    def __init__(self, built: str):
        self.tokenizer = Tokenizer.from_str(built)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.surfaces = [b""] * (1 + max(vocabulary.values(), default=-1))
        for token, i in vocabulary.items():
            self.surfaces[i] = bytes([BYTES[c] for c in token])
        self.memo: dict[str, bytes] = {}

    def _packed(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch as little-endian 32-bit integers."""
        parts = [PARTS.findall(s) for s in stretches]
        distinct = set().union(*parts)
        if len(self.memo) > MEMO:
            self.memo = {p: self.memo[p] for p in distinct & self.memo.keys()}
        new = list(distinct - self.memo.keys())
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.memo.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, encoded))
        packed = [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        for part in new:
            if len(part) > MEMO_CHARS:
                del self.memo[part]
        return packed

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        waiting: list[str] = []  # stretches that are not encoded yet
        done: list[bytes] = []
        sizes: list[int] = []  # stretches per text that is not returned yet
        held = 0

        def finished(last: bool) -> Iterator[np.ndarray]:
            nonlocal held
            done.extend(self._packed(waiting))
            waiting.clear()
            held = 0
            whole = len(sizes) - (not last)  # the last text may go on
            first = 0
            for size in sizes[:whole]:
                yield np.frombuffer(b"".join(done[first : first + size]), "<i4")
                first += size
            del done[:first], sizes[:whole]

        for text in texts:
            sizes.append(0)
            start = 0
            while start < len(text):
                cut = CUT.search(text, start + STRETCH) if len(text) - start > STRETCH else None
                end = cut.end() if cut else len(text)
                waiting.append(text[start:end])
                sizes[-1] += 1
                held += end - start
                start = end
                if held > STRETCH:
                    yield from finished(last=False)
        yield from finished(last=True)

    def tokens(self, ids: list[int]) -> list[bytes]:
        surfaces = self.surfaces
        if ids and (min(ids) < 0 or max(ids) >= len(surfaces)):
            return [surfaces[i] if 0 <= i < len(surfaces) else b"" for i in ids]
        return [surfaces[i] for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens(ids))

    def starts(self, ids: list[int]) -> np.ndarray:
        """The character in which each token begins, from the bytes alone."""
        tokens = self.tokens(ids)
        first = np.cumsum([0, *map(len, tokens)])[:-1]
        joined = np.frombuffer(b"".join(tokens), np.uint8)
        character = np.cumsum((joined & 0xC0) != 0x80) - 1  # all but continuation bytes begin one
        return character[first].astype(np.int32) if len(first) else np.array([], np.int32)


def _codec(built) -> Codec:
    """The codec of a broadcast tokenizer; a worker keeps its last one between tasks."""
    key, text = built.value

    def build() -> Codec:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return Codec(text)

    return kept(key, build)


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """Ids of each list; a null list is empty, a null id is -1."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    start = 0
    for end in ends.tolist():
        yield flat[start:end]
        start = end


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.int32), *rows])))


def _broadcast(df: DataFrame, ranks: str):
    """One vocabulary file, a few megabytes whatever the input."""
    built = build(read_ranks(ranks))
    key = hashlib.sha256(built.encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((key, built))


def encode(docs: DataFrame, ranks: str | None = None, ids: str | None = "token_ids",
           starts: str | None = None, packed: str | None = None,
           decoded: str | None = None) -> DataFrame:
    """``docs`` with the columns that are named: the ids of its texts, the character that each
    token starts in, the ids as little-endian 32-bit integers, and what they decode to."""
    built = _broadcast(docs, ranks or public_tokenizers.path(RANKS))
    kinds = {"ids": "array<int>", "starts": "array<int>", "packed": "binary", "decoded": "binary"}
    wanted = {k: n for k, n in zip(kinds, (ids, starts, packed, decoded)) if n}

    @F.arrow_udf(f"struct<{','.join(f'{k}:{kinds[k]}' for k in wanted)}>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(built)
        made = {
            "ids": _lists,
            "starts": lambda rows: _lists([codec.starts(r.tolist()) for r in rows]),
            "packed": lambda rows: pa.array([r.tobytes() for r in rows], pa.binary()),
            "decoded": lambda rows: pa.array([codec.decode(r.tolist()) for r in rows], pa.binary()),
        }
        for texts in batches:
            rows = list(codec.encode(text.as_py() or "" for text in texts))
            yield pa.StructArray.from_arrays([made[k](rows) for k in wanted], list(wanted))

    both = free_name(docs, "encoded")
    rows = docs.withColumn(both, encoded(F.col("text").cast("string")))
    return rows.withColumns({n: F.col(both)[k] for k, n in wanted.items()}).drop(both)


def decode(rows: DataFrame, ranks: str | None = None, ids: str = "token_ids",
           raw: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids; ``text_of`` makes text of them."""
    built = _broadcast(rows, ranks or public_tokenizers.path(RANKS))

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(built)
        for lists in batches:
            yield pa.array([codec.decode(ids.tolist()) for ids in _rows(lists)], pa.binary())

    return rows.withColumn(raw, decoded(F.col(ids)))


def text_of(raw: str | Column) -> Column:
    """Decoded bytes as text, with U+FFFD for what is none."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([(x.as_py() or b"").decode("utf-8", "replace") for x in batch], pa.string())

    return text(raw)


def report(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of the ids and of what they decode to, per document."""
    rows = encode(docs.select("doc_id", "text"), ranks, None, packed="packed", decoded="decoded")
    return rows.select(
        "doc_id",
        (F.length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )
