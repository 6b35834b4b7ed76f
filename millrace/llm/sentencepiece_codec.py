"""SentencePiece encoding by a prefix table, and decoding.

In a merge-type vocabulary every text has one encoding, and an encoding is right exactly when each adjacent pair of
its tokens is what the merges make of the two strings joined. Dropping the last token of the encoding of a prefix
therefore leaves the encoding of a shorter prefix. So it is enough to store, for each prefix, its unique last token:
among the vocabulary strings that end there (an automaton lists them), the one compatible with the last token of
the prefix before it. The ids are then recovered backwards from the end of the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import parts, table
from millrace.llm.token_counts import MEMO_LENGTH, MODEL, PRE_TOKENS, fence, load, marked
from millrace.session import map_arrow

#: Pre-tokens and pairs a worker remembers; then it forgets them and goes on.
MEMO = 700_000
PAIRS = 1_000_000
EMPTY = -1


class PrefixTable:
    """The vocabulary as an automaton, and the compatibility of pairs of its tokens."""

    def __init__(self, model: str):
        import ahocorasick

        fence(model)  # raises where the cuts do not hold
        sp = load(model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.letters = frozenset("".join(self.piece.values()))
        if not self.letters <= self.score.keys():
            raise ValueError("a character of a vocabulary string is no vocabulary string itself")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.get_piece_size()  # stands for a character that is encoded as bytes, and for the text's begin
        self.shift = self.unknown.bit_length()
        self.automaton = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.automaton.add_word(p, i << 8 | len(p))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def cut(self, text: str) -> list[str]:
        """What the merges make of a short string of vocabulary characters: always the pair with the best score is
        joined, the leftmost of equals."""
        parts = list(text)
        score = [self.score.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while found := [s for s in score if s is not None]:
            k = score.index(max(found))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del score[k]
            if k:
                score[k - 1] = self.score.get(parts[k - 1] + parts[k])
            if k < len(score):
                score[k] = self.score.get(parts[k] + parts[k + 1])
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave right as one token after left, and both apart."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        before = [] if left == self.unknown else [self.piece[left]]
        known = self.pairs[left << self.shift | right] = self.cut("".join(before) + self.piece[right]) == [*before, self.piece[right]]
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a text of any length in time proportional to it, without begin or end ids or white space changes."""
        length, known, shift, unknown = self.length, self.pairs.get, self.shift, self.unknown
        last = [EMPTY] * len(text) + [unknown]  # by the prefix's last character; the empty prefix is at -1
        if not self.letters.issuperset(text):
            for at, c in enumerate(text):
                if c not in self.letters:
                    last[at] = unknown
        for end, found in self.automaton.iter(text):
            if last[end] == EMPTY:
                left, token = last[end - (found & 255)], found >> 8
                if (fits := known(left << shift | token)) or fits is None and self.compatible(left, token):
                    last[end] = token
        ids: list[int] = []
        at = len(text) - 1
        while at >= 0:
            if (token := last[at]) == unknown:
                ids.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8")))
                at -= 1
            else:
                ids.append(token)
                at -= length[token]
        return ids[::-1]


class Encoded(dict):
    """Ids of pre-tokens as little-endian 32-bit integers, the frequent ones kept."""

    def __init__(self, model: str):
        self.table = PrefixTable(model)

    def __missing__(self, piece: str) -> bytes:
        ids = self.table.encode(piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoded:
    return Encoded(model)


def encode_bytes(model: str, text: str) -> bytes:
    """All ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
    sp = load(model)
    inner = b"".join(map(encoder(model).__getitem__, PRE_TOKENS(marked(text))))
    return struct.pack("<I", sp.bos_id()) + inner + struct.pack("<I", sp.eos_id())


def ids_of(packed: bytes) -> list[int]:
    return memoryview(packed).cast("I").tolist()


def decode(model: str, ids: list[int]) -> str:
    return load(model).decode(ids)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (array of int, begin and end ids included). Null and empty texts have just the
    begin and end ids; null and repeated ids are encoded each; other columns are not read; an empty table gives an empty
    one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids = [ids_of(encode_bytes(model, t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens (all ids), ids_sha256, decoded_sha256.

    Null and empty texts have just the begin and end ids and decode to the empty text; a null id stays null;
    repeated rows are encoded each; other columns of docs are not read; an empty table gives an empty one. A plain map: no shuffle, and memory bounded
    by one Arrow batch, MEMO and PAIRS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n, ids, texts = [], [], []
            for t in b.column(1).to_pylist():
                packed = encode_bytes(model, t or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(decode(model, ids_of(packed)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
