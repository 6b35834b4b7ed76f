"""Token counts by the whole-token shortcut.

Before any text is read, every ordinary vocabulary string is encoded alone; those that come back as their own
single id are proven whole tokens. A text is then cut where no merge can cross (before a run of word marks that
follows another character, and between letters and other characters; the proof fails where a vocabulary string
would be cut), and each pre-token that is a proven string counts one. Only the others are merged, once for each distinct one that a worker sees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import parts, table, tokenizer_path
from millrace.session import map_arrow

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens a worker remembers besides the proven ones; then it forgets them and goes on.
MEMO = 400_000
#: Pre-tokens longer than this are merged anew each time, so that the memory stays bounded.
MEMO_LENGTH = 64


@lru_cache(maxsize=4)
def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))


#: Cuts that no piece crosses; each depends on the two characters beside it alone.
PRE_TOKENS = re.compile(rf"{MARK}*[^\W\d_²]+|{MARK}*(?:[^\w{MARK}]|[\d_²])+|{MARK}+|.", re.DOTALL).findall


@lru_cache(maxsize=4)
def fence(model: str) -> str:
    """A character that the vocabulary lacks: it is encoded as bytes, and nothing merges with it. Raises where the
    cuts do not hold for the vocabulary."""
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any("\n" in p or PRE_TOKENS(p) != [p] for p in pieces):
        raise ValueError("a vocabulary string crosses a line break or a cut between pre-tokens")
    if sp.normalize("ﬁ  Ａ ") != f"{MARK}ﬁ{MARK}{MARK}Ａ{MARK}":
        raise ValueError("the model changes its input by more than word marks")
    return "\n"


def merged(model: str, piece: str) -> list[int]:
    """Ids of a pre-token inside a text: a fence before it keeps the model's own word mark away."""
    sp, wall = load(model), fence(model)
    skip = len(sp.encode(wall))
    return sp.encode(wall + piece)[skip:]


@lru_cache(maxsize=4)
def whole_tokens(model: str) -> dict[str, int]:
    """The proof: vocabulary strings that alone encode to their own single id, with that id."""
    sp = load(model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    wall = fence(model)
    skip = len(sp.encode(wall))
    pieces = [sp.id_to_piece(i) for i in ids]
    return {p: i for p, i, got in zip(pieces, ids, sp.encode([wall + p for p in pieces]), strict=True) if got[skip:] == [i]}


def marked(text: str) -> str:
    """The text as the model sees it."""
    return MARK + text.replace(" ", MARK) if text else ""


class Counts(dict):
    """Tokens by pre-token; what is missing is merged."""

    def __init__(self, model: str):
        super().__init__(dict.fromkeys(whole_tokens(model), 1))
        self.model, self.limit = model, len(self) + MEMO

    def __missing__(self, piece: str) -> int:
        n = len(merged(self.model, piece))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= self.limit:
                self.clear()
                self.update(dict.fromkeys(whole_tokens(self.model), 1))
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, PRE_TOKENS(marked(text))))


@lru_cache(maxsize=2)
def counts(model: str) -> Counts:
    return Counts(model)


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows are counted each; other
    columns of docs are not read; an empty table gives an empty one. A plain map: no shuffle, and memory bounded by one Arrow batch and MEMO.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts(model).of
        for b in parts(batches):
            n = pa.array([of(t or "") for t in b.column(1).to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
