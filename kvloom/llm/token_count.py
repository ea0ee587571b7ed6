"""Token counts of a sentencepiece BPE model with a whole-token shortcut.

The model's normalisation is the identity, a space counts as U+2581, and one is
put in front of the text.  Two facts about the vocabulary, checked when the
model is loaded, let a text be cut: no piece holds U+2581 after another
character, and no piece but a byte holds a line feed.  So no merge crosses the
start of a run of spaces or a line feed, and the tokens of a text are those of
its pre-tokens.  A pre-token is a word with the space before it, or a line
feed with the characters after it.

Proof of the shortcut, once per process: every vocabulary string is encoded
alone, and those that give just their own id count as one token wherever they
are a whole pre-token.  The library merges the others; their counts are kept
in a memo that is emptied at ``MEMO`` entries or ``MEMO_CHARS`` characters.

Cases: null and empty texts have 0 tokens; texts of any length are counted
whole, never cut short; special strings inside a text are ordinary text, the
library's default; rows that repeat are counted separately; a null id stays
null; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import map_batches

MEMO = 400_000
MEMO_CHARS = 16_000_000
OVER = 4096
SPACE = "▁"
_PRETOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|\n[^ {SPACE}\n]*")
_PLAIN_BREAK = re.compile(f"  |{SPACE}|^[ \n]| \n| \\Z")
_PROBES = ("a", " a  b ", "\n\na \n b", "x▁y", "ﬁ Ａ e\u0301", "a\x00b\r\n", "<s> </s>", "12 345", "▁", " \n▁\n")


class Counter:
    """Counts tokens with one loaded model; not shared between processes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.splits = self.provable()
        self.whole = self.proven() if self.splits else {}
        self.memo, self.chars = dict(self.whole), 0
        self.splits = self.splits and all(self.count(x) == len(self.library.encode(x)) for x in _PROBES)

    def pieces(self) -> list[tuple[int, str]]:
        m = self.library
        return [(i, m.id_to_piece(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]

    def provable(self) -> bool:
        """Whether the cuts are safe for this model."""
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for _, p in self.pieces())
        return not inner and self.library.encode("\nx", out_type=str)[0] == SPACE

    def proven(self) -> dict[str, int]:
        """Pre-tokens that are one vocabulary string: a word (with its space, 1 token), or a line feed and a string (2 tokens)."""
        listed = self.pieces()
        words = [(i, p[1:]) for i, p in listed if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
        inner = [(i, p) for i, p in listed if SPACE not in p]
        found = {w: 1 for (i, w), ids in zip(words, self.library.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]}
        found |= {"\n" + p: 2 for (i, p), ids in zip(inner, self.library.encode(["\n" + p for _, p in inner], num_threads=1), strict=True) if len(ids) == 3 and ids[2] == i}
        return found

    def merged(self, pretokens: list[str]) -> dict[str, int]:
        """Counts by the library."""
        return {x: len(ids) - 1 if x.startswith("\n") else len(ids) for x, ids in zip(pretokens, self.library.encode(pretokens, num_threads=1), strict=True)}

    def keep(self, found: dict[str, int]) -> None:
        chars = sum(map(len, found))
        if len(self.memo) + len(found) > MEMO or self.chars + chars > MEMO_CHARS:
            self.memo, self.chars = dict(self.whole), 0
        if len(self.memo) + len(found) <= MEMO and chars <= MEMO_CHARS:
            self.memo |= found
            self.chars += chars

    def sum(self, pretokens: list[str]) -> int:
        try:
            return sum(map(self.memo.__getitem__, pretokens))
        except KeyError:
            found = self.merged([x for x in set(pretokens) if x not in self.memo])
        total = sum(found[x] if x in found else self.memo[x] for x in pretokens)
        self.keep(found)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        if not _PLAIN_BREAK.search(text):  # single spaces between words
            return self.sum(text.replace("\n", " \n").split(" "))
        found = _PRETOKEN.findall(" " + text)
        rest = [x[1:] if x[0] != "\n" else x for x in found]
        lone = rest.count("")  # a single space before a line feed or at the end is a token of its own
        return lone + self.sum([x for x in rest if x])


_loaded: dict[int, Counter] = {}


def _counter(model: bytes) -> Counter:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(model)
    return _loaded[key]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", over: int = OVER) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    The model is read on the driver and broadcast (half a megabyte).
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(model.value)
        n = [counter.count(x or "") for x in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[f.name for f in schema])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return map_batches(docs, [F.col(doc_id), size, F.col(text)], count, schema).withColumn("over_limit", F.col("n_tokens") > over)
