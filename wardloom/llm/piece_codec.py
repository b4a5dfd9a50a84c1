"""SentencePiece BPE encoding and decoding by a prefix table of last tokens."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import mapped, texts, without

#: Units are kept by text up to this length, and up to twice so many of them in each Python worker.
MEMO_CHARS, MEMO_UNITS = 48, 300_000
BLANK = "▁"
#: Characters and blanks that a normaliser would change.
PROBE = " ﬁ Ａ①é e\u0301 İ ½  x\u00a0\t\u200b\n y "


class PieceCodec:
    """Exact encoder and decoder for a merge-type model with byte fallback.

    The last token of the encoding of a prefix is unique. For each prefix it is found among the pieces
    that an automaton matches as ending there: the one that may follow the last token of the prefix
    before it. Two pieces may follow each other if merging their joined text leaves their border
    uncrossed; this is tested by the merge rule itself and remembered. The ids are read backwards.
    Characters that no piece holds become byte tokens and never merge, so they, like the blanks that no
    piece holds after another character, cut the text into units that are encoded apart.
    """

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize(PROBE) != BLANK + PROBE.replace(" ", BLANK) or not sp.vocab_size():
            raise ValueError("only models that leave a text as it is, but for a blank before it, are encoded here")
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.chars = {c for p in self.ids for c in p}
        self.crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.sole = {p for p in {*self.ids, *self.chars} if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.sole:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits = lru_cache(maxsize=300_000)(self._fits)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        known = "".join(sorted(self.chars - {BLANK}))
        self.units = re.compile(f"{BLANK}*[{re.escape(known)}]+|{BLANK}+|.", re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """The merge rule, for short texts: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def unit(self, text: str) -> list[str]:
        """Tokens of a unit whose characters are all known."""
        if text in self.sole:
            return [text]
        n = len(text)
        last: list[str | None] = ["", *[None] * n]
        fits = self.fits
        for end, piece in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - len(piece)]
                if before is not None and (not before or fits(before, piece)):
                    last[end + 1] = piece
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unk]

    def packed(self, text: str) -> bytes:
        """Ids of a unit as little-endian 32-bit integers."""
        if len(text) == 1 and text not in self.chars:
            ids = self.fallback(text)
        else:
            ids = [i for p in self.unit(text) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of text with begin and end ids, as little-endian unsigned 32-bit integers."""
        parts = [np.array([self.bos], "<u4").tobytes()]
        if text:
            memo = self.memo
            for u in self.split(text):
                got = memo.get(u)
                if got is None:
                    got = self.old.get(u) or self.packed(u)
                    if len(u) <= MEMO_CHARS:
                        if len(memo) >= MEMO_UNITS:  # keeps what was used since the last change
                            self.old, self.memo = memo, {}
                            memo = self.memo
                        memo[u] = got
                parts.append(got)
        parts.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(parts)

    def split(self, text: str) -> list[str]:
        text = BLANK + text.replace(" ", BLANK)
        return [text] if self.crossing else self.units.findall(text)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, byte tokens read as UTF-8, control ids left out, one leading blank dropped."""
        out: list[str] = []
        held = bytearray()
        pieces, bytes_of, skip = self.pieces, self.bytes_of, {self.bos, self.eos}
        for i in ids.tolist():
            if i in bytes_of:
                held.append(bytes_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in skip:
                out.append(pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    return PieceCodec(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """docs with ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and ``decoded``.

    One pass in Arrow batches, no shuffle; whole texts, in time linear in their length. Defined cases:
    null text is empty text, which has the begin and end ids alone; other rows and columns, repeated or
    null, are carried; columns of docs with the names of the new ones are replaced; an empty table gives an empty one. A model
    that normalises texts raises ValueError.
    """
    docs = without(docs, "ids", "n_tokens", "decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # ids and decoded text of a few hundred texts at a time
                b = whole.slice(at, 500)
                ids = [c.encode(x) for x in texts(b.column("text"))]
                decoded = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.record_batch([*b.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=[*names, "ids", "n_tokens", "decoded"])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return mapped(docs, run, docs.withColumns({"ids": F.lit(b""), "n_tokens": F.lit(0).cast("long"), "decoded": F.lit("")}).schema)
