"""Token counts without tokens: Viterbi over Aho-Corasick matches of a unigram vocabulary.

The dynamic programme carries, per position, the best score and the number of pieces of
the path that has it; no path is kept and none is walked back.

The tie rules are those of the SentencePiece unigram segmenter: a later candidate for the
same end replaces an earlier one only if its score is strictly higher, and candidates
come in order of their start, so of equal paths the one with the longest last piece wins.
A character that no piece of length one covers is unknown, at ten below the least score;
with byte fallback it counts once per UTF-8 byte, else a run of unknowns counts once. A
user-defined piece scores its UTF-8 length times the greatest score, less a tenth. Scores
are added as the segmenter adds them, in 32 bits, from the start of each stretch that no
piece can cross (a word); the segmenter itself adds through the whole text, so a text
whose score no longer fits 24 bits exactly may there lose ties to rounding.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class UnigramVocab:
    """Pieces with scores; pieces hold ``SPACE`` for a blank."""

    pieces: dict[str, float]
    byte_fallback: bool = True
    dummy_prefix: bool = True
    remove_extra: bool = False
    user_defined: frozenset[str] = frozenset()

    @staticmethod
    def from_sentencepiece(path: str) -> UnigramVocab:
        """The normal and user-defined pieces of a model file, with their scores; control,
        unknown, byte and unused pieces match no text."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece.Type
        pieces = {p.piece: p.score for p in m.pieces if p.type == kinds.Value("NORMAL")}
        own = {p.piece for p in m.pieces if p.type == kinds.Value("USER_DEFINED")}
        return UnigramVocab(
            pieces,
            m.trainer_spec.byte_fallback,
            m.normalizer_spec.add_dummy_prefix,
            m.normalizer_spec.remove_extra_whitespaces,
            frozenset(own),
        )


@dataclass
class Counter:
    """Counts one text at a time; words seen before are looked up, ``keep`` of them at most."""

    vocab: UnigramVocab
    keep: int = 1 << 18
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick

        f32 = lambda x: float(np.float32(x))
        normal = self.vocab.pieces
        most = f32(max(normal.values(), default=0.0))
        scores = {p: f32(s) for p, s in normal.items()}
        scores |= {p: f32(f32(len(p.encode()) * most) - 0.1) for p in self.vocab.user_defined}
        self.auto = ahocorasick.Automaton()
        for p, s in scores.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unk = f32(min(normal.values(), default=0.0) - UNKNOWN_PENALTY)
        # whole numbers within 24 bits add up alike in 32 and 64 bits
        self.whole = all(s <= 0 and s == int(s) for s in (*scores.values(), self.unk))
        # pieces hold blanks only as a prefix: then no piece crosses from word to blank
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in scores)
        # a line feed in no piece always stands alone, so lines may be cut apart too
        self.by_line = self.by_word and not any("\n" in p for p in scores)
        self.score = np.zeros(self.keep + 1)
        self.count = np.zeros((self.keep + 1, 2), dtype=np.int64)

    def best(self, text: str) -> tuple[float, int, int]:
        """(score, pieces, unknown characters) of the best path over ``text``."""
        if not len(self.auto):
            return self._unknown(text)
        if self.whole and self.vocab.byte_fallback:
            score, count = self._plain(text)
            if score > -(1 << 24):  # no sum on the best path, and none that beat it, was rounded
                return score, count & 0xFFFFFFFF, count >> 32
        score, count = self._rounded(text)
        return score, count & 0xFFFFFFFF, count >> 32

    def _plain(self, text: str) -> tuple[float, int]:
        """The pass in 64 bits: score, and pieces with unknown characters above 32 bits."""
        n, unk = len(text), self.unk
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        wide = lambda c: (1 << 32) + len(c.encode("utf-8", "surrogatepass"))
        at, top, held, single = 0, 0.0, 0, True
        for end, (size, s) in self.auto.iter(text):
            if end >= at:  # a new position, end + 1
                if not single and (v := score[at - 1] + unk) > top:
                    top, held = v, count[at - 1] + wide(text[at - 1])
                score[at], count[at] = top, held
                while at < end:  # positions that no piece ends at
                    at += 1
                    score[at], count[at] = score[at - 1] + unk, count[at - 1] + wide(text[at - 1])
                at, top, held, single = end + 1, score[end + 1 - size] + s, count[end + 1 - size] + 1, size == 1
                continue
            # the longest match of an end comes first: candidates in order of their start
            if (v := score[at - size] + s) > top:
                top, held = v, count[at - size] + 1
            if size == 1:
                single = True
        if not single and (v := score[at - 1] + unk) > top:
            top, held = v, count[at - 1] + wide(text[at - 1])
        score[at], count[at] = top, held
        while at < n:
            at += 1
            score[at], count[at] = score[at - 1] + unk, count[at - 1] + wide(text[at - 1])
        return score[n], count[n]

    def _rounded(self, text: str) -> tuple[float, int]:
        """The same with every sum rounded to 32 bits, for any scores and both ways to
        count unknown characters."""
        n = len(text)
        score, count = array("f", [0.0]) * (n + 1), [0] * (n + 1)
        lost = [False] * (n + 1)  # whether the best path ends in an unknown character
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.auto.iter(text):
            found[end + 1].append(match)
        sum_ = array("f", [0.0])
        for e in range(1, n + 1):
            top = None
            for size, s in found[e]:
                sum_[0] = score[e - size] + s
                if top is None or sum_[0] > top:
                    top, held = sum_[0], count[e - size] + 1
            if not any(size == 1 for size, _ in found[e]):
                sum_[0] = score[e - 1] + self.unk
                if top is None or sum_[0] > top:
                    top, held, lost[e] = sum_[0], count[e - 1] + (1 << 32), True
                    if self.vocab.byte_fallback:
                        held += len(text[e - 1].encode("utf-8", "surrogatepass"))
                    else:
                        held += not lost[e - 1]
            score[e], count[e] = top, held
        return score[n], count[n]

    def _unknown(self, text: str) -> tuple[float, int, int]:
        """What an empty vocabulary makes of ``text``."""
        pieces = len(text.encode("utf-8", "surrogatepass")) if self.vocab.byte_fallback else bool(text)
        return self.unk * len(text), int(pieces), len(text)

    def _add(self, word: str) -> int:
        at = len(self.known)
        s, pieces, unknown = self.best(word)
        if at >= self.keep:
            at = self.keep  # one spare row, read at once
        else:
            self.known[word] = at
        self.score[at] = s
        self.count[at] = pieces, unknown
        return at

    def words(self, text: str) -> list[str]:
        """Cuts at which no piece can cross; their union is the normalised text."""
        if self.vocab.remove_extra:
            text = " ".join(x for x in text.split(" ") if x)
        if self.vocab.dummy_prefix and text:
            text = " " + text
        if not (self.by_word and self.vocab.byte_fallback):
            return [text.replace(" ", SPACE)] if text else []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        out, blanks = [], 0
        parts = text.split(" ")
        if parts[0]:
            out.append(parts[0])
        for p in parts[1:]:
            blanks += 1
            if p:
                out.append(SPACE * blanks + p)
                blanks = 0
        if blanks:
            out.append(SPACE * blanks)
        return out

    def measure(self, text: str | None) -> tuple[int, float, int]:
        """Pieces, score and unknown characters of the whole text."""
        if not text:
            return 0, 0.0, 0
        pieces, score, unknown = 0, 0.0, 0
        known, rows = self.known, []
        for w in self.words(text):
            for i, x in enumerate(w.split("\n")) if self.by_line and "\n" in w else ((0, w),):
                if i:  # the line feed before x
                    pieces, score, unknown = pieces + 1, score + self.unk, unknown + 1
                if x:
                    at = known.get(x)
                    if at is None:
                        at = self._add(x)
                        if at == self.keep:
                            pieces += int(self.count[at, 0])
                            score += float(self.score[at])
                            unknown += int(self.count[at, 1])
                            continue
                    rows.append(at)
        if rows:
            total = self.count[rows].sum(axis=0)
            pieces, unknown = pieces + int(total[0]), unknown + int(total[1])
            score += float(self.score[rows].sum())
        return pieces, score, unknown


def count_tokens(docs: DataFrame, vocab: UnigramVocab) -> DataFrame:
    """doc_id, n_tokens, score and n_unknown of every row of ``docs``.

    Null and empty texts count 0 with score 0; repeated rows are counted alike and null
    ids are kept; ties follow the module's rule; an empty table gives no rows; other
    columns are ignored. Memory is bounded by the kept words and one text, whatever its
    length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = Counter(vocab)
        for batch in batches:
            made = [counter.measure(t) for t in batch.column("text").to_pylist()]
            n, s, u = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(u, pa.int64())],
                ["doc_id", "n_tokens", "score", "n_unknown"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, score double, n_unknown bigint"
    )


def default_vocab_path() -> str:
    return os.environ.get("CAIRN_VOCAB", "/opt/tokenizers/piece_bpe_32k.model")


def op8_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, UnigramVocab.from_sentencepiece(default_vocab_path()))
