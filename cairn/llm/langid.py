"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, a naive Bayes log
ratio over hashed byte trigrams, predicts that bit; the codeword with the least weighted
loss is the answer. Counts for the classifiers come from every training document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.words import crc_mod

#: A text without a letter is undetermined.
UND = "und"
#: Bytes: ASCII letters and all of UTF-8's others are kept, the rest is a space.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class LangConfig:
    """``buckets`` hashed trigrams; ``smooth`` is added to each bucket's share;
    ``margin`` is the gap of losses below which an answer is flagged ambiguous."""

    buckets: int = 1 << 15
    smooth: float = 0.5
    margin: float = 0.1
    piece: int = 1 << 20


def has_letter(text: str) -> bool:
    """Whether any character is a letter by its Unicode category (fractions, powers and
    letter-like numerals are none). Most texts show one at once."""
    return any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """An n x bits matrix of -1 and 1 with distinct, well separated rows.

    Up to 7 languages take the exhaustive code (every split into two non-empty sides);
    more take columns from a fixed generator, the best of several draws by least distance.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 2 ** (n - 1))]
        return np.array(cols, dtype=float).T
    bits = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        least = (bits - agree.max()) / 2
        if least > apart:
            best, apart = code, least
    return best


def _pieces(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, trigram bytes) of whole texts in pieces that overlap by two bytes.

    A text is folded, padded by a space at both ends, and runs of spaces shrink to one.
    """
    for i, t in enumerate(texts):
        if not t:
            continue
        b = b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(FOLD).split()) + b" "
        for at in range(0, max(len(b) - 2, 0), size):
            yield i, np.frombuffer(b, dtype=np.uint8, offset=at, count=min(size + 2, len(b) - at))


def _hashed(b: np.ndarray, buckets: int) -> np.ndarray:
    x = b.astype(np.uint32)
    key = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def _grouped(texts: list[str | None], cfg: LangConfig) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Pieces of several texts in one array: (text index of each piece, buckets, starts)."""
    at: list[int] = []
    parts: list[np.ndarray] = []
    total = 0
    for i, b in _pieces(texts, cfg.piece):
        h = _hashed(b, cfg.buckets)
        if len(h):
            at.append(i)
            parts.append(h)
            total += len(h)
        if total >= cfg.piece:
            yield at, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            at, parts, total = [], [], 0
    if parts:
        yield at, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def train_counts(train: DataFrame, cfg: LangConfig) -> DataFrame:
    """(lang, counts) over every trigram of every training text: a language's bucket counts
    as 64-bit integers, one row each. Sums are formed per task first."""

    def count(batches):
        # one row of counts per language: the state does not grow with the texts
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for at, h, starts in _grouped(texts, cfg):
                ends = np.append(starts[1:], len(h))
                for i, a, z in zip(at, starts, ends, strict=True):
                    c = sums.setdefault(langs[i], np.zeros(cfg.buckets, dtype=np.int64))
                    # short texts touch few buckets
                    if z - a < cfg.buckets // 8:
                        np.add.at(c, h[a:z], 1)
                    else:
                        c += np.bincount(h[a:z], minlength=cfg.buckets)
        for lang, c in sums.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(b), pa.string()), "bucket": b.astype(np.int32), "n": c[b]}
            )

    parts = train.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def fold(batches):
        """Rows in order of language -> one row with all its buckets."""
        now, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([held.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

        for batch in batches:
            bucket, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "n"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                if lang != now:
                    if held is not None:
                        yield row()
                    now, held = lang, np.zeros(cfg.buckets, dtype=np.int64)
                at = langs == lang
                held[bucket[at]] = n[at]
        if held is not None:
            yield row()

    dealt = summed.repartition("lang").sortWithinPartitions("lang")
    return dealt.select("lang", "bucket", "n").mapInArrow(fold, "lang string, counts binary")


@dataclass
class LangModel:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 and 1
    weights: np.ndarray  # buckets x bits, log ratio of the bit's two sides
    trust: np.ndarray  # weight of each bit in the decoding, sums to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log ratios (texts x bits) -> language index, score, gap of losses.

        A bit's margin is scaled to its spread between the languages and passed through
        the exponential loss; ``trust`` weighs the bits.
        """
        m = np.clip(margins / self.scale, -4, 4)
        loss = (np.exp(-m[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        near = loss - loss.min(axis=1, keepdims=True)
        p = np.exp(-2 * near)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)  # a tie goes to the first language by name
        if loss.shape[1] > 1:
            gap = np.partition(near, 1, axis=1)[:, 1]
        else:
            gap = np.full(len(loss), np.inf)
        return best, p[np.arange(len(p)), best], gap

    scale: np.ndarray = None  # set by fit


def fit(counts: list, cfg: LangConfig) -> LangModel | None:
    """The model from one (lang, counts) row per language."""
    found = {r["lang"]: np.frombuffer(r["counts"], dtype="<i8") for r in counts}
    if not found:
        return None
    langs = sorted(found)
    c = np.array([found[lang] + cfg.smooth for lang in langs])
    share = c / c.sum(axis=1, keepdims=True)  # every language counts alike
    code = codewords(len(langs))
    weights = np.zeros((cfg.buckets, code.shape[1]))
    for j in range(code.shape[1]):
        on, off = share[code[:, j] > 0], share[code[:, j] < 0]
        if len(on) and len(off):
            weights[:, j] = np.log(on.mean(axis=0) / off.mean(axis=0))
    # expected margin of each language, from its own trigram shares
    expected = share @ weights
    model = LangModel(langs, code, weights.astype(np.float32), np.ones(code.shape[1]))
    spread = np.abs(expected)
    model.scale = np.maximum(spread.mean(axis=0) / 2, 1e-6)
    right = np.maximum((expected * code).min(axis=0) / model.scale, 0.05)
    model.trust = right / right.sum()
    return model


def predict(docs: DataFrame, model: LangModel | None, cfg: LangConfig) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> with lang_pred, score and ambiguous."""

    def label(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            langs, score, unsure = [UND] * n, np.zeros(n), np.ones(n, dtype=bool)
            if model is not None:
                sums = np.zeros((n, model.weights.shape[1]))
                size = np.zeros(n)
                for at, h, starts in _grouped(texts, cfg):
                    np.add.at(sums, at, np.add.reduceat(model.weights[h], starts, axis=0))
                    np.add.at(size, at, np.diff(np.append(starts, len(h))))
                best, p, gap = model.decode(sums / np.maximum(size, 1)[:, None])
                for i, t in enumerate(texts):
                    if t and has_letter(t):
                        langs[i], score[i], unsure[i] = model.langs[best[i]], p[i], gap[i] < cfg.margin
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        label, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def identify_languages(docs: DataFrame, train: DataFrame, cfg: LangConfig | None = None) -> DataFrame:
    """Labels ``docs`` (doc_id, text, held_out) by a model learned from ``train``.

    Null or empty text, and text without a letter, is ``und`` with score 0, as is all
    text when ``train`` is empty or has no row with text and lang. Whole texts count,
    however long; equal losses go to the first language by name; repeated rows are
    labelled alike and null ids are kept; an empty table gives no rows. Other columns are
    ignored.
    """
    cfg = cfg or LangConfig()
    usable = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(docs, fit(train_counts(usable, cfg).collect(), cfg), cfg)


def op1_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return identify_languages(docs, docs.filter(~F.col("held_out")))
