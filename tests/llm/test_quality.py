import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from cairn.llm.quality import QualityConfig, distinct_texts, score_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def grams(text, b):
    c = [zlib.crc32(x.encode()) for x in WORD.findall(text or "")]
    return [x % b for x in c] + [(x * 31 + y) % b for x, y in zip(c, c[1:])]


def fold(text, k):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:4], 16) % k


def test_against_brute_force(spark, sf):
    cfg = QualityConfig()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    rows = docs.collect()
    trusted = {r.text for r in rows if r.doc_id in good}
    raw, target = collections.Counter(), [collections.Counter() for _ in range(cfg.folds)]
    for text in {r.text for r in rows}:
        g = grams(text, cfg.buckets)
        raw.update(g)
        for k in range(cfg.folds):
            if text in trusted and fold(text, cfg.folds) != k:
                target[k].update(g)
    flat = cfg.alpha * cfg.buckets
    rn, w = sum(raw.values()), []
    for t in target:
        tn = sum(t.values())
        w.append([round(1e6 * math.log((t[b] + cfg.alpha) / (tn + flat) / ((raw[b] + cfg.alpha) / (rn + flat)))) for b in range(cfg.buckets)])
    score = {}
    for r in rows:
        own = w[fold(r.text, cfg.folds)]
        score[r.doc_id] = sum(own[b] for b in grams(r.text, cfg.buckets)) / (max(2 * features(r.text)[0] - 1, 1) * 1e6)
    bars = sorted(math.floor(score[r.doc_id] * 10_000) for r in rows if r.doc_id in good and features(r.text)[0] >= 50)
    low, mid = bars[math.ceil(cfg.low * len(bars)) - 1], bars[math.ceil(0.5 * len(bars)) - 1]
    least = (low - cfg.spread * (mid - low)) * cfg.grain
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        f = features(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == f
        assert abs(g.score - score[r.doc_id]) < 1e-9
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert g.base_failed == failed
        assert g.kept == (not failed and score[r.doc_id] >= least)


def verdicts(spark, d, held):
    """(good, bad, plain): verdicts on documents whose label was kept from the target, and
    on unlabelled documents without the marks of the low-quality ones."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known = labels.filter(~held)
    marks = F.regexp_count("text", F.lit(r"###|\$\$\$|%%%|&&&|\*\*\*| \| "))
    rows = score_quality(docs, known).filter("NOT base_failed").withColumn("marks", marks).join(labels.withColumn("held", held), "doc_id", "left").collect()
    good = [r.kept for r in rows if r.held and r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.held and r.quality == 0]
    plain = [r.kept for r in rows if r.quality is None and r.marks <= 5]
    return good, bad, plain


def test_labels_kept_apart_are_told_apart(spark):
    share = lambda x: sum(x) / len(x)
    good, bad, plain = verdicts(spark, "/root/testdata/sf0.1", F.col("doc_id") % 3 == 0)
    assert share(good) > 0.99 and share(plain) > 0.99 and sum(bad) == 0 and len(bad) > 50
    # few labels: lenient, but clean documents stay
    good, bad, plain = verdicts(spark, "/root/testdata/sf0.01", F.col("doc_id") % 3 == 0)
    assert share(good) > 0.98 and share(plain) > 0.98 and share(bad) < 0.5


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = score_quality(odd_docs, labels).collect()
    assert len(rows) == 9
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id != 4)
    long = next(r for r in rows if r.doc_id == 4)
    assert long.n_words == 20_000 and long.n_repeat_words == 20_000 and long.base_failed
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert score_quality(no_docs, labels).count() == 0
    assert {r.score for r in score_quality(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_many_repeated_windows(spark):
    rng = __import__("random").Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 4, 10, 80, 400)] + ["a b c d e f g a b c x", "x\n\nx\n x\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for r in score_quality(docs, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == features(texts[r.doc_id])


def test_clashing_names(spark, clashing_docs):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int")
    made = score_quality(clashing_docs, labels)
    own = [c for c in clashing_docs.columns if c not in ("kept", "score")]
    assert made.select(*own).exceptAll(clashing_docs.select(*own)).count() == 0 and made.count() == clashing_docs.count()


def test_each_text_once(spark):
    rows = [(1, "a b"), (2, "a b"), (2, "a b"), (3, "c"), (None, "c"), (None, "d"), (None, "d"), (4, "e"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(2, 1), (4, 1)], "doc_id bigint, _t int")
    made = sorted((r.text, r["_t"]) for r in distinct_texts(docs, target).collect())
    assert made == [("", None), ("a b", 1), ("c", None), ("d", None), ("e", 1)]
