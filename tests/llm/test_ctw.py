import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import ctw


def kt_block(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """The plain tree: a dictionary of nodes, walked bit by bit."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def steps(self, data):
        for i in range(self.depth, len(data)):
            if data[i] == ctw.BEFORE:
                continue
            prefix = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield [(bytes(data[i - d : i]), prefix) for d in range(self.depth + 1)], bit
                prefix = prefix << 1 | bit

    def learn(self, data):
        for path, bit in self.steps(data):
            for node in path:
                self.n.setdefault(node, [0, 0])[bit] += 1

    def weigh(self):
        self.w, below = {}, {}
        for node in sorted(self.n, key=lambda x: -len(x[0])):
            own = kt_block(*self.n[node])
            if len(node[0]) == self.depth:
                self.w[node] = own
            else:
                high, low = max(own, below[node]), min(own, below[node])
                self.w[node] = high + math.log1p(math.exp(low - high)) - math.log(2)
            if node[0]:
                up = (node[0][1:], node[1])
                below[up] = below.get(up, 0.0) + self.w[node]
        self.below = below

    def score(self, data):
        total = 0.0
        for path, bit in self.steps(data):
            p = None
            for d in range(self.depth, -1, -1):
                a = self.n.get(path[d], [0, 0])
                own = (a[bit] + 0.5) / (sum(a) + 1)
                if d == self.depth:
                    p = own
                else:
                    share = 1 / (1 + math.exp(min(self.below.get(path[d], 0.0) - kt_block(*a), 700.0)))
                    p = share * own + (1 - share) * p
            total += math.log10(p)
        return total


TEXTS = ["the cat sat", "the hat", "A cat\nsat on the mat", "", None, "été à la mer", "zzz unseen qq", "the cat sat", "x"]


def test_against_the_plain_tree(spark):
    docs = spark.createDataFrame([(i, t, i % 4 == 2) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, held_out boolean")
    rows = {r.doc_id: r for r in ctw.score_texts(docs.repartition(3)).collect()}
    tree = Tree(ctw.DEPTH)
    words = [ctw.split_words(t and t.encode()) for t in TEXTS]
    for i, w in enumerate(words):
        if i % 4 != 2:
            tree.learn(ctw.coded(w))
    tree.weigh()
    tokens = [x for i, w in enumerate(words) if i % 4 != 2 for x in [*w, None]]
    n, v = len(tokens), len(set(tokens))
    for i, w in enumerate(words):
        r = rows[i]
        assert r.score == pytest.approx(tree.score(ctw.coded(w)), abs=1e-4)
        assert (r.n_tokens, r.train_tokens) == (len(w) + 1, n)
        assert r.n_known == sum(x in tokens for x in [*w, None])
        assert r.base_score == pytest.approx(sum(math.log10((tokens.count(x) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]))


def test_the_query_against_the_plain_tree(spark, sf, tmp_path):
    """The query itself over a table of forty documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id BETWEEN 60 AND 99")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in ctw.op7_context_tree_weighting(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: ctw.split_words((r.text or "").encode()) for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    tree, count = Tree(ctw.DEPTH), collections.Counter()
    for i in texts.keys() - held:
        tree.learn(ctw.coded(texts[i]))
        count.update([*texts[i], None])
    tree.weigh()
    n, v = count.total(), len(count)
    assert rows.keys() == texts.keys() and held
    for i, w in texts.items():
        r = rows[i]
        assert r.held_out == (i in held) and (r.n_tokens, r.train_tokens) == (len(w) + 1, n)
        assert r.n_known == sum(count[x] > 0 for x in [*w, None])
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]))
        assert r.score == pytest.approx(tree.score(ctw.coded(w)), rel=1e-6)


def test_blocks_of_any_size_score_alike(spark, sf, monkeypatch):
    """Parts cut into many blocks, and blocks handed on in parts, change no score."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("held_out"))
    plain = {r.doc_id: r for r in ctw.score_texts(docs.coalesce(1)).collect()}
    for name, value in (("BLOCK", 20_000), ("HELD", 50), ("HELD_PAIRS", 2000), ("PIECE", 3000), ("MIX", 500)):
        monkeypatch.setattr(ctw, name, value)
    cut = {r.doc_id: r for r in ctw.score_texts(docs.repartition(5)).collect()}
    assert cut.keys() == plain.keys()
    for i, r in plain.items():
        assert cut[i].score == pytest.approx(r.score, rel=1e-9) and cut[i].base_score == pytest.approx(r.base_score)
        assert (cut[i].n_known, cut[i].n_tokens, cut[i].train_tokens) == (r.n_known, r.n_tokens, r.train_tokens)


def test_probabilities_of_next_bytes_sum_to_one(spark):
    """Over all 256 next bytes of one context; unseen ones join with count 0."""
    seen = {b"abcde": {ord("f"): 5, ord("g"): 1}, b"zbcde": {ord("f"): 2}}
    key = lambda c, x: int.from_bytes(c + bytes([x]), "big")
    gram = {key(b"abcde", x): 0 for x in range(256)}
    for c, n in seen.items():
        gram |= {key(c[-ctw.DEPTH :], x): k for x, k in n.items()}
    leaves, n = np.array(sorted(gram)), np.array([gram[g] for g in sorted(gram)])
    p, nodes = ctw.mix_leaves(leaves, n)
    # every leaf ends in "cde": depth 2 is one table, depth 1 one byte
    two = nodes["near"] & 0xFFFF
    assert set(two) == {int.from_bytes(b"de", "big")}
    lw, own = ctw._mixed(nodes["a"], nodes["b"], nodes["lw"])
    table = ctw.Depth2(nodes["prefix"], nodes["a"], nodes["b"], own)
    head = ctw.top_mixture(list(zip(two & 255, nodes["prefix"], nodes["a"], nodes["b"], lw)))
    here = leaves >> 8 == key(b"abcde", 0) >> 8
    total = (10 ** table.values(leaves.astype(np.uint64), p, head))[here].sum()
    assert here.sum() == 256
    assert total == pytest.approx(1.0, abs=1e-5)


def test_held_out_text_is_scored_better_than_by_words_alone(spark):
    rows = ctw.op7_context_tree_weighting(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("held_out", F.lit(False))
    rows = ctw.score_texts(docs).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert ctw.score_texts(no_docs.withColumn("held_out", F.lit(False))).count() == 0
    untaught = ctw.score_texts(odd_docs.withColumn("held_out", F.lit(True))).collect()
    assert {r.train_tokens for r in untaught} == {0} and {r.n_known for r in untaught} == {0}


def test_lookup_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 5000).astype(np.uint64))
    find = ctw._Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.arange(1000, dtype=np.uint64), keys)
    assert (find(other) == len(keys)).all()
    assert (ctw._Lookup(keys[:0])(other) == 0).all()
