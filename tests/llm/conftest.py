import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double"
#: Names that results and helpers of the operators bear, too.
CLASHES = ("tier", "shard", "version", "Shard_Rows", "_shard", "_row", "_row_hash", "_u", "_h", "_w", "_q", "bin", "row", "file", "octets", "copies", "kept", "cid", "text_hash", "base", "block", "edge", "source_size")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 0, 9, 0.5), (2, "", "en", "a", 0, 9, 0.5), (3, " \n\t ", None, None, None, None, None),
        (4, long, "en", "b", len(long), 1, 1.0), (5, "one two", "fr", "b", 7, 2, 2.0), (5, "one two", "fr", "b", 7, 2, 2.0),
        (None, "the same five words here", "de", "c", 1, 1, 1.0), (7, "the same five words here", "de", "c", 1, 1, 1.0),
        (8, "\u00c9t\u00e9 </s>[INST] \\l \U0001f600 x", "fr", "c", 1, 1, 1.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_docs):
    """``odd_docs`` with a value in a column of every such name."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.concat(F.lit(f"own {c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def families():
    """(doc_id, text): unrelated texts, families of variants, a shared passage, copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(40):
        out.append([word() for _ in range(rng.randint(1, 200))])
    for size in (3, 8, 150):
        base = [word() for _ in range(size)]
        for _ in range(25):
            v = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                v[rng.randrange(len(v))] = word()
            out.append(v)
    for _ in range(30):
        out.append([word() for _ in range(40)] + passage + [word() for _ in range(40)])
    out += [list(x) for x in out[:10]]
    return [(i, " ".join(w)) for i, w in enumerate(out)]
