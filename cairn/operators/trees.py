"""File trees: reading them, flattening, building from events, and archive serialization.

A tree is flat: one row per node with the tree's id, its path below the root (the root has
the empty path), a kind (directory, regular, symlink), an executable flag, and data or a
target. Depth-first order with names ascending is the order of the split path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.cdc import ChunkParams, chunk_data

NODE = "tree string, path string, kind string, executable boolean, data binary, target string"
# fixed value: the first string of every archive
MAGIC = "nix-archive-1"


class TreeError(ValueError):
    """An event stream or node set that is no tree."""


def read_tree(spark: SparkSession, folder: str, marks: DataFrame | None = None) -> DataFrame:
    """The files below ``folder`` as nodes of one tree, read where they lie.

    File systems that Spark reads tell neither links nor mode bits: ``marks`` (path,
    executable, target) adds them; a path with a target is a symlink.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # the folder's own prefix, in the form in which files are listed
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    top = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).getPath().toString().rstrip("/")
    name = F.url_decode(F.regexp_replace(F.expr(f"substring(path, {len(top) + 2})"), r"\+", "%2B"))
    rows = files.select(F.lit("").alias("tree"), name.alias("path"), F.col("content").alias("data"))
    if marks is None:
        marks = spark.createDataFrame([], "path string, executable boolean, target string")
    both = rows.join(marks, "path", "full")
    link = F.col("target").isNotNull()
    return both.select(
        F.lit("").alias("tree"), "path", F.when(link, "symlink").otherwise("regular").alias("kind"),
        F.coalesce("executable", F.lit(False)).alias("executable"), F.when(~link, F.coalesce("data", F.lit(b""))).alias("data"), "target",
    )


def chunk_path(spark: SparkSession, folder: str, params: ChunkParams | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) of the tree below ``folder``; of equal chunks one row, the first in
    order of (path, position)."""
    nodes = flatten_tree(read_tree(spark, folder))
    cut = chunk_data(nodes.filter("kind = 'regular'"), params)
    first = F.min_by(F.struct("path", "pos", "size", "data"), F.struct(F.split("path", "/"), "pos"))
    return nodes, cut.groupBy("chunk").agg(first.alias("f")).select("chunk", "f.*")


def flatten_tree(leaves: DataFrame) -> DataFrame:
    """``leaves`` with the directories above them, and ``ordinal``: the depth-first place in
    the tree, names ascending, the root first."""
    parts = F.split("path", "/")
    above = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )
    dirs = leaves.select("tree", F.explode(above).alias("path")).distinct()
    fill = {"kind": F.lit("directory"), "executable": F.lit(False), "data": F.lit(None).cast("binary"), "target": F.lit(None).cast("string")}
    own = leaves.select("tree", "path", *fill)
    nodes = own.unionByName(dirs.join(own.select("tree", "path"), ["tree", "path"], "left_anti").withColumns(fill))
    order = Window.partitionBy("tree").orderBy(F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")))
    return nodes.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))


def build_tree(events: DataFrame) -> DataFrame:
    """Nodes from bracketed ``events`` (tree, seq, kind, name): start, end, or a leaf kind.

    Each tree's events stream past a stack of open directories. An end without a start, an
    open directory at the end, several roots, an empty stream and equal names in one
    directory are errors.
    """
    import pyarrow as pa

    def run(batches):
        now, stack, roots = None, [], 0

        def finish():
            if stack:
                raise TreeError(f"{now}: unclosed directory {stack[-1]!r}")

        for batch in batches:
            out = []
            for tree, kind, name in zip(*(batch.column(c).to_pylist() for c in ("tree", "kind", "name")), strict=True):
                if tree != now:
                    finish()
                    now, stack, roots = tree, [], 0
                if kind == "end":
                    if not stack:
                        raise TreeError(f"{tree}: end without start")
                    stack.pop()
                    continue
                if not stack:
                    roots += 1
                    if roots > 1:
                        raise TreeError(f"{tree}: multiple root nodes")
                # the root's own name is no part of the paths below it
                path = "/".join([*stack[1:], name]) if stack else ""
                out.append((tree, path, "directory" if kind == "start" else kind))
                if kind == "start":
                    stack.append(name)
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["tree", "path", "kind"])
        finish()

    rows = events.select("tree", "seq", "kind", "name").repartition("tree").sortWithinPartitions("tree", "seq")
    nodes = rows.mapInArrow(run, "tree string, path string, kind string")
    twice = F.raise_error(F.concat(F.col("tree"), F.lit(": duplicate entry "), F.col("path"))).cast("string")
    kind = F.when(F.count(F.lit(1)) == 1, F.first("kind")).otherwise(twice)
    return nodes.groupBy("tree", "path").agg(kind.alias("kind"))


def map_contents(nodes: DataFrame, change) -> DataFrame:
    """``nodes`` with ``change`` applied to the data of every regular file, and to no other."""
    return nodes.withColumn("data", F.when(F.col("kind") == "regular", change(F.col("data"))).otherwise(F.col("data")))


# -- wire format --------------------------------------------------------------------
def wire_number(n: Column) -> Column:
    """A 64-bit number as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def wire_string(s: Column) -> Column:
    """Length, bytes, and zeros up to a multiple of eight."""
    raw = s.cast("binary")
    size = F.octet_length(raw)
    return F.concat(wire_number(size), raw, F.unhex(F.repeat(F.lit("00"), F.pmod(-size, F.lit(8)))))


def _words(*words: str) -> Column:
    return F.concat(*[wire_string(F.lit(w)) for w in words])


def archive_pieces(nodes: DataFrame) -> DataFrame:
    """(tree, ordinal, piece): what each node of a flattened tree adds to its archive.

    A node opens itself (and the entry that it is), writes its content, and closes as many
    nodes as lie between it and the next one in order, which its depth tells.
    """
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    rows = nodes.withColumn("_d", depth)
    order = Window.partitionBy("tree").orderBy("ordinal")
    rows = rows.withColumn("_next", F.coalesce(F.lead("_d").over(order), F.lit(0)))
    name = wire_string(F.element_at(F.split("path", "/"), -1))
    opening = F.when(F.col("_d") > 0, F.concat(_words("entry", "(", "name"), name, _words("node"))).otherwise(_words(MAGIC))
    regular = F.concat(
        _words("(", "type", "regular"), F.when(F.col("executable"), _words("executable", "")).otherwise(F.lit(b"")),
        _words("contents"), wire_string(F.coalesce("data", F.lit(b""))),
    )
    body = (
        F.when(F.col("kind") == "regular", regular)
        .when(F.col("kind") == "symlink", F.concat(_words("(", "type", "symlink", "target"), wire_string(F.col("target"))))
        .otherwise(_words("(", "type", "directory"))
    )
    # closing a node below the root closes its entry, too
    leaves = F.col("_next") <= F.col("_d")
    one = F.hex(_words(")"))
    closed = F.when(leaves, F.col("_d") - F.greatest("_next", F.lit(1)) + 1).otherwise(0)
    root = F.when(F.col("_next") == 0, one).otherwise("")
    last = F.when((F.col("_next") == 0) & (F.col("_d") == 0), F.lit(0)).otherwise(closed)
    closing = F.unhex(F.concat(F.repeat(F.concat(one, one), last.cast("int")), root))
    return rows.select("tree", "ordinal", F.concat(opening, body, closing).alias("piece"))


def write_archives(nodes: DataFrame) -> DataFrame:
    """(tree, digest, size, blob): the archive of every flattened tree."""
    from cairn.operators.layout import joined_blobs

    return joined_blobs(archive_pieces(nodes), ["tree"], ["ordinal"], "piece")


# -- closure export -------------------------------------------------------------------
# fixed value: the marker between an archive and its path's record
EXPORT_MAGIC = 0x4558494E


def export_frames(paths: DataFrame, archives: DataFrame, store: str = "/store") -> DataFrame:
    """(path, frame): ``paths`` (path, references, deriver) with their archives (path, blob)
    framed for import; a path without archive is an error, never left out."""
    full = lambda c: F.concat(F.lit(f"{store}/"), c)
    refs = F.aggregate(F.transform("references", lambda r: wire_string(full(r))), F.lit(b""), lambda a, x: F.concat(a, x))
    nar = F.when(F.col("blob").isNotNull(), F.col("blob")).otherwise(F.raise_error(F.concat(F.lit("no archive of "), F.col("path"))).cast("binary"))
    frame = F.concat(
        wire_number(F.lit(1)), nar, wire_number(F.lit(EXPORT_MAGIC)), wire_string(full(F.col("path"))), wire_number(F.size("references")), refs,
        wire_string(F.coalesce(full(F.col("deriver")), F.lit(""))), wire_number(F.lit(0)),
    )
    return paths.join(archives.select("path", "blob"), "path", "left").select("path", frame.alias("frame"))
