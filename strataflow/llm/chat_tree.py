"""Chat formatting with a prefix tree over conversations (operator 5).

A turn is formatted as ``<s>role`` + line feed + ``text</s>``. Inside roles and texts a backslash goes before each backslash and
before each control string (``<s> </s> [INST] [/INST]``, in roles the line feed too), which is undone by dropping it. Conversations
that begin with the same turns share those turns' nodes: a node's key is the digest of its parent's key and its own turn.

``tree`` gives the nodes, each once, in depth-first order: ``offset`` is the node's place in the packed text of all
trees, ``position`` the position id of its first character (that of the conversation's own text), and the loss mask
covers the texts of assistant turns. It has a row for each conversation, too, with ``attends``: the intervals of the packed text that the
characters of its last turn may attend to, which are its ancestors and itself. ``packed`` is the text as it is trained on, in blocks: each with its
characters, their loss mask and the position ids of the turns that begin there. ``read_back`` has the blocks and the intervals only.

The order is that of the conversations sorted by their turns, so no tree has to fit a task; offsets are running sums inside
sorted partitions plus the sums of the partitions before.

Rows of equal turn are ordered by role, then text. Null text or role: empty. Null turn: before all others. Each row of a null conv_id
is a conversation of its own. Very long texts: a node may span many blocks; a conversation is one row. Repeated rows are turns of their own. Empty
table: no rows. Columns other than conv_id, turn, role and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_dealt, written

#: Fixed values of the template.
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
_TURN = re.compile(r"<s>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)</s>", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Characters of a block.
BLOCK = 4096


def escaped(text: Column, control: str = _CONTROL) -> Column:
    return F.regexp_replace(text, control, r"\\$1")


def _sorted_convs(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns, path, ord``: a row for each conversation, ord following the order of the turns' digests."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], _CONTROL[:-1] + r"|\n)"), F.lit("\n"))
    body = lambda t: escaped(t["text"])
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda t: F.struct(F.concat(head(t), body(t), F.lit(CLOSE)).alias("segment"), F.length(head(t)).alias("text_from"), F.length(body(t)).alias("text_chars"), (t["role"] == "assistant").alias("loss")),
    )
    convs = rows.groupBy("conv_id", "alone").agg(turns.alias("turns")).drop("alone")
    convs = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["segment"])))
    return convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("ord", F.monotonically_increasing_id())


_STEPS = "ord long, depth int, node binary, parent binary, position long, segment string, text_from int, text_chars int, loss boolean"


def _steps(convs: DataFrame) -> DataFrame:
    """A row for each turn of each conversation, with its node's key."""
    names = [c.split()[0] for c in _STEPS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            sizes = np.diff(turns.offsets.to_numpy())
            own = turns.flatten()
            segments = own.field("segment").to_pylist()
            depth, nodes, parents, positions = [], [], [], []
            at = 0
            for n in sizes.tolist():
                key, position = None, 0
                for d in range(n):
                    parents.append(key)
                    key = hashlib.md5((key or b"") + segments[at + d].encode()).digest()
                    nodes.append(key)
                    depth.append(d)
                    positions.append(position)
                    position += len(segments[at + d])
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(depth, pa.int32()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), pa.array(positions, pa.int64()), *(own.field(c) for c in names[5:])], names=names
            )

    return convs.select("ord", "turns").mapInArrow(run, _STEPS)


def tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: ``node, parent, depth, segment, text_from, text_chars, loss, position, offset``.
    paths: ``ord, conv_id, attends array<struct<offset, end>>``.
    """
    convs = written(_sorted_convs(conversations))
    steps = _steps(convs)
    same = ("parent", "segment", "text_from", "text_chars", "loss", "position", "depth")
    nodes = steps.groupBy("node").agg(F.min("ord").alias("ord"), F.count("*").alias("weight"), *(F.first(c).alias(c) for c in same))
    ordered = nodes.repartitionByRange("ord", "depth").sortWithinPartitions("ord", "depth").withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumn("n", F.length("segment").cast("long")).withColumn("local", F.lit(0).cast("long"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            ends = total + np.cumsum(batch.column("n").to_numpy())
            i = batch.schema.get_field_index("local")
            yield batch.set_column(i, "local", pa.array(ends - batch.column("n").to_numpy(), pa.int64()))
            total = int(ends[-1]) if len(ends) else total

    local = written(ordered.mapInArrow(running, ordered.schema))
    # A row for each partition: its number is a setting, not a size of the data.
    sums = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, bases = 0, []
    for part, n in sums:
        bases.append((part, before))
        before += n
    base = conversations.sparkSession.createDataFrame(bases, "part int, base long")
    nodes = local.join(F.broadcast(base), "part").select("node", "parent", "depth", "segment", "text_from", "text_chars", "loss", "position", (F.col("base") + F.col("local")).alias("offset"), "weight")

    n_steps = convs.agg(F.sum(F.size("turns"))).first()[0] or 0
    places = nodes.select("node", "offset", (F.col("offset") + F.length("segment")).alias("end"), "weight")
    placed = join_dealt(steps.select("ord", "depth", "node"), places, "node", n_steps)
    spans = placed.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("depth", "offset", "end"))).alias("p"))
    # A node that follows its parent at once, as the first child does, extends the parent's interval.
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1)["end"] != x["offset"]))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1)["offset"] != x["end"]))
    attends = F.zip_with(starts, ends, lambda a, b: F.struct(a["offset"].alias("offset"), b["end"].alias("end")))
    return nodes.drop("weight"), spans.select("ord", attends.alias("attends")).join(convs.select("ord", "conv_id"), "ord")


def packed(nodes: DataFrame) -> DataFrame:
    """``block, text, mask, starts array<struct<at, position>>``: the packed text of all trees; mask: 1 for each character that counts for the loss."""
    n = F.length("segment")
    mask = F.concat(F.repeat(F.lit("0"), F.col("text_from")), F.repeat(F.when(F.col("loss"), "1").otherwise("0"), F.col("text_chars")), F.repeat(F.lit("0"), n - F.col("text_from") - F.col("text_chars")))
    rows = nodes.select("offset", "position", "segment", mask.alias("mask"), F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + n - 1) / BLOCK))).alias("block"))
    first, last = F.greatest(F.col("offset"), F.col("block") * BLOCK), F.least(F.col("offset") + n, (F.col("block") + 1) * BLOCK)
    cut = lambda c: F.substring(c, (first - F.col("offset") + 1).cast("int"), (last - first).cast("int")).alias(c)
    rows = rows.select("block", F.struct((first - F.col("block") * BLOCK).cast("int").alias("at"), cut("segment"), cut("mask"), F.when(first == F.col("offset"), F.col("position")).alias("position")).alias("x"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    starts = F.transform(F.filter("x", lambda x: x["position"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["position"].alias("position")))
    return blocks.select("block", *(F.array_join(F.col("x")[c], "").alias(a) for c, a in (("segment", "text"), ("mask", "mask"))), starts.alias("starts"))


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``packed`` blocks, paths): what a training run reads."""
    nodes, paths = tree(conversations)
    return packed(nodes), written(paths)


_READ = "ord long, conv_id long, turns array<struct<role:string,text:string>>, formatted string, loss_text string, positions array<long>"


def read_back(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """``ord, conv_id, turns, formatted, loss_text, positions``: each conversation as its intervals of the packed text have it; positions: those of its turns' first characters."""
    blocks = written(blocks)
    steps = paths.select("ord", "conv_id", F.posexplode("attends").alias("nth", "a"))
    steps = steps.select("ord", "conv_id", "nth", "a", F.explode(F.sequence(F.floor(F.col("a.offset") / BLOCK), F.floor((F.col("a.end") - 1) / BLOCK))).alias("block"))
    first, last = F.greatest(F.col("a.offset"), F.col("block") * BLOCK), F.least(F.col("a.end"), (F.col("block") + 1) * BLOCK)
    steps = written(steps.select("ord", "conv_id", "nth", "block", (first - F.col("block") * BLOCK).cast("int").alias("first"), (last - first).cast("int").alias("n")))
    weights = steps.groupBy("block").agg(F.count("*").alias("weight"))
    seen = join_dealt(steps, blocks.join(weights, "block"), "block", steps.count(), per=1000)
    inside = F.filter("starts", lambda s: (s["at"] >= F.col("first")) & (s["at"] < F.col("first") + F.col("n")))
    cut = lambda c: F.substring(F.col(c), F.col("first") + 1, F.col("n")).alias(c)
    seen = seen.select("ord", "conv_id", F.struct("nth", "block", cut("text"), cut("mask"), F.transform(inside, lambda s: s["position"]).alias("positions")).alias("x"))
    whole = seen.groupBy("ord", "conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = whole.select("ord", "conv_id", *(F.array_join(F.col("x")[c], "").alias(c) for c in ("text", "mask")), F.flatten(F.col("x")["positions"]).alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda s: _ESCAPE.sub(r"\1", s)
        for batch in batches:
            turns, losses = [], []
            for text, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns.append([{"role": plain(m[1]), "text": plain(m[2])} for m in _TURN.finditer(text)])
                losses.append(plain("".join(text[m.start() : m.end()] for m in re.finditer("1+", mask))))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind), batch.column(2), pa.array(losses, pa.string()), batch.column(4)], names=["ord", "conv_id", "turns", "formatted", "loss_text", "positions"])

    return whole.mapInArrow(run, _READ)


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.sha2(F.array_join(F.col("positions").cast("array<string>"), ","), 256).alias("positions_sha256"),
    )
