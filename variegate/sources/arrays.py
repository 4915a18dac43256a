"""Nested JSON arrays of any size: read in many tasks, written in ordered parts.

A document is one array in one file, or in several that make it up in the order of their names.
Spark reads it in pieces between commas, a block of the file in each task. Quotes and brackets before
a block are unknown to its task, so a first pass sums each block up for both cases, within a string
and outside; the sums of all blocks in order, a row for each, give every block its state. A second
pass cuts the items. Only items that cross the bounds of blocks are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.session import cut_lineage

_ESCAPED = re.compile(r"\\.", re.S)
_BATCH_CHARS = 1 << 22


def _depth(text: str) -> int:
    return text.count("[") + text.count("{") - text.count("]") - text.count("}")


def piece_shape(piece: str) -> tuple[int, int, int]:
    """Quotes of a piece, and the change of depth if it begins outside a string, or within one."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    if len(parts) == 1:
        return 0, _depth(piece), 0
    return len(parts) - 1, sum(map(_depth, parts[::2])), sum(map(_depth, parts[1::2]))


class _Walk:
    """State along a document: within a string or not, depth, and the place at each depth.

    ``places`` counts the commas at a depth since one of a lower depth, ``least`` is the lowest
    depth of any comma.
    """

    def __init__(self, inside: int = 0, depth: int = 0, places: dict[int, int] | None = None):
        self.inside, self.depth = inside, depth
        self.places = dict(places or {})
        self.least: int | None = None

    def comma(self) -> int | None:
        """Pass a comma; its depth, or None if it is text."""
        if self.inside:
            return None
        self.places = {d: n for d, n in self.places.items() if d <= self.depth}
        self.places[self.depth] = self.places.get(self.depth, 0) + 1
        self.least = self.depth if self.least is None else min(self.least, self.depth)
        return self.depth

    def piece(self, shape: tuple[int, int, int]) -> None:
        quotes, outside, within = shape
        self.depth += within if self.inside else outside
        self.inside ^= quotes & 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value")


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    for batch in batches:
        for file, block, size, value in zip(*[batch[c].to_pylist() for c in
                                              ("file", "block", "size", "value")]):
            own = held.get((file, block, size))
            if own is None:
                own = held[file, block, size] = [[_Walk(0), _Walk(1)], 0, not block, False]
            shape, octets = piece_shape(value), len(value.encode("utf-8", "surrogatepass"))
            for walk in own[0]:
                if not own[2]:  # all but the first piece of a file stand behind a comma
                    walk.comma()
                walk.piece(shape)
            own[1] += octets + (not own[2])
            own[2] = False
            own[3] = own[3] or not value.isspace() and value != ""
    rows = []
    for (file, block, size), (walks, octets, _, filled) in held.items():
        ends = [{"inside": w.inside, "depth": w.depth, "least": w.least,
                 "places": sorted(w.places.items())} for w in walks]
        rows.append({"file": file, "block": block, "size": size, "octets": octets,
                     "filled": filled, "ends": json.dumps(ends)})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()),
             ("octets", pa.int64()), ("filled", pa.bool_()), ("ends", pa.string())]))


def _in_order(name: str) -> list:
    """Names by their text and numbers, so that part 99999 comes before part 100000."""
    return [int(bit) if bit.isdigit() else bit for bit in re.split(r"(\d+)", name)]


def _states(summary: list) -> dict[tuple[str, int], tuple]:
    """For each block the place of its file, the state before it, and whether its file ends with a
    comma that follows it."""
    blocks = sorted(summary, key=lambda r: (_in_order(r["file"]), r["block"]))
    places = {file: i for i, file in enumerate(dict.fromkeys(r["file"] for r in blocks))}
    octets: dict[str, int] = {}
    for r in blocks:
        octets[r["file"]] = octets.get(r["file"], 0) + r["octets"]
    walk, states, begun = _Walk(), {}, False
    for i, r in enumerate(blocks):
        if begun and r["filled"] and not (walk.depth or walk.inside):
            raise ValueError(f"{r['file']}: a second array, whose positions would collide")
        begun = begun or r["filled"]
        own = json.loads(r["ends"])[walk.inside]
        last = i + 1 == len(blocks)
        ends_file = last or blocks[i + 1]["file"] != r["file"]
        comma = ends_file and octets[r["file"]] < r["size"]
        states[r["file"], r["block"]] = (places[r["file"]], walk.inside, walk.depth,
                                         dict(walk.places), comma)
        base = walk.depth
        if own["least"] is not None:
            if base + own["least"] <= 0:
                raise ValueError(f"{r['file']}: a comma outside the array")
            walk.places = {d: n for d, n in walk.places.items() if d <= base + own["least"]}
        for depth, n in own["places"]:
            walk.places[base + depth] = walk.places.get(base + depth, 0) + n
        walk.inside, walk.depth = own["inside"], base + own["depth"]
        if comma and (walk.comma() or 1) <= 0 or comma and last:
            raise ValueError(f"{r['file']}: a comma behind the array")
    if walk.inside or walk.depth:
        raise ValueError("the array is not closed, or its quotes are not")
    return states


def _cutting(sent, level: int):
    """Pieces to items: path, order, text, depth before and after, and whether that is all of it."""
    schema = pa.schema([("at", pa.list_(pa.int32())), ("file", pa.int32()), ("block", pa.int64()),
                        ("part", pa.int32()), ("text", pa.string()), ("head", pa.int32()),
                        ("tail", pa.int32()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk, held, begun, head, at, part, comma = None, None, [], False, 0, None, 0, False
        number = 0
        out, chars = [], 0

        def put(whole: bool, more: str = "") -> None:
            nonlocal held, chars, part
            text = ",".join(held) + more
            out.append({"at": at, "file": number, "block": key[1], "part": part, "text": text,
                        "head": head if begun else None, "tail": walk.depth, "whole": whole})
            held, part = [], part + 1
            chars += len(text)

        def path() -> list[int]:
            return [walk.places.get(d, 0) for d in range(1, level + 1)]

        for batch in batches:
            for file, block, value in zip(*[batch[c].to_pylist() for c in ("file", "block", "value")]):
                first = (file, block) != key
                if first:
                    if key is not None:
                        put(False, "," if comma else "")
                    key, part = (file, block), 0
                    number, inside, depth, places, comma = sent.value[key]
                    walk = _Walk(inside, depth, places)
                    begun, head, at = False, walk.depth, path()
                if not first or block:
                    found = walk.comma()
                    if found is not None and found <= level:
                        if not first:
                            put(begun)
                        begun, head, at = True, walk.depth, path()
                    elif first:
                        held.append("")  # the comma is text of an item that began before
                walk.piece(piece_shape(value))
                held.append(value)
                if chars > _BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, chars = [], 0
        if key is not None:
            put(False, "," if comma else "")
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def bare_item(text: str, head: int, tail: int, level: int) -> tuple[int, str]:
    """An item without the brackets of the arrays around it, and the depth at which it stands."""
    text, depth = text.strip(), head
    while depth < level and text.startswith("["):
        text, depth = text[1:].lstrip(), depth + 1
    for _ in range(depth - tail):
        if not text.endswith("]"):
            raise ValueError(f"an item of other brackets: {text[-40:]}")
        text = text[:-1].rstrip()
    return depth, text


def _baring(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, head, tail in zip(*[batch[c].to_pylist() for c in ("text", "head", "tail")]):
                depth, own = bare_item(text, head, tail, level)
                if not own and (head >= depth or tail >= depth):
                    raise ValueError("nothing between two commas, or a comma and a bracket")
                if depth < level and own not in ("", "null"):
                    raise ValueError(f"no array of depth {level}: {own[:40]}")
                found.append((depth, own))
            yield pa.RecordBatch.from_arrays(
                [batch["at"], pa.array([t for _, t in found], pa.string()),
                 pa.array([d == level and t != "" for d, t in found], pa.bool_())],
                names=["at", "item", "there"])

    return run


def read_items(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """``at, item``: the places of an item at each depth down to ``level``, from 0, and its JSON text.

    ``path`` holds one nested array, in one file or in parts. Level 1 are the items of the array,
    level 2 those of its items, which must be arrays, and so on; an empty array and a null above the
    level have no row. Places are positions in the arrays. Text that is no such array is an error:
    brackets or quotes that do not close, commas or anything else outside, a second array. A single
    item must fit into a task. Files are read twice, by blocks, and a row for each block reaches the
    driver.
    """
    pieces = _pieces(spark, path)
    summary = pieces.mapInArrow(
        _summed_up, "file string, block long, size long, octets long, filled boolean, "
                      "ends string").collect()
    if not summary:
        raise ValueError(f"no document under {path}")
    sent = spark.sparkContext.broadcast(_states(summary))
    cut = cut_lineage(pieces.select("file", "block", "value").mapInArrow(
        _cutting(sent, level), "at array<int>, file int, block long, part int, text string, "
                               "head int, tail int, whole boolean"))
    sent.unpersist()
    place = F.struct("file", "block", "part")
    bits = F.sort_array(F.collect_list(F.struct("file", "block", "part", "text")))
    crossing = cut.where(~F.col("whole")).groupBy("at").agg(
        F.concat_ws("", F.transform(bits, lambda b: b["text"])).alias("text"),
        F.min_by("head", place).alias("head"), F.max_by("tail", place).alias("tail"))
    whole = cut.where("whole").select("at", "text", "head", "tail")
    first = F.coalesce("head", F.lit(0)).alias("head")  # the document's first item begins at depth 0
    return whole.union(crossing).select("at", "text", first, "tail") \
        .mapInArrow(_baring(level), "at array<int>, item string, there boolean") \
        .where("there").select("at", "item")


def parsed(item: Column, schema: str) -> Column:
    """An item's value; text that is not of the schema is an error, null is null."""
    value = F.from_json(item, schema, {"mode": "FAILFAST"})
    problem = F.raise_error(F.concat(F.lit("not an item of the expected form: "), F.substring(item, 1, 80)))
    return F.when(item == "null", F.lit(None).cast(schema)).when(value.isNotNull(), value) \
        .otherwise(problem.cast(schema))


def _joining(sent):
    """Rows in order to the lines of a nested array, each with the signs between it and the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ending = None, ""
        for batch in batches:
            lines = []
            for part, outer, inner, there, value in zip(*[
                    batch[c].to_pylist() for c in ("part", "outer", "inner", "there", "value")]):
                if before is None:
                    before, ending = sent.value[part]
                if before[0] is None:
                    lead = "[[["
                elif outer != before[0]:
                    lead = "]],[["
                elif inner != before[1]:
                    lead = "],["
                else:
                    lead = "," if before[2] else ""
                lines.append(lead + (value if there else ""))
                before = (outer, inner, there)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if ending:
            yield pa.RecordBatch.from_arrays([pa.array([ending], pa.string())], names=["value"])

    return run


def write_nested(df: DataFrame, path: str, value: str = "answer", order: str = "answer_idx",
                 keys: tuple[str, str] = ("task_idx", "query_idx"),
                 mode: str = "errorifexists") -> None:
    """Write rows as one nested JSON array, in parts that make it up in the order of their names.

    The array has one array for each value of the first key, in order, that holds one for each value
    of the second, and that one the values by ``order``. A row whose order is null lists its keys
    only; a null value is a null. Equal rows are written as often as they are there. Rows are sorted
    over all tasks, and each part begins with the signs that the last row before it calls for, of
    which one for each part reaches the driver. Without rows the array is empty.
    """
    spark = df.sparkSession
    own = df.select(F.col(keys[0]).alias("outer"), F.col(keys[1]).alias("inner"),
                    F.col(order).alias("order"), F.to_json(F.array(value), {"ignoreNullFields": "false"})
                    .alias("value"))
    by = [F.col(c).asc_nulls_first() for c in ("outer", "inner", "order", "value")]
    rows = cut_lineage(own.repartitionByRange(*by).sortWithinPartitions(*by)) \
        .withColumn("part", F.spark_partition_id())
    last = F.struct("outer", "inner", F.col("order").isNotNull().alias("there"))
    ends = rows.groupBy("part").agg(F.max(last).alias("last")).orderBy("part").collect()
    if not ends:
        spark.createDataFrame([("[]",)], "value string").write.mode(mode).text(path)
        return
    before, starts = (None, None, False), {}
    for i, r in enumerate(ends):
        starts[r["part"]] = (before, "]]]" if i + 1 == len(ends) else "")
        before = tuple(r["last"])
    sent = spark.sparkContext.broadcast(starts)
    inside = F.substring("value", F.lit(2), F.char_length("value") - 2)
    rows.select("part", "outer", "inner", F.col("order").isNotNull().alias("there"), inside.alias("value")) \
        .mapInArrow(_joining(sent), "value string").write.mode(mode).text(path)
