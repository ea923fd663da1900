"""Chat formatting into a prefix tree: conversations that share first turns share their tokens.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles and texts
are escaped reversibly: ``<`` with any number of backslashes and ``|`` gets one backslash more, so
no text can hold a control string, and each one shows as it was.  Roles escape line ends and
backslashes too.  Control marks are token ids of their own; between them the pieces are encoded
one by one, so the loss mask covers just the tokens of assistant texts.

A turn's key hashes it with all turns before it, so equal keys are one node of the tree.  A
conversation's path is its row of keys.  Sorted by path, conversations stand depth first: each
sends only the turns that the one before it doesn't share, and these follow each other in one
stream of tokens.  A node holds its place in the stream, position ids (the place within a
conversation), and the intervals of the stream that its tokens attend to beside the node's own
earlier tokens: its ancestors, one run for each conversation that first told a part of its way.

The order is a range sort by path.  A task walks its range with a stack of runs, as if its first
conversation shared nothing; one row a task (its first and last conversation, its stack) then
goes through the driver, where each range's true start and what it shares with the range before
follow, and rows are set right.  No tree, key or group has to fit in a task: copies of a
conversation are one path, and a common first turn is shared by rows of many ranges.

Defined cases: a null or empty text is an empty turn, a null role is the empty role; turns go by
(turn, role, text), nulls first, and a repeated row is a turn of its own; rows with null id are
one conversation; an empty table gives nothing; further columns are ignored.  A conversation is
read in one pass by one task, a turn at a time; its path takes 16 bytes a turn and is one value.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import arrow_rows, small_table, written

START, END = "<|im_start|>", "<|im_end|>"
KEY = 16
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """Without control strings; ``unescaped`` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """On one line, without control strings."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


class Codec:
    """Token ids of a rank file; the two control marks take the ids behind it."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = read_ranks(vocabulary)
        self.start = max(ranks.values(), default=-1) + 1
        self.end = self.start + 1
        self.library = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={START: self.start, END: self.end})

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Token ids of a formatted turn, and where its text's tokens begin and end."""
        head = [self.start, *self.library.encode_ordinary(escaped_role(role) + "\n")]
        body = self.library.encode_ordinary(escaped(text))
        return [*head, *body, self.end, *self.library.encode_ordinary("\n")], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        return self.library.decode_bytes(ids).decode()


@lru_cache(2)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(vocabulary, pattern)


def turns(conversations: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Written: a row a turn (conv_id, depth, ids, loss_from, loss_to), and a row a conversation (path, positions)."""
    schema = "conv_id long, is_turn boolean, depth int, ids array<int>, loss_from int, loss_to int, path binary, positions array<long>"
    types = pa.schema([("conv_id", pa.int64()), ("is_turn", pa.bool_()), ("depth", pa.int32()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("path", pa.binary()), ("positions", pa.list_(pa.int64()))])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        conv, path, positions = None, bytearray(), [0]

        def whole() -> dict:
            return {"conv_id": conv[0], "is_turn": False, "path": bytes(path), "positions": positions}

        for batch in arrow_rows(batches):
            out: list[dict] = []
            for conv_id, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if conv != (conv_id,):
                    if conv:
                        out.append(whole())
                    conv, path, positions = (conv_id,), bytearray(), [0]
                ids, lo, hi = own.turn(role, text)
                said = role.encode()
                path += hashlib.blake2b(b"%b%d:%b%b" % (path[-KEY:], len(said), said, text.encode()), digest_size=KEY).digest()
                loss = (lo, hi) if role == "assistant" else (0, 0)
                out.append({"conv_id": conv_id, "is_turn": True, "depth": len(positions) - 1, "ids": ids, "loss_from": loss[0], "loss_to": loss[1]})
                positions.append(positions[-1] + len(ids))
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if conv:
            yield pa.RecordBatch.from_pylist([whole()], schema=types)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(ordered.select("conv_id", "role", "text").mapInArrow(formatted, schema), "chat-turns", ["is_turn"])


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    return len(os.path.commonprefix([a, b])) // KEY


#: A run of tokens on a path: turns from ``first`` up to ``last``, which stand together from ``start`` on.
RUNS = "array<struct<first:int,last:int,start:bigint>>"
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64())]))


def _cut(runs: list[dict], turns: int) -> list[dict]:
    """The runs of a path's first turns."""
    return [r | {"last": min(r["last"], turns)} for r in runs if r["first"] < turns]


def _walked(paths: DataFrame) -> DataFrame:
    """Written: paths in order within ranges, each with its runs as if a range began a stream of its own; a row a range with its ends."""
    schema = f"range int, is_end boolean, rep long, leaf binary, positions array<long>, runs {RUNS}, first_path binary, last_path binary, first_positions array<long>, tokens long"
    types = pa.schema(
        [("range", pa.int32()), ("is_end", pa.bool_()), ("rep", pa.int64()), ("leaf", pa.binary()), ("positions", pa.list_(pa.int64())), ("runs", _RUNS)]
        + [("first_path", pa.binary()), ("last_path", pa.binary()), ("first_positions", pa.list_(pa.int64())), ("tokens", pa.int64())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        first, last, runs, tokens = None, b"", [], 0
        for batch in arrow_rows(batches):
            out = []
            for rep, path, positions in zip(*(batch.column(n).to_pylist() for n in ("rep", "path", "positions")), strict=True):
                first = first or (path, positions)
                shared, n = _shared(last, path), len(path) // KEY
                runs = [*_cut(runs, shared), {"first": shared, "last": n, "start": tokens}]
                tokens, last = tokens + positions[n] - positions[shared], path
                out.append({"range": number, "is_end": False, "rep": rep, "leaf": path[-KEY:], "positions": positions, "runs": runs})
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if first:
            yield pa.RecordBatch.from_pylist([{"range": number, "is_end": True, "runs": runs, "first_path": first[0], "last_path": last, "first_positions": first[1], "tokens": tokens}], schema=types)

    # an unset number of ranges lets adaptive execution join small ones
    return written(paths.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(walk, schema), "chat-ranges", ["is_end"])


def _mended(runs: list[dict], range_start: int, shared: int, skipped: int, carried: list[dict]) -> list[dict]:
    """Runs of a range in the whole stream: the first row's run holds only what the range before doesn't share."""
    out, rest = [], runs
    if runs and runs[0]["start"] == 0:  # turns of the range's first path
        head, rest = runs[0], runs[1:]
        out = _cut(carried, min(head["last"], shared))
        if head["last"] > shared:
            out.append({"first": shared, "last": head["last"], "start": range_start})
    return out + [r | {"start": r["start"] - skipped + range_start} for r in rest]


def tree(conversations: DataFrame, vocabulary: bytes, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The written nodes and conversations.

    Nodes: ``run`` (where the node's unbranched run starts in the stream), ``start``, ``depth``,
    ``token_ids``, ``position_ids``, ``loss`` (a flag a token), ``attends`` (intervals of the stream
    before the node that its tokens see).  Conversations: conv_id, n_turns, ``runs`` (intervals of
    the stream that hold it, in order).
    """
    spark = conversations.sparkSession
    rows = turns(conversations, vocabulary, pattern)
    convs = rows.where("not is_turn").select("conv_id", "path", "positions", F.expr(f"substring(path, -{KEY}, {KEY})").alias("leaf"))
    paths = convs.groupBy("path").agg(F.min("conv_id").alias("rep"), F.min("positions").alias("positions"))
    walked = _walked(paths)
    carried: dict[int, tuple[int, int, int, list[dict]]] = {}
    at, last, runs = 0, b"", []
    for end in walked.where("is_end").orderBy("range").collect():  # a row a range
        shared = _shared(last, end.first_path)
        skipped = end.first_positions[shared]
        carried[end.range] = (at, shared, skipped, runs)
        runs = _mended([r.asDict() for r in end.runs], at, shared, skipped, runs)
        at, last = at + end.tokens - skipped, end.last_path
    sent = spark.sparkContext.broadcast(carried)

    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = pa.schema([("rep", pa.int64()), ("leaf", pa.binary()), ("first", pa.int32()), ("start", pa.int64()), ("positions", pa.list_(pa.int64())), ("runs", interval)])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            out = []
            for row in batch.to_pylist():
                places = row["positions"]
                fixed = _mended(row["runs"], *sent.value[row["range"]])
                spans = [{"start": r["start"], "end": r["start"] + places[r["last"]] - places[r["first"]]} for r in fixed]
                out.append({"rep": row["rep"], "leaf": row["leaf"], "first": fixed[-1]["first"], "start": fixed[-1]["start"], "positions": places, "runs": spans})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    spans = "array<struct<start:bigint,end:bigint>>"
    mended = walked.where("not is_end").select("range", "rep", "leaf", "positions", "runs").mapInArrow(mend, f"rep long, leaf binary, first int, start long, positions array<long>, runs {spans}")
    mended = written(mended, "chat-paths")
    own = rows.where("is_turn").select("conv_id", "depth", "ids", "loss_from", "loss_to")
    held = own.join(mended, [own.conv_id.eqNullSafe(mended.rep), own.depth >= mended["first"]])
    place = F.element_at("positions", F.col("depth") + 1)
    start = F.col("start") + place - F.element_at("positions", F.col("first") + 1)
    before = F.slice("runs", F.lit(1), F.size("runs") - 1)
    attends = F.when(start > F.col("start"), F.concat(before, F.array(F.struct(F.col("start"), start.alias("end"))))).otherwise(before)
    flags = F.transform("ids", lambda _, i: (i >= F.col("loss_from")) & (i < F.col("loss_to")))
    positions = F.sequence(place, place + F.size("ids") - 1)
    nodes = held.select(F.col("start").alias("run"), start.alias("start"), "depth", F.col("ids").alias("token_ids"), positions.alias("position_ids"), flags.alias("loss"), attends.alias("attends"))
    # in stream order, files of consecutive tokens
    nodes = written(nodes.repartitionByRange("start").sortWithinPartitions("start"), "chat-nodes")
    found = convs.select("conv_id", "leaf").join(mended.select("leaf", "runs", F.size("positions").alias("n")), "leaf")
    return nodes, written(found.select("conv_id", (F.col("n") - 1).cast("long").alias("n_turns"), "runs"), "chat-conversations")


def read_turns(nodes: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """What the nodes' tokens say: run, start, depth, formatted, role, text, and ``loss_text`` under the mask (null without any)."""
    types = pa.schema([("run", pa.int64()), ("start", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss_text", pa.string())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in arrow_rows(batches):
            out = []
            for row in batch.to_pylist():
                said = own.text(row["token_ids"])
                head, _, rest = said.removeprefix(START).partition("\n")
                masked = [t for t, use in zip(row["token_ids"], row["loss"], strict=True) if use]
                out.append({"run": row["run"], "start": row["start"], "depth": row["depth"], "chars": len(said), "role": unescaped_role(head), "text": unescaped(rest.removesuffix("\n").removesuffix(END)), "loss_text": unescaped(own.text(masked)) if masked else None})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return nodes.select("run", "start", "depth", "token_ids", "loss").mapInArrow(decoded, "run long, start long, depth int, chars long, role string, text string, loss_text string")


def digests(nodes: DataFrame, convs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """Read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = written(read_turns(nodes, vocabulary, pattern), "chat-read")
    # copies of a conversation hold the same runs: each path is read once, by the start of its last run
    leaf = F.element_at("runs", -1)["start"]
    paths = convs.groupBy(leaf.alias("leaf")).agg(F.min("runs").alias("runs"))
    each = paths.select("leaf", F.explode("runs").alias("r")).select("leaf", F.col("r.start").alias("run"), F.col("r.end").alias("end"))
    parts = each.join(said, "run").where(F.col("start") < F.col("end"))
    ordered = parts.select("leaf", "depth", "chars", "role", "text", "loss_text").repartition("leaf").sortWithinPartitions("leaf", "depth")
    types = pa.schema([("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, chars, loss_chars, all_said, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def whole() -> dict:
            return {"leaf": now, "n_turns": n, "turns_sha256": all_said.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        for batch in arrow_rows(batches):
            out = []
            for row in batch.to_pylist():
                if row["leaf"] != now:
                    if now is not None:
                        out.append(whole())
                    now, n, chars, loss_chars, all_said, loss = row["leaf"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, chars = n + 1, chars + row["chars"]
                all_said.update(f"{row['role']}\n{row['text']}\n".encode())
                learned = row["loss_text"] or ""
                loss_chars += len(learned)
                loss.update(learned.encode())
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if now is not None:
            yield pa.RecordBatch.from_pylist([whole()], schema=types)

    read = ordered.mapInArrow(hashed, "leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return convs.select("conv_id", leaf.alias("leaf")).join(read, "leaf").drop("leaf")


def with_control_texts(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two turns hold control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    added = small_table(conversations.sparkSession, "conv_id long, turn long, role string, text string", [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(added)
