"""Chat formatting as a prefix tree.

Every turn is a node whose identity is the hash of its parent, role and text, so conversations that begin
alike share nodes. Conversations are sorted by their paths; the first of them that holds a node emits it, which
lists the tree depth first with every shared token once. A node has

* ``offset``: the place of its first token in that sequence,
* ``position``: the position id of its first token, that is the tokens above it,
* ``subtree_end``: a token may be attended by tokens of later places below this bound, and by no others; the
  ancestors of a token are so exactly the nodes whose interval [offset, subtree_end) holds it,
* ``ids``, with ``loss_start`` and ``loss_end``: the tokens of the answer itself in assistant turns.

Template: ``[INST] text [/INST]`` for the user, ``text</s>`` for the assistant, ``[ROLE name] text [/ROLE]``
for others. A control string inside a text gets a backslash before it, and backslashes right before one (or at
a text's end) are doubled, so reading back is exact.

Null text and role count as empty, null turns come first, equal turns are ordered by role and text, and
repeated rows are repeated turns. Rows with a null conversation id are one conversation. An empty table gives
no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, rest
from .tokenizing import library_tokenizer

CONTROL = r"</s>|<s>|\[INST\]|\[/INST\]|\[ROLE [^\]\s]*\]|\[/ROLE\]"
_ESCAPE = re.compile(rf"(\\*)(?:({CONTROL})|\Z)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + (f"\\{m[2]}" if m[2] else ""), text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + (m[2] or ""), text)


def template(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the escaped text, the escaped text, and what stands after it."""
    if role == "user":
        return "[INST] ", escape(text), " [/INST]"
    if role == "assistant":
        return "", escape(text), "</s>"
    return f"[ROLE {quote(role, safe='')}] ", escape(text), " [/ROLE]"


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if turn.startswith("[INST] "):
        return "user", unescape(turn[7:-8])
    if turn.startswith("[ROLE "):
        name = turn[6 : turn.index("]")]
        return unquote(name), unescape(turn[len(name) + 8 : -8])
    return "assistant", unescape(turn[:-4])


def node_id(parent: bytes, role: str, text: str) -> bytes:
    head = role.encode()
    return hashlib.blake2b(parent + len(head).to_bytes(8, "big") + head + text.encode(), digest_size=16).digest()


NODE = "struct<node:binary,parent:binary,depth:int,position:long,n_tokens:long,loss_start:long,loss_end:long,ids:binary>"


def conversation_paths(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, path (the node ids from the root, joined) and the nodes of each conversation."""

    def nodes(batches):
        cache = library_tokenizer(tokenizer, special_text=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                turns_ = part.column(1).to_pylist()
                texts = [s.encode() for conv in turns_ for t in conv for s in template(t["role"], t["text"])]
                offs = np.cumsum([0, *map(len, texts)])
                data = np.frombuffer(b"".join(texts), np.uint8)
                ids: list[np.ndarray] = []
                for _, flat, ends in cache.encode(data, offs):
                    ids += np.split(flat, ends[1:-1])
                paths, rows, k = [], [], 0
                for conv in turns_:
                    parent, position, own, path = b"", 0, [], []
                    for depth, t in enumerate(conv):
                        before, body, after = ids[k : k + 3]
                        k += 3
                        node, n = node_id(parent, t["role"], t["text"]), len(before) + len(body) + len(after)
                        loss = (len(before), len(before) + len(body)) if t["role"] == "assistant" else (0, 0)
                        own.append({"node": node, "parent": parent, "depth": depth, "position": position, "n_tokens": n, "loss_start": loss[0], "loss_end": loss[1], "ids": np.concatenate([before, body, after]).astype("<u4").tobytes()})
                        path.append(node)
                        parent, position = node, position + n
                    paths.append(b"".join(path))
                    rows.append(own)
                kind = pa.list_(pa.struct([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("position", pa.int64()), ("n_tokens", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ids", pa.binary())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.binary()), pa.array(rows, kind)], ["conv_id", "path", "nodes"])

    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rest(turns, ["conv_id"], "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return grouped.mapInArrow(nodes, f"conv_id long, path binary, nodes array<{NODE}>")


def ranked(convs: DataFrame) -> DataFrame:
    """Conversations with a rank that grows with their place in path order; equal paths are dealt out too."""

    def number(batches):
        rank = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield batch.append_column("rank", pa.array(np.arange(rank, rank + batch.num_rows)))
            rank += batch.num_rows

    ordered = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(number, f"conv_id long, path binary, nodes array<{NODE}>, rank long")


def running_total(rows: DataFrame, key: str, value: str, scratch: Scratch) -> DataFrame:
    """rows with ``total``, the sum of value up to and with each row in the order of key; key names its part in its high bits."""
    part = F.shiftright(key, 40)
    within = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = scratch.write(rows.withColumn("part", part).withColumn("inner", F.sum(value).over(within)))
    parts = rows.groupBy("part").agg(F.sum(value).alias("size"))
    # One row a sorted part.
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("total", F.col("inner") + F.col("before")).drop("part", "inner", "before")


def prefix_tree(turns: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of the tree, and (conv_id, path) of each conversation."""
    scratch = Scratch(turns.sparkSession)
    convs = scratch.write(ranked(conversation_paths(turns, tokenizer)))
    every = convs.select("rank", F.explode("nodes").alias("n")).select("rank", "n.*")
    first = [F.first(c).alias(c) for c in ("parent", "depth", "position", "n_tokens", "loss_start", "loss_end", "ids")]
    nodes = scratch.write(every.groupBy("node").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"), *first))
    emitted = nodes.groupBy("rank").agg(F.sum("n_tokens").alias("fresh"), F.min("position").alias("from"))
    ends = convs.select("rank").join(emitted, "rank", "left").na.fill(0, ["fresh", "from"])
    ends = scratch.write(running_total(ends, "rank", "fresh", scratch))
    placed = nodes.join(ends, "rank").withColumn("offset", F.col("total") - F.col("fresh") + F.col("position") - F.col("from"))
    until = ends.select(F.col("rank").alias("last"), F.col("total").alias("subtree_end"))
    out = placed.join(until, "last").select("node", "parent", "depth", "offset", "position", "n_tokens", "subtree_end", "loss_start", "loss_end", "ids")
    return scratch.write(out), convs.select("conv_id", "path")


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the tree's tokens: conv_id, formatted text, turns (role, text) and the text under the loss mask."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length("path") / 16).cast("int"))), lambda i: F.substring(F.col("path"), (i - 1) * 16 + 1, F.lit(16)))
    wanted = Scratch(nodes.sparkSession).write(paths.select("conv_id", F.posexplode(steps).alias("step", "node")))
    found = wanted.join(nodes.select("node", "ids", "loss_start", "loss_end"), "node")
    grouped = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("step", "ids", "loss_start", "loss_end"))).alias("turns"))

    def read(batches):
        model = byte_tokens(tokenizer)
        for batch in batches:
            formatted, turns_, losses = [], [], []
            for conv in batch.column(1).to_pylist():
                raws = [[model[i] for i in np.frombuffer(t["ids"], "<u4").tolist()] for t in conv]
                texts = [b"".join(r).decode() for r in raws]
                formatted.append("".join(texts))
                turns_.append([dict(zip(("role", "text"), parse(t))) for t in texts])
                losses.append("".join(unescape(b"".join(r[t["loss_start"] : t["loss_end"]]).decode()) for r, t in zip(raws, conv)))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(formatted, pa.string()), pa.array(turns_, kind), pa.array(losses, pa.string())], ["conv_id", "formatted", "turns", "loss_text"])

    return grouped.mapInArrow(read, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string")


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level vocabulary of the tokenizers library."""
    from tokenizers import Tokenizer

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out
