"""Alignment of two tokenizers over the same bytes, as joins and windows over exploded tokens.

``links`` is the relational core: tokens are exploded with their positions, windowed running sums of their byte lengths
give each token's end, and an equi-join on key and end finds the offsets where both sides end. Running counts of these
cuts number the groups. A range between two neighbouring ends of either side lies in one token of each, so each end is one
link, and its two tokens are filled in from the next end of either side: a range join that stays linear in a group that
never cuts.

For a corpus the key is a distinct stretch of text, not a document. Both tokenizers end a token before a space or line feed
that follows a visible character, so texts are cut there, each part of the corpus counts its stretches before anything is
shuffled, and every distinct stretch is encoded and aligned once. A document's groups are those of its stretches in order.
Links' counts over the corpus are sums of the stretches' counts. Parts of about PART_BYTES of text meet the results of their
own stretches only; nothing that grows with the corpus is broadcast or collected.

Rows: a null or empty text, and one whose joined token bytes on either side differ from a space and the text, has no tokens
and no links; repeated rows and ids are documents of their own; an empty table gives an empty table; other columns are
ignored. A long stretch without cuts is one key, whose tokens pass one task, as its text does.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, buffers, rest, runs, spread
from .speculative_bpe import byte_letters
from .tokenizing import LibraryPieces, _loaded, cuts

#: Text that one task codes and assembles at once.
PART_BYTES = 12 << 20
#: Pairs of ids that may be broadcast; more are joined by shuffling, with every pair's links in SALTS places.
SENT_PAIRS = 1 << 20
SALTS = 16
#: Pieces encoded in one call.
CALL = 4096
_TOKENS = "array<struct<id:int,size:int>>"


def ends(tokens: DataFrame, column: str, name: str) -> DataFrame:
    """(key, end, id and position) of each token of an array of (id, size), ends in bytes from the key's start."""
    each = tokens.select("key", F.posexplode(column).alias("pos", "t"))
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("key", F.sum(F.col("t.size").cast("long")).over(upto).alias("end"), F.col("t.id").alias(f"{name}_id"), F.col("pos").alias(f"{name}_pos"))


def links(tokens: DataFrame) -> DataFrame:
    """One row for each pair of overlapping tokens of (key, a, b), arrays of (id, size) over the same bytes: key, start and end
    of what the two share, a_id, b_id, a_ends and b_ends (whether the token ends there) and group, counted from 0."""
    both = ends(tokens, "a", "a").join(ends(tokens, "b", "b"), ["key", "end"], "full_outer")
    on = Window.partitionBy("key").orderBy("end")
    back = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    before = F.coalesce(F.count_if(cut).over(on.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return both.select(
        "key", F.coalesce(F.lag("end").over(on), F.lit(0)).alias("start"), "end", before.alias("group"), F.col("a_id").isNotNull().alias("a_ends"), F.col("b_id").isNotNull().alias("b_ends"),
        F.last("a_id", True).over(back).alias("a_id"), F.last("b_id", True).over(back).alias("b_id"),
    )


def grouped(linked: DataFrame) -> DataFrame:
    """One row a key: n_a, n_b, n_groups, n_links, groups as the text ``a1,a2|b1;a3|b2,b3``, and links, its pairs (a_id, b_id)."""
    ids = lambda rows, ends_, id_: F.array_join(F.transform(F.filter(rows, lambda r: r[ends_]), lambda r: r[id_].cast("string")), ",")
    rows, count = F.array_sort(F.collect_list(F.struct("end", "a_ends", "b_ends", "a_id", "b_id"))), lambda c: F.count_if(F.col(c)).alias(f"n_{c[0]}")
    each = linked.groupBy("key", "group").agg(rows.alias("rows"), count("a_ends"), count("b_ends"), F.count("*").alias("n_links"))
    text = F.concat(ids(F.col("rows"), "a_ends", "a_id"), F.lit("|"), ids(F.col("rows"), "b_ends", "b_id"))
    each = each.select("key", F.struct("group", text.alias("text")).alias("spelled"), F.transform("rows", lambda r: F.struct(r.a_id.alias("a_id"), r.b_id.alias("b_id"))).alias("pairs"), "n_a", "n_b", "n_links")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("spelled")), lambda r: r.text), ";")
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links")]
    return each.groupBy("key").agg(*sums, F.count("*").alias("n_groups"), texts.alias("groups"), F.flatten(F.collect_list("pairs")).alias("links"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a_id, b_id, count, is_best) of rows (links, occ): how many links hold a pair, each row's ``occ`` times, and whether no
    other pair of its b_id has more."""
    counts = rows.select("occ", F.inline("links")).groupBy("a_id", "b_id").agg(F.sum("occ").alias("count"))
    best = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(best, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("is_best"))


def link_scores(rows: DataFrame, pairs: DataFrame, key: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) over the links of rows (key, links). ``pairs`` is a written table."""
    linked = rows.select(key, F.inline("links"))
    if pairs.count() <= sent_pairs:
        joined = linked.join(F.broadcast(pairs), ["a_id", "b_id"])
    else:  # a frequent pair stands in many keys: its links are spread over SALTS places
        copies = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = linked.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(copies, ["a_id", "b_id", "salt"])
    return joined.groupBy(key).agg(F.count_if("is_best").alias("n_best"), F.sum("count").alias("count_sum"))


class PieceModels:
    """Both tokenizers on stretches of a space and a text, cut as ``cuts`` says; one a worker process."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(a_path)
        model.encode_special_tokens = True
        self.a = LibraryPieces(model)
        letters = byte_letters()
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.a_size[i] = sum(c in letters for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.b_bytes = [plain(i, p) for i, p in enumerate(names)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if any("▁" in p.lstrip("▁") or "\n" in p for p in names):
            raise ValueError("pieces that go on past a space can't be cut there")
        self.space = self.b.piece_to_id("▁")

    def b_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The model puts a space before each text: a stretch's own first space is left out, or its token dropped."""
        texts = [(p[1:] if p[:1] == b" " else p).decode() for p in pieces]
        found = self.b.encode(texts, num_threads=1)
        if any(p[:1] != b" " and x[0] != self.space for p, x in zip(pieces, found)):
            raise ValueError("a line feed joined the space before it")
        return [[self.space] if p == b" " else x if p[:1] == b" " else x[1:] for p, x in zip(pieces, found)]

    def same_bytes(self, piece: bytes, ids: list[int]) -> bool:
        return b"".join([self.b_bytes[i] for i in ids]) == piece


def models(a_path: str, b_path: str) -> PieceModels:
    if (key := ("aligned", a_path, b_path)) not in _loaded:
        _loaded[key] = PieceModels(a_path, b_path)
    return _loaded[key]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space in front of each that isn't empty."""
    sizes = np.diff(offsets)
    more = (sizes > 0).astype(np.int64)
    out = np.full(len(data) + int(more.sum()), 32, np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes + more)])
    out[np.arange(len(data)) + np.repeat(np.cumsum(more), sizes)] = data
    return out, offs


def cut_rows(column: pa.Array, most: int = 1 << 20):
    """(first row, stretches, first stretch of each row) for runs of rows."""
    data, offsets = buffers(column)
    for i, j in runs(offsets, most):
        part, offs = spaced(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts = cuts(part, offs) if len(part) else np.empty(0, np.int64)
        raw, marks = part.tobytes(), starts.tolist()
        yield i, [raw[a:b] for a, b in zip(marks, [*marks[1:], len(raw)])], np.searchsorted(starts, offs).tolist()


def coded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Parts of about PART_BYTES of text: rows (part, code, piece, occ) of how often a part's usable documents hold each stretch,
    and one row (part, docs) each with the documents' ids and their stretches' codes, none for an unusable document."""

    def code(batches):
        from pyspark import TaskContext

        own, kept = models(a_path, b_path), {}  # of characters beyond ASCII, whether their bytes come back
        task, n = TaskContext.get().partitionId(), 0
        ids, place, codes, sizes, held = [], {}, [], [], 0

        def emit():
            pieces, flat, counts = list(place), np.concatenate(codes), np.concatenate(sizes)
            odd = [k for k, p in enumerate(pieces) if not p.isascii()]
            new = set("".join([pieces[k].decode() for k in odd])) - kept.keys()
            kept.update({c: own.same_bytes(x := f" {c}".encode(), own.b_ids([x])[0]) for c in new})
            if lost := {c for c, fine in kept.items() if not fine}:
                bad = np.zeros(len(pieces), bool)
                bad[[k for k in odd if not lost.isdisjoint(pieces[k].decode())]] = True
                row = np.repeat(np.arange(len(counts)), counts)
                void = np.zeros(len(counts), bool)
                void[row[bad[flat]]] = True
                flat, counts = flat[~void[row]], np.where(void, 0, counts)
            sink, table = pa.BufferOutputStream(), pa.table([pa.concat_arrays(ids), pa.array(counts)], ["doc_id", "size"])
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            blob = pa.compress(flat.astype("<u4").tobytes(), "zstd").to_pybytes()
            packed = len(flat).to_bytes(8, "little") + len(blob).to_bytes(8, "little") + blob + sink.getvalue().to_pybytes()
            part, occ = task << 32 | n, np.bincount(flat, minlength=len(pieces))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, None, None, None, packed), kinds)], names)
            some = np.flatnonzero(occ)
            for at in range(0, len(some), 1 << 16):
                k = some[at : at + (1 << 16)]
                columns = [pa.array(np.full(len(k), part)), pa.array(k.astype(np.int32)), pa.array([pieces[x] for x in k.tolist()], pa.binary()), pa.array(occ[k]), pa.nulls(len(k), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i, pieces, at in cut_rows(batch.column(1)):
                rows = len(at) - 1
                ids.append(batch.column(0).slice(i, rows))
                codes.append(np.array([place.setdefault(p, len(place)) for p in pieces], np.int64))
                sizes.append(np.diff(at))
                held += sum(map(len, pieces))
                if held >= PART_BYTES:
                    yield from emit()
                    n, held = n + 1, 0
                    ids, place, codes, sizes = [], {}, [], []
        if ids:
            yield from emit()

    names = ["part", "code", "piece", "occ", "docs"]
    plain = rest(docs, [id_col], text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(code, "part long, code int, piece binary, occ long, docs binary")


def encoded(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, piece, occ, a, b): each distinct stretch with its tokens of both sides."""

    def lists(ids, sizes, counts):
        tokens = pa.StructArray.from_arrays([pa.array(ids.astype(np.int32)), pa.array(sizes[ids].astype(np.int32))], ["id", "size"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), tokens)

    def encode(batches):
        own = models(a_path, b_path)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for at in range(0, len(raw), CALL):
                group = raw[at : at + CALL]
                flat, lengths, order = own.a(group)
                begin, many = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
                begin[order], many[order] = np.cumsum(lengths) - lengths, lengths
                b = own.b_ids(group)
                if not all(own.same_bytes(p, x) for p, x in zip(group, b)):
                    raise ValueError("a stretch of characters that come back alone lost bytes")
                b_flat = np.array([i for x in b for i in x], np.int64)
                columns = [batch.column(c).slice(at, len(group)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, lists(flat[spread(begin, many)].astype(np.int64), own.a_size, many), lists(b_flat, own.b_size, [len(x) for x in b])], ["key", "piece", "occ", "a", "b"])

    return pieces.select("key", "piece", "occ").mapInArrow(encode, f"key long, piece binary, occ long, a {_TOKENS}, b {_TOKENS}")


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def assembled(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Figures and the digest of the groups of each document, from its codes and its part's stretches."""
    names = ["doc_id", *FIGURES, "groups_sha256"]

    def assemble(key, packed: pa.Table, own: pa.Table) -> pa.Table:
        blob = packed.column("docs")[0].as_py()
        n, size = (int.from_bytes(blob[k : k + 8], "little") for k in (0, 8))
        codes = np.frombuffer(pa.decompress(blob[16 : 16 + size], 4 * n, "zstd", asbytes=True), "<u4")
        docs = pa.ipc.open_stream(blob[16 + size :]).read_all()
        at = own.column("code").to_numpy()
        many = int(at.max()) + 1 if len(at) else 0
        figures, texts = np.zeros((many, len(FIGURES)), np.int64), np.empty(many, object)
        for c, name in enumerate(FIGURES):
            figures[at, c] = own.column(name).to_numpy()
        texts[at] = own.column("groups").cast(pa.binary()).to_pylist()
        spell = texts.tolist().__getitem__
        sums, digests, begin = np.zeros((docs.num_rows, len(FIGURES)), np.int64), [""] * docs.num_rows, 0
        for row, many in enumerate(docs.column("size").to_pylist()):
            if not many:
                continue
            digest = hashlib.sha256()
            for c in range(begin, begin + many, 1 << 16):
                some = codes[c : min(c + (1 << 16), begin + many)]
                sums[row] += figures[some].sum(0)
                digest.update((b";" if c > begin else b"") + b";".join(map(spell, some.tolist())))
            digests[row] = digest.hexdigest()
            begin += many
        return pa.table([docs.column("doc_id"), *[pa.array(sums[:, c]) for c in range(len(FIGURES))], pa.array(digests, pa.string())], names)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string"
    return parts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(assemble, schema)


@contextmanager
def joined_by_key(spark):
    """Within, a join on a key and more takes sides that are dealt by the key as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its b_id's highest count), count_sum (of the links'
    pairs over the corpus) and groups_sha256 ('' without tokens)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = scratch.write(coded(docs, a_path, b_path, id_col, text_col))
    parts, held = whole.where("docs is not null").select("part", "docs"), whole.where("docs is null").drop("docs")
    distinct = held.groupBy("piece").agg(F.sum("occ").alias("occ")).withColumn("key", F.monotonically_increasing_id())
    tokens = scratch.write(encoded(distinct, a_path, b_path))
    dealt = tokens.repartition("key")
    with joined_by_key(spark):
        aligned = scratch.write(grouped(links(dealt)).join(dealt.select("key", "piece", "occ"), "key").drop("key"))
    scratch.drop(tokens)
    pairs = scratch.write(pair_counts(aligned))
    results = aligned.drop("links", "occ").join(link_scores(aligned, pairs, "piece"), "piece")
    known = scratch.write(held.select("part", "code", "piece").join(results, "piece").drop("piece"))
    scratch.drop(aligned, pairs)
    return assembled(parts, known)
