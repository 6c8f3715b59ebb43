"""Keyed reconciliation of a target table with a source.

Every record is classed: equal, geometry or attribute mismatch, only in the target, only in the source, duplicated, or
without a key. Both sides are reduced to one row per key and content by partial aggregation before anything is joined,
so a key with a large share of the rows never meets itself. Inside a key, equal contents pair first (EXACT), then one
left on each side (ELIMINATION); contents that repeat on a side are twins of their first row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from ..functions.geometry import same_geometry, traits
from .pairing import nearest_pairs
from .staging import dropped, spread, written


@dataclass(frozen=True)
class ReconcileConfig:
    """What to compare. ``source_of`` maps a target column to the source's name for it."""

    keys: tuple[str, ...]
    compared: tuple[str, ...]
    source_keys: tuple[str, ...] | None = None
    source_of: dict[str, str] = field(default_factory=dict)
    geometry: str | None = None
    placeholders: bool = False
    encoding: bool = True

    def source(self, column: str) -> str:
        return self.source_of.get(column, column)


def contents(both: DataFrame) -> DataFrame:
    """One row per key and content, with its first row and number of rows on each side, and its key's figures: rows on each
    side (key_t, key_s), contents of the source (kinds_s), and contents that have no partner (left_t, left_s)."""
    own, other = F.when(F.col("is_t"), F.col("rec")), F.when(~F.col("is_t"), F.col("rec"))
    each = both.where("key is not null").groupBy("key", "sig").agg(F.min(own).alias("trec"), F.count(own).alias("tn"), F.min(other).alias("srec"), F.count(other).alias("sn"))
    alone = lambda own, other: F.count_if((F.col(own) > 0) & (F.col(other) == 0))
    keys = each.groupBy("key").agg(F.sum("tn").alias("key_t"), F.sum("sn").alias("key_s"), F.count_if(F.col("sn") > 0).alias("kinds_s"), alone("tn", "sn").alias("left_t"), alone("sn", "tn").alias("left_s"))
    return each.join(keys, "key")


def paired(rows: DataFrame) -> DataFrame:
    """(key, method, db_rec, file_rec) of the keys that stand in the target, from ``contents``: pairs of both sides, and
    first rows left over."""
    out = rows.where("key_t > 0")
    met, one = "(tn > 0 and sn > 0)", "(left_t = 1 and left_s = 1)"
    single = out.where(f"not {met} and {one}").groupBy("key").agg(F.max("trec").alias("db_rec"), F.max("srec").alias("file_rec")).select("key", F.lit("ELIMINATION").alias("method"), "db_rec", "file_rec")
    method = F.when(F.expr(met), "EXACT").when(F.col("left_s") == 0, "ONLY_IN_DB").when(F.col("left_t") == 0, "ONLY_IN_SHP").otherwise("NO_GEOMETRY")
    return out.where(f"{met} or not {one}").select("key", method.alias("method"), F.col("trec").alias("db_rec"), F.col("srec").alias("file_rec")).unionByName(single)


def target_twins(t: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the target after the first of their content."""
    first = rows.where("tn > 1").select("key", "sig", "trec")
    return t.join(first, ["key", "sig"]).where("rec <> trec").select("key", F.lit("DUPLICATE_SUID").alias("method"), F.col("rec").alias("db_rec"), F.lit(None).cast("long").alias("file_rec"))


def exact_pairs(target: DataFrame, source: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    """Pairing, without geometry, of the keys that repeat on a side and stand in the target."""
    both = written(sides(target, source, cfg).select("is_t", "rec", "key", "sig"))
    rows = written(contents(both).where("key_t > 0 and (key_t > 1 or key_s > 1)").drop("key_s", "kinds_s"))
    return paired(rows).unionByName(target_twins(both.where("is_t"), rows))


def staged(target: DataFrame, source: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    """``sides``, written, with a digest of 16 bytes for the signature; the texts it is made of are not kept beside it."""
    return written(sides(target, source, cfg).withColumn("sig", F.unhex(F.md5("sig"))).drop("attr", "shape"))


def sides(target: DataFrame, source: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    """Both sides in one table: side (is_t), rec, key, values as stored (v0...) and cleaned (c0...), geometry with its traits,
    and two signatures: of key and cleaned values (attr), and with the geometry's canonical key (sig). Target rows without a
    key are left out."""

    def side(df: DataFrame, keys, name, is_t: bool) -> DataFrame:
        key = V.composite_key([F.col(k) for k in keys], cfg.placeholders, cfg.encoding)
        raw = [F.col(name(c)).cast("string") for c in cfg.compared]
        geom = F.col(name(cfg.geometry)) if cfg.geometry else F.lit(None)
        each = [f(v).alias(f"{p}{i}") for p, f in (("v", lambda v: v), ("c", V.clean_value)) for i, v in enumerate(raw)]
        return df.select(F.lit(is_t).alias("is_t"), F.col("rec").cast("long").alias("rec"), key.alias("key"), *each, geom.cast("string").alias("geom"))

    both = side(target, cfg.keys, lambda c: c, True).where("key is not null").unionByName(side(source, cfg.source_keys or cfg.keys, cfg.source, False))
    if cfg.geometry:
        both = spread(both).withColumn("_g", traits(F.col("geom"))).select(*both.columns, "_g.*")
    else:
        both = both.select("*", F.lit(None).cast("string").alias("shape"), F.lit(False).alias("flat"))
    both = both.withColumn("attr", F.to_json(F.array("key", *[f"c{i}" for i in range(len(cfg.compared))])))
    return both.withColumn("sig", F.concat_ws("#", "attr", "shape"))


def classes(both: DataFrame, cfg: ReconcileConfig) -> tuple[DataFrame, DataFrame]:
    """One row per key and content: its first row's rec (t, s) and number of rows (tn, sn) on each side, and its key's figures: rows
    (key_t, key_s), contents of the source (kinds_s), and on each side contents without a partner and those with a place; and the
    signatures (key, sig, first) of contents that repeat in the target. Values and geometries stay behind; only rows that are compared
    need them."""
    rec, is_t = F.col("rec"), F.col("is_t")
    placed = [F.min_by(F.col("x").isNotNull(), rec).alias("placed")] if cfg.geometry else []
    each = both.where("key is not null and (is_t or not flat)").groupBy("key", "sig").agg(
        F.min(F.when(is_t, rec)).alias("t"), F.count_if(is_t).alias("tn"), F.min(F.when(~is_t, rec)).alias("s"), F.count_if(~is_t).alias("sn"), *placed
    )
    each = written(each)
    again = written(each.where("tn > 1").select("key", "sig", F.col("t").alias("first")))
    alone = {"t": (F.col("tn") > 0) & (F.col("sn") == 0), "s": (F.col("sn") > 0) & (F.col("tn") == 0)}
    placed = [F.count_if(alone[k] & F.col("placed")).alias(f"placed_{k}") for k in "ts"] if cfg.geometry else []
    keys = each.groupBy("key").agg(F.sum("tn").alias("key_t"), F.sum("sn").alias("key_s"), F.count_if(F.col("sn") > 0).alias("kinds_s"), *[F.count_if(alone[k]).alias(f"left_{k}") for k in "ts"], *placed)
    rows = written(each.drop("sig", "placed").join(keys, "key"))
    dropped(each)
    return rows, again


def items(target: DataFrame, source: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    """(key, type, differences, db_rec, file_rec, n_rows): every item of a comparison. n_rows is over 1 only for
    SKIPPED_TWIN, the source's rows after the first of a content. Differences stand on compared pairs; a geometry that
    differs decides the type, whatever the attributes. Source rows whose geometry has collapsed leave first, as DEGENERATE.

    In a key that repeats, equal contents pair first; with geometry, then equal attributes where one side has no place left,
    then the nearest rows; a row left on each side makes a pair, and other rows that face each other are duplicates."""
    both = staged(target, source, cfg)
    rows, again = classes(both, cfg)
    diff_type = "array<struct<field:string,db_value:string,file_value:string>>"
    none = F.lit(None)

    def item(type_, db=none, file=none, n=F.lit(1), found=none):
        return F.struct(F.lit(type_).alias("type") if isinstance(type_, str) else type_.alias("type"), found.cast(diff_type).alias("differences"), db.cast("long").alias("db_rec"), file.cast("long").alias("file_rec"), n.cast("long").alias("n_rows"))

    t, s, rec, is_t, content = (F.col(c) for c in ("t", "s", "rec", "is_t", "content"))
    two = F.col("key_t") > 0
    alone_t, alone_s = two & (F.col("sn") == 0), two & (F.col("tn") == 0)
    # Single rows: the target's after the first of a content, the source's of keys that clash there, keyless and collapsed ones.
    odd = both.where("not is_t and (flat or key is null)").select("key", item(F.when(F.col("flat"), "DEGENERATE").otherwise("NULL_SUID"), file=rec).alias("i"))
    clash = rows.where("key_t = 0 and kinds_s > 1").select("key").distinct()
    if not again.isEmpty():
        twins = both.where("is_t").select("key", "sig", "rec").join(again, ["key", "sig"]).where(rec != F.col("first"))
        odd = odd.unionByName(twins.select("key", item("DUPLICATE_SUID", rec).alias("i")))
    if not clash.isEmpty():
        odd = odd.unionByName(both.where("not is_t and not flat").select("key", "rec").join(clash, "key").select("key", item("DUPLICATE_SUID", file=rec).alias("i")))
    odd = written(odd.select("key", "i.*"))
    said = [
        F.when((F.col("tn") > 0) & (F.col("sn") > 0), item("MATCH", t, s, found=F.array())),
        F.when(alone_t & (F.col("left_s") == 0), item("ONLY_IN_DB", t)), F.when(alone_s & (F.col("left_t") == 0), item("ONLY_IN_SHP", file=s)),
        F.when(~two & (F.col("kinds_s") == 1), item("ONLY_IN_SHP", file=s)),
        F.when((F.col("sn") > 1) & (two | (F.col("kinds_s") == 1)), item("SKIPPED_TWIN", file=s, n=F.col("sn") - 1)),
    ]
    found = rows.select("key", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("i")).select("key", "i.*")
    # Rows that face others get their values and geometries back.
    cleaned = [f"c{i}" for i in range(len(cfg.compared))]
    shown = F.struct("rec", *[f"v{i}" for i in range(len(cfg.compared))], *cleaned, *(["geom"] if cfg.geometry else [])).alias("content")
    faced = rows.where((alone_t | alone_s) & (F.col("left_t") > 0) & (F.col("left_s") > 0)).withColumn("is_t", F.col("tn") > 0).withColumn("rec", F.coalesce("t", "s"))
    held = lambda which, figures, *more: faced.where(which).select("key", "is_t", "rec", *figures).join(both.select("key", "is_t", "rec", shown, *more), ["key", "is_t", "rec"])
    pairs, several, used = held("left_t = 1 and left_s = 1", ()), "left_t > 1 or left_s > 1", [both, rows, again]
    pairs = spread(pairs, "key") if cfg.geometry else pairs
    pairs = pairs.groupBy("key").agg(*[F.first(F.when(side, content), True).alias(c) for c, side in (("t", is_t), ("s", ~is_t))])
    if cfg.geometry:
        left = written(held(several, ("placed_t", "placed_s"), "x", "y", "line", F.array(*cleaned).alias("attributes")))
        blind = (F.col("placed_t") == 0) | (F.col("placed_s") == 0)
        of = lambda c, side: F.min_by(F.when(side, content), F.when(side, rec)).alias(c)
        same = written(left.where(blind).groupBy("key", "attributes").agg(of("t", is_t), of("s", ~is_t)).where("t is not null and s is not null").drop("attributes"))
        gone = same.select("key", F.col("t.rec").alias("rec"), F.lit(True).alias("is_t")).union(same.select("key", "s.rec", F.lit(False)))
        free = left.join(gone, ["key", "rec", "is_t"], "left_anti")
        side = lambda own: free.where(own).select("key", "rec", "x", "y", "attributes", "line")
        near = written(nearest_pairs(side(is_t), side(~is_t)))
        by_rec = lambda own, name, c: left.where(own).select("key", rec.alias(name), content.alias(c))
        met = near.where("method in ('GEOMETRY', 'ELIMINATION')").join(by_rec(is_t, "db_rec", "t"), ["key", "db_rec"]).join(by_rec(~is_t, "file_rec", "s"), ["key", "file_rec"])
        pairs = pairs.unionByName(same).unionByName(met.select("key", "t", "s"))
        type_ = F.when(F.col("method") == "AMBIGUOUS", "DUPLICATE_SUID").when(F.col("db_rec").isNotNull(), "ONLY_IN_DB").otherwise("ONLY_IN_SHP")
        found = found.unionByName(near.where("method not in ('GEOMETRY', 'ELIMINATION')").select("key", item(type_, F.col("db_rec"), F.col("file_rec")).alias("i")).select("key", "i.*"))
        used += [left, same, near]
    else:
        found = found.unionByName(faced.where(several).select("key", item("DUPLICATE_SUID", t, s).alias("i")).select("key", "i.*"))
    # What each pair differs in.
    at = lambda c, i: F.col(f"{c}.{i}")
    fields = [F.when(~V.equivalent_cleaned(at("t", f"c{i}"), at("s", f"c{i}"), cfg.encoding), F.struct(F.lit(c).alias("field"), at("t", f"v{i}").alias("db_value"), at("s", f"v{i}").alias("file_value"))) for i, c in enumerate(cfg.compared)]
    compared = pairs.withColumn("diff", F.filter(F.array(*fields), lambda x: x.isNotNull()))
    kind = F.when(F.size("diff") > 0, "ATTRIBUTE_MISMATCH").otherwise("MATCH")
    if cfg.geometry:
        kind = F.when(~same_geometry(at("t", "geom"), at("s", "geom")), "GEOMETRY_MISMATCH").otherwise(kind)
    compared = compared.select("key", item(kind, at("t", "rec"), at("s", "rec"), found=F.col("diff")).alias("i"))
    found = written(found.unionByName(compared.select("key", "i.*")))
    dropped(*used)
    return found.unionByName(odd)


TYPES = ("MATCH", "ATTRIBUTE_MISMATCH", "GEOMETRY_MISMATCH", "ONLY_IN_DB", "ONLY_IN_SHP", "DUPLICATE_SUID", "NULL_SUID", "SKIPPED_TWIN", "DEGENERATE")


def summary(found: DataFrame) -> DataFrame:
    """Rows by class, one row. n_total is all that was analysed; rows of both sides are n_rows, where pairs count twice."""
    of = lambda *t: F.coalesce(F.sum(F.when(F.col("type").isin(*t), F.col("n_rows"))), F.lit(0))
    both = of("MATCH", "ATTRIBUTE_MISMATCH", "GEOMETRY_MISMATCH")
    total = F.coalesce(F.sum("n_rows"), F.lit(0))
    return found.agg(*[of(n).alias(f"n_{n.lower()}") for n in TYPES], total.alias("n_total"), (total + both).alias("n_rows"))


def sql_patches(found: DataFrame, target: DataFrame, source: DataFrame, table: str, cfg: ReconcileConfig, file_srid: int = 4326, target_srid: int = 4326, multi: bool = False) -> DataFrame:
    """(key, statement): an UPDATE per mismatch, by the stored values of all key columns, with the source's geometry where that
    differs and the source has one, and an INSERT per source-only record with its keys, mapped attributes and geometry."""
    name = V.sql_identifier(table)
    quoted = lambda field: F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
    names = [*(cfg.source_keys or cfg.keys), *[cfg.source(c) for c in cfg.compared]]
    geom = [F.col(cfg.source(cfg.geometry)).cast("string").alias("geom")] if cfg.geometry else []
    given = source.select(F.col("rec").alias("file_rec"), *[F.col(n).cast("string").alias(f"c{i}") for i, n in enumerate(names)], *geom)
    stored = target.select(F.col("rec").alias("db_rec"), F.struct(*cfg.keys).alias("k"))
    value = lambda k: F.col(f"k.{k}").cast("string")
    where = [F.concat(F.lit(V.sql_identifier(k)), F.when(value(k).isNull(), F.lit(" IS NULL")).otherwise(F.concat(F.lit(" = "), V.sql_literal(value(k))))) for k in cfg.keys]
    changed = found.where("type in ('ATTRIBUTE_MISMATCH', 'GEOMETRY_MISMATCH')").join(stored, "db_rec")
    inserted = found.where("type = 'ONLY_IN_SHP'")
    sets = F.transform("differences", lambda d: F.concat(quoted(d.field), F.lit(" = "), V.sql_literal(d.file_value)))
    columns, values = [*cfg.keys, *cfg.compared], [V.sql_literal(F.col(f"c{i}")) for i in range(len(names))]
    if cfg.geometry:
        shape = V.sql_geometry(F.col("geom"), file_srid, target_srid, multi)
        moved = (F.col("type") == "GEOMETRY_MISMATCH") & F.col("geom").isNotNull()
        sets = F.concat(sets, F.when(moved, F.array(F.concat(F.lit(f"{V.sql_identifier(cfg.geometry)} = "), shape))).otherwise(F.array().cast("array<string>")))
        columns, values = [*columns, cfg.geometry], [*values, shape]
    update = F.concat(F.lit(f"UPDATE {name} SET "), F.array_join("sets", ", "), F.lit(" WHERE "), F.concat_ws(" AND ", *where))
    head = f"INSERT INTO {name} ({', '.join(map(V.sql_identifier, columns))}) VALUES ("
    insert = F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(")"))
    if cfg.geometry:  # the source's rows, with their geometries, meet changed and new records at once
        needed = ["key", "type", "differences", "file_rec", "k"]
        both = changed.select(*needed).unionByName(inserted.select(*needed[:-1]), allowMissingColumns=True).join(given, "file_rec").withColumn("sets", sets)
        said = F.when(F.col("type") == "ONLY_IN_SHP", insert).when(F.size("sets") > 0, update)
        return both.select("key", said.alias("statement")).where("statement is not null")
    updates = changed.withColumn("sets", sets).where("size(sets) > 0").select("key", update.alias("statement"))
    return updates.unionByName(inserted.join(given, "file_rec").select("key", insert.alias("statement")))
