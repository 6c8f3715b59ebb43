"""The update of a parcel layer drawn from parts: each lot of 40 by 40 stays, changes, is renumbered, subdivided, replaced or goes, by
p_partkey % 12; a third of all lots share one province."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import parcels
from ..registry import query, table

_P = "(select p_partkey as p, p_partkey % 12 as kind, p_partkey // 12 % 4 = 1 as used, p_partkey // 12 % 8 = 1 as fixed from part) q"


def lots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored lots, staged lots, and what refers to stored ones."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.cast("long").alias("p"), (p % 12).alias("kind"), (p % 1000 * 100).alias("x"), (F.floor(p / 1000) * 100).cast("int").alias("y"), F.when(p % 3 == 0, 0).otherwise(p % 19).alias("province"), F.when(p % 2 == 0, p % 7).alias("locality"))
    p, kind, x, y = F.col("p"), F.col("kind"), F.col("x"), F.col("y")

    def box(w, h, dx=0) -> Column:
        corners = [(x + dx, y), (x + dx + w, y), (x + dx + w, y + h), (x + dx, y + h), (x + dx, y)]
        return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat(a.cast("string"), F.lit(" "), b.cast("string")) for a, b in corners]), F.lit("))"))

    lot = lambda i, number, geom: F.struct(i.cast("long").alias("i"), F.lit("U").alias("type"), F.col("province"), F.col("locality"), number.cast("string").alias("number"), geom.alias("geom"))
    stored = [F.when(kind != 9, lot(p, p, box(40, 40))), F.when(kind == 10, lot(p + 100000000, p, box(10, 10, 60)))]
    whens = lambda pairs: F.filter(F.array(*pairs), lambda s: s.isNotNull())
    staged = [
        F.when(kind.isin(0, 9, 10), lot(p, p, box(40, 40))), F.when(kind == 1, lot(p, p, box(40, 41))), F.when(kind == 2, lot(p, p, box(40, 50))), F.when(kind == 3, lot(p, p + 100000000, box(40, 40))),
        F.when(kind == 4, lot(p, p + 100000000, box(37, 40))), F.when(kind == 5, lot(p, p + 100000000, box(20, 40))), F.when(kind == 5, lot(p + 100000000, p + 200000000, box(20, 40, 20))), F.when(kind == 6, lot(p, p + 100000000, box(40, 60))),
        F.when(kind == 8, lot(p, p, box(40, 40))), F.when(kind == 8, lot(p + 100000000, p, box(30, 40))), F.when(kind == 11, lot(p, p + 100000000, box(40, 40))), F.when(kind == 11, lot(p + 100000000, p + 200000000, box(40, 40))),
    ]
    target = rows.select(F.inline(whens(stored))).withColumnRenamed("i", "id")
    source = rows.select(F.inline(whens(staged))).withColumnRenamed("i", "rec")
    used = rows.where("floor(p / 12) % 4 = 1 and kind <> 9")
    at = lambda i, dx, movable: F.struct((p * 10 + i).alias("ref_id"), p.alias("parcel_id"), (x + dx).cast("double").alias("x"), (y + 5).cast("double").alias("y"), movable.alias("movable"))
    fixed = F.floor(p / 12) % 8 == 1
    refs = used.select(F.inline(F.array(at(1, 3, F.lit(True)), at(2, 27, ~fixed), at(3, F.lit(None).cast("int"), F.lit(True)))))
    return target, source, refs


@query(f"""select p as rec, case kind when 0 then 'UNCHANGED' when 1 then 'CHANGED_APPLIED' when 2 then 'CHANGED_PENDING' when 3 then 'PAIRED' when 4 then 'INSERTED_PAIR_PENDING' when 5 then 'INSERTED' when 6 then 'INSERTED' when 8 then 'SKIPPED_DUPLICATE_KEY'
  when 9 then 'INSERTED' when 10 then 'AMBIGUOUS' else 'INSERTED_PAIR_AMBIGUOUS' end as outcome from {_P} where kind <> 7
union all select p + 100000000, case kind when 5 then 'INSERTED' when 8 then 'SKIPPED_DUPLICATE_KEY' else 'INSERTED_PAIR_AMBIGUOUS' end from {_P} where kind in (5, 8, 11)""")
def x11_staged_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each staged lot comes to."""
    target, staged, _ = lots(spark, sf_dir)
    return parcels.staged_outcomes(parcels.matching(target, staged))


@query(f"""select p as id, case kind when 3 then 'PAIRED' when 4 then 'KEPT_STILL_PAIRABLE' when 11 then 'KEPT_STILL_PAIRABLE' when 5 then case when used and fixed then 'KEPT_NOT_REASSIGNABLE' when used then 'DELETED_AFTER_MOVES' else 'DELETED' end
  else case when used then 'KEPT_REFERENCED' else 'DELETED' end end as outcome, case kind when 4 then 'REPLACED_ONE' when 5 then 'SUBDIVIDED' when 6 then 'REPLACED_ONE' when 11 then 'REPLACED_ONE' when 3 then null else 'ORPHAN' end as cover from {_P} where kind in (3, 4, 5, 6, 7, 8, 11)""")
def x11_stored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stored lot that the staged layer doesn't name comes to, and what lies in its place now."""
    target, staged, refs = lots(spark, sf_dir)
    match = parcels.matching(target, staged)
    return parcels.stored_outcomes(match, parcels.verdicts(match, refs)[0])


@query(f"""select p * 10 + 1 as ref_id, p as parcel_id, p as rec from {_P} where kind = 5 and used and not fixed
union all select p * 10 + 2, p, p + 100000000 from {_P} where kind = 5 and used and not fixed
union all select p * 10 + 3, p, p from {_P} where kind = 5 and used and not fixed""")
def x11_moved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to subdivided lots and the parts that receive them: the nearest, or by cover without a place."""
    target, staged, refs = lots(spark, sf_dir)
    return parcels.moves_of(*parcels.verdicts(parcels.matching(target, staged), refs), refs)
