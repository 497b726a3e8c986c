"""One row a listed name, with the columns that screening needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, similarity, text
from ..shipping import ship_package

ALIAS_BASE = 1 << 56  # names are ordered primaries first, then aliases


def build(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_id, uid, entry_type, name_kind, is_weak, display); displays follow natural order."""
    person = F.col("entry_type") == "individual"
    shown = F.when(person & F.col("first_name").isNotNull(), F.concat_ws(" ", "first_name", "last_name")).otherwise(F.coalesce("last_name", "primary_name"))
    primary = entries.select(F.col("uid").cast("long").alias("name_id"), "uid", "entry_type", F.lit("primary").alias("name_kind"), F.lit(False).alias("is_weak"), shown.alias("display"))
    known = aliases.join(entries.select("uid", "entry_type"), "uid")
    other = known.select(
        (F.col("id") + ALIAS_BASE).alias("name_id"), "uid", "entry_type", F.lit("alias").alias("name_kind"), "is_weak",
        text.natural_order(F.col("alias_name"), person).alias("display"),
    )
    return derive(primary.unionByName(other))


def derive(names: DataFrame) -> DataFrame:
    """Adds name_norm, stem (null for individuals), grams, phonetic_keys, acronyms; names that normalise to nothing go."""
    ship_package(names.sparkSession)
    person = F.col("entry_type") == "individual"
    out = names.withColumn("name_norm", text.normalize(F.col("display"))).where("name_norm <> ''")
    none = F.array().cast("array<string>")
    return out.withColumns({
        "stem": F.when(person, None).otherwise(text.strip_legal_forms(F.col("name_norm"))),
        "grams": keys.trigrams(F.col("name_norm")),
        "phonetic_keys": keys.phonetic_keys("name_norm"),
        "acronyms": F.when(person, none).otherwise(keys.acronyms(F.col("name_norm"))),
    })


def write(names: DataFrame, path: str) -> None:
    """Store an index, in place of one that is there."""
    names.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def add(names: DataFrame, path: str) -> None:
    """Append the rows of ``names`` whose ids a stored index does not hold yet: later publications cost their own size."""
    known = read(names.sparkSession, path).select("name_id")
    names.join(known, "name_id", "left_anti").select(read(names.sparkSession, path).columns).write.mode("append").parquet(path)


def stem_idf(names: DataFrame) -> DataFrame:
    """(token, df, idf) over the stems of primary entity names."""
    return similarity.idf_table(names.where("entry_type = 'entity' and name_kind = 'primary'"))


def differences(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (with their side) in which a fresh build and a stored index differ, as multisets."""
    columns = sorted(set(fresh.columns) & set(stored.columns))
    a, b = fresh.select(columns), stored.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("fresh")).unionByName(b.exceptAll(a).withColumn("side", F.lit("stored")))


def acronym_groups(names: DataFrame) -> DataFrame:
    """(acronym, n_rows, n_uids, uids)."""
    return names.select("uid", keys.explode_keys("acronyms").alias("acronym")).where("acronym is not null").groupBy("acronym").agg(
        F.count("*").alias("n_rows"), F.countDistinct("uid").alias("n_uids"), F.sort_array(F.collect_set("uid")).alias("uids")
    )
