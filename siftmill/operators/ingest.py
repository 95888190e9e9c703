"""Loading and cleaning: labels joined to records, first-wins de-duplication, keyed upserts, fingerprints, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.functions.text import blank_to_null, normalise_doi, whole_year
from siftmill.operators.ranking import positions
from siftmill.session import stage

#: Other names that frames use for a column.
ALIASES = {"label_included": ("label_included", "included", "label"), "work_id": ("openalex_id", "id", "work_id"), "year": ("publication_year", "year")}


def resolve_aliases(df: DataFrame) -> DataFrame:
    """The first of each column's other names that is there, under the column's name."""
    for name, others in ALIASES.items():
        found = next((c for c in others if c in df.columns), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def clean(df: DataFrame, texts: list[str], year: str | None = "year") -> DataFrame:
    """Blank texts become null, years whole numbers or null."""
    for c in texts:
        df = df.withColumn(c, blank_to_null(F.col(c)))
    return df.withColumn(year, whole_year(F.col(year))) if year else df


def require_labels(df: DataFrame, label: str = "label_included") -> DataFrame:
    """df with an int label; a label other than 0 and 1 fails the job."""
    bad = F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    return df.withColumn(label, F.when(F.col(label).cast("double").isin(0.0, 1.0), F.col(label).cast("int")).otherwise(bad.cast("int")))


def labels_with_records(labels: DataFrame, records: DataFrame) -> DataFrame:
    """A row per label; one without a record keeps null texts."""
    return labels.join(records, ["review", "work_id"], "left")


def first_wins(df: DataFrame, keys: list[str], position: list[str | Column]) -> DataFrame:
    """The first row of each key in the order of position."""
    order = W.partitionBy(*keys).orderBy(*position)
    return df.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def conflicting_labels(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys with more than one label: they must be none before loading."""
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("labels")).filter("labels > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Rows of new replace those of old with the same key, whole; within new the last (by at) counts."""
    columns = [c for c in old.columns if c not in keys]
    order = F.struct(*([F.col("_new"), F.col(at)] if at else [F.col("_new")]), *(F.col(c) for c in columns))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return latest.select(*keys, "r.*").select(*old.columns)


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key by at. A window, so that columns a query doesn't use are neither read nor shuffled; rows
    before the last are dropped on the map side."""
    return first_wins(df, keys, [F.col(at).desc_nulls_last()])


def fingerprint(df: DataFrame, by: list[str], order: Column, parts: list[Column], rows_per_part: int = 4096) -> DataFrame:
    """SHA-256 per group over its rows in order, as hashes of hashes of ranges so that no group is one value."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("None")) for p in parts)), 256)
    ranked = positions(df.select(*by, order.alias("_o"), row.alias("_h")), by, [F.col("_o").asc(), F.col("_h").asc()], "_k")
    pieces = ranked.groupBy(*by, F.floor((F.col("_k") - 1) / rows_per_part).alias("_p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda s: s["_h"]), "\n"), 256).alias("_h"), F.count("*").alias("_n"))
    return pieces.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda s: s["_h"]), "\n"), 256).alias("sha256"))


def cache_key(*parts: Column) -> Column:
    """Key of a remembered answer: a hash of model, prompt version, review and record."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def without_records(reviews: DataFrame, works: DataFrame) -> DataFrame:
    """Reviews that have no record: they must be none before a run."""
    return reviews.select("review").distinct().join(works.select("review"), "review", "left_anti")


def criteria_of(reviews: DataFrame, criteria: DataFrame, draft: str) -> DataFrame:
    """Every review's criteria, or the draft, with its status."""
    joined = reviews.select("review").distinct().join(criteria, "review", "left")
    return joined.select("review", F.coalesce("criteria", F.lit(draft)).alias("criteria"), F.when(F.col("criteria").isNull(), "working-draft").otherwise("published").alias("status"))


def web_duplicates(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """First-wins de-duplication on either of two keys: DOI, or title and year; returns df with ``kept``.

    A row is dropped if an earlier kept row of its group has its DOI or its title and year; the keys of dropped rows are
    forgotten. Decided in rounds: a row all of whose earlier sharers are dropped is kept, one with an earlier kept sharer
    is dropped. Each round settles at least the first open row of every chain, so it ends with none open, after as many
    rounds as the longest chain has links; none is decided on the driver.
    """
    doi = normalise_doi(F.col("doi"))
    title = F.nullif(F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))), F.lit(""))
    keys = F.array_compact(F.array(F.concat(F.lit("d:"), doi), F.concat(F.lit("t:"), title, F.lit("\x1f"), F.coalesce(F.col("year").cast("string"), F.lit("None")))))
    rows = df.withColumn("_keys", keys)
    state = stage(rows.select(*by, position, F.explode_outer("_keys").alias("key")).withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        # per key the first kept and the first open row: a key of any number of rows is a pair of numbers
        first = state.filter("key is not null and (kept or kept is null)").groupBy(*by, "key").agg(F.min(F.when(F.col("kept"), F.col(position))).alias("kept_at"), F.min(F.when(F.col("kept").isNull(), F.col(position))).alias("open_at"))
        marked = state.join(first, [*by, "key"], "left").select(*by, position, F.coalesce(F.col("kept_at") < F.col(position), F.lit(False)).alias("seen"), F.coalesce(F.col("open_at") < F.col(position), F.lit(False)).alias("waits"))
        each = marked.groupBy(*by, position).agg(F.bool_or("seen").alias("seen"), F.bool_or("waits").alias("waits"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("d.seen"), False).when(~F.col("d.waits"), True)
        state = stage(state.alias("s").join(each.alias("d"), [*by, position]).select(*by, position, "key", now.alias("kept")))
        if not state.filter("kept is null").limit(1).count():
            break
    settled = state.select(*by, position, "kept").distinct()
    return rows.drop("_keys").join(settled, [*by, position])
