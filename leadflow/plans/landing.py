"""Land fixture rows as API-shaped page files (test scaffolding, on Spark).

Pages are built with ``groupBy(stream, page)`` + ``collect_list``; the page
key is derived from an id column (``id div page_size``), so every page holds
at most ``page_size`` rows however large the tables grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.schemas import LEAD_COLUMN_BY_ID, STAGE_BY_GROUP
from leadflow.session import literal_table


def land_collection(df: DataFrame, path: str, stream: Column, page: Column, order: Column,
                    row: Column, error: Column | None = None) -> str:
    """Write ``{stream, page, collection, pagination, error}`` JSON lines, gzipped."""
    x = df.select(stream.alias("stream"), page.cast("long").alias("page"),
                  F.struct(order.alias("o"), row.alias("r")).alias("_e"))
    pages = x.groupBy("stream", "page").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
    pages = pages.select("stream", "page", F.transform("_es", lambda e: e["r"]).alias("collection"))
    nxt = F.concat(F.col("stream"), F.lit("?page="), (F.col("page") + 1).cast("string"))
    pages = pages.withColumn("pagination", F.struct(nxt.alias("next_page")))
    if error is not None:
        pages = pages.withColumn("error", error).withColumn(
            "collection", F.when(F.col("error").isNull(), F.col("collection")))
    pages.write.mode("overwrite").option("compression", "gzip").json(path)
    return path


_LANDED: dict = {}


def landed_once(spark, sf_dir: str, name: str, build):
    """Land one fixture's pages once per application and data set; later
    queries read the same files (pages land once and are read many times)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _LANDED:
        _LANDED[key] = build()
    return _LANDED[key]


TITLE_ID = {v: k for k, v in LEAD_COLUMN_BY_ID.items()}
GROUP_OF_STAGE = {v: k for k, v in STAGE_BY_GROUP.items()}

# Lead columns landed as board column values (by canonical name).
BOARD_COLUMNS = ("owner", "email", "sales_call_date", "deal_value", "utm_source",
                 "utm_campaign", "utm_content", "date_created")


def _board_item(e: Column) -> Column:
    """A lead as a board item, its columns by id.

    Every 11th item repeats ``deal_value`` (the last value is the real one)."""
    cvs = [F.struct(F.lit(TITLE_ID[c]).alias("id"), e[c].alias("text")) for c in BOARD_COLUMNS]
    dup = F.struct(F.lit(TITLE_ID["deal_value"]).alias("id"), F.lit("dup").alias("text"))
    arr = F.when(e["seq"] % 11 == 0, F.array(dup, *cvs)).otherwise(F.array(*cvs))
    return F.struct(e["item_id"].alias("id"), e["item_name"].alias("name"), arr.alias("column_values"))


def land_board_pages(leads: DataFrame, path: str, page_size: int = 50,
                     error_every: int | None = None) -> str:
    """Write board item pages: each group's first page in the nested first
    shape, later pages in the ``next_items_page`` shape.

    Leads are shuffled as they are, once, and become items and pages in the task that writes them.
    The files are gzipped: a page is mostly column ids."""
    grp = F.lit(None).cast("string")
    for stage, gid in GROUP_OF_STAGE.items():
        grp = F.when(F.col("stage") == stage, F.lit(gid)).otherwise(grp)
    x = leads.select(grp.alias("group_id"), (F.floor(F.col("seq") / page_size) + 1).cast("long").alias("page"),
                     F.struct("seq", "item_id", "item_name", *BOARD_COLUMNS).alias("_e"))
    firsts = x.groupBy("group_id").agg(F.min("page").alias("_fp"))      # a row per group
    pages = (x.repartition("group_id", "page").groupBy("group_id", "page").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
             .join(F.broadcast(firsts), "group_id").withColumn("_first", F.col("page") == F.col("_fp")))
    ip = F.struct(F.concat(F.lit("c-"), F.col("page").cast("string")).alias("cursor"), F.transform("_es", _board_item).alias("items"))
    boards = F.array(F.struct(F.array(F.struct(F.col("group_id").alias("id"), F.col("group_id").alias("title"),
                                                ip.alias("items_page"))).alias("groups")))
    # Null fields are left out of the JSON, so each page keeps only its own shape.
    data = F.struct(F.when(F.col("_first"), boards).alias("boards"),
                    F.when(~F.col("_first"), ip).alias("next_items_page"))
    out = pages.select(F.col("group_id").alias("stream"), "page", data.alias("data"))
    if error_every:
        err = F.when(F.col("page") % error_every == 0, F.array(F.struct(
            F.concat(F.lit("complexity budget exhausted on page "), F.col("page").cast("string")).alias("message"))))
        out = out.withColumn("errors", err)
    out.write.mode("overwrite").option("compression", "gzip").json(path)
    return path


def land_board_groups(leads: DataFrame, path: str) -> str:
    """One groups page listing the groups that have leads, plus one extra."""
    grp = F.lit(None).cast("string")
    for stage, gid in GROUP_OF_STAGE.items():
        grp = F.when(F.col("stage") == stage, F.lit(gid)).otherwise(grp)
    g = leads.select(grp.alias("id")).filter("id IS NOT NULL AND id <> 'new_group64021__1'").distinct()
    g = g.unionByName(literal_table(leads.sparkSession, [("archive_group",)], "id string"))
    doc = g.agg(F.sort_array(F.collect_list(F.struct("id", F.upper("id").alias("title")))).alias("groups")).select(
        F.lit("groups").alias("stream"), F.lit(1).cast("long").alias("page"),
        F.struct(F.array(F.struct("groups")).alias("boards")).alias("data"))
    doc.write.mode("overwrite").json(path)
    return path
