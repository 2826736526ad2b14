"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations.

Each line hash gets a HyperLogLog sketch of the sites it is on; sketches are built
where the lines are read and merge by aggregation.  Lines whose estimate is near the
threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.shared import look_up, written


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, row, pos, site, h) of every line, row a digest of the text; null texts have none, blank lines are not counted."""
    lines = docs.select(F.col(id_col).alias("id"), _hash(F.col(text_col)).alias("row"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select("id", "row", "pos", "site", _hash(F.col("line")).alias("h"))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, least_sites: int = 5, log_k: int = 12) -> DataFrame:
    """(h, sites, times): hashes of the lines on ``least_sites`` sites or more, and how often they occur.

    ``sites`` is exact below twice the threshold, else estimated.  At such small counts a
    sketch is off only where sites share one of its 2^26 values, so that a
    line on ``least_sites`` sites is never estimated at half of them.
    """
    lines = lines_of(docs, id_col, text_col, site_col).select("h", "site")
    # sketches take no notice of empty strings
    site = F.concat(F.lit("="), F.col("site"))
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg(site, log_k)).alias("estimate"), F.count("*").alias("times"))
    sketched = written(sketched.filter(2 * F.col("estimate") >= least_sites), "sketched")
    near = sketched.filter(F.col("estimate") < 2 * least_sites).select("h", "times")
    met = look_up(lines, near, "h", "times", _sum(near))
    exact = met.groupBy("h").agg(F.count_distinct("site").alias("sites"), F.count("*").alias("times"))
    far = sketched.filter(F.col("estimate") >= 2 * least_sites).select("h", F.col("estimate").cast("long").alias("sites"), "times")
    return exact.filter(F.col("sites") >= least_sites).unionByName(far)


def _sum(lines: DataFrame) -> int:
    return lines.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, least_sites: int = 5, log_k: int = 12) -> DataFrame:
    """One row a document: id, n_lines, n_removed, text.

    Lines that are on ``least_sites`` distinct sites or more are taken out; ``text`` is the
    other lines, in order, joined as they were.  Lines end at newlines and are compared whole; blank
    lines stay.  A null site is one site, the empty string.  Null texts stay null with no
    lines; an empty text has one line, a blank one.  A row is known by its id and its text, so null
    and shared ids are no matter; repeated rows give repeated results and count as one site.  Other
    columns are ignored; an empty table gives no rows.
    """
    spread = written(spread_lines(docs, id_col, text_col, site_col, least_sites=least_sites, log_k=log_k).select("h", "times"), "spread")
    met = look_up(lines_of(docs, id_col, text_col, site_col).select("id", "row", "pos", "h"), spread, "h", "times", _sum(spread))
    places = met.groupBy(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", _hash(F.col("text")))
    joined = source.join(places, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left").withColumn("lines", F.split("text", "\n", -1))
    # the lines between one place and the next, from before the first to behind the last
    before, behind = F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.size("lines")))
    left = F.flatten(F.zip_with(before, behind, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return joined.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )
