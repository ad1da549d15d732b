"""The work table: which rows are open, what their link is, how results are written back, and where the work stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import urls
from ..functions.text import text_of


def is_open(verifier: Column, error: Column) -> Column:
    return (text_of(verifier) == "") & (text_of(error) == "")


def open_rows(sheet: DataFrame) -> DataFrame:
    return sheet.filter(is_open(F.col("Verifier"), F.col("Error")))


def row_at(sheet: DataFrame, index: int) -> DataFrame:
    return sheet.filter(F.col("row_index") == index).na.fill("")


def link_of(source: Column, notes: Column) -> tuple[Column, Column]:
    """The link, from Source before Notes, and whether it is from Notes."""
    own, other = urls.first_url(source), urls.first_url(notes)
    return F.coalesce(own, other), own.isNull() & other.isNotNull()


def padded(row: Column, width: int) -> Column:
    """A ragged row as exactly `width` cells; missing ones null, surplus ones cut."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(row, i))


def updated(sheet: DataFrame, updates: DataFrame, key: str = "row_index") -> DataFrame:
    """sheet with the cells that updates (key, cells: map of column to value, verifier, error) names; an empty value overwrites, an absent one doesn't.

    Verifier changes only to a non-empty value, Error whenever it is given. Columns that the sheet lacks are passed over.
    """
    met = sheet.join(updates.select(key, F.col("cells").alias("_cells"), F.col("verifier").alias("_verifier"), F.col("error").alias("_error")), key, "left")
    columns = []
    for c in sheet.columns:
        if c == key:
            columns.append(F.col(c))
        elif c == "Verifier":
            columns.append(F.when(text_of(F.col("_verifier")) != "", F.col("_verifier")).otherwise(F.col(c)).alias(c))
        elif c == "Error":
            columns.append(F.coalesce("_error", c).alias(c))
        else:
            columns.append(F.when(F.coalesce(F.map_contains_key("_cells", c), F.lit(False)), F.try_element_at("_cells", F.lit(c))).otherwise(F.col(c)).alias(c))
    return met.select(*columns)


def latest(updates: DataFrame, key: str = "row_index") -> DataFrame:
    """Updates (key, ord, cells, verifier, error) in the order of ord as one per key: of each cell its last value, the last verifier that isn't empty, the last error given.

    Of updates equal in ord the larger value counts. A key of many updates is folded by partial aggregates, never gathered.
    """
    cells = updates.select(key, "ord", F.explode("cells").alias("_name", "_value")).groupBy(key, "_name").agg(F.max_by("_value", F.struct("ord", "_value")).alias("_value"))
    cells = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("cells"))
    last = lambda c, kept: F.max_by(F.when(kept, F.col(c)), F.when(kept, F.struct("ord", c))).alias(c)
    rest = updates.groupBy(key).agg(last("verifier", text_of(F.col("verifier")) != ""), last("error", F.col("error").isNotNull()))
    return rest.join(cells, key, "left")


def without_rows(sheet: DataFrame, gone: DataFrame, key: str = "row_index") -> DataFrame:
    """sheet without the keys of gone."""
    return sheet.join(gone.select(key).distinct(), key, "left_anti")


def with_rows(sheet: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after the sheet's; columns that one side lacks are null."""
    return sheet.unionByName(new, allowMissingColumns=True)


def statistics(sheet: DataFrame, reviewed: bool = False) -> DataFrame:
    """One row of counts. With `reviewed`, Error = N means looked over, not failed, and open rows are counted as such; without, open = total - filled - error."""
    filled, note = text_of(F.col("Verifier")) != "", text_of(F.col("Error"))
    counts = [F.count("*").alias("total"), F.count_if(filled).alias("filled")]
    if reviewed:
        counts += [F.count_if(note == "N").alias("reviewed"), F.count_if((note != "") & (note != "N")).alias("error"), F.count_if(~filled & (note == "")).alias("pending")]
    else:
        counts += [F.count_if(note != "").alias("error")]
    out = sheet.agg(*counts)
    if not reviewed:
        out = out.withColumn("pending", F.col("total") - F.col("filled") - F.col("error"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("filled") * 100 / F.col("total"), 4)).otherwise(0.0))


def outcome(found: Column, link: Column, from_notes: Column, content: Column, has_results: Column, stage_error: Column) -> tuple[Column, Column, Column]:
    """Verifier (null: left alone), Error (null: left alone) and whether the row counts as done."""
    third = urls.is_third_party(link) & ~from_notes
    no_error = text_of(stage_error) == ""
    ok = has_results & no_error
    early = F.when(~found, L.NO_ROW).when(link.isNull(), L.NO_LINK).when(text_of(content) == "", L.NO_CONTENT)
    notes = F.when(third, L.THIRD_PARTY_NOTE)
    error = F.concat_ws("; ", F.when(~no_error, stage_error), notes, F.when(ok & from_notes, L.NOTES_NOTE))
    verifier = F.when(early.isNull() & ok, "LLM")
    return verifier, F.coalesce(early, F.nullif(error, F.lit(""))), early.isNull() & has_results


def conversation_lines(turns: DataFrame) -> DataFrame:
    """conv_id, name, log: each conversation's turns in order as one text, with the name of its file."""
    line = F.struct("turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), text_of(F.col("text"))).alias("line"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return per.select("conv_id", F.format_string("row_%04d.txt", "conv_id").alias("name"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("log"))


def numbered(sheet: DataFrame, order: str) -> DataFrame:
    """sheet with row_index from 0. For display-sized tables: the numbering needs one order."""
    return sheet.withColumn("row_index", F.row_number().over(W.orderBy(order)) - 1)
