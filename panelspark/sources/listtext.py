"""Codes out of the text of a published list.

Documents are rows of lines, so a long one is spread over tasks: headings are
found by aggregation, not by walking a document in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Headings, entry layout, and the smallest believable list.
START = r"(?i)LIST OF SHARIAH-COMPLIANT SECURITIES\s*[-–—]\s*\w+"
END = r"(?i)ADDITIONAL LIST"
ENTRY = r"(\d{1,3})\.\s+(\d{4,5})\s+([A-Za-z0-9][^\d]{2,60}?)(?=\s{2,}|$)"
MIN_PLAUSIBLE = 300


def text_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(doc, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line_no", "line"))


def list_section(lines: DataFrame, doc: str = "doc_id", start: str = START, end: str = END) -> DataFrame:
    """Text after the first start heading and before the next end heading; no heading, no rows."""
    marks = lines.groupBy(doc).agg(
        F.min(F.when(F.col("line").rlike(start), F.col("line_no"))).alias("_start"))
    begun = (lines.join(marks.filter(F.col("_start").isNotNull()), doc)
             .filter(F.col("line_no") >= F.col("_start"))
             # on the heading's own line only what follows it counts
             .withColumn("line", F.when(F.col("line_no") == F.col("_start"),
                                        F.regexp_replace("line", "^.*?" + start, "")).otherwise(F.col("line"))))
    stops = begun.groupBy(doc).agg(
        F.min(F.when(F.col("line").rlike(end), F.col("line_no"))).alias("_end"))
    return (begun.join(stops, doc)
            .filter(F.col("_end").isNull() | (F.col("line_no") <= F.col("_end")))
            .withColumn("line", F.when(F.col("line_no") == F.col("_end"),
                                       F.regexp_replace("line", end + ".*$", "")).otherwise(F.col("line")))
            .select(doc, "line_no", "line"))


def document_section(documents: DataFrame, doc: str = "doc_id", text: str = "text", start: str = START, end: str = END) -> DataFrame:
    """The same for whole texts: a document is one row, so its lines are cut where they are and nothing is shuffled."""
    def place(lines, pattern):
        return F.array_position(F.transform(lines, lambda line: line.rlike(pattern)), True).cast("int")

    def tail(lines, first):
        return F.slice(lines, first, F.size(lines))

    rows = documents.select(doc, F.split(text, r"\r\n|\n|\r").alias("_l")).withColumn("_s", place(F.col("_l"), start)).filter("_s > 0")
    opened = F.regexp_replace(F.element_at("_l", F.col("_s")), "^.*?" + start, "")
    rows = rows.select(doc, "_s", F.concat(F.array(opened), tail(F.col("_l"), F.col("_s") + 1)).alias("_l"))
    rows = rows.withColumn("_e", place(F.col("_l"), end))
    closed = F.concat(F.slice("_l", 1, F.col("_e") - 1), F.array(F.regexp_replace(F.element_at("_l", F.col("_e")), end + ".*$", "")))
    kept = F.when(F.col("_e") > 0, closed).otherwise(F.col("_l"))
    return rows.select(doc, "_s", F.posexplode(kept).alias("_p", "line")).select(doc, (F.col("_s") - 1 + F.col("_p")).alias("line_no"), "line")


def assert_plausible(codes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Refuse a list too short to be the full one."""
    short = codes.filter("not plausible").select(doc, "n_codes").distinct().limit(1).collect()
    if short:
        raise ValueError(f"list {short[0][0]} holds only {short[0].n_codes} codes: a table of changes was read instead")
    return codes


def list_codes(section: DataFrame, doc: str = "doc_id", entry: str = ENTRY,
               min_plausible: int = MIN_PLAUSIBLE) -> DataFrame:
    """Each code once, at its first position, with the list's size and whether it is believable."""
    found = section.select(doc, "line_no", F.posexplode(
        F.regexp_extract_all("line", F.lit(entry), 2)).alias("at", "code"))
    first = found.groupBy(doc, "code").agg(F.min(F.struct("line_no", "at")).alias("_p"))
    sizes = first.groupBy(doc).agg(F.count("*").alias("n_codes"))
    return first.join(sizes, doc).select(
        doc, "code", F.col("_p.line_no").alias("line_no"), F.col("_p.at").alias("at"), "n_codes",
        (F.col("n_codes") >= min_plausible).alias("plausible"))
