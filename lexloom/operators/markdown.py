"""Markdown: fences, headings, links, anchors, and checks of links between files. A text's lines are one array, so nothing is shuffled but the joins of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"^\s*(```|~~~)"
#: A link that is no picture; the character before it stands in for a look-behind. Groups: that character, text, target.
LINK = r"(^|[^!])\[([^\]]*)\]\(([^)\s]+)[^)]*\)"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def fenced(text: Column) -> Column:
    """(inside, outside): arrays of the lines within fences and of the others; fence lines are in neither. A fence that is never closed runs to the end."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("inside"), F.array().cast("array<string>").alias("outside"))

    def step(s: Column, line: Column) -> Column:
        mark = line.rlike(FENCE)
        add = lambda side, on: F.when(~mark & on, F.array_append(side, line)).otherwise(side)
        return F.struct((s["open"] != mark).alias("open"), add(s["inside"], s["open"]).alias("inside"), add(s["outside"], ~s["open"]).alias("outside"))

    return F.aggregate(lines(text), start, step, lambda s: F.struct(s["inside"], s["outside"]))


def slug(heading: Column) -> Column:
    """The anchor of a heading: links as their text, no marks or punctuation, lower case, blanks as hyphens."""
    plain = F.regexp_replace(F.regexp_replace(heading, LINK, "$1$2"), r"[`*_]", "")
    return F.replace(F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N} -]", "")), F.lit(" "), F.lit("-"))


def headings(text: Column) -> Column:
    """The headings outside fences, in order, without their marks."""
    found = F.filter(fenced(text)["outside"], lambda x: x.rlike(r"^#{1,6}\s"))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^#{1,6}\s+|\s+#*\s*$", ""))


def targets(text: Column) -> Column:
    """The targets of links outside fences, in order."""
    return F.regexp_extract_all(F.array_join(fenced(text)["outside"], "\n"), F.lit(LINK), F.lit(3))


def anchors(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, place, heading, anchor: a slug that a file has before gets -1, -2 and so on."""
    h = files.select(path, F.posexplode(headings(F.col(text))).alias("place", "heading")).withColumn("slug", slug(F.col("heading")))
    again = F.row_number().over(Window.partitionBy(path, "slug").orderBy("place")) - 1
    return h.withColumn("anchor", F.when(again > 0, F.concat("slug", F.lit("-"), again.cast("string"))).otherwise(F.col("slug"))).drop("slug")


def resolved(path: Column, target: Column) -> Column:
    """The file that a relative target names from `path`; the file itself for a bare fragment."""
    bare, folder = F.regexp_replace(target, "#.*$", ""), F.regexp_replace(path, "[^/]*$", "")
    parts = F.split(F.concat(folder, bare), "/")
    walk = lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when((x == ".") | (x == ""), s).otherwise(F.array_append(s, x))
    return F.when(bare == "", path).otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/"))


def broken_links(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, target, problem ('no such file' or 'no such anchor'), each once: of links that are not to other sites."""
    out = files.select(F.col(path).alias("path"), F.explode(targets(F.col(text))).alias("target")).distinct().where(~F.col("target").rlike("^[a-z][a-z0-9+.-]*:"))
    out = out.withColumns({"file": resolved(F.col("path"), F.col("target")), "fragment": F.regexp_extract("target", "#(.*)$", 1)})
    known = files.select(F.col(path).alias("file")).distinct().withColumn("there", F.lit(1))
    named = anchors(files, path, text).select(F.col(path).alias("file"), F.col("anchor").alias("fragment")).distinct().withColumn("anchored", F.lit(1))
    m = out.join(known, "file", "left").join(named, ["file", "fragment"], "left")
    problem = F.when(F.col("there").isNull(), "no such file").when((F.col("fragment") != "") & F.col("anchored").isNull(), "no such anchor")
    return m.select("path", "target", problem.alias("problem")).where("problem is not null")


def cells(text: Column, mark: str = r"^# %%") -> Column:
    """The cells of a percent-format notebook, in order: (kind, source) with kind 'markdown' where the mark says so; lines before the first mark are left out."""
    start = F.array().cast("array<struct<kind:string,source:string>>")

    def step(s: Column, line: Column) -> Column:
        opened = F.struct(F.when(line.contains("[markdown]"), "markdown").otherwise("code").alias("kind"), F.lit("").alias("source"))
        last = F.try_element_at(s, F.lit(-1))
        longer = F.struct(last["kind"].alias("kind"), F.concat(last["source"], line, F.lit("\n")).alias("source"))
        return F.when(line.rlike(mark), F.array_append(s, opened)).when(F.size(s) > 0, F.array_append(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), longer)).otherwise(s)

    return F.aggregate(lines(text), start, step)
