"""Program texts as rows, and rows as program text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: The three kinds of statements, by the order of their sections.
NODE = r"^(\w+) = nodes\.new\('([^']+)'\)$"
PARAM = r"^(\w+)\.inputs\[(\d+)\]\.default_value = (.+)$"
LINK = r"^links\.new\((\w+)\.outputs\[(\d+)\], (\w+)\.inputs\[(\d+)\]\)$"
GROUP = r"node_groups\['([^']+)'\]"


def statements(programs: DataFrame, key: str, code: str) -> DataFrame:
    """(key, pos, line): the lines of a program, trimmed, without empty ones."""
    lines = programs.select(key, F.posexplode(F.split(code, "\n")).alias("pos", "line"))
    return lines.select(key, F.col("pos").cast("long").alias("pos"), F.trim("line").alias("line")).where("line <> ''")


def rows(programs: DataFrame, key: str, code: str) -> DataFrame:
    """Each statement as a row: its kind (node, param, link or other) and its parts a, b, c, d (H6)."""
    line = F.col("line")

    def pick(pattern: str, kind: str, parts: int) -> Column:
        got = [F.regexp_extract(line, pattern, k + 1).alias("abcd"[k]) if k < parts else F.lit(None).cast("string").alias("abcd"[k]) for k in range(4)]
        return F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), *got))

    other = F.struct(F.lit("other").alias("kind"), *[F.lit(None).cast("string").alias(x) for x in "abcd"])
    parsed = F.coalesce(pick(NODE, "node", 2), pick(PARAM, "param", 3), pick(LINK, "link", 4), other)
    return statements(programs, key, code).select(key, "pos", parsed.alias("s")).select(key, "pos", "s.*")


def line_text() -> Column:
    """The statement that a row of :func:`rows` stands for; null for other lines."""
    return (
        F.when(F.col("kind") == "node", F.format_string("%s = nodes.new('%s')", "a", "b"))
        .when(F.col("kind") == "param", F.format_string("%s.inputs[%s].default_value = %s", "a", "b", "c"))
        .when(F.col("kind") == "link", F.format_string("links.new(%s.outputs[%s], %s.inputs[%s])", "a", "b", "c", "d"))
    )


def programs(parsed: DataFrame, key: str) -> DataFrame:
    """Program texts in their three sections: nodes, parameters, links, each in order (H7)."""
    section = F.when(F.col("kind") == "node", 0).when(F.col("kind") == "param", 1).otherwise(2)
    lines = parsed.where("kind <> 'other'").select(key, F.struct(section.alias("section"), "pos", line_text().alias("line")).alias("s"))
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select(key, F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("code"))


def group_references(texts: DataFrame, key: str, code: str) -> DataFrame:
    """(key, group): node groups that a program names."""
    return texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(GROUP), F.lit(1)))).alias("group"))


def ramp_changes(rows_: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Stops of a ramp, or points of a curve, that differ from the default's, and those that are appended (H8)."""
    mine = rows_.select(key, default, F.posexplode(value).alias("pos", "stop"))
    usual = F.try_element_at(default, F.col("pos") + 1)
    changed = mine.withColumn("change", F.when(F.col("pos") >= F.size(default), "appended").when(~F.col("stop").eqNullSafe(usual), "changed"))
    return changed.where("change IS NOT NULL").select(key, F.col("pos").cast("long").alias("pos"), "stop", "change")


@udtf(returnType="pos long, kind string, a string, b string, c string, d string")
class ProgramRows:
    """The same parse as a table function (L4), for use in SQL on single programs: ``SELECT * FROM program_rows(code)``."""

    def eval(self, code: str):
        import re

        for pos, line in enumerate((code or "").split("\n")):
            line = line.strip(" ")
            if not line:
                continue
            for kind, pattern in (("node", NODE), ("param", PARAM), ("link", LINK)):
                if m := re.match(pattern, line):
                    parts = list(m.groups())
                    yield (pos, kind, *(parts + [None] * (4 - len(parts))))
                    break
            else:
                yield (pos, "other", None, None, None, None)


#: The comment that opens the parameters, and lines that set or add stops and points.
PARAMETERS = "# Set parameters for each node"
STOP = r"^\w+\.(color_ramp\.elements\[\d+\]\.(position|color)|curves\[\d+\]\.points\[\d+\]\.location) = "
NEW_STOP = r"^\w+\.(color_ramp\.elements|curves\[\d+\]\.points)\.new"


def shrunk(texts: DataFrame, key: str, code: str, limit: int, seed: int) -> DataFrame:
    """(key, code): programs of at most ``limit`` tokens (H28). From longer ones parameter lines go in the order of their hashes until the
    rest fits; a new stop or point goes with the line after it, and updates of stops and points stay. ``code`` is null where all
    that may go is not enough. Tokens are the built-in count, which adds up over lines."""
    from pyspark.sql import Window

    from ..functions.hashing import int_hash
    from .gates import token_count

    whole = Window.partitionBy(key)
    rows_ = texts.select(key, F.posexplode(F.split(code, "\n", -1)).alias("pos", "line"))
    rows_ = rows_.withColumns({"bare": F.trim("line"), "tokens": token_count(F.col("line"))})
    inside = F.min(F.when(F.col("line").contains(PARAMETERS), F.col("pos"))).over(whole)
    follows = F.coalesce(F.lag("bare").over(whole.orderBy("pos")).rlike(NEW_STOP), F.lit(False))
    may = (F.col("pos") > inside) & (F.col("bare") != "") & ~F.col("bare").startswith("#") & (~F.col("bare").rlike(STOP) | follows)
    rows_ = rows_.withColumns({"may": F.coalesce(may, F.lit(False)), "part": F.when(follows, F.col("pos") - 1).otherwise(F.col("pos"))})
    rows_ = rows_.withColumns({"order": F.when(F.col("may"), int_hash(seed, F.col(key), F.lit("/"), F.col("part"))), "total": F.sum("tokens").over(whole)})
    # What goes before a part, in the order of parts.
    parts = rows_.where("may").groupBy(key, "part").agg(F.first("order").alias("order"), F.sum("tokens").alias("gone"))
    before = F.coalesce(F.sum("gone").over(Window.partitionBy(key).orderBy("order", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(key, "part", before.alias("before"))
    marked = rows_.join(parts, [key, "part"], "left")
    stays = ~F.col("may") | (F.col("total") - F.col("before") <= limit)
    kept = marked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(stays, F.struct("pos", "line")))).alias("lines"),
        F.coalesce(F.sum(F.when(stays, F.col("tokens"))), F.lit(0)).alias("left"),
    )
    return kept.select(key, F.when(F.col("left") <= limit, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("code"))
