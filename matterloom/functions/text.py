"""Scalar functions on names, literals, logs and program texts. All are column expressions; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
#: Ordered rules of crash reasons, (text to find, reason).
CRASH_RULES = (
    ("System is out of GPU memory", "Out of GPU memory"),
    ("this scene is timed-out", "Timed out"),
    ("DUE TO TIME LIMIT", "Timed out"),
    ("<Signals.SIGKILL: 9>", "SIGKILL: 9 (out-of-memory, probably)"),
    ("SIGCONT", "SIGCONT (timeout?)"),
    ("srun: error", "srun error"),
)
NO_REASON = "Could not summarize cause"
#: Extensions of image types; all others get ``.bin``.
MIME = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff"}
#: A scheduler's line.
JOB_LINE = r"^([0-9]+) +(\S+) +(\S+) +([0-9]+) +([A-Z_]+) +(node[0-9]+) +(\S+).*$"
#: White space that stands around a response: that of Unicode, and the separators of ASCII.
AROUND = r"[\p{IsWhite_Space}\x1c-\x1f]+"
GB = {"G": 1.0, "M": 1e3, "K": 1e6}


def identifier(name: Column) -> Column:
    """Runs of characters that are no word characters become one underscore; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w]+", "_"), "_+", "_"), F.lit("_"))


def short_stem(stem: Column, longest: int = 20) -> Column:
    """The parts of a file stem of at most ``longest`` characters, joined again."""
    return F.array_join(F.filter(F.split(stem, "_"), lambda p: (p != "") & (F.length(p) <= longest)), "_")


def group_name(name: Column, stem: Column) -> Column:
    """A node group's identifier; the default name gives way to the short stem of its file (H2)."""
    name = identifier(name)
    default = (name == "NodeGroup") | name.startswith("NodeGroup_")
    return F.when(default, F.concat(short_stem(stem), F.substring(name, 10, 1 << 20))).otherwise(name)


def example_id(*parts: Column) -> Column:
    return F.translate(F.concat_ws("-", *parts), " ", "_")


def literal(value: Column) -> Column:
    """Three significant digits, at most three decimals, halves away from zero. What rounds to zero keeps its sign, as in the SQL."""
    size = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), 2 - F.greatest(size, F.lit(-1)))
    # The sign is laid on a double, since a whole number has no -0.
    rounded = F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(value == 0, F.lit(0.0)).when(value < 0, -rounded).otherwise(rounded)


def literal_text(value: Column, kind: str) -> Column:
    """Program text of a value: numbers by :func:`literal`, strings quoted, arrays in brackets."""
    if kind == "string":
        return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))
    if kind == "boolean":
        return F.when(value, "True").otherwise("False")
    if kind == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: literal(x).cast("string")), ", "), F.lit("]"))
    return literal(value).cast("string")


def short_count(n: Column) -> Column:
    """999, 1.50K, 2.50M, 1.00G."""
    # format_number rounds the double itself, as printf does; format_string would round its shortest decimal form.
    shown = lambda x, unit: F.concat(F.replace(F.format_number(x, 2), F.lit(","), F.lit("")), F.lit(unit))
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 1_000_000, shown(n / 1e3, "K")).when(n < 1_000_000_000, shown(n / 1e6, "M")).otherwise(shown(n / 1e9, "G"))


def bytes_text(n: Column) -> Column:
    """A size in binary units with one decimal."""
    out = F.format_string("%.1fYiB", n / 1024.0**8)
    for power, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB")))):
        out = F.when(F.abs(n) < 1024.0 ** (power + 1), F.format_string(f"%3.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def class_name(name: Column) -> Column:
    """The class of an object instance: before ``(``, after the last ``:``, before ``.``."""
    head = F.split_part(name, F.lit("("), F.lit(1))
    return F.split_part(F.split_part(head, F.lit(":"), F.lit(-1)), F.lit("."), F.lit(1))


def crash_reason(text: Column) -> Column:
    """The first rule that applies; else all error lines but the ignored one; else a fallback."""
    errors = F.filter(F.regexp_extract_all(text, F.lit("(Error:[^\n]+)\n"), F.lit(1)), lambda e: ~e.contains("Not freed memory blocks"))
    rules = [F.when(text.contains(find), reason) for find, reason in CRASH_RULES]
    return F.coalesce(*rules, F.when(F.size(errors) > 0, F.array_join(errors, ",")), F.lit(NO_REASON))


def crash_line(line: Column) -> Column:
    """The reason that one line of a log gives for a crash, by the rules of :func:`crash_reason`; null if it gives none."""
    return F.nullif(crash_reason(F.concat(line, F.lit("\n"))), F.lit(NO_REASON))


def seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``D day(s), H:MM:SS``; null if the text is neither."""
    pattern = r"^(?:(\d+) days?, )?(\d+):(\d\d):(\d\d)(?:\.\d+)?$"
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def clock(total: Column) -> Column:
    """``HH:MM:SS`` of a number of seconds."""
    total = total.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)


def memory_gb(text: Column) -> Column:
    """GB of a size with a unit suffix; -1 where there is none."""
    unit = F.regexp_extract(text, r"^([0-9.]+)([GMK])$", 2)
    number = F.nullif(F.regexp_extract(text, r"^([0-9.]+)([GMK])$", 1), F.lit("")).cast("double")
    value = F.coalesce(*[F.when(unit == u, number / d) for u, d in GB.items()])
    return F.coalesce(value, F.lit(-1.0))


def job_line(line: Column) -> Column:
    """A scheduler's line as a struct of id, name, resources, elapsed, state, node and start; more may follow on the line. Null
    if it is none."""
    get = lambda k: F.regexp_extract(line, JOB_LINE, k)
    return F.when(
        line.rlike(JOB_LINE),
        F.struct(get(1).cast("long").alias("job_id"), get(2).alias("name"), F.str_to_map(get(3), F.lit(","), F.lit("=")).alias("resources"), get(4).cast("long").alias("elapsed"), get(5).alias("state"), get(6).alias("node"), F.to_timestamp(get(7)).alias("start")),
    )


def data_url(url: Column) -> Column:
    """Extension and bytes of a base64 data URL; null if it is none or its payload is bad."""
    mime = F.regexp_extract(url, r"^data:([^;,]+);base64,", 1)
    payload = F.regexp_replace(F.when(mime != "", F.split_part(url, F.lit(","), F.lit(2))), r"\s", "")
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    data = F.try_to_binary(payload, F.lit("base64"))
    return F.when(data.isNotNull(), F.struct(F.coalesce(F.try_element_at(table, mime), F.lit(".bin")).alias("extension"), data.alias("data")))


def content_key(script: Column, image: Column, query: Column, rank: Column) -> Column:
    """Sixteen hex digits of the sha256 of the script's path, else the image's, else query and rank."""
    none = F.concat(query, F.lit("::rank="), rank.cast("string"))
    return F.substring(F.sha2(F.coalesce(F.nullif(script, F.lit("")), F.nullif(image, F.lit("")), none), 256), 1, 16)


def extract_code(response: Column) -> Column:
    """The looser extractor: the response without white space around it; what stands after the first fence, if there is one,
    without a leading language word, up to the next fence."""
    whole = F.regexp_replace(response, f"^{AROUND}|{AROUND}$", "")
    at = F.instr(whole, FENCE)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(whole)
    return F.substring_index(F.regexp_replace(rest, r"^python", ""), FENCE, 1)


def response_reason(response: Column, function: str = "def shader_material(") -> Column:
    """Why a response is no program: no fenced block, or a block without the function; null if it is one."""
    code = response_code(response)
    return F.when(code.isNull(), "No code block found").when(~code.contains(function), "Function not defined")


def response_code(response: Column) -> Column:
    """The block fenced as python, up to its end or that of the text; null without one."""
    found = F.regexp_extract(response, r"(?s)```python[^\n]*\n(.*?)(```|\z)", 1)
    return F.when(response.rlike(r"```python[^\n]*\n"), F.trim(found))


def bare_answer(answer: Column) -> Column:
    """A reference answer without its fence and language line."""
    return F.regexp_replace(F.btrim(answer, F.lit("`")), "^python[^\n]*\n", "")


def asset_name(name: Column) -> Column:
    """``Class(seed).spawn_kind(instance)`` as a struct; null if the whole name is not of that form."""
    pattern = r"^(.*)\((\d+)\)\.spawn_(.*)\((\d+)\)$"
    get = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(get(1).alias("cls"), get(2).cast("long").alias("seed"), get(3).alias("kind"), get(4).cast("long").alias("instance")))


def tool_error(output: Column) -> Column:
    """A tool's Python error up to where it quits; null if there is none."""
    return F.nullif(F.regexp_extract(output, r"(?s)(Error: Python:.*?)Blender quit", 1), F.lit(""))


def tool_failure(output: Column, path: Column, there: Column) -> Column:
    """Why a tool failed (B12): its Python error, else that the file it should have written is not there, by the file's kind; null if it
    did not fail. ``there`` is whether the file is."""
    kinds = {".py": "Code", ".jpg": "Rendered image", ".json": "Analysis result"}
    kind = F.coalesce(*[F.when(path.endswith(e), name) for e, name in kinds.items()], F.concat(F.lit("File '"), path, F.lit("'")))
    return F.coalesce(tool_error(output), F.when(~there, F.concat(kind, F.lit(" not found"))))


def pair_prompt(first: Column, second: Column) -> Column:
    """Two programs in one prompt: functions numbered, imports left out."""
    numbered = lambda c, n: F.trim(F.replace(F.replace(c, F.lit("import bpy"), F.lit("")), F.lit("shader_material"), F.lit(f"shader_material_{n}")))
    return F.concat(F.lit("```python\nimport bpy\n\n"), numbered(first, 1), F.lit("\n\n"), numbered(second, 2), F.lit("\n```"))
