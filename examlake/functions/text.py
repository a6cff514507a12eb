"""Scalar functions on exam text, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question types with their labels, in the order of reports.
TYPE_LABELS = {"single": "单选", "multi": "多选", "judge": "判断", "blank": "填空", "essay": "简答"}
#: What ends a sentence.
SENTENCE_ENDS = "。．.！!？?：:；;）)”\"」』"
#: What an image question's stem or options hold, and the section names of each type, in order of precedence.
SECTION_TYPES = [
    ("multi", "不定项|多项选择|多选"),
    ("single", "单项选择|单选|选择题"),
    ("judge", "判断"),
    ("blank", "填空"),
    ("essay", "简答|论述|问答|案例分析|计算题|材料分析"),
]


def stripped(text: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)^\s+|\s+$", "")


def seldom_stripped(text: Column | str) -> Column:
    """stripped(), for texts (a column, as it stands here several times) of which most have no white space at an end: of those only the ends are looked at, not each character."""
    column = F.col(text) if isinstance(text, str) else text
    ends = F.concat(F.left(column, F.lit(1)), F.right(column, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), stripped(column)).otherwise(column)


def squeezed(text: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\s+", "")


def split_lines(text: Column | str) -> Column:
    """The lines of a text; all Unicode line breaks count."""
    return F.split(F.col(text) if isinstance(text, str) else text, "[\n\u000b\f\r\u001c-\u001e\u0085  ](?:(?<=\\r)\\n)?")


def blank_runs(text: Column | str) -> Column:
    """The number of runs of at least two underscores, plain or full-width."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit("[_＿]{2,}"))


def weighted_length(text: Column | str) -> Column:
    """1 for each character above U+2E80, 0.55 for any other."""
    column = F.col(text) if isinstance(text, str) else text
    narrow = F.octet_length(column) == F.length(column)  # ASCII alone
    wide = F.when(narrow, 0).otherwise(F.length(F.regexp_replace(column, "[\\x{0}-\\x{2E80}]+", "")))
    return wide + (F.length(column) - wide) * F.lit(0.55)


def ends_sentence(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    last = F.right(column, F.lit(1))
    last = F.when(last.rlike(r"(?U)\s"), F.right(F.regexp_replace(column, r"(?U)\s+$", ""), F.lit(1))).otherwise(last)
    return (last != "") & (F.instr(F.lit(SENTENCE_ENDS), last) > 0)


def section_type(name: Column | str) -> Column:
    """The question type that a section's name stands for; single by default."""
    column = F.col(name) if isinstance(name, str) else name
    out = F.lit("single")
    for kind, names in reversed(SECTION_TYPES):
        out = F.when(reduce(or_, [column.contains(name) for name in names.split("|")]), kind).otherwise(out)
    return out


def type_label(kind: Column | str) -> Column:
    column = F.col(kind) if isinstance(kind, str) else kind
    labels = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, column), column)


def question_key(unit: str = "unit", no: str = "no") -> Column:
    return F.concat_ws("|", F.coalesce(F.col(unit), F.lit("")), F.col(no).cast("string"))


def display_label(unit: str = "unit", no: str = "no") -> Column:
    """unit-no, or no alone where there is no unit."""
    return F.concat(F.when(F.coalesce(F.col(unit), F.lit("")) != "", F.concat(F.col(unit), F.lit("-"))).otherwise(""), F.col(no).cast("string"))


def formatted_answer(kind: str = "type", values: str = "values", is_list: str = "is_list") -> Column:
    """An answer as text. Choices: non-empty values in order, with spaces; blanks: trimmed values unless all are empty; else the trimmed text.

    values is an array even for a single answer; is_list says whether it was given as a list. A list for an essay is joined by line ends.
    """
    given = F.col(values)
    trimmed = F.transform(given, lambda v: F.btrim(v))
    choice = F.when(F.col(is_list), F.array_join(F.array_sort(F.filter(given, lambda v: v != "")), " ")).otherwise(F.array_join(trimmed, ""))
    blank = F.when(F.exists(trimmed, lambda v: v != ""), F.array_join(trimmed, "；")).otherwise("")
    return F.when(given.isNull(), "").when(F.col(kind).isin("single", "multi", "judge"), choice).when(F.col(kind) == "blank", blank).otherwise(F.btrim(F.array_join(given, "\n")))


def answer_values(answer: Column | str) -> Column:
    """(values, is_list) of an answer as it was sent, for formatted_answer(): a JSON text, number or truth value is one value, a list or an object (by the order of its keys, numbers first) is several.

    JSON null and a null answer have no values; what isn't JSON is a text.
    """
    column = F.col(answer) if isinstance(answer, str) else answer
    parsed = F.try_parse_json(column)
    kind = F.schema_of_variant(parsed)
    entries = F.array_sort(F.transform(F.map_entries(F.try_variant_get(parsed, "$", "map<string,string>")), lambda e: F.struct(e["key"].try_cast("long").isNull().alias("named"), e["key"].try_cast("long").alias("at"), e["key"], e["value"])))
    whole = lambda values: F.transform(values, lambda v: F.coalesce(v, F.lit("")))
    values = (
        F.when(parsed.isNull(), F.when(column.isNotNull(), F.array(column))).when(kind.startswith("ARRAY"), whole(F.try_variant_get(parsed, "$", "array<string>"))).when(kind.startswith("OBJECT"), whole(F.transform(entries, lambda e: e["value"])))
        .when(kind != "VOID", F.array(F.try_variant_get(parsed, "$", "string")))
    )
    return F.struct(values.alias("values"), F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False)).alias("is_list"))


def slug(name: Column | str, fallback: str = "paper") -> Column:
    """Letters, digits, _ and - of a name; a fallback where nothing is left."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.regexp_replace(column, r"[^A-Za-z0-9_\-]+", ""), F.lit("")), F.lit(fallback))


def masked(secret: Column | str) -> Column:
    column = F.col(secret) if isinstance(secret, str) else secret
    return F.concat(F.lit("******"), F.right(column, F.lit(4)))


#: Figures and signs with their raised forms.
RAISED = ("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")


def raised(text: Column | str) -> Column:
    """With figures, signs and n as superscripts."""
    return F.translate(F.col(text) if isinstance(text, str) else text, *RAISED)


def safe_name(name: Column | str) -> Column:
    """Up to ten letters, digits and Chinese characters of a name; u where nothing is left."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.left(F.regexp_replace(column, "[^A-Za-z0-9一-鿿]+", ""), F.lit(10)), F.lit("")), F.lit("u"))


def picture_name(seq: str = "seq", unit: str = "unit", no: str = "no", prefix: str = "q") -> Column:
    """The file of a question's picture: q for itself, m for its material."""
    return F.format_string(f"{prefix}_%03d_%s_%d.png", F.col(seq), safe_name(unit), F.col(no))


def table_row(cells: Column | str) -> Column:
    """Cells as one line between bars; line ends become spaces, bars full-width bars."""
    column = F.col(cells) if isinstance(cells, str) else cells
    return F.concat(F.lit("|"), F.array_join(F.transform(column, lambda c: stripped(F.translate(c, "\n|", " ｜"))), "|"), F.lit("|"))


def table_cells(line: Column | str) -> Column:
    """The cells of such a line; null for any other."""
    column = F.col(line) if isinstance(line, str) else line
    inside = F.substring(column, F.lit(2), F.length(column) - 2)
    return F.when((F.length(column) >= 2) & column.startswith("|") & column.endswith("|"), F.split(inside, r"\|", -1))


def spans_of_cells(rows: Column | str) -> Column:
    """Of a table (array of rows of cells), row by row: text, colspan and rowspan of each cell; > is merged into the cell to its left, ^ into the one above."""
    table = F.col(rows) if isinstance(rows, str) else rows
    run = lambda marks, sign: F.size(F.aggregate(marks, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("run")), lambda s, c: F.struct((s["on"] & (c == sign)).alias("on"), F.when(s["on"] & (c == sign), F.array_append(s["run"], c)).otherwise(s["run"]).alias("run")))["run"])

    def cell(row: Column, r: Column, c: Column, k: Column) -> Column:
        below = F.transform(F.filter(table, lambda _, i: i > r), lambda x: F.coalesce(F.get(x, k), F.lit("")))
        return F.struct(c.alias("text"), (run(F.filter(row, lambda _, i: i > k), ">") + 1).alias("colspan"), (run(below, "^") + 1).alias("rowspan"), k.alias("at"))

    def own(row: Column, r: Column) -> Column:
        return F.filter(F.transform(row, lambda c, k: cell(row, r, c, k)), lambda x: ~x["text"].isin(">", "^"))

    return F.transform(table, own)


def is_answered(values: Column | str) -> Column:
    """Whether any value is more than white space."""
    return F.coalesce(F.exists(F.col(values) if isinstance(values, str) else values, lambda v: stripped(v) != ""), F.lit(False))


def escaped(text: Column | str) -> Column:
    """For HTML: & first, then the signs that it would turn into."""
    column = F.col(text) if isinstance(text, str) else text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(sign), F.lit(entity))
    return column


def paper_title(given: str, parsed: str, fallback: Column) -> Column:
    """The given title, else the parsed one, else a fallback; 80 characters at most."""
    pick = F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in (given, parsed)], fallback)
    return F.left(stripped(pick), F.lit(80))


def time_id(at: Column | str, prefix: Column | None = None) -> Column:
    """An id from a moment, which is a parameter and not the clock."""
    stamp = F.date_format(at, "yyyyMMdd-HHmmss")
    return stamp if prefix is None else F.concat_ws("-", stamp, prefix)


def quantised_box(x: str, y: str, height: str) -> Column:
    """A picture's place in steps of five, halves to even."""
    return F.concat(F.lit("IMG@"), F.concat_ws(":", *[F.bround(F.col(c) / 5).cast("long").cast("string") for c in (x, y, height)]))


def utf16_text(content: Column | str) -> Column:
    """Little-endian two-byte text, as older Word files hold it: of fields (between 0x13 and 0x15) the result behind 0x14 alone, 0x1E as a hyphen, no control characters."""
    text = F.decode(F.col(content) if isinstance(content, str) else content, "UTF-16LE")
    shown = F.regexp_replace(text, r"\x13[^\x14\x15]*(?:\x14|\x15)", "")
    return stripped(F.regexp_replace(F.regexp_replace(shown, r"\x1E", "-"), r"[\x00-\x08\x0B-\x1F]", ""))
