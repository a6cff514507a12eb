"""How the lines of exam papers are recognised: a line's shape is a string of the same length with a sign for the class of each character, and rules are patterns of such signs.

A place in the shape is the place in the text. Everything here is a column expression; what depends on words, and not on classes of signs, looks at the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of signs, and the words and labels by which papers are known.
HAN = "一-鿿"
POINTS = ".．、"
NUMERALS = "一二三四五六七八九十"
DIGITS = "0123456789０１２３４５６７８９"
SIGNS = {
    "9": DIGITS, "n": NUMERALS, "L": "ABCDEFG", "w": "HIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ".": POINTS, ":": ":：", ",": ",，;；", "-": "-–—~～", "(": "(（", ")": ")）", "[": "[【", "]": "]】",
    "%": "%％", "/": "/", "q": "\"“", "_": "_＿", " ": " \t\u00a0\u2002\u2003\u2009\u3000", "d": "第", "t": "题", "y": "年", "j": "项选正错和或与",
}
DIVISIONS = "单元|部分|篇|卷"
ANSWER_LABELS = "答案解析|参考答案|正确答案|答案|解析"
READING_MATTER = "材料|短文|文章|资料|统计表|图表|下表"
READING_SECTIONS = "完形填空|阅读理解|资料分析|阅读材料"
TYPE_MARKS = {"单选": "single", "多选": "multi", "判断": "judge", "填空": "blank", "简答": "essay", "不定项": "multi"}
MULTI_CUES = "多项|多选|有哪些|包括哪些|正确的有|错误的有|不定项"
STEM_CUES = "选项|填入|问号|下列|以下|正确|错误|规律"
FIGURE_CUES = "问号|图形|图片|填入"
VERDICTS = "故本题|正确答案|答案为|答案选|答案是|由(?:表格|材料|题干|图|图表|文段)可知|(?:错误|正确)(?:[，。]排除|[。；;])|排除\\s*[A-G]|[选为]\\s*[A-G]\\s*[。．]|^[A-G]\\s*项[，,、:：]"
ARGUMENTS = "解得|可得|可知|排除|选项|答案|∴|综上|即可|[=＝]|故选|本题|考查|考察|则[有:：]|设[一-鿿a-zA-Z]{0,4}[为是]"
MATH_SIGNS = "⁰¹²³⁴⁵⁶⁷⁸⁹×÷√∑∫≈≠≤≥∠π°∞"
PRIVATE = r"[\uE000-\uF8FF\uFFFD]"

#: Signs of what can be part of a word.
_WORDY = "hndtyjLw"

# Rules over shapes.
NUMBER = "^ *(9{1,3}) *[.:](?!9(?!999 *[y-])) *"
NUMBER_WORD = "^ *d *(9{1,3}) *t[.:]? *"
SECTION = r"^ *n+ *\. *[^ ]"
SECTION_MARK = r"^ *n+ *\. *"
OPTION = "^ *L(?: *[.:]| +(?=[hndty9])) *"
OPTION_MARK = r"L(?: *\.| +(?=[hndty9]))"
KEY_ROW = r"^ *(?:9{1,3} *[.:]? *L{1,4} *[,.]? *){2,}$"
#: A label and three digits at least, with what may stand in figures between them; each digit may be a figure of its own, so the pattern has one way to match.
FIGURES_ROW = "^[^9\n]{1,24}? *(?:-?9[.,%]* *){3,}(?:\n|$)"
HEADING = rf"^[{_WORDY}]{{2,8}}(?: *\( *9{{1,3}} *\))?$"
AXIS = r"^[9 %.,:/()-]+$"
GLUED_NUMBER = r"^ *(9{1,3})(?=[hndtyjq(])"
LOOSE_NUMBER = r"^9{1,3} *\."
EMPTY_BRACKET = r"\( *\)"

# Rules over texts.
UNIT = rf"^\s*第\s*([{NUMERALS}\d]+)\s*({DIVISIONS})\s*[:：]?\s*(.*)$"
ANSWER = rf"^\s*(?:【\s*(?:{ANSWER_LABELS})\s*】|(?:{ANSWER_LABELS}))"
ANSWERS_ALONE = r"^\s*(?:(?:参考)?答案[与及和]?(?:解析|详解)?|(?:参考)?(?:答案)?解析)(?:部分)?\s*[:：]?\s*$"
LETTERS_ALONE = r"^\s*A(?:\s+[B-G])+\s*$"
PASSAGE = r"(?i)^\s*(?:text|passage)\s*\d+\s*$"
RANGE = r"回答\s*第?\s*(\d+)\s*[～~—–\-至到]+\s*(\d+)\s*题"
HINT = rf"(?:阅读|根据)(?:以下|下列|下面)?(?:{READING_MATTER})|{RANGE}|(?:Text|Passage)\s*\d+"
STEM_END = rf"[:：？?]\s*$|{STEM_CUES}"
FIRST_OPTION = rf"(?<![\d.])A\s*[{POINTS}]"
TYPE_MARK = rf"^\s*[【\[（(]\s*({'|'.join(TYPE_MARKS)})(?:选择题|题)?\s*[】\]）)]\s*"
FILLED = r"[（(]\s*[A-G]{1,4}\s*[）)]"
WIDE_BRACKET = r"[（(]\s{2,}[）)]"
BLANK_RUN = "[_＿]{2,}"
MATH = rf"[{MATH_SIGNS}□\uE000-\uF8FF]|\d\s*/\s*\d"
FORMULA_LINE = r"^[\d\s+×÷*/=().,（）％%^²³√…\-]{8,}$"


def shape(text: Column | str) -> Column:
    """A text with each character replaced by the sign of its class: SIGNS, h for other Chinese characters, o for all else beyond ASCII; other ASCII signs and line ends stay."""
    column = F.col(text) if isinstance(text, str) else text
    signs, classes = zip(*((c, sign) for sign, chars in SIGNS.items() for c in chars), strict=True)
    known = F.translate(column, "".join(signs), "".join(classes))
    return F.regexp_replace(F.regexp_replace(known, f"[{HAN}]", "h"), r"[^\x00-\x7f]", "o")


def java(pattern: str) -> str:
    """A pattern over texts with white space and digits of all scripts."""
    return f"(?U){pattern}"


def says(pattern: str, text: Column | str = "text") -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(java(pattern))


def plain_digits(text: Column) -> Column:
    return F.translate(text, DIGITS[10:], DIGITS[:10])


def without(text: Column, shape_: Column, *patterns: str) -> Column:
    """A text without what the first of the shape patterns that matches finds at its start."""
    size = F.lit(0)
    for pattern in reversed(patterns):
        size = F.when(shape_.rlike(pattern), F.length(F.regexp_extract(shape_, pattern, 0))).otherwise(size)
    return F.substring(text, size + 1, F.length(text))


def options_of(text: Column, shape_: Column) -> Column:
    """The options of a text that begins with one (within its first three characters): letters in order from the first mark's on; a mark out of order is part of an option."""
    marks = F.transform(F.regexp_extract_all(shape_, F.lit(OPTION_MARK), F.lit(0)), F.length)
    gaps = F.transform(F.split(shape_, OPTION_MARK, -1), F.length)
    # each mark's place follows from what lies before it; options are cut where a mark of the letter that is due ends and where the next one begins
    options = F.aggregate(
        F.arrays_zip(marks.alias("size"), F.slice(gaps, 1, F.size(marks)).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("due"), F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("out")),
        lambda done, mark: _next_mark(text, done, mark),
        lambda done: F.zip_with(done["out"], F.concat(F.transform(F.slice(done["out"], 2, F.greatest(F.size(done["out"]) - 1, F.lit(0))), lambda m: m["first"]), F.array(F.length(text))), lambda m, end: _trimmed(F.substring(text, m["last"] + 1, end - m["last"]))),
    )
    none = F.expr("cast(array() as array<string>)")
    # most have one mark, and what is behind it needs no walk over marks
    single = F.array(_trimmed(F.substring(text, F.length(F.regexp_extract(shape_, rf"^.{{0,2}}?{OPTION_MARK}", 0)) + 1, F.length(text))))
    return F.when(~shape_.rlike(rf"^.{{0,2}}{OPTION_MARK}"), none).when(~shape_.rlike(rf"(?s){OPTION_MARK}.*{OPTION_MARK}"), single).otherwise(options)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _next_mark(text: Column, done: Column, mark: Column) -> Column:
    first = done["at"] + mark["gap"]
    letter = F.ascii(F.substring(text, first + 1, F.lit(1)))
    taken = (F.size(done["out"]) == 0) | (letter == done["due"])
    found = F.array(F.struct(first.alias("first"), (first + mark["size"]).alias("last")))
    return F.struct((first + mark["size"]).alias("at"), F.when(taken, letter + 1).otherwise(done["due"]).alias("due"), F.when(taken, F.concat(done["out"], found)).otherwise(done["out"]).alias("out"))
