"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names within sentences and units behind numbers become typed placeholders, so a question that was given other numbers or names
still has the same templates. Items have a second form without names, which copies in lower case share. Windows of WINDOW template words are hash-joined with those of the benchmark and compared word by word. The
values that a document puts into an item's slots must be consistent: in one occurrence, a value of the item always becomes the same value.
Items with too few windows of plain words are looked for word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, and how many of them must be plain words.
WINDOW, LEAST_PLAIN = 8, 4
#: Windows of an item that a document must have, and the share of an item's slots that may be inconsistent.
LEAST_WINDOWS, MOST_CONFLICTS = 3, 0.34
#: Benchmark windows up to which they are broadcast (about 100 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
NUMBER, NAME, UNIT = "#", "¤", "@"
#: Unit words.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees mph kmh"
)


def _words(text: Column) -> Column:
    """A text's words, in one string with single spaces between them; names within sentences marked."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]", " ")
    out = F.regexp_replace(out, r"(?<=\d)[.,](?=\d)", "")
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N},;)] )(?=\p{Lu}\p{Ll})", NAME)
    return F.btrim(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{NAME}]+", " "))


def _template(words: Column) -> Column:
    """The words with placeholders, in as many places."""
    out = F.regexp_replace(words, rf"{NAME}\S+", NAME)
    out = F.regexp_replace(F.lower(out), r"(?<!\S)\d+(?!\S)", NUMBER)
    return F.regexp_replace(out, rf"(?<=(?:^| ){NUMBER} )(?:{UNITS.replace(' ', '|')})(?!\S)", UNIT)


def _arrays(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, words and template as arrays."""
    return df.select(*keys, _words(F.col(text)).alias("line")).select(*keys, F.split("line", " ").alias("words"), F.split(_template(F.col("line")), " ").alias("template"))


def _hashed(arrays: DataFrame, words: Column, width: int, *keys: str) -> DataFrame:
    """keys, words and template, and for each place (at, from 0) the hash of so many of the given words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width))
    # the hashes are a column of their own before they are exploded: explode and join then run in one generated loop, and the arrays are
    # copied for windows that match only. posexplode_outer, as a filter inferred from posexplode would repeat all expressions below it;
    # the null of a short text joins with nothing
    hashed = arrays.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, width))))
    return hashed.select(*keys, "words", "template", F.posexplode_outer("hashes").alias("at", "hash"))


def _plain_words() -> Column:
    """The words in lower case, without marks of names."""
    return F.transform("words", lambda w: F.lower(F.ltrim(w, F.lit(NAME))))


def _item_arrays(benchmark: DataFrame) -> DataFrame:
    """item_id, form, words and template: form 0 is the text as it stands, form 1, for texts with names, the text in lower case.

    A first word that would be a name within a sentence is one in a further row of the first window, as in documents it stands behind other words.
    """
    arrays = _arrays(benchmark.select("item_id", "text"), "text", "item_id").withColumn("form", F.lit(0))
    lower = _arrays(benchmark.select("item_id", F.lower("text").alias("text")), "text", "item_id").withColumn("form", F.lit(1))
    named = arrays.where(F.array_contains("template", NAME)).select("item_id").distinct()
    behind = _arrays(benchmark.select("item_id", F.concat(F.lit("x "), "text").alias("text")), "text", "item_id")
    behind = behind.select("item_id", F.slice("words", 2, WINDOW).alias("words"), F.slice("template", 2, WINDOW).alias("template"), F.lit(0).alias("form")).where(F.get("template", F.lit(0)) == NAME)
    return arrays.unionByName(behind).unionByName(lower.join(named, "item_id", "left_semi"))


def _benchmark_windows(arrays: DataFrame) -> DataFrame:
    """One row a window of at least LEAST_PLAIN plain words: item_id, form, item_at, item_windows (how many there are), hash, its words and template."""
    windows = _hashed(arrays, F.col("template"), WINDOW, "item_id", "form")
    own = F.slice("template", F.col("at") + 1, WINDOW)
    plain = F.size(F.filter(own, lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    out = windows.select("item_id", "form", F.col("at").alias("item_at"), "hash", F.slice("words", F.col("at") + 1, WINDOW).alias("item_words"), own.alias("item_template"), plain.alias("plain"))
    out = out.where(F.col("plain") >= LEAST_PLAIN).drop("plain")
    return out.join(out.groupBy("item_id", "form").agg(F.countDistinct("item_at").alias("item_windows")), ["item_id", "form"])


def _joined(windows: DataFrame, items: DataFrame) -> DataFrame:
    if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        return windows.join(F.broadcast(items), "hash")
    keys = windows.select("doc_id", "at", "hash").join(items.select("hash").distinct(), "hash").select("doc_id", "at").distinct()
    return windows.join(keys, ["doc_id", "at"]).join(items, "hash")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, form, at, item_at, item_windows, words, item_words, template of each window that a document shares with an item."""
    windows = _arrays(docs.select("doc_id", "text"), "text", "doc_id")
    both = _joined(_hashed(windows, F.col("template"), WINDOW, "doc_id"), _benchmark_windows(_item_arrays(benchmark)))
    own = F.array_join(F.slice("template", F.col("at") + 1, WINDOW), " ")
    item = F.array_join("item_template", " ")
    same = (F.instr(own, item) == 1) & (F.instr(item, own) == 1)  # equal, written as a condition that doesn't become a join key
    return both.where(same).select("doc_id", "item_id", "form", "at", "item_at", "item_windows", F.slice("words", F.col("at") + 1, WINDOW).alias("words"), "item_words", F.col("item_template").alias("template"))


def _whole(docs: DataFrame, benchmark: DataFrame) -> list[DataFrame]:
    """doc_id, item_id of the documents that hold all words of an item with fewer than LEAST_WINDOWS windows; a table for each length of hashed beginnings."""
    arrays = _arrays(benchmark.select("item_id", "text"), "text", "item_id").withColumn("form", F.lit(0))
    enough = _benchmark_windows(arrays).where(F.col("item_windows") >= LEAST_WINDOWS).select("item_id").distinct()
    items = arrays.join(enough, "item_id", "left_anti").select("item_id", _plain_words().alias("item_words")).where("item_words[0] <> ''").distinct()
    items = items.withColumn("width", F.least(F.size("item_words"), F.lit(WINDOW)))
    words = _arrays(docs.select("doc_id", "text"), "text", "doc_id").select("doc_id", _plain_words().alias("words"), F.array().cast("array<string>").alias("template"))
    found = []
    for width in sorted(r.width for r in items.select("width").distinct().collect()):  # WINDOW at most
        begun = items.where(F.col("width") == width).withColumn("hash", F.xxhash64(F.slice("item_words", 1, width)))
        both = _joined(_hashed(words, F.col("words"), width, "doc_id"), begun)
        own, item = F.array_join(F.slice("words", F.col("at") + 1, F.size("item_words")), " "), F.array_join("item_words", " ")
        found.append(both.where((F.instr(own, item) == 1) & (F.instr(item, own) == 1)).select("doc_id", "item_id").distinct())
    return found


def _counted(found: DataFrame) -> DataFrame:
    """The figures of each occurrence of an item in a document.

    An occurrence has one offset between document and item. Two grids of offsets, shifted against each other, hold those into which words were
    inserted; the whole document is one more, for an item in scattered parts. A window counts in each of the four.
    """
    offset = F.col("at") - F.col("item_at")
    grid = lambda shift: F.floor((offset + shift) / WINDOW)
    places = [(0, offset), (1, grid(0)), (2, grid(WINDOW // 2)), (3, F.lit(0))]
    placed = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place")) for kind, place in places])).alias("occurrence")
    at = F.sequence(F.lit(1), F.lit(WINDOW))
    slots = F.filter(F.transform(at, lambda i: F.struct(F.element_at("template", i).alias("kind"), F.lower(F.element_at("item_words", i)).alias("item"), F.lower(F.element_at("words", i)).alias("doc"))), lambda s: s["kind"].isin(NUMBER, NAME, UNIT))
    # the items of a pair are few: an item's own windows and values bound both sets
    pairs = found.select("*", placed).groupBy("doc_id", "item_id", "form", "occurrence").agg(F.countDistinct("item_at").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"])))
    by_value = F.transform(values, lambda v: F.filter("slots", lambda s: (s["kind"] == v["kind"]) & (s["item"] == v["item"])))
    return pairs.withColumn("by_value", by_value).select(
        "doc_id", "item_id", "n_windows", F.col("item_windows").cast("long").alias("item_windows"), (F.col("n_windows") / F.col("item_windows")).alias("coverage"),
        F.size("by_value").cast("long").alias("n_slots"),
        F.size(F.filter("by_value", lambda g: F.exists(g, lambda s: s["item"] != s["doc"]))).cast("long").alias("n_changed"),
        F.size(F.filter("by_value", lambda g: F.size(g) > 1)).cast("long").alias("n_conflicts"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed, n_conflicts: a row for each document and item it contains.

    docs: doc_id, text; benchmark: item_id, text. The figures are those of one occurrence of the item in the document: of those that count, the one with
    most windows, then fewest conflicts. item_windows are the item's windows with LEAST_PLAIN plain words, coverage the share of them found; n_slots are
    the item's distinct values under placeholders in them, n_changed those that the document gives another value, n_conflicts those it gives
    several. An occurrence counts from LEAST_WINDOWS windows on (fewer if the item has no more) and up to MOST_CONFLICTS of its slots in
    conflict. An item with fewer windows is also found where all its words follow each other, however short it is; without any window
    found, n_windows, item_windows and the slots' figures are 0 and coverage is 1. Null and empty texts contain nothing and are contained in nothing; repeated rows
    of either table count once; ties don't matter.
    """
    counted = _counted(matches(docs, benchmark))
    passing = counted.where((F.col("n_windows") >= F.least(F.lit(LEAST_WINDOWS), "item_windows")) & (F.col("n_conflicts") <= MOST_CONFLICTS * F.col("n_slots")))
    figures = counted.columns[2:]
    for whole in _whole(docs, benchmark):
        passing = passing.unionByName(whole.select("doc_id", "item_id", *[F.lit(int(name == "coverage")).cast(counted.schema[name].dataType).alias(name) for name in figures]))
    best = F.max_by(F.struct(*figures), F.struct("n_windows", -F.col("n_conflicts"), -F.col("n_changed"))).alias("best")
    return passing.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col(f"best.{name}") for name in figures])
