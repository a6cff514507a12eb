"""Queries on edits, places, lists and stores of papers, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import crops as C
from ..operators import keeping as K
from ..operators import lifecycle as L
from ..operators import spans as S
from ..operators.reports import answer_summary, latest_answers
from ..sources import papers as P
from ..sources.store import Change, scratch
from . import bridges as B

Q = B.questions


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with places: three to a page, some with an end of their own, some with material before them."""
    page, y0 = (F.floor((F.col("seq") - 1) / 3) + 1).cast("int"), (F.col("seq") - 1) % 3 * 200.0 + 50
    ends, owns = F.col("seq") % 4 == 0, F.col("seq") % 5 == 0
    return Q(spark, sf_dir).withColumns({
        "page": page, "y0": y0, "end_page": F.when(ends, page).otherwise(0), "y1": F.when(ends, y0 + 60).otherwise(0.0), "group": F.when(owns, "g1"), "material": F.when(owns, "m"), "m_page": F.when(owns, page), "m_y0": F.when(owns, y0 - 30),
    })


_PLACED = B.QUESTIONS + """, placed AS (SELECT *, (seq - 1) // 3 + 1 AS page, (seq - 1) % 3 * 200.0 + 50 AS y0, seq % 4 = 0 AS has_end, seq % 5 = 0 AS owns FROM questions),
    spans AS (SELECT *, lead(page) OVER w AS next_page, lead(y0) OVER w AS next_y FROM placed WINDOW w AS (PARTITION BY paper_id ORDER BY seq)),
    ends AS (SELECT *, CASE WHEN has_end THEN page WHEN next_page BETWEEN page AND page + 1 THEN next_page ELSE page END AS stop_page,
        CASE WHEN has_end THEN y0 + 60 WHEN next_page BETWEEN page AND page + 1 THEN next_y ELSE 1000000 END AS stop FROM spans)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (and pictures) somewhere on a paper's pages."""
    line = B.table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return line.select(F.col("l_orderkey").alias("paper_id"), pos.alias("pos"), (F.col("l_partkey") % 3 + 1).cast("int").alias("page"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 700 + 0.5).alias("y"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"))


_ITEMS = """, items AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 3 + 1 AS page, (l_suppkey * 7 + l_partkey) % 700 + 0.5 AS y, 't' || l_partkey AS text FROM lineitem)"""


def span_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_ends(_placed(spark, sf_dir)).select("paper_id", "seq", "page", "stop_y", "over_y")


def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    pages = placed.select("paper_id", "page").distinct().withColumn("height", F.when(F.col("page") < 3, 800.0))
    return S.crop_plan(placed, pages)


def stacked_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each crop as they are stacked; every seventh question was cut again by hand, in two pieces that overlap, touch or lie apart."""
    plan = crop_plan(spark, sf_dir).withColumn("to_page", F.col("to_page") + (F.col("seq") % 6 == 0).cast("int"))
    pages = _placed(spark, sf_dir).select("paper_id", "page").distinct().withColumn("height", F.when(F.col("page") == 2, 1000.0))
    pieces = C.crop_pieces(plan, pages)
    again = plan.where("(seq + paper_id) % 7 = 0 and file like 'q%'")
    manual = again.withColumn("y1", F.col("y0") + 20).unionByName(again.withColumn("y0", F.col("y0") + F.col("seq") % 3 * 20).withColumn("y1", F.col("y0") + 15 * F.lit(2)))
    return C.stacked(C.recropped(pieces, manual))


def assigned_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by the questions and materials that they lie in."""
    found = C.assigned_pictures(_placed(spark, sf_dir), _items(spark, sf_dir).withColumnRenamed("text", "ref"))
    return found.groupBy("paper_id", "seq", "part").agg(F.count("*").alias("n"), F.min_by("ref", F.struct("page", "y", "ref")).alias("first_ref"), F.max("y").alias("lowest"))


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.question_texts(_items(spark, sf_dir), _placed(spark, sf_dir))


def question_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.question_pictures(_placed(spark, sf_dir), _items(spark, sf_dir).withColumnRenamed("text", "ref"))


def checked_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guessed pictures against those that lie in the questions."""
    placed = _placed(spark, sf_dir).withColumns({"crop": F.lit(None).cast("string"), "reviewed": F.lit(True)})
    found = L.checked_pictures(placed, question_pictures(spark, sf_dir))
    return found.select("paper_id", "seq", "crop", "image", "reviewed", F.array_join("issues", ";").alias("issues"))


def carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second parse takes pictures over from the first."""
    old = Q(spark, sf_dir).withColumn("crop", F.concat(F.lit("c"), F.col("seq").cast("string"))).withColumn("image", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("p"), F.col("seq").cast("string"))))
    return L.carried_over(Q(spark, sf_dir), old).select("paper_id", "seq", "crop", "image")


def spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten questions in place of some of a paper's."""
    whole = Q(spark, sf_dir)
    new = whole.where("seq % 2 = 0").withColumns({"stem": F.concat(F.lit("R"), F.col("seq").cast("string")), "type": F.lit("essay"), "options": F.array().cast("array<string>"), "blanks": F.lit(0), "unit": F.when(F.col("seq") % 4 == 0, "elsewhere").otherwise(F.col("unit"))})
    keys = whole.where("seq % 3 > 0").select("paper_id", T.question_key().alias("key"))
    return L.spliced(whole, new, keys).select("paper_id", "seq", "stem", "type", F.size("options").cast("long").alias("n_options"))


def requested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q(spark, sf_dir).where("seq % 2 = 1")
    keys = rows.select("paper_id", F.col("seq").alias("pos"), F.when(F.col("seq") % 3 == 0, "x|99").otherwise(T.question_key()).alias("key"))
    return L.requested(keys, Q(spark, sf_dir)).select("paper_id", "pos", "key")


def merged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Q(spark, sf_dir)
    out = L.merged_into_previous(whole, whole.where("seq = 1 or seq % 3 = 0 or seq = 4").select("paper_id", "seq"))
    return out.select("paper_id", "seq", "no", "stem", F.size("options").cast("long").alias("n_options"))


def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Q(spark, sf_dir).withColumn("reviewed", F.col("blanks") > 0)
    acts = F.array(*[F.lit(a) for a in ("delete", "flag", "accept", "insert", "none")])
    edits = whole.select("paper_id", "seq", F.get(acts, F.col("seq") % 5).alias("action")).where("action <> 'none'")
    return L.list_edits(whole, edits).select("paper_id", "seq", "no", "type", "reviewed", F.array_join("issues", ";").alias("issues"))


def picture_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Q(spark, sf_dir).withColumn("crop", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("c"), F.col("seq").cast("string"))))
    switches = whole.where("seq % 3 > 0").select("paper_id", "seq", (F.col("seq") % 3 == 1).alias("shown"))
    return L.picture_switched(whole, switches).select("paper_id", "seq", "image")


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validation import validated

    out = L.confirmed(validated(Q(spark, sf_dir)))
    return out.groupBy("paper_id").agg(F.count("*").alias("n"), F.bool_and("reviewed").alias("all_reviewed"), F.sum(F.size("issues")).alias("n_issues"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as an editor saves them: issues set by hand are gone, blanks are counted, verdicts are new."""
    rows = Q(spark, sf_dir).withColumns({"issues": F.array(F.lit("x")), "stem": F.nullif("stem", F.lit("")), "extra": F.lit(1)})
    return L.edited(rows).select("paper_id", "seq", "stem", "blanks", F.size("issues").cast("long").alias("n_issues"), "reviewed")


def picture_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q(spark, sf_dir).withColumn("stem", F.when(F.col("seq") % 2 == 0, F.concat("stem", F.lit("（ ）。"))).otherwise(F.col("stem")))
    both = [L.picture_options(rows).withColumn("lost", F.lit(False)), L.without_pictures(rows).withColumn("lost", F.lit(True))]
    return both[0].unionByName(both[1]).select("paper_id", "seq", "lost", "type", F.size("options").cast("long").alias("n_options"), F.size("issues").cast("long").alias("n_issues"))


def next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with text among the next three of a document, pictures and empty ones aside."""
    rows = B.pages(spark, sf_dir).select("paper_id", "pos", F.when(F.col("pos") % 4 != 1, F.col("text")).alias("text"))
    ahead = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(1, 3)
    return rows.select("paper_id", "pos", F.first("text", ignorenulls=True).over(ahead).alias("next_text"))


def unit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a listing shows a unit's heading."""
    order = Window.partitionBy("paper_id").orderBy("seq")
    return Q(spark, sf_dir).select("paper_id", "seq", "unit", F.lag("unit").over(order).alias("last")).where(~F.col("unit").eqNullSafe(F.coalesce("last", F.lit("")))).select("paper_id", "seq", "unit")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on names of parts."""
    name, key = F.col("p_name"), F.col("p_partkey")
    values = F.when(key % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(""), name))
    moment = F.expr("timestamp'2024-02-28 22:59:58' + make_dt_interval(0, cast(p_partkey as int), 0, p_partkey % 60)")
    return B.table(spark, sf_dir, "part").select(
        key.alias("part"), T.raised(F.concat(key.cast("string"), F.lit("+(n)"))).alias("raised"), T.table_row(F.array(name, F.concat(F.lit(" a|b\n"), key.cast("string")), F.lit(""))).alias("row"), F.size(T.table_cells(F.concat(F.lit("|"), F.replace(name, F.lit(" "), F.lit("|")), F.lit("|")))).cast("long").alias("n_cells"),
        F.format_string("q_%03d_%s_%d.png", (key % 1000).cast("int"), T.safe_name(name), key).alias("file"), T.is_answered(values).alias("answered"), T.escaped(F.concat(F.lit("<b>\"&"), name, F.lit("&amp;</b>"))).alias("escaped"),
        F.left(F.coalesce(F.nullif(T.stripped(F.when(key % 2 == 0, " ").otherwise(F.concat(F.lit(" "), name))), F.lit("")), F.lit("粘贴的试卷")), F.lit(80)).alias("title"), T.time_id(moment, F.when(key % 2 == 0, "text")).alias("id"), F.bround(key / 2).cast("long").alias("half"),
        T.utf16_text(F.encode(F.concat(F.lit("\x13 PAGE \x14"), name, F.lit("\x15\x1ex\x07")), "UTF-16LE")).alias("utf16"),
    )


_GRID = [["甲", ">", "乙"], ["^", "^", "丙"], ["丁", "戊", "^"], ["^", "己", "庚"]]


def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table with merge marks, for each supplier one, with its key in the first cell."""
    grid = F.array(*[F.array(*[F.concat(F.lit("甲"), F.col("s_suppkey").cast("string")) if c == "甲" else F.lit(c) for c in row]) for row in _GRID])
    cells = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("paper_id"), F.explode(F.flatten(T.spans_of_cells(grid))).alias("cell"))
    return cells.select("paper_id", "cell.text", "cell.colspan", "cell.rowspan")


def stored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as JSON and back, damaged ones dropped, updated by key, listed with their attempts."""
    rows = Q(spark, sf_dir).withColumn("reviewed", F.when(F.col("seq") % 2 == 0, F.col("blanks") > 0))
    question = F.struct(*[F.col(c) for c in ("unit", "no", "type", "stem", "options", "blanks", "image", "reviewed")])
    papers = rows.groupBy(F.col("paper_id").cast("string").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", question.alias("q")))), lambda x: x["q"]).alias("questions"))
    papers = papers.select("id", F.concat(F.lit("卷"), "id").alias("title"), F.lit("s").alias("source"), F.lit("text").alias("import_path"), F.lit("2024-01-01 00:00:00").alias("created_at"), "questions")
    json = P.as_json(papers).withColumn("json", F.when(F.col("id").endswith("7"), F.left("json", F.lit(40))).otherwise(F.col("json")))
    path = scratch(spark)
    P.from_json(json).write.parquet(path)  # parsed once; the changes by key read keys alone
    table = spark.read.parquet(path)
    table = P.upserted(table, table.where("id like '%1'").withColumn("title", F.lit("新")), "id")
    attempts = B.table(spark, sf_dir, "events").select((F.col("user_id") % 500).cast("string").alias("paper_id"))
    return P.listed(P.without(table, table.where("id like '%2'"), "id"), attempts)


def kept_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers in a store: all saved as drafts, most confirmed, some of these opened again, some deleted with the attempts made at them."""
    question = F.struct(*[F.col(c) for c in ("unit", "no", "type", "stem", "options", "blanks", "image", "issues")])
    drafts = Q(spark, sf_dir).withColumn("issues", F.when(F.col("seq") % 2 == 0, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>"))).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", question.alias("q")))), lambda x: x["q"]).alias("questions"))
    drafts = P.from_json(P.as_json(drafts.select(F.col("paper_id").cast("string").alias("id"), "questions")))
    attempts = B.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), (F.col("user_id") % 500).cast("string").alias("paper_id"))
    store = K.paper_store(spark, scratch(spark), buckets=16)
    number, ids = F.col("id").cast("long"), B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    K.saved(store, drafts)
    store.change(attempts=Change(put=attempts.select("id", "paper_id", *[F.lit(None).cast(kind).alias(name) for name, kind in spark.createDataFrame([], P.ATTEMPT).dtypes if name not in ("id", "paper_id")])))
    K.confirmed(store, ids.where(number % 3 > 0))
    K.reopened(store, ids.where(number % 5 == 0))
    K.deleted(store, ids.where(number % 7 == 0))
    n = store.table("attempts").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("attempts"))
    held = store.table("drafts").withColumn("table", F.lit("drafts")).unionByName(store.table("papers").withColumn("table", F.lit("papers")))
    reviewed = F.size(F.filter("questions", lambda q: F.coalesce(q["reviewed"], F.lit(False)) & (F.size(q["issues"]) == 0)))
    return held.join(n, "id", "left").select("table", "id", F.size("questions").cast("long").alias("questions"), reviewed.cast("long").alias("reviewed"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def mixed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they were sent: texts, numbers, lists, objects and what isn't JSON, by order line."""
    line = B.table(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    sent = F.concat_ws("", *[F.when(F.col("l_partkey") % 6 == k, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])) for k, parts in enumerate([('"t', part, '"'), ('["', part, '", "", ', supplier, "]"), ('{"10": "', part, '", "9": ', supplier, ', "b": null}'), (part,), ("选 ", part), ("null",)])])
    rows = line.select(F.col("l_orderkey").alias("paper_id"), "l_linenumber", "l_partkey", "l_suppkey", T.answer_values(sent).alias("a"))
    return rows.select("paper_id", F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.array_join("a.values", "|").alias("given"), F.col("a.is_list").alias("is_list"))


def latest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last autosave of each user and paper."""
    saves = B.table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("paper_id"), "user_id", F.col("ts").alias("saved_at"), F.col("event_id").alias("save_id"), "event_type")
    return P.latest_drafts(saves).select("paper_id", "user_id", "save_id", "event_type")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that are left once attempts have been handed in, and of these, those without a confirmed paper."""
    drafts = latest_drafts(spark, sf_dir).select("paper_id", "user_id", "save_id")
    attempts, done = drafts.where("save_id % 7 = 0"), drafts.where("save_id % 3 = 0")
    kept, left = P.submitted(attempts, drafts, done)
    papers = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    lonely = P.orphaned(left.select(F.col("paper_id").alias("id")).distinct(), papers)
    out = [kept.agg(F.lit("attempts").alias("what"), F.count("*").alias("n")), left.agg(F.lit("drafts").alias("what"), F.count("*").alias("n")), lonely.agg(F.lit("without a paper").alias("what"), F.count("*").alias("n"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def clipboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clipboard(answer_summary(Q(spark, sf_dir), latest_answers(B.answers(spark, sf_dir)), B.marks(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (stacked_crops, assigned_pictures, kept_papers, mixed_answers, span_ends, crop_plan, question_texts, question_pictures, checked_pictures, carried_over, spliced, requested_keys, merged_questions, list_edits, picture_switches, confirmed, edited, picture_options, next_lines, unit_changes, text_forms, merged_cells, stored_papers, latest_drafts, submissions, clipboard)}

_NAME = "printf('%s_%03d_%s_%d.png', {}, seq, CASE WHEN unit = '' THEN 'u' ELSE unit END, no)"
_OWN = """own AS (SELECT p.paper_id, p.seq, i.page, i.y, i.pos, i.text FROM ends p JOIN items i ON i.paper_id = p.paper_id AND (i.page, i.y) >= (p.page, p.y0) AND (p.next_page IS NULL OR (i.page, i.y) < (p.next_page, p.next_y)))"""
_CROPS = f"""SELECT paper_id, seq, {_NAME.format("'q'")} AS file, CAST(page AS INTEGER) AS page, CAST(y0 AS DOUBLE) AS y0, CAST(stop_page AS INTEGER) AS to_page, CAST(CASE WHEN stop_page = page THEN least(stop, 744.0) ELSE stop END AS DOUBLE) AS y1 FROM ends
    UNION ALL SELECT paper_id, seq, {_NAME.format("'m'")}, CAST(page AS INTEGER), CAST(y0 - 30 AS DOUBLE), CAST(page AS INTEGER), CAST(y0 AS DOUBLE) FROM ends WHERE owns"""
_BRACKET = "regexp_matches(stem, '[（(]\\s*[)）]\\s*[。.]?\\s*$')"
ORACLE_SQL = {
    "span_ends": f"WITH {_PLACED} SELECT paper_id, seq, CAST(page AS INTEGER) AS page, CAST(CASE WHEN stop_page = page THEN stop ELSE 1000000 END AS DOUBLE) AS stop_y, CAST(CASE WHEN stop_page <> page THEN stop END AS DOUBLE) AS over_y FROM ends",
    "crop_plan": f"WITH {_PLACED} {_CROPS}",
    "stacked_crops": f"""WITH {_PLACED}, plan AS (SELECT * REPLACE (to_page + CASE WHEN seq % 6 = 0 THEN 1 ELSE 0 END AS to_page) FROM ({_CROPS})), hand AS (SELECT * FROM plan WHERE (seq + paper_id) % 7 = 0 AND file LIKE 'q%'),
        p AS (SELECT paper_id, seq, file, k AS page, CASE WHEN k = page THEN y0 ELSE 0 END AS y0, CASE WHEN k = to_page THEN y1 WHEN k = 2 AND EXISTS (SELECT 1 FROM placed x WHERE x.paper_id = plan.paper_id AND x.page = 2) THEN 930.0 ELSE 744.0 END AS y1
            FROM plan, LATERAL unnest(generate_series(CAST(page AS BIGINT), CAST(to_page AS BIGINT))) AS u(k) WHERE (paper_id, file) NOT IN (SELECT paper_id, file FROM hand)),
        h AS (SELECT paper_id, seq, file, page, y0, seq % 3 * 20 AS gap FROM hand),
        m AS (SELECT paper_id, seq, file, page, y0, CASE WHEN gap <= 20 THEN y0 + gap + 30 ELSE y0 + 20 END AS y1, 1 AS piece FROM h UNION ALL SELECT paper_id, seq, file, page, y0 + gap, y0 + gap + 30, 2 FROM h WHERE gap > 20),
        a AS (SELECT paper_id, seq, file, page, y0, y1, row_number() OVER (PARTITION BY paper_id, file ORDER BY page) AS piece FROM p WHERE y1 > y0 UNION ALL SELECT * FROM m)
        SELECT paper_id, seq, file, CAST(piece AS INTEGER) AS piece, CAST(page AS INTEGER) AS page, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1,
            CAST(coalesce(sum(y1 - y0) OVER (PARTITION BY paper_id, file ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS at FROM a""",
    "assigned_pictures": f"""WITH {_PLACED}{_ITEMS}, {_OWN}, f AS (SELECT paper_id, seq, 'question' AS part, page, y, text FROM own
            UNION ALL SELECT p.paper_id, p.seq, 'material', i.page, i.y, i.text FROM ends p JOIN items i ON i.paper_id = p.paper_id AND p.owns AND i.page = p.page AND i.y >= p.y0 - 30 AND i.y < p.y0)
        SELECT paper_id, seq, part, count(*) AS n, arg_min(text, (page, y, text)) AS first_ref, CAST(max(y) AS DOUBLE) AS lowest FROM f GROUP BY 1, 2, 3""",
    "question_texts": f"""WITH {_PLACED}{_ITEMS}, {_OWN}, material AS (SELECT p.paper_id, p.seq, i.page, i.y, i.pos, i.text FROM ends p JOIN items i ON i.paper_id = p.paper_id AND p.owns AND i.page = p.page AND i.y >= p.y0 - 30 AND i.y < p.y0),
        found AS (SELECT paper_id, seq, string_agg(text, chr(10) ORDER BY page, y, pos) AS found FROM (SELECT * FROM own UNION ALL SELECT * FROM material) GROUP BY 1, 2)
        SELECT paper_id, seq, coalesce(found, no || '. ' || stem || array_to_string(list_transform(options, lambda o, i: chr(10) || chr(CAST(64 + i AS INTEGER)) || '. ' || o), '')) AS text FROM placed LEFT JOIN found USING (paper_id, seq)""",
    "question_pictures": f"WITH {_PLACED}{_ITEMS}, {_OWN} SELECT paper_id, seq, count(*) AS n_pictures, arg_min(text, (page, y, text)) AS first_ref FROM own GROUP BY 1, 2",
    "checked_pictures": f"""WITH {_PLACED}{_ITEMS}, {_OWN}, n AS (SELECT paper_id, seq, count(*) AS n FROM own GROUP BY 1, 2)
        SELECT paper_id, seq, CASE WHEN n > 0 THEN {_NAME.format("'q'")} END AS crop, CASE WHEN n > 0 THEN {_NAME.format("'q'")} END AS image, NOT (n IS NULL AND image IS NOT NULL) AS reviewed,
            CASE WHEN n IS NULL AND image IS NOT NULL THEN 'Word 中本题范围内没有图片，请核对题干' ELSE '' END AS issues FROM placed LEFT JOIN n USING (paper_id, seq)""",
    "carried_over": f"WITH {B.QUESTIONS}, old AS (SELECT paper_id, unit, no, max(seq) AS s FROM questions GROUP BY 1, 2, 3) SELECT paper_id, seq, 'c' || s AS crop, CASE WHEN image IS NOT NULL THEN CASE WHEN s % 2 = 0 THEN 'p' || s ELSE image END END AS image FROM questions JOIN old USING (paper_id, unit, no)",
    "spliced": f"""WITH {B.QUESTIONS}, new AS (SELECT paper_id, seq AS s, CASE WHEN seq % 4 = 0 THEN 'elsewhere' ELSE unit END AS unit, no FROM questions WHERE seq % 2 = 0), named AS (SELECT paper_id, unit, no, max(s) AS s FROM new GROUP BY 1, 2, 3),
        numbered AS (SELECT paper_id, no, max(s) AS s FROM new GROUP BY 1, 2), asked AS (SELECT DISTINCT paper_id, unit, no FROM questions WHERE seq % 3 > 0)
        SELECT q.paper_id, seq, CASE WHEN r.s IS NULL THEN stem ELSE 'R' || r.s END AS stem, CASE WHEN r.s IS NULL THEN type ELSE 'essay' END AS type, CAST(CASE WHEN r.s IS NULL THEN len(options) ELSE 0 END AS BIGINT) AS n_options FROM questions q
        LEFT JOIN (SELECT a.*, coalesce(n.s, m.s) AS s FROM asked a LEFT JOIN named n USING (paper_id, unit, no) LEFT JOIN numbered m USING (paper_id, no)) r ON r.paper_id = q.paper_id AND r.unit = q.unit AND r.no = q.no""",
    "requested_keys": f"WITH {B.QUESTIONS} SELECT paper_id, seq AS pos, unit || '|' || no AS key FROM questions WHERE seq % 2 = 1 AND seq % 3 <> 0",
    "merged_questions": f"""WITH {B.QUESTIONS}, heads AS (SELECT *, CASE WHEN seq = 1 OR seq % 3 = 0 OR seq = 4 THEN NULL ELSE seq END AS own FROM questions),
        g AS (SELECT *, coalesce(max(own) OVER (PARTITION BY paper_id ORDER BY seq), 1) AS head FROM heads)
        SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY head) AS INTEGER) AS seq, min_by(no, seq) AS no, CASE WHEN count(*) = 1 THEN min(stem) ELSE regexp_replace(string_agg(stem, chr(10) ORDER BY seq), '^\\s+|\\s+$', '', 'g') END AS stem,
            CAST(sum(len(options)) AS BIGINT) AS n_options FROM g GROUP BY paper_id, head""",
    "list_edits": f"""WITH {B.QUESTIONS}, r AS (SELECT *, blanks > 0 AS reviewed FROM questions), e AS (
            SELECT paper_id, seq, 0 AS new, no, type, CASE seq % 5 WHEN 2 THEN true WHEN 1 THEN NOT reviewed ELSE reviewed END AS reviewed, CASE WHEN seq % 5 = 1 AND reviewed THEN '手动标为待核对' ELSE '' END AS issues FROM r WHERE seq % 5 <> 0
            UNION ALL SELECT paper_id, seq, 1, no + 1, 'single', false, '新增的题' FROM r WHERE seq % 5 = 3)
        SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY seq, new) AS INTEGER) AS seq, CAST(no AS INTEGER) AS no, type, reviewed, issues FROM e""",
    "picture_switches": f"WITH {B.QUESTIONS} SELECT paper_id, seq, CASE seq % 3 WHEN 0 THEN image WHEN 1 THEN coalesce(image, CASE WHEN seq % 2 = 0 THEN 'c' || seq END, 'yes') END AS image FROM questions",
    "confirmed": f"WITH {B.QUESTIONS} SELECT paper_id, count(*) AS n, true AS all_reviewed, CAST(0 AS BIGINT) AS n_issues FROM questions GROUP BY 1",
    "edited": f"""WITH {B.ISSUES} SELECT paper_id, seq, stem, CASE WHEN type = 'blank' THEN greatest(blanks, 1) ELSE blanks END AS blanks, CAST(len(list_filter(issues, lambda x: x <> '填空题没有空位')) AS BIGINT) AS n_issues, len(list_filter(issues, lambda x: x <> '填空题没有空位')) = 0 AS reviewed FROM checked""",
    "picture_options": f"""WITH {B.QUESTIONS}, r AS (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN stem || '（ ）。' ELSE stem END AS stem), len(options) AS n FROM questions), h AS (SELECT *, type = 'blank' AND blanks <= 1 AND {_BRACKET} AS bracket FROM r),
        k AS (SELECT *, n = 0 AND (type IN ('single', 'multi') OR bracket) AS hit FROM h)
        SELECT paper_id, seq, lost, CASE WHEN hit AND bracket THEN 'single' ELSE type END AS type, CAST(CASE WHEN hit THEN 4 ELSE n END AS BIGINT) AS n_options, CAST(CASE WHEN hit AND (lost OR image IS NULL) THEN 1 ELSE 0 END AS BIGINT) AS n_issues FROM k CROSS JOIN (VALUES (false), (true)) v(lost)""",
    "next_lines": f"""WITH {B.LINES}, r AS (SELECT paper_id, pos, CASE WHEN pos % 4 <> 1 THEN text END AS text FROM lines)
        SELECT paper_id, pos, coalesce(lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w) AS next_text FROM r WINDOW w AS (PARTITION BY paper_id ORDER BY pos)""",
    "unit_changes": f"WITH {B.QUESTIONS}, r AS (SELECT *, lag(unit, 1, '') OVER (PARTITION BY paper_id ORDER BY seq) AS last FROM questions) SELECT paper_id, seq, unit FROM r WHERE unit <> last",
    "text_forms": """SELECT p_partkey AS part, translate(p_partkey || '+(n)', '0123456789+-=()n', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ') AS raised, '|' || trim(p_name) || '|a｜b ' || p_partkey || '||' AS row, CAST(length(p_name) - length(replace(p_name, ' ', '')) + 1 AS BIGINT) AS n_cells,
        printf('q_%03d_%s_%d.png', p_partkey % 1000, left(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g'), 10), p_partkey) AS file, p_partkey % 3 <> 0 AS answered, '&lt;b&gt;&quot;&amp;' || p_name || '&amp;amp;&lt;/b&gt;' AS escaped,
        CASE WHEN p_partkey % 2 = 0 THEN '粘贴的试卷' ELSE p_name END AS title, strftime(TIMESTAMP '2024-02-28 22:59:58' + to_hours(p_partkey) + to_seconds(p_partkey % 60), '%Y%m%d-%H%M%S') || CASE WHEN p_partkey % 2 = 0 THEN '-text' ELSE '' END AS id,
        CAST(round_even(p_partkey / 2, 0) AS BIGINT) AS half, p_name || '-x' AS utf16 FROM part""",
    "merged_cells": """SELECT s_suppkey AS paper_id, CASE WHEN text = '甲' THEN text || s_suppkey ELSE text END AS text, CAST(c AS INTEGER) AS colspan, CAST(r AS INTEGER) AS rowspan FROM supplier
        CROSS JOIN (VALUES ('甲', 2, 2), ('乙', 1, 1), ('丙', 1, 2), ('丁', 1, 2), ('戊', 1, 1), ('己', 1, 1), ('庚', 1, 1)) v(text, c, r)""",
    "kept_papers": f"""WITH {B.QUESTIONS}, n AS (SELECT CAST(user_id % 500 AS VARCHAR) AS id, count(*) AS attempts FROM events GROUP BY 1), q AS (SELECT paper_id, count(*) AS n FROM questions WHERE paper_id % 7 <> 0 GROUP BY 1),
        held AS (SELECT 'drafts' AS "table", paper_id, n, CASE WHEN paper_id % 3 = 0 THEN 0 ELSE n END AS reviewed FROM q WHERE paper_id % 3 = 0 OR paper_id % 5 = 0 UNION ALL SELECT 'papers', paper_id, n, n FROM q WHERE paper_id % 3 > 0)
        SELECT "table", CAST(paper_id AS VARCHAR) AS id, n AS questions, reviewed, coalesce(attempts, 0) AS attempts FROM held LEFT JOIN n ON n.id = CAST(paper_id AS VARCHAR)""",
    "mixed_answers": """SELECT l_orderkey AS paper_id, l_linenumber AS line, l_partkey, l_suppkey,
        CASE l_partkey % 6 WHEN 0 THEN 't' || l_partkey WHEN 1 THEN l_partkey || '||' || l_suppkey WHEN 2 THEN l_suppkey || '|' || l_partkey || '|' WHEN 3 THEN CAST(l_partkey AS VARCHAR) WHEN 4 THEN '选 ' || l_partkey END AS given, l_partkey % 6 IN (1, 2) AS is_list FROM lineitem""",
    "stored_papers": f"""WITH {B.QUESTIONS}, n AS (SELECT CAST(user_id % 500 AS VARCHAR) AS id, count(*) AS attempts FROM events GROUP BY 1)
        SELECT id, CASE WHEN id LIKE '%1' THEN '新' ELSE '卷' || id END AS title, 's' AS source, 'text' AS import_path, '2024-01-01 00:00:00' AS created_at, CAST(n AS INTEGER) AS count, CAST(review AS INTEGER) AS to_review, coalesce(attempts, 0) AS attempts
        FROM (SELECT CAST(paper_id AS VARCHAR) AS id, count(*) AS n, count(*) FILTER (seq % 2 = 0 AND blanks <= 0) AS review FROM questions GROUP BY 1) LEFT JOIN n USING (id) WHERE id NOT LIKE '%7' AND id NOT LIKE '%2'""",
    "latest_drafts": "SELECT event_id % 50 AS paper_id, user_id, arg_max(event_id, (ts, event_id)) AS save_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2",
    "submissions": """WITH d AS (SELECT event_id % 50 AS paper_id, user_id, arg_max(event_id, (ts, event_id)) AS save_id FROM events GROUP BY 1, 2)
        SELECT 'attempts' AS what, count(*) FILTER (save_id % 7 = 0) + count(*) FILTER (save_id % 3 = 0) AS n FROM d UNION ALL SELECT 'drafts', count(*) FILTER (save_id % 3 <> 0) FROM d
        UNION ALL SELECT 'without a paper', count(DISTINCT paper_id) FROM d ANTI JOIN nation ON n_nationkey = paper_id WHERE save_id % 3 <> 0""",
    "clipboard": f"""WITH {B.SUMMARY}, h AS (SELECT *, bool_or(unit <> '') OVER (PARTITION BY attempt_id) AS has FROM summary)
        SELECT attempt_id, CASE WHEN bool_or(has) THEN '单元' || chr(9) ELSE '' END || '题号' || chr(9) || '题型' || chr(9) || '我的答案' || chr(10) || string_agg(CASE WHEN has THEN unit || chr(9) ELSE '' END || no || chr(9) || type || chr(9) || CASE WHEN answer = '' THEN '未作答' ELSE answer END, chr(10) ORDER BY seq) AS text FROM h GROUP BY 1""",
}
