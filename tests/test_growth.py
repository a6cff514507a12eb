"""What must not grow with a table: rows of a task, exchanges, copies of texts."""

import pytest
from pyspark.sql import functions as F

from examlake.functions import text as T
from examlake.operators import crops as C
from examlake.operators import lifecycle as L
from examlake.operators.rewriting import CHUNK, text_chunks
from examlake.operators.segmentation import parsed_questions
from examlake.operators.spans import beside
from examlake.plans import bridges as B
from examlake.plans import catalog, editing, layouts
from examlake.sources.text import text_lines


@pytest.fixture
def plain(spark):
    """Plans as they are made, without what adaptive execution changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write_tables(spark, path, n):
    lines = [(k // 3, k % 3, k % 7, 1, 10.0, "N") for k in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, f"p{k}") for k in range(1, 7)], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_questions_are_dealt_out_by_the_rows_of_their_table(plain, tmp_path, monkeypatch):
    path = write_tables(plain, tmp_path, 60)
    monkeypatch.setattr(B, "ROWS_A_PART", 6)
    assert B.questions(plain, path).rdd.getNumPartitions() == 10
    assert plan(B.questions(plain, path).groupBy("paper_id").count()).count("Exchange hashpartitioning") == 1


def test_questions_are_numbered_among_those_with_a_part(spark, tmp_path):
    got = B.questions(spark, write_tables(spark, tmp_path, 9)).select("paper_id", "seq", "no").collect()
    # the lines 0 and 7 have part 0, which isn't there
    assert sorted(map(tuple, got)) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 2)]


def test_beside_is_a_left_join(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, None, 7), (2, "b", 8)], "p int, k string, v int")
    others = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (1, None, 9), (3, "c", 4)], "p int, k string, w int")
    got = beside(rows, others, ["p", "k"], most=F.max("_other.w"), n=F.count("_other.w"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", 5, 3, 2), (1, "a", 6, 3, 2), (1, None, 7, None, None), (2, "b", 8, None, 0)]


@pytest.mark.parametrize("edit", [
    lambda q: L.picture_switched(q, q.select("paper_id", "seq", F.lit(True).alias("shown"))),
    lambda q: L.checked_pictures(q, q.select("paper_id", "seq", F.lit(1).alias("n_pictures"))),
    lambda q: L.carried_over(q, q),
    lambda q: L.list_edits(q, q.select("paper_id", "seq", F.lit("flag").alias("action"))),
    lambda q: L.merged_into_previous(q, q.where("seq % 2 = 0")),
    lambda q: L.spliced(q, q, q.select("paper_id", F.concat("unit", F.lit("|"), F.col("no").cast("string")).alias("key"))),
    lambda q: C.recropped(*[q.select("paper_id", "seq", F.lit("f").alias("file"), F.lit(1).alias("page"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))] * 2),
])
def test_edits_deal_no_paper_out_again(plain, edit):
    q = plain.range(20).select((F.col("id") % 3).alias("paper_id"), F.col("id").cast("int").alias("seq"), F.lit("u").alias("unit"), F.lit(1).alias("no"), F.lit("single").alias("type"), F.lit("s").alias("stem"), F.array(F.lit("o")).alias("options"), F.lit(0).alias("blanks"), F.lit("i").alias("image"), F.lit("c").alias("crop"), F.lit(True).alias("reviewed"), F.array(F.lit("x")).alias("issues"), F.lit("text").alias("source"))
    made = plan(edit(q.repartition(7, "paper_id")))
    assert made.count("Exchange hashpartitioning") == made.count("REPARTITION_BY_NUM") > 0


def test_chunks_hold_no_text_for_each_line(plain):
    rows = [(1, "\n".join(f"{k}. q" for k in range(1, 2 * CHUNK + 3))), (2, "intro\n1. q\n"), (3, None), (4, ""), (5, "a\n" + "\n".join("1. q\nmore" for _ in range(CHUNK + 1)))]
    chunks = text_chunks(plain.createDataFrame(rows, "paper_id int, text string"))
    assert "Window" not in plan(chunks)
    line = rows[0][1].split("\n")
    assert sorted(map(tuple, chunks.collect())) == [(1, 0, "\n".join(line[:CHUNK])), (1, 1, "\n".join(line[CHUNK : 2 * CHUNK])), (1, 2, "\n".join(line[2 * CHUNK :])), (2, 0, "intro\n1. q\n"), (4, 0, ""), (5, 0, "a\n" + "\n".join(["1. q\nmore"] * CHUNK)), (5, 1, "1. q\nmore")]


def test_lines_are_judged_once_for_both_kinds_of_papers(plain):
    papers = plain.createDataFrame([(1, "1. q?\nA. a\nB. b"), (2, "材料：x\n2. q?\nA. a\nB. b")], "paper_id int, text string")
    made = plan(parsed_questions(text_lines(papers), parts=6))
    assert "ReusedExchange" in made and "hashpartitioning(paper_id" in made and ", 6)" in made


def test_files_of_a_small_table_are_made_by_many_tasks(plain, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILES_A_PART", 5)
    plain.range(20).selectExpr("id as s_suppkey", "concat('s', id) as s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert layouts.word_scan(plain, str(tmp_path)).rdd.getNumPartitions() == 4


def test_stored_papers_are_parsed_once(plain):
    assert "from_json" not in plan(editing.stored_papers(plain, "/root/testdata/sf0.001"))


def test_lines_meet_no_pattern_that_looks_at_each_character_in_vain(plain):
    made = plan(catalog.text_functions(plain, "/root/testdata/sf0.001"))
    assert "多项选择|多选" not in made and made.count("(?U)^\\s+") == made.count("THEN regexp_replace(lambda") == 1


def test_text_functions_on_odd_ends(spark):
    texts = ["", " ", "a", " a", "a\u3000", "\u00a0a b\u2028", "a\n", "\n\r\na", "a\u200b", "\x1ca\x85", "中。 ", "中。", "é\u2e80\u2e81中𝒳", "𝒳 ", "b)\t\n", "c\ufeff", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    wide = F.length(F.regexp_replace("text", "[\\x{0}-\\x{2E80}]", ""))
    last = F.right(T.stripped("text"), F.lit(1))
    ends = F.when(F.col("text").isNotNull(), (last != "") & (F.instr(F.lit(T.SENTENCE_ENDS), last) > 0))
    got = rows.select("k", T.seldom_stripped("text").eqNullSafe(T.stripped("text")).alias("same"), T.weighted_length("text").eqNullSafe(wide + (F.length("text") - wide) * 0.55).alias("wide"), T.ends_sentence("text").eqNullSafe(ends).alias("ends"))
    assert [r.k for r in got.collect() if not (r.same and r.wide and r.ends)] == []


def test_each_line_break_counts_once(spark):
    texts = {"a\r\nb": 2, "a\r\r\nb": 3, "a\n\rb": 3, "\r\n": 2, "\r\n\r\n\n": 4, "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i": 9, "a\x1f\tb": 1, "": 1}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.split_lines("text").alias("lines")).collect()
    assert {r.text: len(r.lines) for r in got} == texts and all("\r" not in x and "\n" not in x for r in got for x in r.lines)


def test_no_text_of_a_paper_goes_through_arrays_to_the_automaton(plain):
    lines = text_lines(plain.createDataFrame([(1, "材料：x\n2. q?\nA. a\nB. b")], "paper_id int, text string"))
    made = plan(parsed_questions(lines, parts=6))
    fed = made[made.index("MapInArrow") :].split("\n")[1:4]
    assert any("Window" in x for x in fed) and not any("Aggregate" in x for x in fed)


def test_papers_are_read_whole_whatever_batches_they_come_in(spark):
    text = "根据以下材料，回答 1～2 题。\n今年增长了。\n1. 甲？\nA. 一 B. 二\n2乙？\nA. 三\nB. 四\n4. 丙？\nA B C D\n1. 丁？\n答案：A"
    papers = spark.createDataFrame([(k or None, text * (k % 4) + "\n1. 末？\nA. 五") for k in range(13)], "paper_id int, text string")
    read = lambda: sorted(map(str, parsed_questions(text_lines(papers), parts=2).collect()))
    want = read()
    try:
        for rows in ("1", "7", "30"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert read() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
