import difflib
import uuid

import pytest
from pyspark.sql import functions as F

from overscribe.functions import similarity as sim
from overscribe.functions import text as tx
from overscribe.operators import dense
from overscribe.operators.chunk import split_text, upsert


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norm_title_by_hand(spark):
    values = ["Visa 2024 rules", "[new] Visa rules", "News║Visa: rules!", "Spring 3rd visa rules", "  ", "純文字", "112年度簽證"]
    assert one(spark, values, tx.norm_title) == ["visarules", "visarules", "visarules", "visarules", "", "純文字", "簽證"]


def test_norm_body_by_hand(spark):
    values = ["in 2024 and 1999", "112 年 3 月 2023", "1234年 99 年", "a \u3000\n b", ""]
    assert one(spark, values, tx.norm_body) == ["in<Y>and<Y>", "<Y>年3月<Y>", "1234年99年", "ab", ""]


def test_tokens_by_hand(spark):
    values = ["Visa-Rules 2024", "混合 mixed 中文字 text 一", "Été", ""]
    assert one(spark, values, tx.tokens) == [["visa", "rules", "2024"], ["mixed", "text", "混合", "中文", "文字", "一"], ["t"], []]


def test_title_and_text_by_hand(spark):
    values = ["\u3000\n# Title \t x\n\n body  line\n next ", "only", None, "##\nrest"]
    assert [tuple(r) for r in one(spark, values, tx.title_and_text)] == [("Title x", "body line\n next"), ("only", ""), ("", ""), ("", "rest")]


def test_furniture(spark):
    banner, long, edge = "Office of X", "y" * 121, "z" * 120
    text = "\n".join(f"{banner} P{i}\nbody {chr(97 + i)}\n\n{long}\n{edge}" for i in range(4))
    got = one(spark, [text, "a\na\na\nb", ""], tx.strip_furniture)
    assert got[0] == "\n".join(f"body {chr(97 + i)}\n\n{long}" for i in range(4))
    assert got[1:] == ["a\na\na\nb", ""]


def test_html(spark):
    page = "<script>x<p></script>A&nbsp;&lt;b&gt;<br/>c <b>d</b></p>\n\n<div>e</div>&amp;lt;"
    assert one(spark, [page], tx.html_to_text) == ["A <b>\nc d\ne &lt;"]


@pytest.mark.parametrize("name", ["t01_html_to_text", "t02_title_extract"])
def test_pages_as_sql_has_them(spark, tmp_path, name):
    """Cut and other entities, ones of ones, white space that is not ASCII's, and pages without text or title."""
    import duckdb

    from overscribe.plans import REGISTRY, SQL

    from .oracle import rows

    odd = ["token = &quot", "&quot &lt &gt", "&eacute; &#8217; &#x27; &#039; &#10;x", "&amp;lt; &amp;amp; &ampx &am &", "&nbsp;a&nbsp;", "\u3000a\u2003", "\x0ba\x0b b\x85", "a<br\x0b/>b<br \t/>c", "&copy &copy; &middot;&#39;", "", " \r\n\r &nbsp;", "a\u00a0\t b"]
    pages = [(i, f"<html><title>{x}</title><script>s</script><p>{x}</p><h1>{x}</h1></html>") for i, x in enumerate(odd)] + [(98, "no title &quot"), (99, None), (100, "")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(REGISTRY[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL[name]).df())


def test_attachments(spark):
    page = '<ul class="list-group"><a class="x" href="/download.php?dir=news&amp;filename=a1.PDF&amp;title=T">T <i>1</i></a><a href="https://x.org/form">form</a><a href="https://x.org/download.php?f=1">n</a></ul>'
    got = one(spark, [page, "none"], lambda c: tx.attachments(c, "https://s"))
    assert [tuple(x) for x in got[0]] == [("https://s/download.php?dir=news&filename=a1.PDF&title=T", "T 1", "pdf"), ("https://x.org/download.php?f=1", "n", "")]
    assert got[1] == []


def test_uuid5(spark):
    names = ["a.pdf:0", "公告.pdf:12", ""]
    assert one(spark, names, tx.uuid5_url) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_reply(spark):
    good = '{"rationale":"r","label":"UPDATE","target":"C1","confidence":0.5}'
    got = one(spark, [good, f"```{good}```", good[:-5], good.replace("0.5", "1.5"), good.replace("UPDATE", "X"), "", None], lambda c: tx.parse_reply(c)["quality"])
    assert got == ["valid", "recovered"] + ["invalid"] * 5


def test_ratio_is_difflibs(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("公告2024", "公告2025")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(sim.ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_coverage(spark):
    df = spark.createDataFrame([(0, "", "x"), (1, "abc", "zabcz"), (2, "abcd", "ab-cd"), (3, "abc", "")], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(sim.coverage(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 1.0, 0.0]


def test_split_text():
    text = "\n\n".join("word " * 60 for _ in range(5)) + "。" + "x" * 2000
    parts = split_text(text)
    assert all(0 < len(p) <= 800 for p in parts)
    assert "".join("".join(parts).split()).count("x") >= 2000
    assert split_text("") == [] and split_text("short") == ["short"]


def test_upsert_keeps_the_old_tail(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "f string, i int, t string")
    new = spark.createDataFrame([("a", 0, "n")], "f string, i int, t string")
    assert sorted(map(tuple, upsert(old, new, ["f", "i"]).collect())) == [("a", 0, "n"), ("a", 1, "y"), ("b", 0, "z")]
    assert sorted(map(tuple, upsert(old, new, ["f", "i"], prune="f").collect())) == [("a", 0, "n"), ("b", 0, "z")]


def test_knn_ties_by_key(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q int, v array<double>")
    b = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    assert [(r.k, r.rank) for r in dense.knn(q, "q", "v", b, "k", "v", 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
