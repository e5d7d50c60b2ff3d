import collections

import duckdb
import pytest
from llm_helpers import SPACED
from pyspark.sql import functions as F

from heddle.llm import line_rules as R
from heddle.llm.queries import ORACLE


def base(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = collections.Counter(windows)
    covered = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = ["a b c d e f g h " * 3, "x " * 9, "one two three four five six seven", "é #*$%&|<> ü\n\nb\n b\nb", None, "", " \t\x0b\x0c\r\n ", "a\x1cb c", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 z", "w " * 5000]


def test_measures_of_a_text(spark, texts):
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate([*TEXTS, *(t for _, t in texts[:80])])], "doc_id int, text string, source string")
    for r in R.measured(docs).select("text", "found.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)


@pytest.fixture
def site(spark):
    nav = "Home  ABOUT contact"
    own = "this is line number {} of its own with a few more words to be long enough for the rules of this test ok"
    rows = [(i, f"{nav}\n{own.format(i)}", "hot" if i < 40 else "cold", i) for i in range(60)]
    rows += [(100 + i, "home about Contact\nhome about contact\nshort {}".format(i), "hot", 0) for i in range(3)]
    rows += [(200, None, None, 0), (201, own.format(3), None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, found int")


def test_frequent_lines_by_host(site):
    rows, name = R.judged(site)
    got = {r.doc_id: r for r in rows.select("doc_id", F.col(f"{name}.n_frequent_words").alias("n"), F.col(f"{name}.kept").alias("kept")).collect()}
    # 43 documents of the hot host hold the line, 20 of the other, which isn't more than the limit
    assert [got[i].n for i in (0, 39, 40, 59)] == [3, 3, 0, 0]
    assert got[0].kept and got[40].kept
    assert got[100].n == 6 and not got[100].kept
    assert not got[200].kept and got[201].kept


def test_depleted_documents_go(spark):
    boiler = "\n".join(f"line {i} is the same on every page of this host and has many words in it" for i in range(3))
    rows = [(i, boiler + f"\npage {i}", "h") for i in range(30)] + [(99, "a page with words of its own " * 1 + " ".join(f"w{i}" for i in range(30)), "h")]
    out = R.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [r.doc_id for r in out.collect()] == [99]


def test_cleaned_texts_lose_the_lines(site):
    out = R.cleaned(site)
    assert out.columns == site.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0].startswith("this is line number 0") and text[45].startswith("Home")


def test_lines_count_once_for_each_document_as_in_sql(spark):
    own = "this is line number {} of its own with a few more words to be long enough for the rules of this test ok"
    rows = [(1, "often repeated\n" + own.format(1), "a")] * 16 + [(i, "Often  repeated\n" + own.format(i), "a") for i in range(2, 12)]
    rows += [(i, "over the limit\n\n" + own.format(i) + "\nOver the limit", "b") for i in range(100, 121)] + [(100, "another text of the id\nover the limit", "b"), (200, "over the limit", None), (201, "over the limit", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, name = R.judged(docs)
    got = [tuple(r) for r in out.select("doc_id", F.col(f"{name}.n_frequent_words"), F.array_join(f"{name}.removed", ",")).collect()]
    assert sorted(got) == sorted((d, 3 * t.lower().count("over the limit") * (s == "b"), ",".join(str(i) for i, x in enumerate(t.split("\n")) if s == "b" and x.lower() == "over the limit")) for d, t, s in rows)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    # the query tells rows apart by id, so rows of an id are compared by what they lose
    marked = con.sql(f"SELECT doc_id, n_frequent_words > 0 FROM ({ORACLE['op7_line_rules']})").fetchall()
    assert sorted(set(marked)) == sorted({(d, n > 0) for d, n, _ in got})
