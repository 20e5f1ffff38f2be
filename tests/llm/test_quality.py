from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from seriesloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i}" for i in range(70)) + "."
CASES = [
    None,
    "",
    " \n\t\n",
    "a b c",
    "a b c a b c",
    "x x x x x",
    PROSE,
    "\n" + PROSE + "\n" + PROSE + "\n",
    PROSE + "\n" + " | ".join(f"item{i}" for i in range(5)),
    " ".join(f"w{i}###" for i in range(80)) + "\n" + PROSE,
    PROSE + "\nAll Rights Reserved by us",
    " ".join(f"w{i}" for i in range(100)),
    "é ü ß ## $\v%\f& |<>\r\n" * 30,
    "long " * 40_000,
    " ".join(f"t{i % 977}x{i % 1009}" for i in range(60_000)),
]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_measures_match_a_plain_loop(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(CASES)], SCHEMA)
    got = {r.doc_id: r for r in quality.measures(docs).collect()}
    for i, t in enumerate(CASES):
        assert tuple(got[i])[1:7] == plain(t), i
    assert [i for i in got if got[i].kept] == [6, 8, 10]


def test_failing_lines_go_and_the_rest_stays(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(CASES)] + [(None, PROSE, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.keep_clean(docs)
    assert got.columns == docs.columns
    texts = [(r.doc_id, r.text, r.n_chars) for r in got.collect()]
    assert (8, PROSE, len(PROSE)) in texts and (10, PROSE, len(PROSE)) in texts and (6, PROSE, len(PROSE)) in texts
    assert texts.count((None, PROSE, None)) == 2


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, words int, row string, kept int, cleaned string, lines int")
    assert quality.measures(docs).count() == 0 and quality.keep_clean(docs).count() == 0
    docs = spark.createDataFrame([(1, PROSE, 5, "r", 6, "c", 7)], docs.schema)
    assert quality.keep_clean(docs).collect() == docs.collect()


def test_plan_stays_in_the_jvm(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"))
    plan = quality.measures(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
