"""Registered queries over texts and tables that a prefix or a range of ids would cut."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import relational as R

WORDS = "word " * 300  # 1,500 characters


@pytest.fixture
def run(spark, tmp_path):
    def go(name, **tables):
        for table, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{table}.parquet")
        return [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]

    return go


def documents(*texts):
    return [(2 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string"


def test_normal_form_of_late_characters(run):
    assert sorted(run("TXT15_normal_form", documents=documents(WORDS, WORDS + "e\u0301", WORDS + "\u00e9"))) == [("BOTH", 1), ("NFC", 1), ("NFD", 1)]


def test_windows_to_the_end(run):
    got = run("TXT27_windows", documents=documents(WORDS))
    assert len(got) == 30 and max(e for _, _, e in got) == len(WORDS.rstrip())


def test_edits_keep_the_rest(run):
    [(_, text)] = run("TXT46_CMP46_span_edits", documents=documents(WORDS))
    assert text == WORDS[:5] + "<A>" + WORDS[9:12] + "<C>" + WORDS[12:]


def test_late_thai(run):
    assert run("TXT14_thai", documents=documents(WORDS + "\u0e01\u0e48")) == [(1, True, 2)]


def test_customers_of_all_ids(run):
    customers = [(i, i % 7) for i in range(1, 1000, 3)] + [(None, 1)]
    suppliers = [(i, i * i % 11) for i in range(1, 120)]
    pairs = Counter((min(a, b), max(a, b)) for i, a in customers for k, b in suppliers if i is not None and i % 50 == k % 50)
    got = run("shared_products_of_nations", customer=(customers, "c_custkey long, c_nationkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int"))
    assert sorted(got) == sorted((a, b, n) for (a, b), n in pairs.items() if n > 1)


def test_derangement_of_one_large_group(spark):
    """No task holds a group; a null gives way to the group's first value, as in the SQL."""
    rows = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 1000 == 999, "few").when(F.col("id") % 1000 == 998, None).otherwise("many").alias("g"), "id", F.when(F.col("id") % 1000 != 500, F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(4)), "id")).alias("v"))
    got = R.deranged(rows, "id", ["g"], ["v"]).withColumn("task", F.spark_partition_id()).toPandas()
    assert got.loc[got.g == "many"].task.nunique() > 1
    assert len(got) == 40_000
    for _, own in got.sort_values("id").groupby("g", dropna=False):
        v = [x if isinstance(x, str) else None for x in own.v]
        assert [x if isinstance(x, str) else None for x in own.next_v] == [x or v[0] for x in v[1:] + v[:1]]
    assert R.deranged(rows.limit(0), "id", ["g"], ["v"]).count() == 0
