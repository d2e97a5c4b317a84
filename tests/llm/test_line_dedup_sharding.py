"""Line dedup and sharding against brute force on small fixtures."""

import hashlib
import zlib

from pyspark.sql import functions as F

from loomwright.llm.line_dedup import LineRuns, dedup_lines
from loomwright.llm.sharding import shard_by_bytes

WS = " \t\n\x0b\f\r"
LONG = "A Line that is long enough é"
ROWS = [
    (5, LONG + "\nshort\nother line of five"),
    (1, "  " + LONG.upper().replace("É", "é") + "\t\nshort"),
    (2, None),
    (3, ""),
    (4, "tail line repeated\ntail line repeated\n\n"),
    (9, "tail line repeated\n" + LONG + "\n" + "x" * 5000),
    (8, LONG),
    (7, "Short\nshort\n"),
]


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows):
    key = lambda x: _lower(x.strip(WS))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("pos", F.lit("clash"))
    for batches in (1, 2, 7):
        out = dedup_lines(df, batches=batches, fanout=2).withColumn("sha", F.sha2("text", 256)).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in out} == brute_lines(ROWS)
        assert {r.pos for r in out} == {"clash"}


def test_rows_of_one_id_and_rows_without(spark):
    rows = [
        (5, "first line of row one\nshared by both rows of five"),
        (5, "unique text of row two\nother unique line\nshared by both rows of five\nheld by five and six"),
        (5, "unique text of row two\nother unique line\nshared by both rows of five\nheld by five and six"),
        (6, "held by five and six\nheld by six and a row without id"),
        (None, "held by six and a row without id\nheld by two rows without id\nlast"),
        (None, "held by two rows without id\nof the second row only"),
        (None, None),
    ]
    for batches in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
        out = [(r.doc_id, r.text, r.n_dropped) for r in dedup_lines(df, batches=batches).collect()]
        assert [x for x in out if x[0] == 5 and x[1].startswith("first")] == [(5, rows[0][1], 0)]
        assert [x for x in out if x[0] == 5 and x[1].startswith("unique")] == [(5, rows[1][1], 0)] * 2
        assert [x for x in out if x[0] == 6] == [(6, "held by six and a row without id", 1)]
        bare = [x for x in out if x[0] is None]
        assert ("", 0) in [x[1:] for x in bare] and not any("held by six" in x[1] for x in bare)
        assert sum("held by two rows without id" in x[1] for x in bare) == 1 and sum(x[2] for x in bare) == 2
    alone = dedup_lines(spark.createDataFrame(rows[4:], "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in alone) == [0, 0, 1]


def test_runs_are_joined_as_they_lie(spark):
    keys = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("owner"))
    with LineRuns(spark, fanout=2) as runs:
        for i in range(3):
            runs.add(keys(100 * i, 100 * i + 100))
        assert [len(level) for level in runs.levels] == [1, 1]
        fresh = keys(250, 350).select("h1", "h2", F.lit(None).alias("x")).groupBy("h1", "h2").agg(F.max("x").alias("x"))
        met = runs.seen(fresh)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
        assert sorted((r.h2, r.owner) for r in met.collect()) == [(i, i if i < 300 else None) for i in range(250, 350)]
        names = list(runs.paths)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_line_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(df).count() == 0


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = [(i * 3, "x" * (i * 37 % 101)) for i in range(300)] + [(1, None), (1, None), (2, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    out = shard_by_bytes(df, 5, partitions=3).orderBy("shard", "slot").collect()
    assert len(out) == len(rows)
    assert [r.doc_id for r in out] == sorted(i for i, _ in rows)
    sizes = {}
    for r in out:
        assert r.slot == len(sizes.setdefault(r.shard, []))
        sizes[r.shard].append(r.size)
    total = sum(map(sum, sizes.values()))
    assert sorted(sizes) == list(range(5))
    assert all(abs(sum(v) - total / 5) <= 109 for v in sizes.values())
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in out)


def test_shards_of_an_empty_table(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
