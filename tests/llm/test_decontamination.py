"""Decontamination against brute force."""

import random
import re

from pyspark.sql import functions as F

from loomwright.llm.decontamination import build_index, find_contamination, n_hit, search

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for win, ids in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    got |= ids
        out.append((-1 if d is None else d, len(w), len(hit), sorted(got)))
    return sorted(out)


def data():
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["a", "B", "c", "É", "d1"]) for _ in range(n))
    items = [(1, make(6)), (2, make(3)), (3, None), (4, "..."), (11, make(9)), (12, "a"), (1, make(5))]
    docs = [(i, make(rng.randint(0, 60))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, items[0][1] + ", " + items[4][1].lower()), (103, items[0][1].replace(" ", "\n--")), (104, "z " * 3000 + items[4][1]), (None, "x")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 25, 60):
        out = find_contamination(d, i, window=4, block_bytes=block).withColumn("n", n_hit()).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n, r["items"]) for r in out) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(d.limit(0), i).count() == 0
    out = find_contamination(d, i.limit(0)).collect()
    assert len(out) == len(docs) and not any(r["items"] or r.hits for r in out)


def test_rows_of_one_key(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, f"x {item} y"), (None, "a clean text"), (5, f"{item} tail"), (5, "four clean words here"), (5, "four clean words here"), (6, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    for df in (d, d.coalesce(1), d.repartition(3)):
        out = find_contamination(df, i).withColumn("n", n_hit()).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n) for r in out) == [(0, 3, 0), (0, 12, 10), (5, 4, 0), (5, 4, 0), (5, 11, 10), (6, 0, 0)]


def near_brute(docs, items, slop):
    """Words from the first to the last term of each span that starts with a term and holds all."""
    out = {}
    for d, t in docs:
        w, hit = words(t), set()
        for _, x in items:
            want = set(words(x))
            for a in range(len(w)):
                if w[a] in want:
                    ends = [next((b for b in range(a, len(w)) if w[b] == q), 1 << 30) for q in want]
                    if max(ends) < a + len(words(x)) + slop:
                        hit |= set(range(a, max(ends) + 1))
        if hit:
            out[d] = sorted(hit)
    return out


def test_proximity(spark):
    docs = [(1, "q red one green two blue q"), (2, "red a b c d e green blue"), (3, "blue green red"), (4, "x blue x green red red y red blue green"), (5, None)]
    items = [(7, "red green blue")]
    i = spark.createDataFrame(items, "item_id long, text string")
    for d in (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)):
        index = build_index(d)
        assert {r.k for r in search(index, i, window=3).collect()} == set()
        for slop in (1, 2, 5):
            got = {r.k: sorted({j for x in r.hits for j in range(x["first"], x["last"] + 1)}) for r in search(index, i, window=3, slop=slop).collect()}
            assert got == near_brute(docs, items, slop)
