"""Near copies against brute force on exact shingle sets."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from loomwright.llm import near_copies, simhash, store, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeghimnoprst", k=rng.randint(2, 8))) for _ in range(900)]
    return rng, lambda n: [rng.choice(vocab) for _ in range(n)]


def test_pairs_at_the_threshold_are_found(spark):
    rng, make = corpus(3)
    texts = []
    while len(texts) < 160:
        a = make(rng.randint(60, 400))
        b = list(a)
        while jaccard(" ".join(a), " ".join(b)) > 0.85:
            b[rng.randrange(len(b))] = "changed"
        if jaccard(" ".join(a), " ".join(b)) >= 0.8:
            texts += [" ".join(a), " ".join(b)]
    assert kept(spark, texts) == set(range(0, 160, 2))


def test_only_similar_texts_go(spark):
    rng, make = corpus(4)
    line = make(10)
    texts = [None, "", " \n", "hendtion ates thble a, inreor heoning.", " ".join(line * 7), " ".join(line * 8), "one two", "One  two", "two one"]
    for _ in range(300):
        texts.append(" ".join(make(6)))
    base = make(60)
    for size in (12, 5, 3, 2):  # the same text at similarities on both sides of the threshold
        other = list(base)
        other[-size:] = make(size)
        texts.append(" ".join(other))
    group = make(120)
    for _ in range(120):  # a group that is dense in parts
        other = list(group)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            other[at] = rng.choice("xyz")
        texts.append(" ".join(other))
    first = list(range(len(texts)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            x, y = root(i), root(j)
            if x != y and (5 * len(a & sets[j]) >= 4 * len(a | sets[j]) if a | sets[j] else True):
                first[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if first[i] == i}
    assert {0, 3, 4, 6, 8} <= want
    assert kept(spark, texts) == want


def test_rows_without_ids_and_rows_of_one_id(spark):
    rng, make = corpus(5)
    a, b, c, d, e, f = (" ".join(make(50)) for _ in range(6))
    close = a.split()
    close[3] = "changed"
    rows = [(None, b), (None, c), (3, d), (3, e), (1, f), (9, a), (7, " ".join(close)), (None, d), (2, None), (None, ""), (3, d), (None, c), (4, "  " + f.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA + ", kept string").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    assert got == sorted([(0, b), (0, c), (3, d), (3, e), (1, f), (7, " ".join(close)), (2, None)], key=str)


def test_empty(spark):
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_disk_of_the_stage(spark, monkeypatch, tmp_path):
    """Tables go once they are read, and the texts are dealt out once for both the join and the repeated rows."""
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    _, make = corpus(6)
    texts = [" ".join(make(40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts + texts[:9])], SCHEMA).repartition(3)
    with store.settings(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "loomwright").iterdir()}
    assert "members" in left and left <= {"members", "links", "lowest"}  # the last two are of the components, some rows
    key = plan[: plan.index("LeftSemi")]
    assert key.count("Exchange hashpartitioning") == 0, "a second exchange of the texts above the join"
    assert {r.doc_id for r in out.collect()} == set(range(30))


def test_parities_keep_all_similar_pairs_and_few_others():
    rng = np.random.default_rng(7)
    for n in (1, 4, 9, 60, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for other in (n, n * 4 // 5, n * 5 // 4):  # sketches of one length and of two
            for share in (0.0, 0.3, 0.6, 0.88, 0.9, 1.0):
                shared = a[: int(min(n, other) * share)]
                b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, max(other - len(shared), 0), dtype=np.uint64)]))
                x, y, both = near_copies._parities(a), near_copies._parities(b), len(a) + len(b)
                assert len(x) <= max(64, len(a)) and len(y) <= max(64, len(b))
                true = 9 * len(np.intersect1d(a, b)) >= 4 * both
                assert near_copies._reaches(a.tobytes(), b.tobytes(), both) == true
                assert near_copies._may_reach(x, y, both) or not true
                if n >= 60 and share <= 0.6:
                    assert not near_copies._may_reach(x, y, both)


def test_marking_takes_little_memory_at_once():
    """A worker stands beside the executor's heap: neither the texts of a batch nor what it has freed pile up in it."""
    _, make = corpus(8)
    texts = pa.array([" ".join(make(400)) for _ in range(900)])
    tracemalloc.start()
    small = simhash.fingerprints(texts, 5, near_copies._BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert (small == simhash.fingerprints(texts, 5)).all()
    freed = []
    words.release, before = (lambda: freed.append(1)), words.release
    try:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        assert sum(len(b) for b in near_copies._slices(iter([batch]))) == 900
    finally:
        words.release = before
    assert len(freed) == 2
    words.release()
