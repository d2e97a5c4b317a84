"""Token counts and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwright.llm import packing
from loomwright.llm.packing import best_fit, pack
from loomwright.llm.token_counts import count_tokens
from loomwright.llm.tokenizing import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


def test_both_implementations_agree_on_every_plain_character(enc):
    assert enc.fast is not None
    forms = ["{}", "a{}b", " {}", "{0}{0}", "1{}2", "\n{} x", "x {} y", "é{}é", "'{}", "{}'s", "  {}  ", "{}1", ".{}."]
    for c in map(chr, range(0x250)):
        for form in forms:
            text = form.format(c)
            assert enc.fast.encode_ordinary(text) == enc.lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_both_implementations_agree_on_random_texts(enc):
    rng = random.Random(5)
    some = "abcdefgh  \n\n\t'sdtm.,!?0123ÀéßñŒÿĿ\xa0\x85\x1c ͅ中🙂ﬁ" + "don't we'll "
    for _ in range(3000):
        text = "".join(rng.choices(some, k=rng.randint(0, 60)))
        assert enc.ids(text).tolist() == enc.lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunks_are_spliced_exactly(enc):
    rng = random.Random(7)
    for alphabet in ("ab cdé\n", "abcdefghij", "  \n a", "x<|endoftext|> y", "中文 字a"):
        units = [alphabet] if "endoftext" in alphabet else list(alphabet)
        for _ in range(60):
            text = "".join(rng.choices(units, k=rng.randint(0, 400)))
            for chunk, overlap in ((16, 4), (7, 1), (64, 16)):
                assert enc.encode(text, chunk, overlap).tolist() == enc.lib.encode(text, add_special_tokens=False).ids, repr(text)


DOCS = [(1, "hello world again"), (2, None), (3, ""), (4, "word " * 3000), (5, "é<|endoftext|>b"), (5, "hello world again"), (6, "z" * 9000), (None, "no id")]


def test_count_tokens(spark, enc):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = count_tokens(df, PATH, 1024, chunk_chars=100, overlap_chars=10).collect()
    want = sorted((i or 0, len((t or "").encode()), len(enc.lib.encode(t or "", add_special_tokens=False).ids)) for i, t in DOCS)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert count_tokens(df.limit(0), PATH, 1024).count() == 0


def test_best_fit_is_gapless_within_capacity():
    sizes = np.random.default_rng(3).integers(1, 101, 500)
    bins, offsets = best_fit(sizes, 100)
    for b in set(bins):
        mine = sorted((o, s) for o, s, x in zip(offsets, sizes, bins, strict=True) if x == b)
        assert [o for o, _ in mine] == [sum(s for _, s in mine[:i]) for i in range(len(mine))]
        assert sum(s for _, s in mine) <= 100
    assert len(set(bins)) <= 1.04 * sizes.sum() / 100


def test_pack_round_trip(spark, enc):
    rng = random.Random(1)
    rows = DOCS + [(100 + i, "word " * rng.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    out = pack(df, PATH, fan_in=2).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.append(np.array(enc.lib.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4"))
    for r in out:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    at = {}
    for r in out:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in at.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))]
        assert sum(n for _, n in v) <= 1024
    alone, _ = best_fit(np.array([r.length for r in out]), 1024)
    assert len(at) <= 1.1 * (alone.max() + 1)


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_bins_without_a_partner_do_not_climb_the_tree(spark, monkeypatch):
    """Pieces of over half a bin never share one: of each node a few are passed on, whatever the input's size."""
    rows = [(i, "a" * 5 + " word" * (520 + i * 37 % 470)) for i in range(400)] + [(1000 + i, "x y") for i in range(16)]
    seen = []
    keep = packing.store.materialize
    monkeypatch.setattr(packing.store, "materialize", lambda df, name: (lambda out: (seen.append((name, out)), out)[1])(keep(df, name)))
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), public_tokenizers.path("byte_bpe_50k.json"), fan_in=4).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    merged = [df.count() for name, df in seen if name == "merged-bins"]
    assert len(bins) == 400 and len(merged) == 2 and merged[1] <= 4 * 17
