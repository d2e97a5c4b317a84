"""PII: long secrets, many short mailboxes, names in all their forms, further kinds, and the keyed streams."""

import hashlib
import hmac
import re

from pyspark.sql import functions as F

from loomwright.llm import pii
from loomwright.llm.pii import replace_pii


def test_long_secret(spark):
    secret = "".join(f"x{i}Q-" for i in range(900))
    df = spark.createDataFrame([(1, f"token={secret} end")], "doc_id long, text string")
    row = replace_pii(df, "k").first()
    m = re.fullmatch(r"token=(\S+) end", row.text)
    assert len(secret) > 4000 and row.n_entities == 1
    assert m and len(m[1]) == len(secret) and secret[256:300] not in row.text and secret[-40:] not in row.text
    assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", m[1]))) == re.sub("[0-9]", "9", secret.replace("x", "a").replace("Q", "A"))


def test_short_mailboxes(spark):
    real = [f"a@x{i}.com" for i in range(1, 40)] + [f"{c}@one.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(real)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in replace_pii(df, "k").collect()}
    assert len(set(out.values())) == len(real) and not set(real) & set(out.values())
    assert all(re.fullmatch(r"[a-z]+@[a-z0-9]+\.(com|org)", t) for t in out.values())
    assert all(out[i].split("@")[0] != a.split("@")[0] for i, a in enumerate(real))


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    return [r.text for r in replace_pii(df.withColumn("at", F.monotonically_increasing_id()), key).orderBy("at").collect()]


def test_names(spark):
    out = replaced(
        spark,
        [
            "Mr. John Smith met us. Later John Smith called; Smith's mail, SMITH too, smith not, Smithson not.",
            "Smith alone stays, without a title.",
            "Dr. Ioannis Παπαδόπουλος and г-н Ivan Петров.",
            "Mr. O'Neil-Smith and Mrs Anne-Marie d'Arc",
        ],
    )
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met us\. Later (\w+) (\w+) called; (\w+)'s mail, (\w+) too, smith not, Smithson not\.", out[0])
    assert m and (m[1], m[2]) == (m[3], m[4]) and m[5] == m[2] and m[6] == m[2].upper() and not {"John", "Smith"} & set(m.groups())
    assert out[1] == "Smith alone stays, without a title."
    m = re.fullmatch(r"Dr\. ([A-Z][a-z]+) ([Α-Ωα-ωςά-ώ]+) and г-н ([A-Z][a-z]+) ([А-Яа-я]+)\.", out[2])
    assert m and m[1] != "Ioannis" and m[2] != "Παπαδόπουλος" and m[4] != "Петров"
    smith = re.search(r"met us", out[0]) and re.match(r"Mr\. \w+ (\w+)", out[0])[1]
    m = re.fullmatch(r"Mr\. O'([A-Z][a-z]+)-([A-Z][a-z]+) and Mrs ([A-Z][a-z]+)-([A-Z][a-z]+) d'Arc", out[3])
    assert m and m[2] == smith and m[1] != "Neil" and m[3] != "Anne"


def test_further_kinds(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    out = replaced(spark, [f"see {jwt}, 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80:0:1::8a2e:370 at 10:20:30", "Passport no. AB1234567; born 1984-12-31, DOB: 01.02.1990"])
    m = re.fullmatch(r"see (eyJ[\w-]+\.[\w-]+\.[\w-]+), ((?:[0-9a-f]{4}:){7}[0-9a-f]{4}) and ([0-9a-f]{4}:[0-9a-f]:[0-9a-f]::[0-9a-f]{4}:[0-9a-f]{3}) at 10:20:30", out[0])
    assert m and m[1] != jwt and len(m[1]) == len(jwt) and "85a3" not in m[2] + m[3]
    m = re.fullmatch(r"Passport no\. ([A-Z]{2}\d{7}); born (\d{4})-(\d\d)-(\d\d), DOB: (\d\d)\.(\d\d)\.(\d{4})", out[1])
    assert m and m[1] != "AB1234567" and 1 <= int(m[3]) <= 12 and 1 <= int(m[4]) <= 28 and 1 <= int(m[6]) <= 12


def test_keyed_streams_are_hmac_and_hide_the_key(spark):
    for key in ("k", "long key " * 20):
        rows = pii._pads(spark, key).crossJoin(spark.createDataFrame([("a",), ("ünï",), ("",)], "m string"))
        for r in rows.select("m", pii.hmac_sha256(F.col("m")).alias("h")).collect():
            assert r.h == hmac.new(key.encode(), r.m.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    plan = replace_pii(df, "very-secret-key")._jdf.queryExecution().toString()
    assert "very-secret-key" not in plan


def test_rows_without_ids_have_their_own_replacements(spark):
    out = replaced(spark, ["Mr. Joe Blake and Blake", "Blake is no one here", "Mr. Joe Blake and Blake", None])
    assert out[0] == out[2] and "Blake" not in out[0] and out[1] == "Blake is no one here" and out[3] is None
