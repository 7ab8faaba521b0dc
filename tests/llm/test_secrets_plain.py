"""Base spans of the secret scan, through its query, against the stated patterns."""
import hashlib
import random
import re

import pytest

from labelforge.llm import queries

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text):
    t = text or ""
    return ([("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
            + [("hex", m.start(), m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24])


def check(spark, folder):
    texts = dict(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op7_secret_scan(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain(texts[r["doc_id"]])
        spans.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        told = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, tmp_path, seed):
    random.seed(seed)
    parts = ["password", "PassWd", "api_key", "apiKEY", "token", "ſecret", "secret", " ", "  ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef", "x9+/_.=-", "é\U0001F600", "\n", "\t", "const ", "a", "K"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 30)))) for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))
