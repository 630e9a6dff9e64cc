import hashlib
import random
import re

import numpy as np
import parity
from pyspark.sql import functions as F

from tabulens.llm import fillmiddle, suite

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "one", "  one two\n", "a <P> b c d", "<S>", "x<M>y z", "é 😀 中文  x ﬁ", "w " * 30_000, "y" * 50_000, "\t\n"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def docs(spark):
    rng = random.Random(7)
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS * 6)] + [(None, "no id at all", "x", 1), (3, "one", "again", 2)]
    rows += [(1000 + i, "".join(rng.choice("ab é😀\n\t中  <>PSM") for _ in range(rng.randint(0, 200))), "n", 0) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, form string, n int")


def test_forms_cuts_and_texts(spark):
    rows, df = docs(spark)
    made = fillmiddle.transform(df)
    got = made.withColumn("back", fillmiddle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, ((r["doc_id"], *brute(r["doc_id"], r["back"])) for r in got))) == sorted(
        map(repr, (tuple(r)[:6] for r in got)))
    assert sorted((r["doc_id"] or -1, r["back"]) for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fillmiddle.transform(df.limit(0)).count() == 0


def test_ranks_in_skip_lists_of_many_texts():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab é😀\n\t中  ") for _ in range(rng.randint(0, rng.choice([0, 3, 50, 2000]))))
                 for _ in range(rng.randint(1, 20))]
        units = [UNIT.findall(t) for t in texts]
        lists = fillmiddle.SkipLists([t.encode() for t in texts])
        assert lists.counts.tolist() == [len(u) for u in units]
        wanted = [(i, r) for i, u in enumerate(units) for r in sorted({0, len(u), rng.randint(0, len(u))})]
        points, octets = lists.find(np.array([i for i, _ in wanted]), np.array([r for _, r in wanted]))
        for (i, r), x, y in zip(wanted, points.tolist(), octets.tolist(), strict=True):
            head = "".join(units[i][:r])
            assert (x, y) == (len(head), len(head.encode()))


def test_lanes_thin_out():
    lists = fillmiddle.SkipLists([b"word " * 100_000])
    sizes = [len(lane[0]) for lane in lists.lanes]
    assert all(3 * b < a for a, b in zip(sizes[:6], sizes[1:7]))
    assert all(lane[1][:, 0].sum() == 100_001 for lane in lists.lanes)


def test_query_equals_sql(spark, tmp_path):
    rows, df = docs(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert parity.compare(suite.fill_in_middle(spark, str(tmp_path)), con, fillmiddle.oracle()) is None
