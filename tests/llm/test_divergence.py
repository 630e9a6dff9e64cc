import random
from collections import Counter
from itertools import groupby

import duckdb
import parity
import pytest

from tabulens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, part string, value long"


def rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["ÄÖ", "äö", "中文", "It's", "UPPER"]
    out = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(9)] + [None])
        text = " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60)))
        out.append((i, rng.choice([text, text, text.upper(), text.replace(" ", "1,")]), lang, source))
    out += [(500, None, "en", "silent"), (501, "", "few", "a"), (502, "only once", "few", "b"), (503, "x", "lone", "z")]
    out += [(None, "wak wbk", "en", "hot")] * 3
    return [(*r, "clash", 1, "clash", 2) for r in out]


def brute(data, min_docs=10):
    capital = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    def terms(t):
        t = (t or "").translate(capital)
        return ["".join(g) for k, g in groupby(t, lambda c: c >= "\x80" or "a" <= c <= "z") if k]
    docs = [(r[2] or "", r[3] or "", terms(r[1])) for r in data]
    in_docs = Counter((lang, t) for lang, _, ts in docs for t in set(ts))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (k, t), n in in_docs.items() if k == lang and n >= min_docs]
        count = {s: Counter(t for k, x, ts in docs if (k, x) == (lang, s) for t in ts) for k, s, _ in docs if k == lang}
        total = Counter()
        for c in count.values():
            total.update(c)
        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        price = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in count.items()}, shares(total)
        for s in count:
            pairs = sorted((-sum(price(p[s][t], p[x][t]) for t in kept), x.encode()) for x in count if x != s)
            tops = sorted((-price(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:10]
            for part, found in (("pair", pairs), ("term", tops)):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_terms": 7, "block_sources": 3}, {"block_terms": 1, "block_sources": 100}])
def test_report_equals_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 5)
    monkeypatch.setattr(divergence, "HELD", 40)
    data = rows()
    got = divergence.audit(spark.createDataFrame(data, SCHEMA).repartition(3), **blocks).collect()
    assert sorted(map(tuple, got)) == brute(data)


def test_sql_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(rows(2), SCHEMA)
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert parity.compare(divergence.audit(df), con, divergence.oracle()) is None
    assert divergence.audit(df.limit(0)).count() == 0


def test_no_kept_terms_gives_zero_distances(spark):
    data = [(1, "a b", "x", "s1", "", 0, "", 0), (2, "c", "x", "s2", "", 0, "", 0), (3, None, "x", None, "", 0, "", 0)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(data, SCHEMA)).collect()))
    assert got == [("x", s, "pair", o, 0, i + 1) for s in ("", "s1", "s2")
                   for i, o in enumerate(x for x in ("", "s1", "s2") if x != s)]


def test_terms_of_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 10)
    text = ("Ab,c É9dd " * 50 + "z" * 100 + " end").encode()
    assert [t for part in divergence.terms_of(text) for t in part] == text.translate(divergence.TERM_SIGNS).split()


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, terms = 5 * 10**11, 10**13, 10**7
    sql = divergence._share("n", "total")
    got = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").selectExpr(f"{sql} AS p").first()
    assert got["p"] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
