"""The audit against brute force with odd rows, many sources and its SQL; block products against direct sums."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from mnemolake.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, nth int, rank int"


def brute(rows, top=200):
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, c in in_docs[lang].items() if c >= 3]
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update({t: n[g][t] for t in kept})
        p = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        own, whole = p(n[lang, source]), p(total)
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            q = p(n[lang, other])
            pairs.append((sum((own[t] - q[t]) ** 2 // q[t] for t in kept), other))
        terms = [((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if n[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def made(sources, docs, vocabulary=400):
    rng = np.random.default_rng(4)
    names = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" + "É" * (i % 3) for i in range(vocabulary)]
    rows = [(k, " ".join(names[i].title() if i % 5 else names[i] + "9'" for i in np.minimum(rng.zipf(1.4, rng.integers(0, 90)) - 1, vocabulary - 1)), ("en", "de", None)[k % 3], f"s{rng.integers(0, sources)}", 1, "x", 2, 3) for k in range(docs)]
    rows += [(9000, None, "en", None, 1, "x", 2, 3), (9001, "", "fr", "a", 1, "x", 2, 3), (9002, "12 ' _", "fr", "", 1, "x", 2, 3), (9003, "the " * 60_000 + "of", "en", "s0", 1, "x", 2, 3)]
    return rows + rows[:5] + [(None, "Ta Taa taa", "en", "lone", 1, "x", 2, 3)] * 3


@pytest.mark.parametrize(("sources", "tile", "terms"), [(4, 32, 1024), (7, 2, 16), (5, 32, 8)])
def test_audit_matches_brute_force(spark, monkeypatch, sources, tile, terms):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "COLUMNS", 7)
    rows = made(sources, 150)
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_ranks_of_terms_end(spark):
    rows = made(2, 120)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), top_terms=3).where("part = 'term'").collect()
    assert sorted(tuple(r) for r in got) == [r for r in brute(rows, 3) if r[2] == "term"]


def test_sql_matches_brute_force():
    rows = made(5, 120)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.sql(queries.ORACLES["op13_source_divergence"]).fetchall()) == brute(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_products_match_direct_sums():
    rng = np.random.default_rng(6)
    groups, terms = np.arange(6) * 3, 40
    table = rng.integers(0, 4, (6, terms)) * (rng.random((6, terms)) < 0.6)
    price = np.array([[1 + g + 10 * c for c in range(4)] for g in range(6)], np.int64)
    g, t = np.nonzero(table)
    want = {(i, j): int(sum((price[i, table[i, k]] - price[j, table[j, k]]) ** 2 // price[j, table[j, k]] for k in range(terms))) for i in range(6) for j in range(6) if i != j}
    run = lambda left: divergence.block_sums(groups[g], t, price[g, table[g, t]], groups, price[:, 0], terms, left)
    assert run(np.ones(6, bool)) == want
    half = np.arange(6) < 2
    assert run(half) == {(i, j): v for (i, j), v in want.items() if half[i] != half[j]}
