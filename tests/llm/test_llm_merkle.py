"""The manifest against a plain recursion, its SQL, and containers and ranks against sets."""

import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from mnemolake.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, place long, id int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(told(v) for v in (row[0], row[3], row[2], row[4], text)))


def climb(nodes):
    """The root, and for each node the list of (before, after) on its way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for w, i in zip(ways, at, strict=True):
            run = i // 8 * 8
            w.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], ways


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = own, *climb([leaf(r, r[1]) for r in own])
    root, tops = climb([trees[k][1] for k in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        own, sub, ways = trees[lang]
        for r, way in zip(own, ways, strict=True):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate({k: k + 32 for k in range(65, 91)})
            node = leaf(r, text)
            for b, a in way + top:
                node = h(b + node + a)
            out.append((r[0], leaf(r, r[1]), sub, root, h("".join(b + a for b, a in way + top)), node, node == root))
    return out


def rows_of(sizes, start=0, step=1):
    out, at = [], start
    for lang, n in sizes.items():
        for _ in range(n):
            out.append((at, f"Text Ä {at} Of" if at % 5 else None, lang, f"s{at % 3}" if at % 4 else None, at, "x", 1, 2))
            at += step
    return out


def got(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


@pytest.mark.parametrize(
    ("sizes", "start", "step"),
    [({"en": 9000, None: 1, "de": 8, "": 9, "fr": 65}, 0, 1), ({f"l{k:02d}": 1 + k % 3 for k in range(70)}, -50, 4099), ({"en": 1}, 5, 1), ({"en": 700, "é": 520}, -(10**15), 10**12)],
)
def test_manifest_matches_a_plain_recursion(spark, sizes, start, step):
    rows = rows_of(sizes, start, step)
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    assert got(spark, shuffled) == sorted(brute(rows), key=str)


def test_missing_and_repeated_ids_and_long_texts(spark):
    rows = rows_of({"en": 20, None: 12})
    rows += rows[:7] + rows[:7] + [(None, "A", "en", None, None, "x", 1, 2)] * 3 + [(None, None, None, None, None, "x", 1, 2), (5, "B" * 2_000_000, "en", "s", 1, "x", 1, 2)]
    assert got(spark, rows) == sorted(brute(rows), key=str)
    assert merkle.manifest(spark.createDataFrame(rows[:1], SCHEMA).limit(0)).count() == 0


def test_sql_matches_a_plain_recursion():
    rows = rows_of({"en": 600, None: 3, "de": 8, "fr": 9})
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    assert sorted(con.sql(queries.ORACLES["op12_merkle_manifest"]).fetchall(), key=str) == sorted(brute(rows), key=str)


def test_containers_and_ranks():
    rng = np.random.default_rng(2)
    for ids in ([0], [4095], range(4096), range(10, 900), rng.choice(4096, 40, replace=False), rng.choice(4096, 2000, replace=False), range(0, 4096, 2)):
        low = np.sort(np.array(ids, np.int64))
        blob = merkle.pack(low)
        assert len(blob) <= 1 + min(512, 2 * len(low))
        assert np.array_equal(np.flatnonzero(np.unpackbits(merkle.words(blob).view(np.uint8), bitorder="little")), low)
        assert np.array_equal(merkle.rank(merkle.words(blob), low), np.arange(len(low)))
