"""SimHash classes against brute force, links for every number of blocks and on both routes, and star contraction."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemolake.llm import simhash
from mnemolake.llm.components import components

SCHEMA = "doc_id long, text string, row_key string, node int, print string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{name: least name reachable} over pairs of prints within 3 bits."""
    names = sorted(prints)
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def texts():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 900, 400)]
    rows = [(100 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 400, 16)]
    rows += [(1, "A b\tC"), (2, "a B c"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "Élan vital É"), (8, "élan vital é"), (9, "z " * 40_000)]
    return rows + [(600 + k, " ".join(f"v{i}" for i in rng.integers(0, 5000, 60))) for k in range(30)]


def test_classes_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    prints = {d: brute_print(t) for d, t in rows}
    label = brute_components(prints)
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in prints}
    assert len(set(label.values())) < len(label)


def planted():
    rng = np.random.default_rng(5)
    out = set()
    for seed in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist() + [0, 2**64 - 1, 2**63]:
        out.add(seed)
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            out.add(seed ^ sum(1 << int(b) for b in bits))
    return sorted(out)


@pytest.mark.parametrize(("blocks", "block", "bucket"), [(4, 4, 1 << 15), (5, 3, 4)])
def test_links_for_each_cut_and_route(spark, blocks, block, bucket):
    prints = planted()
    rows = [(i, simhash._signed(p)) for i, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(rows, "node long, print long"), blocks=blocks, block=block, bucket=bucket)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 12 for a, b in pairs)
    label = {r.row: r.label for r in components(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert {i: label.get(i, i) for i in range(len(prints))} == brute_components(dict(enumerate(prints)))


def test_masks_cover_every_pair_within_three_bits():
    for blocks in (4, 5, 6, 7):
        kept = simhash.masks(blocks)
        for bits in ([0, 1, 2], [0, 31, 63], [15, 16, 47], [10, 21, 42]):
            assert any(not any(m >> b & 1 for b in bits) for m in kept)
    assert [simhash.block_count(n) for n in (0, 65_535, 65_536, 1 << 25, 1 << 32)] == [5, 5, 5, 6, 7]


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    rows = [(7, "same words here now", "a", 1, "b"), (7, "same words here now", "a", 1, "b"), (None, "same words here now", None, None, None), (None, "other things entirely so", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0


def test_contraction_in_chunks_and_rounds(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(2000 + i, 2001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(400)]
    links = spark.createDataFrame(pairs * 2, "a long, b long")
    want = {r.row: r.label for r in components(links).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert want == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r.row: r.label for r in components(links, chunk=150).collect()} == want
    assert components(links.where(F.lit(False))).count() == 0


def test_short_texts_share_an_exact_bucket():
    from mnemolake.llm import order_minhash as om

    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(4000):
        n = int(rng.integers(1, 20))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[rng.permutation(n)[: n - int(rng.integers(0, 3))]], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64)])
        common = len(set(a.tolist()) & set(b.tolist()))
        if common and common >= 0.8 * (n + len(b) - common):
            hits += 1
            assert set(om.buckets(a).tolist()) & set(om.buckets(b).tolist())
    assert hits > 500
    assert len(om.buckets(np.arange(1, 4, dtype=np.uint64))) == 1 and len(om.buckets(np.arange(1, 101, dtype=np.uint64))) == om.SKETCHES
