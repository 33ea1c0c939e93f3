"""Exact, near and line duplicates on small tables with every odd case, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from mnemolake.llm import exact, line_dedup, order_minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, class_id string, row_key string, cut int, size string"


def table(spark, rows):
    """Documents with clashing further columns; rows are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z", 1, "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, share=None):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(w, places, tag):
    w = list(w)
    for p in places:
        w[p] = f"{tag}{p}"
    return w


@pytest.mark.parametrize("digest", [True, False])
def test_exact_duplicates(spark, digest):
    rows = [(1, "a b\tc"), (2, "abc"), (3, "a  b  c "), (4, None), (5, ""), (6, " \n"), (7, "abcd"), (None, "a b c d"), (8, "x" * 200000), (8, "x" * 200000), (9, "é\x85"), (10, "é \x85"), (11, "a" * 64 + "b"), (12, "a" * 64 + "c"), (13, "only once")]
    got = exact.duplicates(table(spark, rows), digest=digest).collect()
    assert len(got) == len(rows)
    flat = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (d, t), f in zip(rows, flat):
        groups.setdefault(f, []).append((-len(t or ""), d is None, d or 0, d))
    want = sorted((d if d is not None else -9, min(groups[f])[3] if min(groups[f])[3] is not None else -9, len(groups[f])) for (d, _), f in zip(rows, flat))
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.keep_id if r.keep_id is not None else -9, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    if digest:
        shas = sorted(hashlib.sha256(f.encode()).hexdigest() for f in flat)
        assert sorted(r.text_sha256 for r in got) == shas
    else:
        assert sum(r.text_sha256 is None for r in got) > 0
    assert exact.duplicates(table(spark, [])).count() == 0


def near_cases():
    base = words(400, 1)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited(base, [10, 200], "q"))), (4, " ".join(edited(base, [50, 51, 52, 300], "r")))]
    rows += [(5, " ".join(words(300, 2))), (6, " ".join(base[200:] + base[:200])), (7, None), (8, ""), (9, "one two"), (10, "One, two!"), (11, "one three"), (None, " ".join(base))]
    # a chain: each text is near its neighbours only
    chain = words(400, 5)
    for k in range(6):
        chain = edited(chain, [k * 60 + x for x in range(0, 40, 8)], f"c{k}")
        rows.append((20 + k, " ".join(chain)))
    same = ["a b c d e"] * 60
    rows += [(30, " ".join(same)), (31, " ".join(same[:-1]))]
    long = words(30000, 6)
    rows += [(40, " ".join(long)), (41, " ".join(edited(long, range(0, 30000, 500), "l")))]
    # one large group around a text that few of them resemble each other through
    hub = words(200, 7)
    rows += [(100 + k, " ".join(edited(hub, [k, 199 - k], "h"))) for k in range(60)]
    rows += [(1000, " ".join(hub)), (1001, " ".join(hub))]
    return rows


def brute_classes(rows):
    ws = [np.array([order_minhash.xxhash.xxh32_intdigest(w) for w in re.findall(r"\w+", (t or "").lower())], np.uint32) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(ws[i]) and len(ws[j]) and order_minhash.similarity(ws[i].tobytes(), ws[j].tobytes()) >= 0.8:
            parent[find(i)] = find(j)
    return {i: find(i) for i in range(len(rows))}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_cases()
    want = brute_classes(rows)
    got = order_minhash.classes(table(spark, rows)).orderBy("row").collect()
    assert len(got) == len(rows)
    where = {r.row: r for r in got}
    # rows are numbered in table order when an id is missing; texts name them here
    sizes = sorted(list(want.values()).count(c) for c in want.values())
    assert sorted(r.class_size for r in got) == sizes
    ids = {r.doc_id: r.class_id for r in where.values() if r.doc_id is not None}
    for (i, (d, _)), (j, (e, _)) in itertools.combinations(enumerate(rows), 2):
        if d is not None and e is not None:
            assert (ids[d] == ids[e]) == (want[i] == want[j]), (d, e)
    assert ids[4] == ids[1] == 1 and ids[6] == 6 and ids[7] == 7 and ids[8] == 8 and ids[10] == 9 and ids[1001] == 100
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_alignment_is_the_longest_in_order():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.randrange(12)
        x, y = (order_minhash.labelled(np.array(v, np.uint32)) for v in (a, b))
        assert len(set(x.tolist())) == len(x)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        true = best[-1][-1] / (len(x) + len(y) - best[-1][-1])
        got = order_minhash.aligned(x, y)
        got = got / (len(x) + len(y) - got)
        assert (got >= 0.8) == (true >= 0.8) and (true < 0.8 or got == true)


def test_near_duplicates_keep_columns_and_empty_tables(spark):
    kept = order_minhash.deduplicated(table(spark, near_cases()))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.where("class_id = 'y'").count() == kept.count() == len(set(brute_classes(near_cases()).values()))
    assert order_minhash.classes(table(spark, [])).count() == 0


def line_cases():
    passage = " ".join(words(60, 11))
    two = [" ".join(words(25, 12)), " ".join(words(30, 13))]
    short = "Licensed under the usual terms."
    rows = [(k, "\n".join([" ".join(words(30, 100 + k)), passage if k < 14 else "", short, " ".join(words(12, 300 + k))])) for k in range(20)]
    rows += [(30, "\n".join(two)), (31, "\n".join([" ".join(words(9, 50)), "", two[0].upper(), "", two[1] + "  ", short]))]
    rows += [(32, None), (33, ""), (34, "\n\n"), (None, passage), (35, passage), (35, passage), (36, "\n".join([two[1], two[0]]))]
    return rows


def brute_lines(rows, min_words):
    """Delete each line inside a run of equal lines, long enough, that the later text shares with an earlier one."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    parsed = [line_dedup.lines_of(t or "") for _, t in rows]
    cut = {i: set() for i in range(len(rows))}
    for p, later in enumerate(order):
        for earlier in order[:p]:
            a, b = parsed[earlier], parsed[later]
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k][1] == b[j + k][1]:
                        k += 1
                    if sum(x[2] for x in b[j : j + k]) >= min_words:
                        cut[later].update(x[0] for x in b[j : j + k])
    return cut


@pytest.mark.parametrize("rare", [2, 8])
def test_line_dedup_equals_brute_force(spark, rare):
    rows = line_cases()
    want = brute_lines(rows, line_dedup.MIN_WORDS)
    got = line_dedup.line_deduplicated(table(spark, rows), rare=rare).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.removed_lines) for r in got) == sorted((rows[i][0] if rows[i][0] is not None else -1, len(c)) for i, c in want.items())
    text = {r.doc_id: r.text for r in got}
    assert text[0] == rows[0][1] and text[32] == "" and text[34] == "\n\n" and text[35] == ""
    assert text[31].split("\n")[-1] == "Licensed under the usual terms." and "w" in text[31].split("\n")[0]
    assert text[15] == rows[15][1]
    left = line_dedup.emptied(table(spark, rows), rare=rare)
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert left.where("doc_id = 35").count() == 0 and left.where("doc_id in (32, 33)").count() == 2
    assert line_dedup.line_deduplicated(table(spark, [])).count() == 0


def test_patience_is_rising_and_equal():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    assert line_dedup.patience([1, 2, 3, 9], [7, 1, 2, 3, 9]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def repeated_cases():
    """Passages that stand twice in one of two texts, once with many holders that come after such a first one."""
    a, b, c, d = (" ".join(words(45, 500 + k)) for k in range(4))
    own = [" ".join(words(12, 600 + k)) for k in range(40)]
    rows = [(1, "\n".join([a, own[0], a])), (2, "\n".join([own[1], a, own[2]])), (3, "\n".join([own[3], b, own[4]])), (4, "\n".join([b, own[5], b]))]
    rows += [(5, "\n".join([c, own[6], c, own[7]]))] + [(10 + k, "\n".join([own[8 + k], c, own[20 + k]])) for k in range(12)]
    rows += [(30, "\n".join([d, d, own[33]])), (31, "\n".join([own[34], d, d, d]))]
    return rows, {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, **{10 + k: 1 for k in range(12)}, 30: 0, 31: 3}


def test_passages_that_stand_twice_are_deleted(spark):
    rows, removed = repeated_cases()
    assert {rows[i][0]: len(c) for i, c in brute_lines(rows, line_dedup.MIN_WORDS).items()} == removed
    got = line_dedup.line_deduplicated(table(spark, rows)).collect()
    assert {r.doc_id: r.removed_lines for r in got} == removed
    assert {r.doc_id: r.text for r in got}[4] == rows[3][1].split("\n")[1]


def test_passages_in_another_order_are_deleted(spark):
    a, b, c = (" ".join(words(45, 700 + k)) for k in range(3))
    own = [" ".join(words(12, 720 + k)) for k in range(40)]
    rows = [(1, "\n".join([a, own[0], b])), (2, "\n".join([b, own[1], a])), (3, "\n".join([own[2], c, a, b]))]
    # frequent ones, drawn in varying order
    rows += [(10 + k, "\n".join([own[3 + k], *random.Random(k).sample([a, b, c], 3)])) for k in range(12)]
    removed = {1: 0, 2: 2, 3: 2, **{10 + k: 3 for k in range(12)}}
    assert {rows[i][0]: len(x) for i, x in brute_lines(rows, line_dedup.MIN_WORDS).items()} == removed
    got = line_dedup.line_deduplicated(table(spark, rows)).collect()
    assert {r.doc_id: r.removed_lines for r in got} == removed
    assert {r.doc_id: r.text for r in got}[2] == own[1]


def test_passages_inside_longer_lines_are_deleted(spark):
    p, q, own = words(60, 800), words(100, 801), [words(12, 810 + k) for k in range(30)]
    j = lambda *parts: " ".join(w for x in parts for w in x)
    rows = [(1, j(own[0], p, own[1])), (2, j(own[2], p) + "\n\n" + j(own[3])), (3, j(own[4]) + "\n" + j(p[:30]) + "\n\n" + j(p[30:], own[5]))]
    rows += [(4, j(q)), (5, "  " + j(own[6], q[:50], ["changed"], q[51:]) + "  "), (6, j(own[7], p[:39], own[8])), (7, j(own[9], p[5:45], own[10], p[:40]))]
    # many holders, each beside other words
    rows += [(20 + k, j(own[11 + k], p, own[12 + k][:6])) for k in range(12)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.line_deduplicated(table(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[4] == (rows[3][1], 0) and got[6] == (rows[5][1], 0)
    assert got[2] == (j(own[2]) + "\n\n" + j(own[3]), 1) and got[3] == (j(own[4]) + "\n\n" + j(own[5]), 2)
    assert got[5] == ("  " + j(own[6]) + " changed", 1) and got[7] == (j(own[9], own[10]), 1)
    assert all(got[20 + k] == (j(own[11 + k], own[12 + k][:6]), 1) for k in range(12))


def test_windows_equal_brute_force():
    """Random texts of few words: deleted words are those of every shared run that is long enough."""
    rng = random.Random(5)
    for _ in range(60):
        size = rng.randrange(1, 9)
        a, b = ([str(rng.randrange(3)) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        x, y = (line_dedup.word_hashes(" ".join(t)) for t in (a, b))
        runs = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
        hit = [tuple(b[i : i + size]) in runs for i in range(len(b) - size + 1)]
        assert np.isin(line_dedup.windows(y, size), line_dedup.windows(x, size)).tolist() == hit
        # equal windows have equal anchors, one for each window
        kept = np.isin(line_dedup.anchors(y, size), line_dedup.anchors(x, size)).tolist()
        assert len(kept) == len(hit) and all(k for k, h in zip(kept, hit) if h)
        left, _ = line_dedup.without(" ".join(b), np.unique(line_dedup.windows(x, size)).view(np.int64), size)
        gone = {i + k for i, h in enumerate(hit) if h for k in range(size)}
        assert left.split() == [w for i, w in enumerate(b) if i not in gone]


def test_alignment_finds_every_shared_window():
    """Random texts of few words, repeated and reordered passages: blocks are exactly the words of shared windows."""
    rng = random.Random(6)
    for _ in range(300):
        size, letters = rng.randrange(1, 9), rng.choice([2, 3, 50])
        a, b = ([str(rng.randrange(letters)) for _ in range(rng.randrange(0, 60))] for _ in range(2))
        cuts = [a[k : k + 12] for k in rng.choices(range(50), k=3)]
        b = rng.choice([b, [w for c in rng.sample(cuts, 3) for w in c + b[:3]], cuts[0] * 3 + b])
        runs = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
        want = {i + k for i in range(len(b) - size + 1) if tuple(b[i : i + size]) in runs for k in range(size)}
        x, y = line_dedup.parsed([" ".join(a), " ".join(b)], size)
        assert {k for lo, hi in line_dedup.common_blocks(x, y) for k in range(lo, hi)} == want
        left, _ = line_dedup.without_blocks(" ".join(b), np.array(line_dedup.common_blocks(x, y), np.int64).reshape(-1, 2))
        assert left.split() == [w for i, w in enumerate(b) if i not in want]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = "Ab c\x1dd  É\n\tab C d é  " * 50 + "x" * 300
    one = line_dedup.word_hashes(text)
    assert len(one) == len(text.split()) and (one[:4] == one[4:8]).all() and len(set(one.tolist())) == 5
    monkeypatch.setattr(line_dedup, "SLICE_BYTES", 37)
    assert (line_dedup.word_hashes(text) == one).all()
    assert [w.tolist() for w in line_dedup._words([text, "", "ab", text])] == [[*one, one[0], *one], [0] * len(one) + [2] + [3] * len(one)]


def brute_words(rows, size):
    """Kept words of each text: those in no window of an earlier one."""
    held, out = set(), []
    for t in rows:
        low = (t or "").lower().split()
        runs = [tuple(low[i : i + size]) for i in range(len(low) - size + 1)]
        gone = {i + k for i, r in enumerate(runs) if r in held for k in range(size)}
        out.append([w for i, w in enumerate(low) if i not in gone])
        held.update(runs)
    return out


def test_hot_passages_and_very_long_texts(spark, monkeypatch):
    """One long text holds passages of many short ones, so that its partners come in several groups."""
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", 2000)
    rng = random.Random(8)
    p = [words(rng.randrange(41, 90), 900 + k) for k in range(30)]
    rows = [" ".join(words(10, 2000 + k) + p[k % 30][: rng.randrange(30, 90)] + words(5, 3000 + k) + p[rng.randrange(3)]) for k in range(80)]
    rows.insert(40, " ".join(w for k in range(2000) for w in p[rng.randrange(30)][: rng.randrange(20, 90)]))
    got = line_dedup.line_deduplicated(table(spark, list(enumerate(rows)))).collect()
    assert [r.text.split() for r in sorted(got, key=lambda r: r.doc_id)] == brute_words(rows, line_dedup.MIN_WORDS)


def test_line_dedup_query_equals_brute_force(spark):
    from mnemolake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.text.lower().split() for r in QUERIES["op6_line_dedup"](spark, folder).collect()}
    ids = sorted(docs)
    assert got == dict(zip(ids, brute_words([docs[i] for i in ids], line_dedup.MIN_WORDS), strict=True))
