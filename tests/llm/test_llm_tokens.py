"""Token files, packing, token totals and the piecewise encoder, against the tokenizer itself."""

import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import packing, subwords, token_counts, token_files
from mnemolake.session import run_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, start string, length string, ids string, row string"
ODD = ["", None, " ", "a" * 50000, "Don't <|endoftext|> stop", "naïve ÉCOLE, déjà!", "x<|ENDOFTEXT|>y", "1234 ½ ≠ é ≠", "\x1c\x85​z", "word, word. word"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, "a", "b", "c", "d") for d, t, s in rows], SCHEMA)


def docs():
    rng = random.Random(1)
    rows = [(k, t, "s") for k, t in enumerate(ODD)]
    rows += [(100 + k, " ".join(rng.choice(["alpha", "Beta,", "gämma", "it's", "7"]) for _ in range(rng.choice([1, 5, 200, 900]))), "t") for k in range(60)]
    return [*rows, (None, "nameless", "s"), (None, None, None), (3, "again", "s"), (3, "again", "s")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = random.Random(2)
    letters = "aZéÀß×÷'s<|>. ,\n\t1²İΣςœ́H̱≠̸  　‍字﻿’ǅ\x0b\x0c\x1f\x85tdre"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(4000)] + ODD
    ids, sizes = subwords.encoder(PATH).encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_files_with_other_rules_are_encoded_whole(name, cut):
    path = PATH.replace("word_bpe_49k.json", name)
    texts = ["Plain words, in a sentence.", None, "", "  Two  spaces\nand 2024 lines ", "It's <|endoftext|> here", *filter(None, ODD)]
    coder = subwords.Encoder(path)
    ids, sizes = coder.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert coder.divisible == cut and sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w] and ids.dtype == np.uint32


def test_rules_are_compared(tmp_path):
    rules = json.loads(open(PATH, encoding="utf-8").read())
    for name, value in [("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 8})]:
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps({**rules, name: value}))
        assert not subwords.divisible(str(file))


def test_ranks_survive_coding():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 999):
        ranks = np.array([rng.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)], np.uint32)
        control, data = token_files.pack_ranks(ranks)
        assert len(control) == math.ceil(n / 4)
        assert token_files.unpack_ranks(control, data, n).tolist() == ranks.tolist()


def test_token_files_round_trip(spark, tokenizer):
    rows = docs()
    path = f"{run_folder(spark)}/files"
    token_files.write_token_files(table(spark, rows), path, tokenizer=PATH, end_id=2)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    want = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows]
    assert [r.doc_id for r in got] == sorted((d for d, _ in want), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    assert sorted((r.doc_id is not None, r.doc_id or 0, crc(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted((d is not None, d or 0, crc(i)) for d, i in want)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    counts = np.bincount([i for _, w in want for i in w])
    assert [counts[r.id] for r in ranks] == sorted(counts[counts > 0], reverse=True)
    path = f"{run_folder(spark)}/none"
    token_files.write_token_files(table(spark, []), path, tokenizer=PATH, end_id=2)
    assert token_files.read_documents(spark, path).count() == 0


def test_minimum_slack_fills_bins():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 20))}
        bins = packing.minimum_slack(counts, 64)
        used = {}
        for combination, times in bins:
            assert sum(combination) <= 64 and times > 0
            for n in combination:
                used[n] = used.get(n, 0) + times
        assert used == counts
    # the fullest combination, not the first that fits
    assert packing.minimum_slack({6: 1, 5: 1, 4: 1}, 10)[0][0] == [6, 4]
    assert sorted(packing._fullest({5: 3, 3: 2, 2: 1}, [5, 3, 2], 11)) == [3, 3, 5]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, tokenizer, capacity):
    rows = docs()
    got = packing.pack(table(spark, rows), tokenizer=PATH, end_id=1, capacity=capacity).collect()
    pieces = []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert 0 < len(ids) <= capacity
        at = 0
        for p in r.pieces:
            assert p.offset == at
            pieces.append((p.doc_id is not None, p.doc_id or 0, p.piece, p.start, crc(ids[at : at + p.length])))
            at += p.length
        assert at == len(ids)
    want, total = [], 0
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want += [(d is not None, d or 0, k // capacity, k, crc(ids[k : k + capacity])) for k in range(0, len(ids), capacity)]
    assert sorted(pieces) == sorted(want)
    assert len(got) <= math.ceil(total / capacity) + 1
    assert packing.pack(table(spark, []), tokenizer=PATH, end_id=1).count() == 0


def changes(spark, rows):
    return spark.createDataFrame(rows, "seq long, op string, doc_id long, source string, lang string, version string, tokens long")


def test_rollup_follows_a_plain_replay(spark):
    rng = random.Random(6)
    totals = token_counts.Rollup(spark, f"{run_folder(spark)}/rollup")
    state = {}
    for batch in range(4):
        rows = []
        for seq in range(40):
            d, v = rng.choice([None, *range(12)]), rng.choice(["a", "b", None])
            rows.append((seq, rng.choice(["insert", "revise", "delete"]), d, rng.choice(["x", "y", None]), rng.choice(["en", None]), v, rng.choice([None, 0, 5, 10**12])))
        last = {(r[2], r[5]): r for r in rows}
        for key, r in last.items():
            state.pop(key, None)
            if r[1] != "delete":
                state[key] = (r[3], r[4], r[5], r[6] or 0)
        assert totals.commit(f"b{batch}", changes(spark, rows))
        assert not totals.commit(f"b{batch}", changes(spark, list(reversed(rows))))
        want = {}
        for s, lang, v, n in state.values():
            a, b = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (a + 1, b + n)
        assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in totals.totals().collect()} == want
    with pytest.raises(ValueError, match="other content"):
        totals.commit("b0", changes(spark, [(0, "insert", 1, "x", "en", "a", 1)]))
    # a batch without manifest does not count, and is written anew
    spark.createDataFrame([(1, "x", "en", "a", 5, 5)], token_counts.ENTRY).write.parquet(f"{totals.root}/entries/half")
    before = totals.totals().collect()
    assert totals.commit("half", changes(spark, []))
    assert sorted(map(str, totals.totals().collect())) == sorted(map(str, before))


def test_counts_are_the_tokenizer_s(spark, tokenizer):
    rows = docs()
    got = token_counts.counted(table(spark, rows), PATH, "v").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.tokens) for r in got) == sorted((d is not None, d or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert token_counts.counted(table(spark, []), PATH, "v").count() == 0


def test_query_counts_rows_without_id_and_repeated_ids(spark, tmp_path):
    """Against a replay in plain Python: toxic rows go, poor ones lose repeated lines, every row counts."""
    from tokenizers import Tokenizer

    from mnemolake.llm import queries

    rows = [(1, "a b\na b\nc", "x", "en"), (1, "other words here", "x", "en"), (None, "no name", "y", None), (None, "no name", "y", None), (2, "bad thing", "y", "en"), (3, None, None, "en"), (4, "keep\nkeep", "x", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    enc, want = Tokenizer.from_file(PATH), {}
    for doc_id, text, source, lang in rows:
        if doc_id == 2:
            continue
        text = "\n".join(dict.fromkeys((text or "").split("\n"))) if doc_id == 1 else text or ""
        n, tokens = want.get((source, lang), (0, 0))
        want[source, lang] = n + 1, tokens + len(enc.encode(text, add_special_tokens=False).ids)
    got = queries.QUERIES["op8_token_counts"](spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in got} == want
