"""Token ids of many texts, equal to encoding each text whole, with every distinct piece encoded once.

White space never takes part in a token of this tokenizer, and a run of letters or of punctuation is always
split off by its pattern. A chunk between white space that holds only such runs is cut into them; any other
chunk (digits, apostrophes, special-token marks, further scripts) is encoded as it stands. A worker keeps the
pieces it has met, up to ``MEMORY`` of them; beyond, those met most often stay.

This holds for the rules in ``KNOWN``, which the tokenizer file is compared with. Texts of a file with other rules are
encoded whole.
"""

from __future__ import annotations

import json
import sys
import types
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

MEMORY = 200_000
SPACE, LETTER, MARK, OTHER = 0, 1, 2, 3
#: The parts of a tokenizer file under which texts may be cut into pieces.
KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}

_kind = np.full(256, OTHER, np.uint8)
_kind[[0x20, *range(0x09, 0x0E)]] = SPACE
_kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_kind[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<"]] = MARK
#: Second bytes after 0xC3 that make a Latin-1 letter: all but the multiplication and division signs.
_tail = np.zeros(256, bool)
_tail[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_small = np.arange(256, dtype=np.uint8)
_small[0x41:0x5B] += 0x20
_small_tail = np.arange(256, dtype=np.uint8)
_small_tail[[c for c in range(0x80, 0x9F) if c != 0x97]] += 0x20


def _visible() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def divisible(path: str) -> bool:
    """Whether texts may be cut into pieces: known rules, and marks of added tokens that all begin with ``<``."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = all(t["content"].startswith("<") and not (t["normalized"] or t["lstrip"] or t["rstrip"]) for t in rules.get("added_tokens") or [])
    return added and rules["model"]["type"] == "BPE" and all(rules.get(k) == v for k, v in KNOWN.items())


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.divisible = divisible(path)
        self.alphabet = _visible()
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.size, self.hits = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def _trim(self) -> None:
        """Keep the pieces met in several slices, half the memory at most; their counts fade."""
        n = len(self.slot)
        keep = np.flatnonzero(self.hits[:n] > 1)
        if len(keep) > MEMORY // 2:
            keep = np.sort(keep[np.argpartition(-self.hits[keep], MEMORY // 2)[: MEMORY // 2]])
        pieces, sizes = list(self.slot), self.size[keep]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.start[keep] - ends + sizes, sizes) + np.arange(sizes.sum())]
        hits = self.hits[keep] // 2
        self._forget()
        self._grow(len(flat), len(keep))
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.size[: len(keep)], self.start[: len(keep)], self.hits[: len(keep)] = sizes, ends - sizes, hits
        self.slot = {pieces[k]: i for i, k in enumerate(keep.tolist())}

    def _grow(self, ids: int, slots: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while slots > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))

    def _remember(self, pieces: list[bytes], odd: list[bool]) -> None:
        whole = [p.decode("utf-8") for p, o in zip(pieces, odd, strict=True) if o]
        encoded = iter(self.tokenizer.encode_batch(whole, add_special_tokens=False))
        split, alphabet = self.tokenizer.model.tokenize, self.alphabet
        lists = [
            next(encoded).ids if o else [t.id for t in split(p.decode() if p.isascii() else p.decode("latin-1").translate(alphabet))]
            for p, o in zip(pieces, odd, strict=True)
        ]
        first, n = len(self.slot), len(lists)
        sizes = np.fromiter(map(len, lists), np.int64, n)
        total = int(sizes.sum())
        self._grow(self.used + total, first + n)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.slot.update(zip(pieces, range(first, first + n), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text (null: none)."""
        if not self.divisible:
            whole = [e.ids for e in self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(whole), np.uint32), np.array([len(w) for w in whole], np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or bounds[-1] == bounds[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind, low = _kind[raw], _small[raw]
        pair = np.flatnonzero((raw[:-1] == 0xC3) & _tail[raw[1:]])
        kind[pair] = kind[pair + 1] = LETTER
        low[pair + 1] = _small_tail[raw[pair + 1]]
        solid = kind != SPACE
        edge = np.zeros(len(raw), bool)
        edge[bounds[:-1][bounds[:-1] < len(raw)]] = True
        before = np.concatenate([[False], solid[:-1]])
        opens = solid & (~before | edge)
        chunks = np.flatnonzero(opens)
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        odd = np.add.reduceat(kind == OTHER, chunks, dtype=np.int64) > 0
        in_odd = np.concatenate([np.zeros(chunks[0], bool), np.repeat(odd, np.diff(np.append(chunks, len(raw))))])
        opens |= solid & ~in_odd & np.concatenate([[False], kind[1:] != kind[:-1]])
        begins = np.flatnonzero(opens)
        place = np.cumsum(solid, dtype=np.int32) - 1
        cuts = np.append(place[begins], solid.sum()).astype(np.int32)
        clean = np.where(in_odd, raw, low)[solid]
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(clean)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        distinct = pieces.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].tolist()
        held = distinct.buffers()[2].to_pybytes()
        listed = [held[a:b] for a, b in pairwise(ends)]
        is_odd = np.zeros(len(listed), bool)
        is_odd[which] = in_odd[begins]
        if len(self.slot) > MEMORY:
            self._trim()
        known = list(map(self.slot.get, listed))
        if None in known:
            new = [i for i, k in enumerate(known) if k is None]
            first = len(self.slot)
            self._remember([listed[i] for i in new], is_odd[new].tolist())
            for i, k in enumerate(new, first):
                known[k] = i
        known = np.array(known, np.int64)
        self.hits[known] += 1
        slots = known[which]
        sizes = self.size[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[slots] - ends + sizes, sizes) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(begins, bounds)]
        return ids, np.diff(upto)


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``: read once, kept between tasks.

    Functions travel to executors with their code, so a module of this package is made anew for every task; what
    shall last as long as the worker process is held in a module of its own.
    """
    store = sys.modules.setdefault("mnemolake_worker_state", types.ModuleType("mnemolake_worker_state"))
    if getattr(store, "encoder_path", None) != path:
        store.encoder_path, store.encoder = path, Encoder(path)
    return store.encoder
