"""BPE encoding by a deterministic token automaton, and decoding by the labels of its arcs.

The automaton reads token ids and accepts exactly the sequences that BPE gives.  At first it has one state with an arc
for every byte.  The merges are compiled in order of rank, each by the same gadget: for the merge of ``a`` and ``b``

* every state with an arc ``a`` gets an arc ``ab``, which leads where ``b`` leads from behind ``a``;
* the state behind ``a`` is split off for the arcs ``a``, and loses its arc ``b``: what was ``a b`` is ``ab`` from now on.

Where an arc leads depends on its label only, so a state is known by the label that leads there, and labels share a
state until a gadget splits it.  A state is a table of the arcs it lost and when (``lost``).  An arc ``ab`` is there if
its ``a`` was when the gadget ran, so whether a state has an arc is read off the table for the chain of its left parts
(``chain``).  For the 50,000 merges that is 14,639 states with 365,863 lost arcs.

Every string of bytes has exactly one path, and so has each of its prefixes.  A word is encoded from left to right: at each
place the label that leads there is known, a table of byte steps lists the labels that start there, and those whose arc is
live name the label behind them.  Texts are cut into words by the vocabulary's pattern; words seen before are looked up in a
table of bounded size.

Defined cases: a null text is as an empty one and has no ids; words of any length are encoded whole, in a time that grows with
their length times the longest label; the special texts of the vocabulary file are one id each, as ``tokenizers`` has it;
null ids decode to an empty text, and bytes that are no UTF-8 to U+FFFD; repeated rows give repeated rows; an empty table gives
an empty table; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Later than any merge: the end of a chain is never merged, and an arc that isn't lost stays.
NEVER, KEPT = 1 << 30, 1 << 31
#: Words that a worker keeps, the longest such word, and ids that are decoded at once.
KEPT_WORDS, KEPT_CHARS, STEP_IDS = 1 << 20, 64, 1 << 20
#: Fixed: the pattern that cuts texts into words before byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII alone.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Before this character Unicode versions agree about letters and numbers.
FIRST_UNSURE = "\u0500"


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def disputed() -> str:
    """Characters that Unicode versions call letters or numbers in one case and neither in the other, as a class of a pattern."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    held = [{ord(c) for c in regex.findall(p, every)} for p in (r"\p{L}", r"\p{N}")]
    plain = [{ord(c) for c in every if unicodedata.category(c)[0] == k} for k in "LN"]
    at = sorted((held[0] ^ plain[0]) | (held[1] ^ plain[1]))
    if at and chr(at[0]) < FIRST_UNSURE:
        raise ValueError(f"Unicode versions differ about U+{at[0]:04X}")
    if not at:
        return r"(?!)"
    cuts = [0, *(k + 1 for k, (a, b) in enumerate(pairwise(at)) if b != a + 1), len(at)]
    return "[" + "".join(f"{chr(at[a])}-{chr(at[b - 1])}" for a, b in pairwise(cuts)) + "]"


class Automaton:
    """The compiled merges of a byte-level vocabulary file."""

    def __init__(self, json_path: str):
        with open(json_path, encoding="utf-8") as f:
            kept = json.load(f)
        model = kept["model"]
        if model["type"] != "BPE" or kept["normalizer"] or model.get("dropout") or model.get("ignore_merges") or (kept["pre_tokenizer"] or {}).get("type") != "ByteLevel" or kept["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{json_path} isn't a plain byte-level BPE vocabulary")
        self.json_path, self._splitter = json_path, None
        byte = {c: b for b, c in enumerate(byte_characters())}
        ids = model["vocab"]
        self.labels: list[bytes] = [b""] * (1 + max([*ids.values(), *(t["id"] for t in kept["added_tokens"])]))
        for text, k in ids.items():
            self.labels[k] = bytes(byte[c] for c in text)
        self.special = {}
        for t in kept["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"special text {t['content']} that takes its surroundings")
            self.special[t["content"]] = t["id"]
            self.labels[t["id"]] = t["content"].encode()
        self._compile([tuple(ids[x] for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]], [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]])
        self.cut = regex.compile(WORDS).findall
        self.mixed = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.unsure = regex.compile(disputed())
        self.cut_ascii, self.beyond = re.compile(ASCII_WORDS).findall, re.compile(f"[{FIRST_UNSURE}-{chr(sys.maxunicode)}]").search
        self.known: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.labels), np.uint8)
        self.ends = np.cumsum([len(x) for x in self.labels])

    def _compile(self, merges: list[tuple[int, int]], made: list[int]) -> None:
        single = [k for k, x in enumerate(self.labels) if len(x) == 1]
        if len({self.labels[k] for k in single}) != 256:
            raise ValueError("a byte has no label")
        self.lost: list[dict[int, int]] = [{}]  # by state; the first is where words start and where bytes led at first
        self.state = [0] * len(self.labels)
        self.chain: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.labels)
        for k in single:
            self.chain[k] = ((k, NEVER),)
        seen = set(single)
        for rank, ((a, b), ab) in enumerate(zip(merges, made, strict=True)):
            if ab in seen:
                raise ValueError("two merges make one label")
            seen.add(ab)
            if self.chain[a] is None or not self.live(self.state[a], b):
                continue  # b never stands behind a by now: no arc gets this label
            self.state[ab] = self.state[b]
            self.chain[ab] = (*self.chain[a][:-1], (a, rank), (ab, NEVER))
            self.lost.append(self.lost[self.state[a]] | {b: rank})
            self.state[a] = len(self.lost) - 1
        held = sorted({0, *self.state})
        place = {s: k for k, s in enumerate(held)}
        self.lost, self.state = [self.lost[s] for s in held], [place[s] for s in self.state]
        # steps by bytes: node and byte to node, and the label that ends at a node
        self.steps: dict[int, int] = {}
        self.ending: list[int] = [-1]
        for k in sorted(seen):
            if self.chain[k] is not None:
                node = 0
                for byte in self.labels[k]:
                    node = self.steps.setdefault(node << 8 | byte, len(self.ending))
                    if node == len(self.ending):
                        self.ending.append(-1)
                self.ending[node] = k

    def live(self, state: int, label: int) -> bool:
        """Whether the state has an arc of the label."""
        lost, chain = self.lost[state], self.chain[label]
        return chain is not None and all(lost.get(part, KEPT) > until for part, until in chain)

    def word(self, raw: bytes) -> list[int]:
        """The labels of the path of a word that isn't cut any further.

        At each place the longest live arc is tried first.  A place that was reached before isn't tried again: only one
        path leads there.
        """
        n, steps, ending, lost, chain, state = len(raw), self.steps, self.ending, self.lost, self.chain, self.state
        into, at, found = [-1] * (n + 1), 0, []
        while at < n:
            gone, node = lost[state[into[at]] if at else 0], 0
            for j in range(at, n):
                node = steps.get(node << 8 | raw[j])
                if node is None:
                    break
                label = ending[node]
                if label >= 0:
                    found.append((j + 1, label, gone))
            while True:
                at, label, gone = found.pop()
                if into[at] < 0:
                    for part, until in chain[label]:
                        if gone.get(part, KEPT) <= until:
                            break
                    else:
                        into[at] = label
                        break
        out = []
        while at:
            out.append(into[at])
            at -= len(self.labels[into[at]])
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """A text without special ones as words.  What Unicode versions don't agree about is cut by the library that is the measure."""
        if text.isascii():
            return self.cut_ascii(text)
        if not self.beyond(text) or not self.unsure.search(text):
            return self.cut(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.json_path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32 bits each."""
        out = []
        for part in self.mixed.split(text) if self.mixed else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            words = self.words(part)
            try:
                out.extend(map(self.known.__getitem__, words))
            except KeyError:
                del out[:]
                return self._encode_new(text)
        return b"".join(out)

    def _encode_new(self, text: str) -> bytes:
        """As ``encode``, for texts with words not seen before."""
        out, known = [], self.known
        for part in self.mixed.split(text) if self.mixed else [text]:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            for w in self.words(part):
                ids = known.get(w)
                if ids is None:
                    ids = array("i", self.word(w.encode())).tobytes()
                    if len(w) <= KEPT_CHARS:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        known[w] = ids
                out.append(ids)
        return b"".join(out)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of ids in one row of bytes, and where each ends."""
        sizes = np.diff(self.ends, prepend=0)[ids]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k in range(0, len(ids), STEP_IDS):
            size, part = sizes[k : k + STEP_IDS], ids[k : k + STEP_IDS]
            begin = int(ends[k] - sizes[k])
            n = int(size.sum())
            out[begin : begin + n] = self.blob[np.arange(n) + np.repeat(self.ends[part] - np.cumsum(size), size)]
        return out, ends


_compiled: dict[str, Automaton] = {}


def automaton(json_path: str | None = None) -> Automaton:
    """One per worker process."""
    path = json_path or tokens.default_path()
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", json_path: str | None = None) -> DataFrame:
    """docs with the ids of their texts (array<int>) in ``ids_col``; ``json_path`` is a file that all executors have."""
    if ids_col in docs.columns:
        raise ValueError(f"there is a column {ids_col} already")
    common.arrow_bytes(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(json_path)
        for b in common.batches(rows):
            parts = [own.encode(t.as_py() or "") for t in b.column(place)]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, ids_col])

    return docs.mapInArrow(run, docs.withColumn(ids_col, F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", json_path: str | None = None) -> DataFrame:
    """rows with the texts of their ids in ``text_col``, special ids as their texts, in place of ``ids_col``."""
    if text_col in rows.columns:
        raise ValueError(f"there is a column {text_col} already")
    common.arrow_bytes(rows.sparkSession)
    place = rows.columns.index(ids_col)

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(json_path)
        for b in common.batches(got):
            ids = b.column(place)
            size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            raw, ends = own.bytes_of(ids.flatten().to_numpy(zero_copy_only=False))
            at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])]
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
            try:
                text = binary.cast(pa.large_string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in binary.to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != place), text.cast(pa.string())], [*(c for k, c in enumerate(b.schema.names) if k != place), text_col])

    return rows.mapInArrow(run, rows.drop(ids_col).withColumn(text_col, F.lit(None).cast("string")).schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, and sha256 of its ids (decimal, joined by commas) and of what they decode to."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = encode(docs, json_path=json_path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return decode(ids, json_path=json_path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
