"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation.

Short texts are encoded row by row where they are read.  A longer text is cut into
leaves; the leaves of all long texts are dealt over the cluster and encoded in
parallel, then joined pairwise, like a tree.  A join re-encodes a growing window of
tokens around the cut until its ends reproduce a token of either side.  That is exact:
a sequence of canonical tokens is the encoding of its text if and only if each two
neighbours are what their joint text encodes to, and every neighbouring pair of the
result was neighbouring in one of the three encodings.

Cuts fall where the pre-tokenizer splits in any case, if there is such a place; only in
text without one (a long run of one character class) do they fall inside a word.
Special strings are kept whole, each an encoding of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, text_or_empty

#: Longer texts are cut; the size of a leaf, in characters.
LEAF = 1 << 15
#: Tokens on each side of a cut that are re-encoded at first.
WINDOW = 8
#: Words remembered by a worker before it starts anew.
CACHE_WORDS = 1 << 19

#: Characters on whose classes every Unicode version and both regex engines agree: Latin and what is common beside it.
PLAIN = re.compile(r"[\t\n\v\f\r -~\u00a1-\u017f]*")
#: The letters and the digits among those characters.
LETTER, DIGIT = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The split pattern over those characters, for the faster engine.
PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
#: A place where the pattern always ends a match: the class changes after a character that can't continue into the next.
SAFE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")

_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The worker's coder for the vocabulary file; it outlives a task."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable ones for themselves, others from U+0100 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class _Words(dict):
    """Word to its ids as packed little-endian uint32; filled by the library on a miss."""

    def __init__(self, one):
        super().__init__()
        self.one = one

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.one(word)
        if len(word) <= 64:
            self[word] = out
        return out


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.letters = letters
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.find = PLAIN_PATTERN.findall
        self.piece = self._piece_coder(spec)
        self.words = _Words(self._model)

    def _model(self, word: str) -> bytes:
        return self._merge(word.encode())

    def leaf(self, text: str) -> bytes:
        """The ids of a text without special strings, as the library gives them."""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of any text, in one piece."""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str, leaf: int = LEAF) -> list[tuple[str, bool]]:
        """The text as (leaf, joined): joined tells that the cut before it lies inside a word."""
        out: list[tuple[str, bool]] = []
        leaf = max(2, leaf)
        for part in self.split_special.split(text) if any(s in text for s in self.special) else [text]:
            if not part:
                continue
            if part in self.special:
                out.append((part, False))
                continue
            at = 0
            while len(part) - at > leaf:
                ends = [m.start() for m in SAFE.finditer(part, at + (leaf + 1) // 2, at + leaf)] or [m.start() for m in SAFE.finditer(part, at + 1, at + (leaf + 1) // 2)]
                if ends:
                    out.append((part[at : ends[-1]], False))
                    at = ends[-1]
                    continue
                # Unsplit text: its words are cut at any character, up to where it ends.
                m = SAFE.search(part, at + leaf - 1)
                stop = m.start() if m else len(part)
                for word in self._split_words(part[at:stop]):
                    out += [(word[i : i + leaf], i > 0) for i in range(0, len(word), leaf)]
                at = stop
            if at < len(part):
                out.append((part[at:], False))
        return out

    def _split_words(self, text: str) -> list[str]:
        """The pre-tokenizer's own words of a stretch that begins and ends where it splits."""
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pre]

    def encode_leaf(self, text: str, inner: bool) -> bytes:
        """Ids of a leaf; an inner one is part of a word, so only the merges apply."""
        if text in self.special:
            return np.array([self.special[text]], "<u4").tobytes()
        return self._model(text) if inner else self.leaf(text)

    def joined(self, left: bytes, right: bytes) -> bytes:
        """The encoding of the joint word from those of its two parts."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        size = WINDOW
        while True:
            x, y = a[max(0, len(a) - size) :], b[:size]
            window = np.frombuffer(self._merge(b"".join(self.bytes_of[int(i)] for i in (*x, *y))), "<u4")
            if (size >= len(a) or window[0] == x[0]) and (size >= len(b) or window[-1] == y[-1]):
                return np.concatenate([a[: len(a) - len(x)], window, b[len(y) :]]).astype("<u4").tobytes()
            size *= 2

    def _piece_coder(self, spec: dict):
        """A faster coder of single words, where merging by the merge list is merging by token id."""
        letters, merges, vocab = self.letters, spec["model"]["merges"], spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and all(vocab.get(c, 256) < 256 for c in letters)
        if not in_order or len(vocab) != 256 + len(pairs) + sum(t in vocab for t in self.special):
            return None
        import tiktoken

        ranks = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _merge(self, raw: bytes) -> bytes:
        """The merges over bytes; no split, no special strings."""
        if self.piece is not None and len(raw) <= 4096:
            return np.array(self.piece(raw), "<u4").tobytes()
        letters = self.letters
        return np.fromiter((t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in raw]))), "<u4").tobytes()

    def tree(self, leaves: list[tuple[bytes, bool]]) -> bytes:
        """Joins the encoded leaves of each word in pairs, level by level; words stand side by side."""
        words: list[list[bytes]] = []
        for ids, joined in leaves:
            if joined:
                words[-1].append(ids)
            else:
                words.append([ids])
        for parts in words:
            while len(parts) > 1:
                parts[:] = [self.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return b"".join(parts[0] for parts in words)

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives: the bytes of all tokens, read as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _digests(ids: list[bytes], texts: list[str]) -> tuple[list[int], list[str], list[str]]:
    return [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    leaf: int = LEAF,
    keep_ids: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids_sha256, decoded_sha256; ids and decoded on request.

    ``ids`` are packed little-endian uint32.  A null text counts as empty; an empty text has
    no tokens.  Texts of any length are encoded whole.  Rows repeated with one id give a row
    each.  An empty table gives no rows; other columns are ignored.  ``path`` names the
    vocabulary file on every machine.
    """
    prepare(docs.sparkSession)
    extra = (", ids binary" if keep_ids else "") + (", decoded string" if keep_text else "")
    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" + extra

    def columns(ids: list[bytes], decoded: list[str]) -> dict:
        n, a, b = _digests(ids, decoded)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
        return out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}) | ({"decoded": pa.array(decoded, pa.string())} if keep_text else {})

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, "_t", 1 << 20):
            ids = [bpe.encode(t) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id")} | columns(ids, [bpe.decode(x) for x in ids]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, "_t", 1 << 20):
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                leaves = bpe.cut(text, leaf)
                for at in range(0, len(leaves), 256):
                    some = leaves[at : at + 256]
                    inner = [j or at + i + 1 < len(leaves) and leaves[at + i + 1][1] for i, (_, j) in enumerate(some)]
                    yield pa.RecordBatch.from_pydict({
                        "_key": pa.array([key] * len(some), pa.string()), "_at": pa.array(range(at, at + len(some)), pa.int64()),
                        "_leaf": pa.array([x for x, _ in some], pa.string()), "_joined": pa.array([j for _, j in some], pa.bool_()), "_inner": pa.array(inner, pa.bool_()),
                    })

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, "_leaf", 1 << 20):
            ids = [bpe.encode_leaf(t, i) for t, i in zip(batch.column("_leaf").to_pylist(), batch.column("_inner").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_key"), "_at": batch.column("_at"), "_joined": batch.column("_joined"), "_ids": pa.array(ids, pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        bpe = coder(path)
        table = table.sort_by("_at")
        ids = bpe.tree(list(zip(table.column("_ids").to_pylist(), table.column("_joined").to_pylist(), strict=True)))
        return pa.table({"_key": table.column("_key").slice(0, 1)} | columns([ids], [bpe.decode(ids)]))

    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    id_type = src.schema["_id"].dataType.simpleString()
    whole = src.where(F.length("_t") <= leaf).mapInArrow(short, f"_id {id_type}, {result}")
    long = src.where(F.length("_t") > leaf).withColumn("_key", F.sha2("_t", 256))
    # Copies of a long text are encoded once: their leaves meet before the shuffle and after it.
    parts = long.mapInArrow(cut, "_key string, _at long, _leaf string, _joined boolean, _inner boolean")
    parts = parts.groupBy("_key", "_at").agg(F.first("_leaf").alias("_leaf"), F.first("_joined").alias("_joined"), F.first("_inner").alias("_inner"))
    encoded = parts.mapInArrow(leaves, "_key string, _at long, _joined boolean, _ids binary")
    per_text = encoded.groupBy("_key").applyInArrow(join, f"_key string, {result}")
    rest = long.select("_id", "_key").join(per_text, "_key").drop("_key")
    return whole.unionByName(rest).withColumnRenamed("_id", id_col)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
