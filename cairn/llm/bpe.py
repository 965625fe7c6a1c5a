"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken's symbols stand in an array; leaf i of the tree holds (rank of the pair at i, i), and
each inner node the smaller of its children, so the root is the leftmost pair of lowest rank.
A merge changes at most three leaves, each a logarithmic point update; encoding ends when no
pair in the tree can merge. Many pretokens are encoded at once as rows of one array of trees;
a few long ones each get a tree of their own.

The vocabulary file is a parameter and read where a task runs, so executors need it at that
path. Pretokens that a worker has met are kept in a cache of two bounded generations;
each is decoded when it is encoded, and a text's decoded bytes are put together from that.

Cases: a null text counts as empty and has no tokens; special tokens of the file are recognised
in the text as the tokenizers library does; white-space runs and pretokens of any length are
encoded whole; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches

#: The public pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPLIT = regex.compile(PATTERN)
#: The same for texts of ASCII and Latin letters, where the standard library's classes agree.
LATIN = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ]")
FAR = np.int64(1) << 62
SHIFT = 32
SLOT_BITS = 19


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def check_supported(spec: dict) -> None:
    """ValueError for a file whose text would be split, normalised or merged in another way than here."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"only plain byte-level BPE is supported, not {model.get('type')} with {odd}")
    if spec.get("normalizer") is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only texts without normaliser and with the byte-level pre-tokenizer's own pattern are supported")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that take their surroundings are not supported")


class Encoder:
    """The merges and tokens of one vocabulary file."""

    def __init__(self, path: str, cache_words: int = 40_000, cache_bytes: int = 4 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode("utf-8") for s, i in self.special.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.pairs, self.merged = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)  # in order of rank
        self.merged_array = np.array(self.merged, np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Pairs of bytes are looked up directly, others in a hash table with an overflow.
        self.byte_pairs = np.full(1 << 16, FAR)
        for (x, y), rank in self.pairs.items():
            if len(self.bytes_of[x]) == len(self.bytes_of[y]) == 1:
                self.byte_pairs[self.bytes_of[x][0] << 8 | self.bytes_of[y][0]] = rank << SHIFT
        slots = self.slot(keys)
        _, first = np.unique(slots, return_index=True)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, FAR)
        self.slot_key[slots[first]], self.slot_rank[slots[first]] = keys[first], first << SHIFT
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_rank = np.append(keys[rest], np.int64(1) << 62), np.append(rest << SHIFT, FAR)
        #: Pretoken to its ids in decimal: the current and the previous generation.
        self.cache: dict[str, bytes] = {}
        self.previous: dict[str, bytes] = {}
        #: What a pretoken's ids decode to, if that is not the pretoken.
        self.odd: dict[str, bytes] = {}
        self.cache_words, self.cache_bytes, self.held = cache_words, cache_bytes, 0

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    # One tree for one long pretoken.
    def encode_one(self, word: bytes) -> list[int]:
        n = len(word)
        tokens = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        if n < 2:
            return tokens
        size = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        far, pairs = int(FAR), self.pairs

        def leaf(i: int) -> int:
            rank = pairs.get((tokens[i], tokens[after[i]])) if after[i] < n else None
            return far if rank is None else rank << SHIFT | i

        tree = [far] * (2 * size)
        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < far:
            i, rank = tree[1] & (1 << SHIFT) - 1, tree[1] >> SHIFT
            j = after[i]
            tokens[i], after[i] = self.merged[rank], after[j]
            if after[j] < n:
                before[after[j]] = i
            tokens[j] = -1
            update(j, far)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        return [t for t in tokens if t >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (a, b) at the positions ``at``; b is negative at a word's end."""
        key = np.where(b >= 0, a << 20 | b, -2)
        slot = self.slot(key)
        held = self.slot_key[slot]
        value = np.where(held == key, self.slot_rank[slot], FAR)
        other = np.flatnonzero((held != key) & (held >= 0) & (b >= 0))
        if len(other):
            place = np.searchsorted(self.rest_key, key[other])
            value[other] = np.where(self.rest_key[place] == key[other], self.rest_rank[place], FAR)
        return np.where(value < FAR, value | at, FAR)

    # Trees as rows of an array for many pretokens of up to ``size`` bytes.
    def encode_rows(self, words: list[bytes], size: int) -> list[list[int]]:
        count, wide = len(words), size + 1
        lengths = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(count, wide)
        columns = np.arange(wide)
        tokens = np.where(columns < lengths[:, None], self.byte_id[raw], -1)
        after = np.tile(columns + 1, (count, 1)).ravel()
        before = np.tile(columns - 1, (count, 1)).ravel()
        tree = np.full((count, 2 * size), FAR)
        pairs = self.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        tree[:, size:] = np.where((pairs < FAR) & (columns[1:] < lengths[:, None]), pairs | columns[:-1], FAR)
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        tokens, tree = tokens.ravel(), tree.ravel()

        def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            base, k = rows * (2 * size), size + leaf
            tree[base + k] = value
            while k[0] > 1:
                k = k >> 1
                tree[base + k] = np.minimum(tree[base + 2 * k], tree[base + 2 * k + 1])

        rows = np.arange(count)
        while len(rows := rows[tree[rows * (2 * size) + 1] < FAR]):
            root = tree[rows * (2 * size) + 1]
            i, base = root & (1 << SHIFT) - 1, rows * wide
            j = after[base + i]
            k = np.minimum(after[base + j], size)
            tokens[base + i] = self.merged_array[root >> SHIFT]
            tokens[base + j] = -1
            after[base + i], before[base + k] = k, i
            update(rows, j, FAR)
            update(rows, i, self.rank_of(tokens[base + i], tokens[base + k], i))
            p = before[base + i]
            has = p >= 0
            if has.any():
                r, b, p = rows[has], base[has], p[has]
                update(r, p, self.rank_of(tokens[b + p], tokens[b + i[has]], p))
        left = tokens.reshape(count, wide) >= 0
        flat, ends = tokens.reshape(count, wide)[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each pretoken."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) < 2:
                out[i] = self.byte_id[np.frombuffer(w, np.uint8)].tolist()
            else:
                classes.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, (1 << 20) // size)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                if len(part) < 32 or size > 4096:
                    ids = [self.encode_one(words[i]) for i in part]
                else:
                    ids = self.encode_rows([words[i] for i in part], size)
                for i, x in zip(part, ids, strict=True):
                    out[i] = x
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def pretokens(self, text: str | None) -> list[str]:
        """The text in pretokens; special tokens stand alone."""
        if not text:
            return []
        split = SPLIT.findall if NOT_LATIN.search(text) else LATIN.findall
        if self.split_special is None or not any(s in text for s in self.special):
            return split(text)
        return [w for part in self.split_special.split(text) for w in ([part] if part in self.special else split(part))]

    def learn(self, words: set[str]) -> None:
        """Put into the cache what it lacks of ``words``."""
        if len(self.cache) > self.cache_words or self.held > self.cache_bytes:
            self.previous, self.cache, self.held = self.cache, {}, 0
            self.odd = {w: x for w, x in self.odd.items() if w in self.previous}
        lacking = [w for w in words if w not in self.cache]
        new = []
        for w in lacking:
            if (known := self.previous.get(w)) is not None:
                self.cache[w] = known
            elif w in self.special:
                self.cache[w] = str(self.special[w]).encode()
            else:
                new.append(w)
        raws = [w.encode("utf-8") for w in new]
        self.held += sum(map(len, lacking))
        for w, raw, ids in zip(new, raws, self.encode_words(raws), strict=True):
            self.cache[w] = ",".join(map(self.decimal.__getitem__, ids)).encode()
            if (decoded := self.decode(ids)) != raw:
                self.odd[w] = decoded

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids in decimal, joined by commas, and its decoded bytes."""
        split = [self.pretokens(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        for words in split:
            ids = b",".join(map(self.cache.__getitem__, words))
            raw = b"".join([self.odd.get(w) or w.encode("utf-8") for w in words]) if self.odd else "".join(words).encode("utf-8")
            out.append((ids, raw))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, once for each Python worker."""
    return Encoder(path)


def encode_udf(path: str):
    """A column function: text to its ids."""

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        found = encoder(path).encode_batch(text.to_pylist())
        return pa.array([[int(i) for i in ids.split(b",")] if ids else [] for ids, _ in found], pa.list_(pa.int32()))

    return encode


def decode_udf(path: str):
    """A column function: ids to their text, malformed UTF-8 replaced."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if i is None else encoder(path).decode(i).decode("utf-8", "replace") for i in ids.to_pylist()], pa.string())

    return decode


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Each row as struct ``row`` with the digests of its ids and of its decoded text."""
    arrow_batches(docs.sparkSession, 256)

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def trip(text: pa.Array) -> pa.Array:
        counts, ids, decoded = [], [], []
        for joined, raw in encoder(path).encode_batch(text.to_pylist()):
            counts.append(joined.count(b",") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined).hexdigest())
            decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode("utf-8")).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.withColumn("bpe", trip(F.col("row.text")))


def vocabulary_path() -> str:
    """Where this machine has the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of the contract."""
    return round_trip(docs, path or vocabulary_path()).select(F.col("row.doc_id").alias("doc_id"), "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
