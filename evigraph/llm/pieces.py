"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut at places no vocabulary piece can cross (before a run of word marks,
around characters that are in no piece).  The distinct words of a batch lie as
symbols in one flat numpy array.  Each round finds, per word, the smallest rank
among its neighbouring pairs, merges the leftmost non-overlapping pairs of that
rank in all words at once and compacts the array; a word leaves when none of its
pairs is in the vocabulary.  Where merging could create a pair that ranks before the
merged one, only the leftmost pair of the word is merged in that round, so the result
is exactly that of merging one pair at a time.  Characters without a piece become byte
pieces.  Encoded words are remembered up to a bound.

Defined results: null counts as empty; an empty text is the end id alone (or
nothing without it) and decodes to ""; texts of any length are encoded whole;
repeated rows get equal answers; other columns pass through (the added names
replace equal ones).
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm import flat

MARK = "▁"
NONE = np.int32(2**31 - 1)
KEPT_WORDS = 150_000
NEW_CHARS = 1 << 18
CHUNK_BYTES = 1 << 19
DECODED_IDS = 1 << 19


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names, ids = [sp.id_to_piece(i) for i in range(sp.get_piece_size())], range(sp.get_piece_size())
        normal = {names[i]: i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # symbols: the ids, then characters that occur in pieces without being pieces
        inner = sorted({c for p in normal for c in p} - normal.keys())
        self.symbol = normal | {c: len(names) + i for i, c in enumerate(inner)}
        self.size = len(names) + len(inner)
        rank = {p: r for r, p in enumerate(sorted(normal, key=lambda p: -sp.get_score(normal[p])))}
        left, right, made, ranks = [], [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if p[:cut] in self.symbol and p[cut:] in self.symbol:
                    left.append(self.symbol[p[:cut]])
                    right.append(self.symbol[p[cut:]])
                    made.append(i)
                    ranks.append(rank[p])
        self._tabulate(np.array(left, np.int64) * self.size + np.array(right, np.int64), np.array(made, np.int32), np.array(ranks, np.int32))
        # pieces that, once made, can join a pair of better rank than their own: one merge at a time
        own = np.full(self.size, -1, np.int64)
        for p, i in normal.items():
            if len(p) > 1:
                own[i] = rank[p]
        self.single = np.zeros(self.size, bool)
        for side in (left, right):
            side = np.array(side, np.int64)
            self.single[side[np.array(ranks) < own[side]]] = True
        # the bytes each id stands for
        control = {i for i in ids if sp.is_control(i)}
        texts = [b"" if i in control else " ⁇ ".encode() if i == self.unknown else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in ids]
        self.is_byte = np.array([sp.is_byte(i) for i in ids])
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.silent = np.array([i in control for i in ids])
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_len)])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        crossing = any(MARK in p.lstrip(MARK) for p in normal)
        if crossing:
            raise ValueError("a piece holds a word mark after other characters: texts can't be cut at word marks")
        # line breaks are in no piece of most vocabularies: then they part words too
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+" if "\n" not in "".join(normal) else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _tabulate(self, keys: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """Hash table of the pairs: a pair lies in its slot or in one of the next ``probes`` - 1."""
        self.bits = max(10, int(len(keys)).bit_length() + 3)
        self.probes, left = 0, np.arange(len(keys))
        slots = np.full((1 << self.bits) + 64, -1, np.int64)
        while len(left):
            spot = self._slot(keys[left]) + self.probes
            free = slots[spot] < 0
            spot, first = np.unique(spot[free], return_index=True)
            slots[spot] = left[free][first]
            left = np.setdiff1d(left, slots[spot], assume_unique=True)
            self.probes += 1
        self.pair = np.where(slots >= 0, keys[slots], -1)
        self.made, self.rank = np.where(slots >= 0, made[slots], 0).astype(np.int32), np.where(slots >= 0, rank[slots], NONE).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * flat.ROOT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the n + 1 offsets."""
        chars = "".join(words)
        lens = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, at = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), -1) for c in distinct], np.int32)[at] if len(points) else np.zeros(0, np.int32)
        raw = points.copy()  # the character of a symbol that has no piece
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            rank, made = self._ranks(sym, word)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(word)))
            over = np.repeat(least == NONE, size)
            if over.any():
                done.append((word[over], sym[over], raw[over]))
                keep = ~over
                sym, word, raw, rank, made = sym[keep], word[keep], raw[keep], rank[keep], made[keep]
                first = np.flatnonzero(np.diff(word, prepend=-1))
                least, size = least[least != NONE], size[least != NONE]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(least, size))
            # neighbours of equal rank overlap: take every other one from the left
            fresh = np.diff(pick, prepend=-2) != 1
            run = np.flatnonzero(fresh)
            pick = pick[(np.arange(len(pick)) - np.repeat(run, np.diff(np.append(run, len(pick))))) % 2 == 0]
            lead = np.diff(word[pick], prepend=-1) != 0
            pick = pick[lead | ~self.single[made[pick]]]
            sym[pick] = made[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, word, raw = sym[keep], word[keep], raw[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, sym, raw = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return self._bytes(word[order], sym[order], raw[order], len(words))

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pair that starts at each symbol."""
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        pairs = np.flatnonzero((word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0))
        keys = sym[pairs].astype(np.int64) * self.size + sym[pairs + 1]
        spot = self._slot(keys)
        for _ in range(self.probes):
            held = self.pair[spot]
            found = held == keys
            rank[pairs[found]], made[pairs[found]] = self.rank[spot[found]], self.made[spot[found]]
            on = ~found & (held >= 0)
            pairs, keys, spot = pairs[on], keys[on], spot[on] + 1
        return rank, made

    def _bytes(self, word: np.ndarray, sym: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols without a piece by their bytes."""
        bad = (sym < 0) | (sym >= len(self.text_len))
        if bad.any():
            points, at = np.unique(raw[bad], return_inverse=True)
            codes = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in points]
            width = np.ones(len(sym), np.int64)
            width[bad] = np.array([len(c) for c in codes])[at]
            begin = np.cumsum(width) - width
            out = np.repeat(sym, width)
            table = np.zeros((len(codes), 4), np.uint8)
            for i, c in enumerate(codes):
                table[i, : len(c)] = c
            for j in range(4):
                long = bad & (width > j)
                out[begin[long] + j] = self.byte[table[at[(width > j)[bad]], j]]
            word, sym = np.repeat(word, width), out
        return sym.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the id lists ids[offsets[i]:offsets[i + 1]]."""
        size = self.text_len[ids]
        data = self.text_bytes[_gather(self.text_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = ends[offsets]
        # the mark the encoder put in front: on the first id that is not a control id
        shown = np.flatnonzero(~self.silent[ids])
        spot = np.searchsorted(shown, offsets[:-1])
        lead = shown[np.minimum(spot, len(shown) - 1)] if len(shown) else np.zeros(len(offsets) - 1, np.int64)
        has = (spot < len(shown)) & (lead < offsets[1:]) if len(shown) else np.zeros(len(offsets) - 1, bool)
        strip = np.zeros(len(has), bool)
        strip[has] = self.marked[ids[lead[has]]]
        if strip.any():
            keep = np.ones(len(data), bool)
            keep[at[:-1][strip]] = False
            data = data[keep]
            at = at - np.concatenate([[0], np.cumsum(strip)])
        blob = data.tobytes()
        try:
            blob.decode("utf-8")
            return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(blob))
        except UnicodeDecodeError:  # byte ids that are no UTF-8: each such byte shows as U+FFFD
            return pa.array([_lenient(blob[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.large_string())


def _lenient(blob: bytes) -> str:
    out, at = [], 0
    while at < len(blob):
        try:
            out.append(blob[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(blob[at : at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Coder:
    """Encodes texts; words met before are looked up."""

    def __init__(self, model: str):
        self.vocabulary = Vocabulary(model)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, at = self.vocabulary.encode_words(words)
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.at = np.concatenate([self.at, at[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        for _, part in flat.chunks(texts, CHUNK_BYTES):
            if len(self.known) > KEPT_WORDS:
                self._forget()
            cut = [self.vocabulary.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in part.to_pylist()]
            words = list(chain.from_iterable(cut))
            which = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
            unknown = np.flatnonzero(which < 0).tolist()
            new = list({words[i] for i in unknown})
            while new:  # in portions, so that the symbol arrays stay small
                total, n = 0, 0
                while n < len(new) and (n == 0 or total < NEW_CHARS):
                    total, n = total + len(new[n]), n + 1
                self._learn(new[:n])
                new = new[n:]
            which[unknown] = [self.known[words[i]] for i in unknown]
            width = np.diff(self.at)[which]
            ids = self.ids[_gather(self.at[which], width)]
            per = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)]
            if end:
                ids = np.insert(ids, per[1:], self.vocabulary.end)
            parts.append(ids)
            sizes.append(np.diff(per) + end)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))


_coders: dict[str, Coder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _coder(model: str | None) -> Coder:
    path = model or default_model()
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(text: Column, model: str | None = None, end: bool = True) -> Column:
    """Ids of a text; ``model`` is the file's path on the workers."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [_lists(*_coder(model).encode(part, end)) for _, part in flat.chunks(texts, CHUNK_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, model: str | None = None) -> Column:
    """Text of an id list; a null list is an empty text."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        parts, first = [], 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while first < len(lists):  # runs of lists of bounded length, so that the byte positions stay small
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + DECODED_IDS, "right")))
            part = lists.slice(first, last - first)
            at = np.concatenate([[0], ends[first:last] - done])
            parts.append(_coder(model).vocabulary.decode(pc.list_flatten(part).to_numpy(zero_copy_only=False).astype(np.int32), at).cast(pa.string()))
            first = last
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return texts(ids)


def tokenized(df: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Adds ``token_ids`` with the end id, and ``decoded``, the text those ids decode to."""

    @F.arrow_udf("struct<token_ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        lists, decoded = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.string())]
        for _, part in flat.chunks(texts, CHUNK_BYTES):
            ids, at = _coder(model).encode(part)
            lists.append(_lists(ids, at))
            decoded.append(_coder(model).vocabulary.decode(ids, at).cast(pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.concat_arrays(decoded)], ["token_ids", "decoded"])

    flat.small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("token_ids", "decoded")]
    return df.select(*kept, both(F.col(text)).alias("__both")).select(*kept, F.col("__both.token_ids").alias("token_ids"), F.col("__both.decoded").alias("decoded"))
