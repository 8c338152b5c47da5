"""Token counts by rank-synchronous merging of ragged symbol arrays (operator 2)."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Texts, chunks, read, texts

MODEL, LIMIT = "piece_bpe_32k.model", 4096
BLANK = "▁"  # stands for a blank in the pieces
NONE = np.int32((1 << 31) - 1)  # rank of a pair that makes no piece
CACHED, LONG = 400_000, 512


class Merges:
    """The pieces of a BPE model as a table from symbol pairs to ranks.

    Every character is a symbol: a piece, a character that only occurs inside
    pieces, or an unknown one, which ends as one token for each UTF-8 byte.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in plain}
        symbol = dict(piece)
        for p in piece:
            for c in p:
                symbol.setdefault(c, sp.get_piece_size() + len(symbol))
        top = max(symbol.values()) + 1
        self.width = top + 5
        self.of_char = np.full(0x110000, top + 4, np.int32)
        self.of_char[:0x80], self.of_char[0x80:0x800], self.of_char[0x800:0x10000] = top + 1, top + 2, top + 3
        self.tokens = np.ones(self.width, np.int64)
        self.tokens[top + 1:top + 5] = [1, 2, 3, 4]
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
                if c not in piece:
                    self.tokens[i] = len(c.encode())
        pairs = {}
        for p, i in piece.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (-sp.get_score(i), i)
        self._table({k: (int(r), i) for k, (r, i) in pairs.items()})

    def _table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Two-slot hash table, so that looking up an array of pairs is a few array reads."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, slots = np.uint64(64 - bits), 1 << bits
        keys = np.array(list(pairs), np.uint64)
        first, second = (x.tolist() for x in self._slots(keys))
        places = dict(zip(pairs, zip(first, second)))
        held: list[int | None] = [None] * slots
        for k in pairs:
            at = places[k][0] if held[places[k][0]] is None else places[k][1]
            for _ in range(500):
                k, held[at] = held[at], k
                if k is None:
                    break
                at = places[k][1] if at == places[k][0] else places[k][0]
            else:
                raise RuntimeError("the pair table is too full")
        self.keys = np.array([-1 if k is None else k for k in held], np.int64)
        self.rank = np.array([NONE if k is None else pairs[k][0] for k in held], np.int32)
        self.made = np.array([0 if k is None else pairs[k][1] for k in held], np.int32)

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64),
                (key * np.uint64(0xC2B2AE3D27D4EB4F) >> self.shift).astype(np.int64))

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the piece it makes."""
        key = a.astype(np.int64) * self.width + b
        at, other = self._slots(key.view(np.uint64))
        at = np.where(self.keys[at] == key, at, other)
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.made[at]

    def count(self, items: list[str]) -> np.ndarray:
        """Tokens of each string; all strings advance together.

        In each step every string applies its lowest-rank pair at all its
        places at once, if no pair made on the way would come before the
        places still open; else at the leftmost place alone. That is the order
        of one merge at a time. Long strings that must go place by place, such
        as runs of one character, take the same order from a heap.
        """
        total = np.zeros(len(items), np.int64)
        sizes = np.array([len(x) for x in items], np.int64)
        cp = np.frombuffer("".join(items).encode("utf-32-le"), np.uint32)
        sym, word = self.of_char[cp], np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        rank, made = self.look(sym, np.append(sym[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        while len(sym):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            over = least == NONE
            if over.any():  # these strings have no pair left
                done = np.repeat(over, length)
                total += np.bincount(word[done], self.tokens[sym[done]], len(items)).astype(np.int64)
                sym, word, rank, made = sym[~done], word[~done], rank[~done], made[~done]
                least, length = least[~over], length[~over]
                if not len(sym):
                    break
                start = np.cumsum(length) - length
            nth = np.repeat(np.arange(len(start)), length)
            low = least[nth]
            take = rank == low
            # of overlapping places every second one, from the left
            at = np.flatnonzero(take)
            fresh = np.append(True, np.diff(at) > 1)
            take[at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 1]] = False
            at = np.flatnonzero(take)
            gone = np.append(False, take[:-1])
            after = np.where(take, made, sym)
            left = np.maximum(at - 1, 0)
            left = np.where(gone[left], np.maximum(left - 1, 0), left)
            bad = (at > 0) & (nth[left] == nth[at]) & (self.look(after[left], after[at])[0] <= low[at])
            right = np.minimum(at + 2, len(sym) - 1)
            inside = (at + 2 < len(sym)) & (nth[right] == nth[at])
            bad |= inside & ((self.look(after[at], sym[right])[0] <= low[at]) | (self.look(after[at], after[right])[0] <= low[at]))
            if bad.any():
                slow = np.zeros(len(start), bool)
                slow[nth[at[bad]]] = True
                first = np.append(True, nth[at[1:]] != nth[at[:-1]])
                drop = at[slow[nth[at]] & ~first]
                take[drop] = False
                gone = np.append(False, take[:-1])
                for i in np.flatnonzero(slow & (length > LONG)):
                    a, b = start[i], start[i] + length[i]
                    total[word[a]] += self.one(sym[a:b])
                    gone[a:b] = True
                    take[a:b] = False
                after = np.where(take, made, sym)
            stay = ~gone
            sym, word, rank, made, take = after[stay], word[stay], rank[stay], made[stay], take[stay]
            touched = take.copy()
            touched[:-1] |= take[1:]
            new = np.flatnonzero(touched)  # only these pairs have changed
            to = np.minimum(new + 1, len(sym) - 1)
            rank[new], made[new] = self.look(sym[new], sym[to])
            rank[new[(word[new] != word[to]) | (new == to)]] = NONE
        return total

    def one(self, sym: np.ndarray) -> int:
        """Tokens of one symbol string, merged place by place from a heap."""
        s, n = [int(x) for x in sym], len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = (x.tolist() for x in self.look(sym[:-1], sym[1:]))
        heap = [(rank[i], i, s[i], s[i + 1], made[i]) for i in range(n - 1) if rank[i] < NONE]
        heapq.heapify(heap)

        def offer(i, j):
            r, m = self.look(np.array([s[i]]), np.array([s[j]]))
            if r[0] < NONE:
                heapq.heappush(heap, (int(r[0]), i, s[i], s[j], int(m[0])))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return int(sum(self.tokens[x] for x in s if x >= 0))


_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def split(text: str) -> list[str]:
    """Pre-tokens without their first blank sign: no piece holds a blank after another character."""
    if "  " not in text and BLANK not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [w[1:] for w in _WORD.findall(BLANK + text.replace(" ", BLANK))]


class Counter:
    """Counts of pre-tokens; what was counted is kept, up to a bound, for the next texts."""

    def __init__(self, path: str):
        self.merges, self.known = Merges(path), {}

    def __call__(self, strings: list[str]) -> list[int]:
        lists = [split(s) for s in strings]
        new = list(set().union(*lists) - self.known.keys()) if lists else []
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = list(set().union(*lists))
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            self.known.update(zip(part, self.merges.count([BLANK + w for w in part]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in lists]


_COUNTERS: dict[str, Counter] = {}  # in a worker, for all its tasks


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null and empty texts have no tokens.

    The model's file must be at the same path on all executors. Repeated rows
    are counted each; other columns of ``docs`` are not read.
    """

    def run(batches):
        count = counter(model_path)
        for b in chunks(batches, 2 << 20):
            n = count(b.column(1).to_pylist())
            size = np.diff(Texts(b.column(1)).off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = texts(docs)
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
