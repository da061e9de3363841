"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The scheme of the model: spaces become ``\\u2581``, one more is put in front of a text that is not
empty, and neighbouring symbols merge by score, best first, leftmost on ties, until no pair forms a
piece; characters without a piece become their UTF-8 bytes. No piece holds ``\\u2581`` after another
character, so no merge crosses into the next run of it and texts split there into segments. (A
vocabulary with such pieces is handled too: its texts stay one segment.)

Segments that a worker has not met go through the merges together, as flat arrays of symbol ids and
pair ranks. Each round takes the leftmost best pair of every segment (one segmented minimum over rank
and place), merges all of these at once, looks up the two new pairs beside each merge, and drops the
consumed symbols and the finished segments. One merge per segment and round is exact whatever the
vocabulary: a merged pair may open a better one than the next best. Long segments are cut before the
rounds between characters that no piece holds side by side. What stays long merges all leftmost
pairs of its best piece in one round where no pair with that piece ranks better than the piece itself, which
the model knows of every piece beforehand; so a run of a million letters takes few rounds. Long segments whose
rounds have cost ``PATIENCE`` looks at every symbol, made of pieces that must go one by one, are finished
from a queue of their pairs, best and leftmost first.

Whole texts are encoded, of any length. Null texts count as empty; an empty text is its end id only.
Ids are deterministic functions of the text; rows need no order, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments that one worker remembers; beyond it starts afresh (ids do not depend on it).
REMEMBERED = 400_000
#: Characters of texts that are encoded together, and of new segments that share merge rounds.
GROUP_CHARS = 4_000_000
ROUND_CHARS = 1_000_000
#: Characters of a segment from which it is cut, and takes all merges of one piece in a round.
LONG = 64
PATIENCE = 64
#: Rank of a pair that forms no piece; ranks stand above the places in one sortable number.
_NONE = np.int64(1) << 22
_PLACES = np.int64(1) << 40


class PieceModel:
    """Vocabulary of a model file: pieces, ids, merge ranks and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = {i for i in range(size) if sp.is_unknown(i)}
        plain = [i for i in range(size) if not (i in silent or i in self.unknown or i in self.byte_of or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.text_of = ["" if i in silent else " ⁇ " if i in self.unknown else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Symbols: ids of pieces; characters without a piece get numbers from ``size`` on, for good.
        self.size = size
        left, right, made, rank = [], [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                a = a if a is not None or k > 1 else None
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(order[sp.get_score(i)])
        left, right, made, rank = (np.array(x, np.int64) for x in (left, right, made, rank))
        self._table(left, right, made, rank)
        # Pieces that may be merged everywhere at once: a rank of their own, better than that of every pair they are part of.
        own, opened = np.full(size, _NONE), np.full(size, _NONE)
        own[made] = rank
        np.minimum.at(opened, left, rank)
        np.minimum.at(opened, right, rank)
        shared = np.bincount(np.array(list(order[sp.get_score(i)] for i in plain), np.int64), minlength=len(order)) > 1
        self.everywhere = (opened > own) & ~shared[np.minimum(own, len(order) - 1)]
        top = max((ord(c) for c in self.ids if len(c) == 1), default=0) + 1
        self.symbol = np.full(top, size, np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.decimal_text = {str(i): t for i, t in enumerate(self.text_of) if i not in self.byte_of}

    def _table(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """Open hash table of pairs: keys, ranks, results; probed at most ``self.probes`` places on."""
        keys = left * (self.size + 1) + right
        bits = max(4, int(len(keys) * 8).bit_length())
        self.mask = (1 << bits) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.full(self.mask + 1, _NONE, np.int64)
        self.made = np.zeros(self.mask + 1, np.int64)
        at, todo, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            place = at[todo]
            free = self.slots[place] == -1
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            put = first[free[first]]
            self.slots[place[put]], self.rank[place[put]], self.made[place[put]] = keys[todo[put]], rank[todo[put]], made[todo[put]]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo = todo[left_over]
            at[todo] = (at[todo] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting piece of each pair; rank ``_NONE`` where it forms none."""
        keys = left * (self.size + 1) + right
        at = self._hash(keys)
        rank, made = np.full(len(keys), _NONE, np.int64), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            place = at[open_]
            found = self.slots[place]
            hit = found == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[place[hit]], self.made[place[hit]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
        return rank, made

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment (spaces already ``\\u2581``)."""
        cuts, parts = [], []
        for s in segments:
            if len(s) > LONG:
                own, start = [], 0
                for k in range(1, len(s)):
                    if s[k - 1 : k + 1] not in self.inside:
                        own.append(s[start:k])
                        start = k
                parts += [*own, s[start:]]
                cuts.append(len(own) + 1)
            else:
                parts.append(s)
                cuts.append(1)
        long = [k for k, p in enumerate(parts) if len(p) > LONG]
        merged = self._rounds(["" if len(p) > LONG else p for p in parts] if long else parts)
        for k, ids in zip(long, self._rounds([parts[k] for k in long], many=True)):
            merged[k] = ids
        out, at = [], 0
        for n in cuts:
            out.append(merged[at] if n == 1 else [i for ids in merged[at : at + n] for i in ids])
            at += n
        return out

    def _rounds(self, parts: list[str], many: bool = False) -> list[list[int]]:
        """Ids of each part. many: merge all leftmost pairs of a part's best piece in a round, where the piece allows it."""
        flat = "".join(parts)
        if not flat:
            return [[] for _ in parts]
        chars = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = np.where(chars < len(self.symbol), self.symbol[np.minimum(chars, len(self.symbol) - 1)], self.size)
        lengths = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(parts)), lengths)
        place = np.arange(len(chars))  # of the first character of each symbol
        final = symbol.copy()  # by that place; -1 where a symbol was merged away
        last = np.r_[owner[1:] != owner[:-1], True]
        rank, made = self.pairs(symbol, np.r_[symbol[1:], self.size])
        rank[last] = _NONE
        looks = PATIENCE * len(owner)
        while True:
            if many:
                looks -= len(owner)
                if looks < 0:
                    for row in np.split(np.arange(len(owner)), np.flatnonzero(owner[1:] != owner[:-1]) + 1):
                        final[place[row]] = self._queue(symbol[row].tolist())
                    break
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank * _PLACES + np.arange(len(rank)), starts)
            alive = best < _NONE * _PLACES
            if not alive.all():
                keep = np.repeat(alive, np.diff(np.r_[starts, len(owner)]))
                if not keep.any():
                    break
                owner, place, symbol, rank, made = owner[keep], place[keep], symbol[keep], rank[keep], made[keep]
                continue
            at = best % _PLACES
            if many:
                again = np.flatnonzero((rank == np.repeat(best // _PLACES, np.diff(np.r_[starts, len(owner)]))) & self.everywhere[made])
                # Of pairs that overlap in a row, every second one from the left.
                row = np.flatnonzero(np.r_[True, np.diff(again) > 1])
                again = again[(np.arange(len(again)) - np.repeat(row, np.diff(np.r_[row, len(again)]))) % 2 == 0]
                at = np.union1d(at, again)
            symbol[at] = made[at]
            final[place[at]] = made[at]
            final[place[at + 1]] = -1
            keep = np.ones(len(owner), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the compaction: one symbol went per earlier merge
            owner, place, symbol, rank, made = owner[keep], place[keep], symbol[keep], rank[keep], made[keep]
            same = np.r_[owner[1:] == owner[:-1], False]
            renew = np.unique(np.r_[at, at[at > 0] - 1])
            renew, over = renew[same[renew]], renew[~same[renew]]
            rank[over] = _NONE
            rank[renew], made[renew] = self.pairs(symbol[renew], symbol[renew + 1])
        keep = final >= 0
        ids, own = final[keep], np.repeat(np.arange(len(parts)), lengths)[keep]
        ends = np.searchsorted(own, np.arange(len(parts)), side="right").tolist()
        values = ids.tolist()
        lost = set(np.unique(own[ids == self.size]).tolist())
        chars_kept = chars[keep] if lost else None
        out, start = [], 0
        for k, end in enumerate(ends):
            if k in lost:
                row = []
                for j in range(start, end):
                    row += [values[j]] if values[j] != self.size else self._bytes(chr(chars_kept[j]))
                out.append(row)
            else:
                out.append(values[start:end])
            start = end
        return out

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        used = np.flatnonzero(self.slots >= 0)
        return dict(zip(self.slots[used].tolist(), zip(self.rank[used].tolist(), self.made[used].tolist())))

    def _queue(self, symbol: list[int]) -> list[int]:
        """The symbols after all merges, each at the place of its first; -1 where one was merged away."""
        pairs, width, end = self._pairs, self.size + 1, len(symbol)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < end:
                key = symbol[i] * width + symbol[after[i]]
                if key in pairs:
                    rank, made = pairs[key]
                    heapq.heappush(queue, (rank, i, key, made))

        for i in range(end):
            offer(i)
        while queue:
            _, i, key, made = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j >= end or symbol[i] * width + symbol[j] != key:
                continue  # one of the two has been merged since
            symbol[i], symbol[j], after[i] = made, -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return symbol

    def _bytes(self, char: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8")]
        return sorted(self.unknown)[:1]

    def segments(self, text: str) -> list[str]:
        """The text cut where no piece can cross; each with its leading space."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.splits:
            return [" " + text]
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [s[1:] for s in re.findall(r" +[^ ]+| +$", " " + text)]

    def decode(self, ids: Iterable[str]) -> str:
        """Text of ids given in decimals: pieces joined, runs of bytes as UTF-8, the leading space off."""
        ids = list(ids)
        table = self.decimal_text
        try:
            text = "".join(map(table.__getitem__, ids))
        except KeyError:
            out, run = [], bytearray()
            for i in ids:
                piece = table.get(i)
                if piece is None:
                    run.append(self.byte_of[int(i)])
                    continue
                if run and piece:
                    out.append(_utf8(bytes(run)))
                    run = bytearray()
                out.append(piece)
            text = "".join([*out, _utf8(bytes(run))])
        shown = next((i for i in ids if table.get(i, "x")), None)
        return text[1:] if shown in table and table[shown].startswith(" ") and int(shown) not in self.unknown else text


def _utf8(run: bytes) -> str:
    """Bytes as text, one replacement character per byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as err:
            out.append(run[at : at + err.start].decode("utf-8") + "�")
            at += err.start + 1
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


_MEMORY: dict[str, dict[str, str]] = {}


def encode_decimals(path: str, texts: Iterable[str | None]) -> Iterator[str]:
    """Per text its ids with the end id, in decimals joined by one space."""
    m = model(path)
    group, chars = [], 0
    for text in texts:
        group.append(m.segments(text or ""))
        chars += len(text or "")
        if chars > GROUP_CHARS:
            yield from _encode_group(m, path, group)
            group, chars = [], 0
    yield from _encode_group(m, path, group)


def _encode_group(m: PieceModel, path: str, group: list[list[str]]) -> Iterator[str]:
    """Texts that are cut already: segments new to this worker go through the merges, together."""
    memory = _MEMORY.setdefault(path, {})
    if len(memory) > REMEMBERED:
        memory.clear()
    missing = list({s for segments in group for s in segments if s not in memory})
    batch, chars = [], 0
    for k, s in enumerate(missing):
        batch.append(s)
        chars += len(s)
        if chars > ROUND_CHARS or k == len(missing) - 1:
            # Where texts are split, a segment stands after exactly one space of its own.
            spelled = [(SPACE + b if m.splits else b).replace(" ", SPACE) for b in batch]
            memory.update(zip(batch, (" ".join(map(str, ids)) for ids in m.merge(spelled))))
            batch, chars = [], 0
    end = str(m.eos)
    for segments in group:
        yield " ".join([*map(memory.__getitem__, segments), end])


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, end id included) of every row."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(int, s.split(" "))) for s in encode_decimals(path, texts)])

    return docs.select(F.col(id_column).alias("doc_id"), ids(F.col(text_column)).alias("ids"))


def decode_documents(encoded: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with the column text: what its ids stand for (null ids: empty)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for rows in batches:
            yield pd.Series([m.decode(map(str, r)) if r is not None else "" for r in rows])

    return encoded.withColumn("text", text(F.col(ids_column)))


def token_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded again, and hashed."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for texts in batches:
            rows = []
            for ids in encode_decimals(path, texts):
                tokens = ids.split(" ")
                text = m.decode(tokens).encode("utf-8")
                rows.append((len(tokens), hashlib.sha256(ids.encode("ascii")).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), digests(F.col(text_column)).alias("d"))
    return rows.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
