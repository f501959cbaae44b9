"""SentencePiece encoding with seeded merge-dropout, and decoding.

Reads the pieces of a public BPE model with byte fallback (its path is a parameter; nothing is trained). A text is cut
into units, a run of spaces with the word after it: no piece joins two units. Within a unit an agenda holds all
candidate merges, best piece first, then leftmost; a popped candidate is skipped where a hash keyed by the seed, the
unit, its occurrence and the candidate's place falls below `dropout`. The occurrence is a hash of the seed, the text and
the unit's place in it; so each occurrence is drawn on its own, and a rerun or a retried task gives the same ids. A task
remembers each unit's plain ids and the merges that lead to them: an occurrence that skips none of these is plain, and
only the others run an agenda of their own. dropout 0 is plain BPE.

Decoding is lossless: characters without a piece, and U+2581 itself (the model's mark for a space), become byte pieces.

Cases: a null text has null pieces and decodes to null; an empty one has none; long texts are encoded whole; repeated
texts get equal pieces; an empty table gives no rows; other columns pass through unread, one of the result's name is replaced.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

#: The public model's place, the share of skipped merges and the seed.
MODEL, DROPOUT, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 17

#: Units that a task remembers, and those of them, the first ones, that stay when its memory is full.
REMEMBERED, KEPT = 200_000, 50_000

#: Characters of text, and units, that a task works on together; longer units have their own agenda.
GROUP, TOGETHER, LONGEST = 1_000_000, 24_000, 64

#: No candidate; no symbol.
NONE, GONE = 1 << 20, -(1 << 40)

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}| +[^ {SPACE}]*|[^ {SPACE}]+")


class Vocabulary:
    """The pieces of a model: scores of those that merges make, ids of single characters and of bytes, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.texts: list[bytes] = []
        for i, p in enumerate(pieces):
            text = b""
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                text = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[p] = i
                self.rank[p] = -model.get_score(i)
                text = p.replace(SPACE, " ").encode()
            self.texts.append(text)
        # All pairs of pieces that make a piece, and the pieces of single characters, for encode_units.
        self.size = n
        pairs = sorted((self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        ranks = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        bits = max(len(pairs), 1).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        # A hash table with linear probing: an empty slot holds no pair, no piece and no candidate.
        self.slots, self.made, self.ranks = np.full(1 << bits, -1), np.full(1 << bits, -1), np.full(1 << bits, NONE)
        for at, (pair, i) in zip(self._slot(np.array([x for x, _ in pairs], np.int64)).tolist(), pairs, strict=True):
            while self.slots[at] >= 0:
                at = at + 1 & self.mask
            self.slots[at], self.made[at], self.ranks[at] = pair, i, ranks[self.rank[pieces[i]]]
        chars = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.char_ids = np.full(max(chars) + 2, -1, np.int64)
        self.char_ids[list(chars)] = list(chars.values())

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols makes and its rank; -1 and NONE where it makes none."""
        pair = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = self._slot(pair)
        wrong = np.arange(len(pair))
        while len(wrong := wrong[((seen := self.slots[at[wrong]]) != pair[wrong]) & (seen >= 0)]):
            at[wrong] = at[wrong] + 1 & self.mask
        return self.made[at], self.ranks[at]

    def fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _key(unit: str, occurrence: int, seed: int) -> int:
    """What the skips of one occurrence of a unit depend on."""
    return xxhash.xxh64_intdigest(unit, seed) ^ occurrence * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _skipped(key: np.ndarray, merge: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether each merge, by its place, is skipped."""
    h = (key ^ merge) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)) < limit


def encode_unit(v: Vocabulary, unit: str, occurrence: int, dropout: float, seed: int) -> list[int]:
    """The ids of one unit (spaces, then a word)."""
    if unit == SPACE:
        return v.fallback(SPACE)
    s = unit.replace(" ", SPACE)
    n, rank = len(s), v.rank
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at a place; 0: there is none any more
    agenda = [(rank[s[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if s[i : i + 2] in rank]
    heapify(agenda)
    limit = int(dropout * (1 << 64))
    key = _key(unit, occurrence, seed)
    while agenda:
        _, left, right, end = heappop(agenda)
        if ends[left] != right or ends[right] != end:
            continue  # one of its symbols has been merged meanwhile
        if limit:
            h = (key ^ (left << 40 | right << 20 | end)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            if h ^ h >> 32 < limit:
                continue
        ends[left], ends[right] = end, 0
        if end < n:
            before[end] = left
            after = ends[end]
            if (p := s[left:after]) in rank:
                heappush(agenda, (rank[p], left, end, after))
        if (first := before[left]) >= 0 and (p := s[first:end]) in rank:
            heappush(agenda, (rank[p], first, left, end))
    ids, at = [], 0
    while at < n:
        piece = s[at : ends[at]]
        if (i := v.ids.get(piece)) is None:
            ids += v.fallback(piece)
        else:
            ids.append(i)
        at = ends[at]
    return ids


def encode_units(v: Vocabulary, units: list[tuple[str, int]], dropout: float, seed: int, merges: list | None = None, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """encode_unit for many (unit, occurrence), as all ids in a row and how many each has: the agendas of all short units
    advance together, one candidate each a round. merges, if given, gets arrays of the units and places of the merges made;
    keys are the units' _key, if known."""
    texts = [u.replace(" ", SPACE) for u, _ in units]
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    alone = {i: encode_unit(v, *units[i], dropout, seed) for i in np.flatnonzero((sizes > LONGEST) | ((sizes == 1) & (flat[first[:-1]] == ord(SPACE)))).tolist() if len(units[i][0]) > LONGEST or units[i][0] == SPACE}
    unit = np.repeat(np.arange(len(texts)), sizes)
    final = np.full(len(flat), GONE)  # the symbol that starts at each character, when its unit is done
    start = np.arange(len(flat)) - first[unit]
    symbol = v.char_ids[np.minimum(flat, len(v.char_ids) - 1)]
    symbol = np.where(symbol < 0, -1 - flat.astype(np.int64), symbol)  # no piece: the character itself, to fall back on bytes
    limit = np.uint64(int(dropout * (1 << 64)))
    key = keys if keys is not None else np.array([_key(u, k, seed) for u, k in units] if limit else [0] * len(units), np.uint64)

    made, rank = v.merged(symbol, np.append(symbol[1:], -1))
    rank[first[1:] - 1] = NONE
    if alone:
        for i in alone:
            rank[first[i] : first[i + 1]] = NONE
    while len(unit):
        edge = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(rank << 40 | np.arange(len(unit)), edge)
        live = best >> 40 < NONE
        rest = np.repeat(live, np.diff(np.append(edge, len(unit))))
        if not live.all():  # units whose agenda is empty are done
            final[first[unit[~rest]] + start[~rest]] = symbol[~rest]
        if not live.any():
            break
        at = (best & ((1 << 40) - 1))[live]
        after = np.minimum(at + 2, len(unit) - 1)
        ends = np.where((at + 2 < len(unit)) & (unit[after] == unit[at]), start[after], sizes[unit[at]])
        place = (start[at] << 40 | start[at + 1] << 20 | ends).astype(np.uint64)
        if merges is not None:
            merges.append((unit[at], place))
        if limit:
            skipped = _skipped(key[unit[at]], place, limit)
            rank[at[skipped]] = NONE
            at = at[~skipped]
        symbol[at] = made[at]
        rest[at + 1] = False  # the symbols that are merged away go with the units that are done
        kept = np.flatnonzero(rest)
        new = np.searchsorted(kept, at)
        unit, start, symbol, made, rank = unit[kept], start[kept], symbol[kept], made[kept], rank[kept]
        for left in (new, new[new > 0] - 1):
            right = np.minimum(left + 1, len(unit) - 1)
            m, r = v.merged(symbol[left], symbol[right])
            made[left], rank[left] = m, np.where((right > left) & (unit[right] == unit[left]), r, NONE)
    odd = np.flatnonzero((final < 0) & (final != GONE))  # characters that become bytes
    count = np.where(final == GONE, 0, 1)
    for at in odd.tolist():
        count[at] = len(chr(-1 - final[at]).encode())
    for i, ids in alone.items():
        count[first[i] : first[i + 1]] = 0
        count[first[i]] = len(ids)
    ends = np.cumsum(count)
    out = np.zeros(ends[-1], np.int32)
    kept = np.flatnonzero(count)
    out[ends[kept] - count[kept]] = final[kept]
    for at in odd.tolist():
        if count[at]:
            out[ends[at] - count[at] : ends[at]] = v.fallback(chr(-1 - final[at]))
    for i, ids in alone.items():
        out[ends[first[i]] - len(ids) : ends[first[i]]] = ids
    return out, np.diff(np.append(0, ends[first[1:] - 1]))


class Encoder:
    """Encodes texts, and remembers at most about REMEMBERED units."""

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.dropout, self.seed = vocabulary(path), dropout, seed
        self.limit = np.uint64(int(dropout * (1 << 64)))
        self.known: dict[str, int] = {}
        # Of each known unit: its plain ids, its plain merges, its hash, and whether it is too long for its merges to be kept.
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.merges, self.firsts = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.hashes, self.long = np.zeros(0, np.uint64), np.zeros(0, bool)

    def _forget(self) -> None:
        self.known = dict(islice(self.known.items(), KEPT))
        n = len(self.known)
        self.begins, self.firsts, self.hashes, self.long = self.begins[: n + 1].copy(), self.firsts[: n + 1].copy(), self.hashes[:n].copy(), self.long[:n].copy()
        self.ids, self.merges = self.ids[: self.begins[-1]].copy(), self.merges[: self.firsts[-1]].copy()

    def _occurrences(self, text: str, n: int) -> np.ndarray:
        h = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(text, self.seed))
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def _learn(self, new: list[str]) -> None:
        """The plain ids and merges of new units."""
        for at in range(0, len(new), TOGETHER):
            units, merges = new[at : at + TOGETHER], [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            ids, sizes = encode_units(self.v, [(u, 0) for u in units], 0, self.seed, merges)
            unit, place = (np.concatenate(x) for x in zip(*merges, strict=True))
            self.ids, self.begins = np.concatenate([self.ids, ids]), np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            self.merges = np.concatenate([self.merges, place[np.argsort(unit, kind="stable")]])
            self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(np.bincount(unit, minlength=len(units)))])
            self.hashes = np.concatenate([self.hashes, np.array([_key(u, 0, self.seed) for u in units], np.uint64)])
            self.long = np.concatenate([self.long, np.array([len(u) > LONGEST for u in units], bool)])

    def _varied(self, place: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The occurrences that skip one of their unit's plain merges."""
        first = self.firsts[place]
        n = self.firsts[place + 1] - first
        owner = np.repeat(np.arange(len(place)), n)
        merge = self.merges[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = self.hashes[place] ^ occurrence * np.uint64(0x9E3779B97F4A7C15)
        found = self.long[place]
        found[owner[_skipped(key[owner], merge, self.limit)]] = True
        return np.flatnonzero(found)

    def encode(self, texts: list) -> list:
        """The ids of each text; None for None."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, old, units, sizes, drawn = self.known, len(self.known), [], [], []
        for text in texts:
            mine = _UNITS.findall(" " + text) if text else []  # the model's own leading space
            units += mine
            sizes.append(len(mine))
            if self.limit and mine:
                drawn.append(self._occurrences(text, len(mine)))
        place = np.array([known.setdefault(u, len(known)) for u in units], np.int64)
        self._learn(list(islice(known, old, None)))
        begin, size, ids = self.begins[place], self.begins[place + 1] - self.begins[place], [self.ids]
        if drawn:
            occurrence = np.concatenate(drawn)
            varied, end = self._varied(place, occurrence), len(self.ids)
            for at in range(0, len(varied), TOGETHER):
                some = varied[at : at + TOGETHER]
                keys = self.hashes[place[some]] ^ occurrence[some] * np.uint64(0x9E3779B97F4A7C15)
                made, n = encode_units(self.v, [(units[i], k) for i, k in zip(some.tolist(), occurrence[some].tolist(), strict=True)], self.dropout, self.seed, keys=keys)
                begin[some], size[some] = end + np.cumsum(n) - n, n
                ids.append(made)
                end += len(made)
        flat = np.concatenate(ids)[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ends = np.append(0, np.cumsum(size))[np.cumsum(sizes, dtype=np.int64)]
        return [None if t is None else x for t, x in zip(texts, np.split(flat, ends[:-1]), strict=True)] if texts else []


def decode_ids(v: Vocabulary, ids) -> str | None:
    """The text of ids; the leading space that encoding adds is dropped."""
    if ids is None:
        return None
    text = b"".join(map(v.texts.__getitem__, np.asarray(ids).tolist())).decode(errors="replace")
    return text[1:] if text[:1] == " " else text


def encode_texts(documents: DataFrame, text: str = "text", name: str = "pieces", decoded: str | None = None, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """documents with the ids of each text's pieces added, as an array<int>, and, if named, the text that they decode to.

    Rows pass as Arrow batches and leave in slices of about GROUP characters, so a task holds little beside its batch.
    """
    documents = documents.drop(name, *([decoded] if decoded else []))
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    place = documents.columns.index(text)

    def encoded(batches):
        encoder = Encoder(model, dropout, seed)
        for batch in batches:
            for part in _slices(batch, place):
                ids = encoder.encode(part.column(place).to_pylist())
                columns = [*part.columns, _lists(ids)]
                if decoded:
                    columns.append(pa.array([decode_ids(encoder.v, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        del encoder
        give_back()

    return documents.mapInArrow(encoded, schema)


def _slices(batch: pa.RecordBatch, place: int):
    """The batch in slices of whole rows with about GROUP characters of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(int(np.searchsorted(size, base + GROUP)), at + 1)
        yield batch.slice(at, end - at)
        at = end


def _lists(ids: list) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))


def decode_pieces(rows: DataFrame, pieces: str = "pieces", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with the text of an array of ids added."""

    @F.pandas_udf(T.StringType())
    def text_of(ids: pd.Series) -> pd.Series:
        v = vocabulary(model)
        return pd.Series([decode_ids(v, x) for x in ids.tolist()], dtype=object)

    return rows.withColumn(name, text_of(F.col(pieces)))


def query(spark, sf_dir: str) -> DataFrame:
    back = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return back.select(
        "doc_id",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
