"""Encoding and decoding with a SentencePiece BPE model by suffix-array matching.

The distinct segments of a batch are concatenated and indexed by a suffix
array; a binary search finds every piece's range of occurrences; the resulting
edges, sorted by where they end, are relaxed from left to right.

A segment is a run of blanks with the letters after it: no piece of the model
goes beyond one, so segments are encoded apart and only once per worker.

The model's pieces were made by merges, for which the best-scored path is not
the library's answer. So an edge is relaxed not by adding scores but by a test
of the pair of pieces that it would make neighbours: a sequence is what the
merges give exactly if each pair of neighbours is (the two would not have been
merged across their border before each was whole). One edge at most passes at
each position. Segments with two or more blanks in front, whose pieces share
one score, are merged step by step.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import StemCoder, chunks, in_arrow, remembered, spread, table

BLANK = "▁"
BORDER = 0x110000  # no code point
NEVER = np.int64(1) << 40
#: Marks that are cut off from the letters before them.
MARKS = ".,;:!?)"


@dataclass
class Pieces:
    """What encoding needs of a model; arrays have a row for each id."""

    texts: list[str]
    rank: np.ndarray  # 0 merges first; NEVER for what isn't made by merges
    left: np.ndarray  # parts of the last merge, or -1
    right: np.ndarray
    usable: np.ndarray  # merges of its own letters give the piece
    bytes_of: list[int]  # id for each byte value
    number: dict[str, int]


def merged(symbols: list[str], number: dict[str, int], rank: np.ndarray) -> tuple[list[str], tuple[str, str] | None]:
    """Merge neighbours, best rank first and leftmost of equals, until none is a piece; also the last merge."""
    text, nxt, prev = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap, last = [], None

    def offer(i):
        if i >= 0 and nxt[i] < len(text):
            k = number.get(text[i] + text[nxt[i]])
            if k is not None and rank[k] < NEVER:
                heapq.heappush(heap, (int(rank[k]), i, nxt[i], text[i], text[nxt[i]]))

    for i in range(len(text)):
        offer(i)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if text[i] != a or nxt[i] != j or text[j] != b:
            continue
        last = (a, b)
        text[i], text[j] = a + b, ""
        nxt[i] = nxt[j]
        if nxt[i] < len(text):
            prev[nxt[i]] = i
        offer(prev[i])
        offer(i)
    return [t for t in text if t], last


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    """Read a BPE model with byte fallback and the identity normaliser; raises ValueError for another kind."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model)
    n = p.vocab_size()
    texts = [p.id_to_piece(i) for i in range(n)]
    plain = np.array([not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(n)])
    scores = np.array([p.get_score(i) for i in range(n)])
    number = {texts[i]: i for i in np.flatnonzero(plain).tolist()}
    odd = " ﬁ  a"
    if any(BLANK in t.lstrip(BLANK) for t in number) or p.decode(p.encode(odd)) != odd or not any(p.is_byte(i) for i in range(n)):
        raise ValueError("the model normalises text, joins words or has no byte fallback")
    rank = np.full(n, NEVER)
    many = np.array([len(t) > 1 for t in texts]) & plain
    rank[many] = np.unique(-scores[many], return_inverse=True)[1]
    left, right, usable = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, dtype=bool)
    for text, i in number.items():
        if len(text) == 1:
            usable[i] = True
            continue
        got, last = merged(list(text), number, rank)
        if got == [text]:
            usable[i], left[i], right[i] = True, number[last[0]], number[last[1]]
    bytes_of = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces(texts, rank, left, right, usable, bytes_of, number)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` codes from each, by prefix doubling."""
    found = np.unique(codes)
    rank = np.searchsorted(found, codes).astype(np.int64)
    step = 1
    while True:
        follow = np.zeros_like(rank)
        if step < len(codes):
            follow[:-step] = rank[step:] + 1
        key = rank * (len(codes) + 2) + follow
        order = np.argsort(key)
        step *= 2
        if step >= depth:
            return order
        moved = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(moved[1:] != moved[:-1])])


class Matcher:
    """Encodes segments; remembers which pairs of pieces may be neighbours."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.ids = np.flatnonzero(pieces.usable)
        words = [pieces.texts[i] for i in self.ids]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.depth = int(self.lengths.max())
        self.codes = np.full((len(words), self.depth), -1, dtype=np.int64)
        for row, w in zip(self.codes, words, strict=True):
            row[: len(w)] = [ord(c) for c in w]
        self.length_of = np.ones(len(pieces.texts), dtype=np.int64)
        self.length_of[self.ids] = self.lengths
        n = len(pieces.texts)
        pairs, ranks = [], []
        for i in np.flatnonzero((pieces.rank < NEVER)).tolist():
            t = pieces.texts[i]
            for k in range(1, len(t)):
                a, b = pieces.number.get(t[:k]), pieces.number.get(t[k:])
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    ranks.append(pieces.rank[i])
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.n = np.array(pairs, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order], n

    def joint_rank(self, a, b):
        """The rank at which two pieces merge, or NEVER."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave pieces a and b side by side.

        Goes back in time along the border: what lies at it changes when the
        later-made of the two was merged. Before that, the two parts then at
        the border must not have merged with each other; of equal ranks the
        leftmost merge comes first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        until = np.full(len(a), NEVER)
        live = np.arange(len(a))
        rank, left, right = self.p.rank, self.p.left, self.p.right
        while len(live):
            x, y = a[live], b[live]
            clash = self.joint_rank(x, y) < until[live]
            good[live[clash]] = False
            live = live[~clash]
            x, y = a[live], b[live]
            made_x = np.where(left[x] >= 0, rank[x], -1)
            made_y = np.where(left[y] >= 0, rank[y], -1)
            back_y = made_y >= made_x  # of equal ranks the left one was made first, so the right one is undone first
            done = (made_x < 0) & (made_y < 0)
            at_y, at_x = live[back_y & ~done], live[~back_y & ~done]
            until[at_y] = rank[b[at_y]] + 1
            b[at_y] = left[b[at_y]]
            until[at_x] = rank[a[at_x]]
            a[at_x] = right[a[at_x]]
            live = live[~done]
        return good

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of each occurrence of each usable piece."""
        order = suffix_array(codes, self.depth)
        padded = np.concatenate([codes, np.full(self.depth, BORDER)])

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order), np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    return low
                mid = (low[open_] + high[open_]) // 2
                suffix = padded[order[mid][:, None] + np.arange(self.depth)]
                piece = self.codes[open_]
                differ = (suffix != piece) & (piece >= 0)
                first = differ.argmax(axis=1)
                row = np.arange(len(open_))
                less = np.where(differ[row, first], suffix[row, first] < piece[row, first], upper)
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)

        low, high = bound(False), bound(True)
        return order[spread(low, high - low)], np.repeat(self.ids, high - low)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each segment's number of ids."""
        text = "".join(segments)
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = np.arange(len(segments)) + np.cumsum(sizes) - sizes
        codes = np.full(len(chars) + len(segments), BORDER, dtype=np.int64)
        codes[spread(starts, sizes)] = chars
        start, piece = self.edges(codes)
        letters = np.flatnonzero(codes != BORDER)
        known = np.zeros(len(codes), dtype=bool)
        known[start[self.length_of[piece] == 1]] = True
        strange = letters[~known[letters]]  # letters that aren't pieces: edges of their own, with id 0
        start, piece = np.concatenate([start, strange]), np.concatenate([piece, np.zeros(len(strange), np.int64)])
        end = start + self.length_of[piece]
        origin = np.repeat(starts, sizes + 1)
        depth = end - origin[start]
        order = np.argsort(depth)
        start, piece, end, depth = start[order], piece[order], end[order], depth[order]
        last = np.full(len(codes) + 1, -1, dtype=np.int64)  # the piece that ends before a position; -2: a segment's start
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[starts] = True
        cuts = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            free = first[s] | (p == 0) | (before == 0)
            test = np.flatnonzero(~free & (before > 0))
            ok = free & (first[s] | (before >= 0))
            if len(test):
                key, back = np.unique(before[test] * self.n + p[test], return_inverse=True)
                ok[test] = self.neighbours(key // self.n, key % self.n)[back]
            last[e[ok]] = p[ok]
        at, rounds = starts + sizes, []
        who = np.flatnonzero(sizes)
        at = at[who]
        while len(who):
            p = last[at]
            rounds.append((who, p, at - self.length_of[p]))
            at = at - self.length_of[p]
            more = at > starts[who]
            who, at = who[more], at[more]
        owner, ids, where = (np.concatenate([r[k] for r in rounds]) if rounds else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(where, kind="stable")
        owner, ids, where = owner[order], ids[order], where[order]
        counts = np.bincount(owner, minlength=len(segments)).astype(np.int64)
        if (ids == 0).any():
            at = np.flatnonzero(ids == 0)  # only these become the ids of their bytes
            kinds, which = np.unique(codes[where[at]], return_inverse=True)
            raw = [[self.p.bytes_of[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
            wide = np.ones(len(ids), dtype=np.int64)
            wide[at] = np.array([len(r) for r in raw], dtype=np.int64)[which]
            ends = np.cumsum(counts)
            total = np.concatenate([[0], np.cumsum(wide)])
            counts = total[ends] - total[ends - counts]
            ids = np.repeat(ids, wide)
            ids[spread(total[at], wide[at])] = np.array([i for k in which.tolist() for i in raw[k]], dtype=np.int64)
        return ids, counts

    def encode_run(self, segment: str) -> list[int]:
        """One segment, merged step by step."""
        out = []
        for s in merged(list(segment), self.p.number, self.p.rank)[0]:
            i = self.p.number.get(s)
            out += [i] if i is not None else [self.p.bytes_of[b] for b in s.encode("utf-8", "surrogatepass")]
        return out


class Encoder:
    """Ids of whole texts; each distinct segment is matched once.

    A mark behind a letter is cut off first where no piece of the model has
    the two side by side, so that a word is matched once for all its marks.
    """

    def __init__(self, model: str):
        p = load(model)
        self.matcher = Matcher(p)
        joined = {t[k] for t in p.number for k in range(1, len(t)) if t[k - 1].isalpha()}
        self.coder = StemCoder(self.encode_stems, {m: p.number[m] for m in MARKS if m in p.number and m not in joined}, fold=False)

    def encode_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each stem's number of ids."""
        run = np.array([s.startswith(BLANK * 2) for s in stems], dtype=bool)
        counts = np.zeros(len(stems), dtype=np.int64)
        ids, counts[~run] = self.matcher.encode([s for s, r in zip(stems, run.tolist(), strict=True) if not r])
        runs = [self.matcher.encode_run(stems[k]) for k in np.flatnonzero(run).tolist()]
        counts[run] = [len(r) for r in runs]
        starts = np.zeros(len(stems), dtype=np.int64)
        order = np.argsort(run, kind="stable")
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([ids, np.array([i for r in runs for i in r], dtype=np.int64)]).astype(np.int32)[spread(starts, counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids.

        A segment is a part between blanks with the blanks before it; a part
        without letters only counts as one if it is its text's last.
        """
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, type=pa.string()), BLANK, " "), " ")
        n = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        part, ends = parts.flatten(), np.cumsum(n)
        counts = pc.utf8_length(part).to_numpy(zero_copy_only=False) > 0
        counts[ends - 1] = np.array([bool(t) for t in texts], dtype=bool)  # an empty text has none
        at = np.flatnonzero(counts)
        owner = np.searchsorted(ends, at, side="right")
        before = np.concatenate([[-1], at])[:-1]
        blanks = at - np.maximum(before, (ends - n)[owner] - 1)
        coded = part.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)[at].copy()
        more = np.flatnonzero(blanks > 1)
        longer = [BLANK * int(blanks[k]) + part[int(at[k])].as_py() for k in more.tolist()]
        which[more] = len(coded.dictionary) + np.arange(len(more))
        ids, sizes = self.coder.ids_of(pa.array([*(BLANK + w for w in coded.dictionary.to_pylist()), *longer], type=pa.string()))
        lengths = sizes[which]
        totals = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.bincount(owner, minlength=len(texts)))]
        return ids[spread((np.cumsum(sizes) - sizes)[which], lengths)].astype(np.int32), np.diff(totals, prepend=0)


def encoder(model: str) -> Encoder:
    """One for the tasks of a stage in a worker process, so that tasks after the first find most stems known."""
    return remembered(("segments", model), lambda: Encoder(model))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, n_ids, ids_crc32): the library's ids of every whole text.

    Null texts count as empty and have no ids; repeated rows are encoded each;
    a null id stays null; other columns are ignored.
    """

    def run(batches):
        coder = encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in chunks([len(t) for t in texts]):
                ids, sizes = coder.encode(texts[s])
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], batch.column(1)[s], lists, pa.array(sizes, type=pa.int64()), pa.array(crcs, type=pa.int64())], names=["id", "text", "ids", "n_ids", "ids_crc32"])

    load(model)
    return in_arrow(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, f"{id_col} long, {text_col} string, ids array<int>, n_ids long, ids_crc32 long")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its ids replaced by ``decoded``, the text they stand for.

    The blank that encoding puts in front goes. Malformed bytes become U+FFFD;
    null ids give a null text. Control and unknown ids give nothing.
    """
    keep = [c for c in encoded.columns if c != ids_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids_col)

    def run(batches):
        p = load(model)
        value = {i: bytes([b]) for b, i in enumerate(p.bytes_of)} | {i: t.replace(BLANK, " ").encode() for t, i in p.number.items()}
        raw = [value.get(i, b"") for i in range(len(p.texts))]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        starts, buffer = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(raw), dtype=np.uint8)
        for batch in batches:
            lists = batch.column(len(keep))
            sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)
            nulls = lists.is_null().to_pylist()
            ids, texts, begin = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), [], 0
            for s in chunks(sizes.tolist(), 1_000_000):
                own = ids[begin : begin + int(sizes[s].sum())]
                begin += len(own)
                text = buffer[spread(starts[own], lengths[own])].tobytes()
                ends = np.concatenate([[0], np.cumsum(lengths[own])])[np.cumsum(sizes[s])]
                texts += [text[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            texts = [None if null else t for t, null in zip(texts, nulls, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, type=pa.string())], names=[*keep, "decoded"])

    return in_arrow(encoded.select(*keep, ids_col), run, f"{fields}, decoded string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", "n_ids", "ids_crc32", F.crc32("decoded").alias("decoded_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
