"""Packing documents into training sequences of several lengths.

Each document goes to the smallest context tier that holds what is left of it
after its full windows. Tiers are packed from the longest down: a window opens
with the longest waiting piece, its gap takes the best-fitting pieces of
shorter tiers, and the last bit of gap is cut from the next piece. Windows are
therefore full; only what is left at the end of a partition is split by powers
of two. Sequences are then dealt to step groups, tier by tier and each to the
emptiest group, so that groups have equal tokens and the same mix of tiers.

Packing is local to a partition, so there is no shuffle, a lost task is simply
run again, and a worker holds one chunk of documents, less than one window of
leftovers, and the lengths of the sequences that wait for their group.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import StemCoder, chunks, in_arrow, remembered, spread, table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 64 * 2048
#: So many groups' worth of sequences are dealt at once.
GROUPS_AT_ONCE = 32
#: Words in a line for the tokenizer, and marks that it parts from letters.
LINE, MARKS = 256, (".", ",")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Ids of whole texts by those of their distinct words.

    Right for tokenizers that lower-case, drop white space, never join what it
    parts, and part a mark from the letters before it.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.coder = StemCoder(self.encode_stems, {m: e.ids[0] for m, e in zip(MARKS, self.batch(list(MARKS)), strict=True)}, fold=True)

    def encode_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each stem's number of ids.

        Stems of letters go to the tokenizer in long lines: the ids that end a
        word part them again. A line where those don't add up, and other
        stems, are encoded one by one.
        """
        plain = [k for k, w in enumerate(stems) if w.isalpha()]
        lengths = np.zeros(len(stems), dtype=np.int64)
        owners, found, rest = [], [], [k for k, w in enumerate(stems) if not w.isalpha()]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        for line, e in zip(lines, self.batch([" ".join([stems[k] for k in line]) for line in lines]), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                lengths[line] = np.diff(ends, prepend=0)
                owners += line
                found.append(ids)
            else:
                rest += line
        for k, e in zip(rest, self.batch([stems[k] for k in rest]), strict=True):
            lengths[k] = len(e.ids)
            owners.append(k)
            found.append(np.array(e.ids, dtype=np.uint32))
        starts = np.zeros(len(stems), dtype=np.int64)
        starts[owners] = np.cumsum(lengths[owners]) - lengths[owners]
        return np.concatenate(found)[spread(starts, lengths)], lengths

    def batch(self, lines: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, ``end_id`` after each text, and each text's number of ids with it."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, type=pa.string()), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        ids, sizes = self.coder.ids_of(words.dictionary)
        at = words.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[at]
        body = ids[spread((np.cumsum(sizes) - sizes)[at], lengths)].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]
        return np.insert(body, ends, np.uint32(end_id)), np.diff(ends, prepend=0) + 1


def word_tokenizer(path: str) -> WordTokenizer:
    """One for the tasks of a stage in a worker process, so that tasks after the first find most stems known."""
    return remembered(("words", path), lambda: WordTokenizer(path))


def pack(pieces: list[tuple], tiers=TIERS) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Full windows, each (tier, pieces), and the pieces left over (less than one window).

    A piece is (length, key, start): ``length`` tokens of what ``key`` names
    from its token ``start``. Longest pieces first; ties by key and start.
    """
    top, done, pool = tiers[0], [], []
    for length, key, start in pieces:
        while length >= top:
            done.append((top, [(top, key, start)]))
            start, length = start + top, length - top
        if length:
            pool.append((length, key, start))
    pool.sort()
    for t, tier in enumerate(tiers):
        least = tiers[t + 1] if t + 1 < len(tiers) else 0
        while pool and pool[-1][0] > least:
            window, gap = [], tier
            while gap and pool:
                at = bisect.bisect_right(pool, (gap, float("inf"), 0))
                if at:
                    window.append(pool.pop(at - 1))
                else:  # every waiting piece is longer: cut the shortest
                    length, key, start = pool.pop(0)
                    window.append((gap, key, start))
                    bisect.insort(pool, (length - gap, key, start + gap))
                gap -= window[-1][0]
            if gap:
                return done, window
            done.append((tier, window))
    return done, []


def powers(pieces: list[tuple]) -> list[tuple[int, list[tuple]]]:
    """Leftovers as sequences whose lengths are powers of two, so that none is padded."""
    left, out = list(pieces), []
    total = sum(p[0] for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        gap, window = size, []
        while gap:
            length, key, start = left.pop(0)
            used = min(gap, length)
            window.append((used, key, start))
            if used < length:
                left.insert(0, (length - used, key, start + used))
            gap -= used
        out.append((size, window))
        total -= size
    return out


def deal(sizes: list[int], step_tokens: int) -> list[int]:
    """The group of each sequence: as many groups as ``step_tokens`` fit best, filled evenly; longest sequences first."""
    fill = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        tokens, out[k] = fill[0]
        heapq.heapreplace(fill, (tokens + sizes[k], out[k]))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence; see ``SCHEMA``.

    ``tokenizer`` is the path of a word-bounded tokenizer file. A null or empty
    text has the end id alone; a very long one is cut at windows; repeated rows
    are packed once each; a null id stays null; ties go by order in the
    partition; an empty table gives no rows; other columns are ignored. Groups
    are a partition's own: within one they differ by less than a window.
    """
    tiers = tuple(sorted(tiers, reverse=True))

    def run(batches):
        part, words = TaskContext.get().partitionId(), word_tokenizer(tokenizer)
        seen, key, carried, held = 0, 0, [], {}
        waiting, groups, tokens = [], 0, 0  # sequences as (length, their rows)

        def settle(windows):
            """Pieces of finished sequences as rows that wait for a group; their ids are dropped."""
            nonlocal seen, tokens
            for tier, window in windows:
                offset, rows = 0, []
                for length, k, start in window:
                    doc, ids, base = held[k]
                    crc = zlib.crc32(ids[start - base : start - base + length].tobytes())
                    rows.append((doc[0], start, length, crc, doc[1], (part << 40) | seen, offset, tier))
                    offset += length
                waiting.append((offset, rows))
                seen, tokens = seen + 1, tokens + offset

        def flush():
            nonlocal groups, tokens
            dealt = deal([n for n, _ in waiting], step_tokens)
            out = [(*row, (part << 40) | (groups + g)) for g, (_, rows) in zip(dealt, waiting, strict=True) for row in rows]
            groups, tokens = groups + max(dealt, default=-1) + 1, 0
            waiting.clear()
            cols = list(zip(*out, strict=True)) or [[]] * 9
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for s in chunks([len(t) for t in texts]):
                ids, sizes = words.encode(texts[s], end_id)
                starts, pieces = np.cumsum(sizes) - sizes, list(carried)
                for name, a, n in zip(names[s], starts.tolist(), sizes.tolist(), strict=True):
                    held[key] = ((name, n), ids[a : a + n], 0)
                    pieces.append((n, key, 0))
                    key += 1
                windows, carried = pack(pieces, tiers)
                settle(windows)
                held = {k: (held[k][0], held[k][1][start - held[k][2] : start - held[k][2] + length].copy(), start) for length, k, start in carried}
                if tokens >= GROUPS_AT_ONCE * step_tokens:
                    yield flush()
        settle(powers(carried))
        yield flush()

    return in_arrow(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
