"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of CHUNK code points that run OVERLAP into the next one. Each chunk is split into pre-tokens by itself,
as if nothing stood before it. Neighbours are stitched at the first pre-token boundary that both have: the pattern looks
ahead but never back, so from a common boundary on both agree. The last pre-tokens of a chunk that the text goes on behind count for
nothing (UNSURE): those the rest of the text could change. The pieces are then merged by rank. Decoding concatenates the raw bytes
of the ids.

The chunks of a text follow each other through the task that has the text: its pre-tokens and ids exist for a few
chunks at a time only, whatever its length. (Dealing the chunks over other tasks and back would shuffle all texts twice.)
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light, small_batches

#: Code points in a chunk, and how far a chunk runs into the next one.
CHUNK, OVERLAP = 1 << 10, 1 << 7
#: Pre-tokens before a cut that later text may change. The last may grow; and the one before it, where the last is what a longer
#: match would have taken along (an apostrophe before half of its ending, white space before a line end).
UNSURE = 2
#: Entries of a task's pre-token cache; when full it is emptied. It changes speed only.
CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: again and again the adjacent pair of lowest rank (the leftmost of equals) becomes one."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + (1 << 30)
    get = ranks.get
    order = [get(a + b, none) for a, b in pairwise(parts)]
    while order:
        best = min(order)
        if best == none:
            break
        i = order.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del order[i]
        if i < len(order):
            order[i] = get(parts[i] + parts[i + 1], none)
        if i:
            order[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of (rank, place) over a linked list of spans; entries gone stale are skipped."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Pattern, ranks and a bounded cache from pre-token to its ids as text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.cache = ranks, regex.compile(pattern).findall, {}
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}

    def split(self, piece: str, ends: bool) -> list[str]:
        """The pre-tokens of a piece of text by itself; without the unsure ones, unless the text ``ends`` with it."""
        tokens = self.find(piece)
        if sum(map(len, tokens)) != len(piece):
            raise ValueError("the pattern must cover all of a text")
        return tokens if ends else tokens[:-UNSURE]

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """All pre-tokens of a text in order, a run for each chunk."""
        held: list[str] = []  # split already, but ending behind the next chunk's start: the chunks agree on them first
        at = 0  # where they begin
        for start in range(0, max(1, len(text)), CHUNK):
            stop = start + CHUNK
            own = self.split(text[start : stop + OVERLAP], stop + OVERLAP >= len(text))
            out, tokens, at = stitch(held, at, own, start)
            if tokens is None:  # no boundary that both have: what is held is sure, and the text is split anew from its end
                tokens = self._anew(text, at, stop)
            # tokens go on from ``at``; those that end by the next chunk's start are done
            size = 0
            total = sum(map(len, tokens))
            while size < len(tokens) and stop < len(text) and at + total > stop:
                size += 1
                total -= len(tokens[-size])
            done = len(tokens) - size
            yield out + tokens[:done]
            at, held = at + total, tokens[done:]
        yield held

    def _anew(self, text: str, at: int, stop: int) -> list[str]:
        """Sure pre-tokens from the boundary ``at`` until one ends at or behind ``stop`` (or the text does)."""
        out, size = [], CHUNK + OVERLAP
        while at < min(stop, len(text)):
            found = self.split(text[at : at + size], at + size >= len(text))
            out += found
            at += sum(map(len, found))
            size = CHUNK + OVERLAP if found else 2 * size  # a pre-token longer than the piece: look further
        return out

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def _written(self, token: str) -> str:
        """The decimal ids of a pre-token, joined by spaces: what the cache holds."""
        if (hit := self.cache.get(token)) is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            hit = self.cache[token] = " ".join(map(str, merge(token.encode(), self.ranks)))
        return hit

    def _runs(self, text: str) -> Iterator[str]:
        """The decimal ids of a text, joined by spaces, a run for a few chunks."""
        get, own, run = self.cache.get, self._written, []
        for tokens in self.pretokens(text):
            run += [get(t) or own(t) for t in tokens]
            if len(run) >= 4096:
                yield " ".join(run)
                run = []
        if run:
            yield " ".join(run)

    def ids(self, text: str) -> np.ndarray:
        out = [np.fromstring(run, np.int32, sep=" ") for run in self._runs(text)]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, sha256 of the decimal ids joined by spaces, sha256 of the bytes that the ids decode to."""
        ids_hash, text_hash, n, bytes_of = hashlib.sha256(), hashlib.sha256(), 0, self.bytes_of
        for run in self._runs(text):
            ids_hash.update(((" " if n else "") + run).encode())
            ids = run.split(" ")
            n += len(ids)
            text_hash.update(b"".join([bytes_of[i] for i in ids]))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def stitch(held: list[str], at: int, own: list[str], start: int) -> tuple[list[str], list[str] | None, int]:
    """Where two chunks resynchronise: (pre-tokens of the earlier one up to there, those of the later one from there, the place).

    ``held`` begin at the boundary ``at``, ``own`` at ``start``; without a common boundary the second is None and all of ``held`` come first.
    """
    if at == start:  # the text's start, or a boundary of the earlier chunk where the later one begins
        return [], own, at
    ends = {end: k for k, end in enumerate(accumulate(map(len, held), initial=at)) if end >= start}
    last, end = max(ends, default=start), start
    for k, token in enumerate([*own, ""]):
        if end in ends:
            return held[: ends[end]], own[k:], end
        if end > last:
            break
        end += len(token)
    return held, None, at + sum(map(len, held))


def _codec(shared) -> Codec:
    """A task's codec, built from the broadcast vocabulary; it goes when the task ends."""
    return Codec(*shared.value)


#: What an encoder makes of a text: Spark columns, Arrow fields, function.
DIGEST = ("n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], Codec.digest)
IDS = ("n_tokens long, ids array<int>", [pa.int64(), pa.list_(pa.int32())], lambda codec, text: (len(found := codec.ids(text)), found))


def _rows(keep: pa.Table | pa.RecordBatch, found: list[tuple], form: tuple) -> list[pa.Array]:
    """The kept columns and those of ``found``."""
    columns = list(zip(*found)) if found else [()] * len(form[1])
    return [*keep.columns, *[_lists(c) if pa.types.is_list(t) else pa.array(c, t) for c, t in zip(columns, form[1])]]


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, form: tuple = IDS) -> DataFrame:
    """``keep``, n_tokens and ids (or digests): one row per row of ``docs`` (text and ``keep``); null texts are empty.

    The vocabulary at ``ranks_path`` is read on the driver and broadcast: its size is fixed (about 50,000 ranks). No special
    tokens: their strings in a text are ordinary text. Repeated rows and null ids give one row each.
    """
    made = [c.split(" ")[0] for c in form[0].split(", ")]
    if clash := {c.lower() for c in keep} & set(made):
        raise ValueError(f"columns to keep have names of columns to make: {sorted(clash)}")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    asked, kinds = keep, [docs.schema[c].dataType.simpleString() for c in keep]
    keep = [f"k{i}" for i in range(len(keep))]  # names that can't clash with those used on the way
    texts = docs.select(*[F.col(c).alias(k) for c, k in zip(asked, keep)], F.coalesce("text", F.lit("")).alias("_text"))
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for part in light(batches, "_text"):
            found = [form[2](codec, t) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(_rows(part.select(keep), found, form), names)

    kept = [f"{k} {kind}" for k, kind in zip(keep, kinds)]
    encoded = texts.mapInArrow(run, ", ".join([*kept, form[0]]))
    return encoded.select(*[F.col(k).alias(c) for c, k in zip(asked, keep)], *made)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids (null ids: null); bytes that are no UTF-8 become replacement marks.

    The column ``text`` must be new. Repeated rows and an empty table come through as they are.
    """
    if text.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"there is a column {text!r} already")
    shared = encoded.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            out = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{text}` string")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The tokenising digest of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, ["doc_id"], ranks_path, pattern, DIGEST)


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
