"""SentencePiece BPE encoding with source spans, and decoding.

The model file is read once on the driver and sent to the workers; normalisation walks the compiled character map by
longest prefix and keeps, for every normalised character, the source bytes it came from, so that each piece has a span
of original UTF-8 bytes. Words are encoded once per worker while they stay in a bounded cache.

Cases: null texts are encoded as empty ones; an empty text has no pieces but the end id, if asked for; very long texts
and words are encoded whole (merges of long words go through a heap); an empty table gives an empty result; the id
column may have any type and may repeat or be null; other columns are left alone.
"""
from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import documents, query

MARK = "▁"
CACHE, BATCH_BYTES, LONG = 250_000, 2 << 20, 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values: piece types of the model format


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield key >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes consumed) of the longest key that starts at `at`."""
        units = self.units
        if not units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = offset(units[0]), None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.strings[start:self.strings.index(b"\0", start)], found[1]


class PieceModel:
    def __init__(self, data: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in wire_fields(data):
            if field == 1:
                entry = dict(wire_fields(value))
                pieces.append((entry[1].decode(), struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0, entry.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normaliser = dict(wire_fields(value))
        if pieces and trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are encoded here")
        if any(kind in (USER, UNUSED) for *_, kind in pieces) or trainer.get(24, 0):
            raise ValueError("models with user-defined or unused pieces, or spaces as suffixes, are not encoded here")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.fallback = bool(trainer.get(35, 0))
        self.ids = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.end = next((k for k, p in enumerate(pieces) if p[0] == trainer.get(47, b"</s>").decode()), -1)
        self.bytes = {int(text[1:-1], 16): k for k, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        order = {score: k for k, score in enumerate(sorted({p[1] for p in pieces if p[2] == NORMAL}, reverse=True))}
        self.rank = {text: order[score] for text, score, kind in pieces if kind == NORMAL}
        unknown_text = trainer.get(44, " ⁇ ".encode())
        self.surface = [b"" if kind == CONTROL else unknown_text if kind == UNKNOWN else bytes([int(text[1:-1], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in pieces]
        self.kind = [p[2] for p in pieces]
        inside = {c for text in self.ids if len(text) > 1 for c in text}
        whole = any(MARK in text.lstrip(MARK) for text in self.ids)
        alone = "" if "\n" in inside else "\n"
        # where no piece can reach over a word start or a line end, the parts between them are encoded on their own
        self.split = None if whole else re.compile(f"[ {MARK}]+[^ {MARK}{alone}]*|[^ {MARK}{alone}]+" + (f"|{alone}" if alone else ""))
        self.plain = not self.map.units and not self.squeeze and self.escape
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and the source byte at which each of its characters starts, then the end."""
        data = text.encode()
        out, align, at, after_space = [], [], 0, self.squeeze
        space = MARK if self.escape else " "

        def step(at):
            found = self.map.longest(data, at)
            if found is None:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at:at + size], size
            return found[0].decode(errors="replace"), found[1]

        while self.squeeze and at < len(data):
            piece, size = step(at)
            if piece != " ":
                break
            at += size
        if at >= len(data):
            return "", [len(data)]
        if self.dummy:
            out.append(space)
            align.append(at)
        while at < len(data):
            piece, size = step(at)
            if after_space:
                piece = piece.lstrip(" ")
            for c in piece:
                out.append(space if c == " " else c)
                align.append(at)
            if piece or not self.squeeze:
                after_space = self.squeeze and piece.endswith(" ")
            at += size
        end = at
        while self.squeeze and out and out[-1] == space:
            out.pop()
            end = align.pop()
        return "".join(out), [*align, end]

    def merge(self, word: str) -> list[str]:
        """BPE: the best pair first, the leftmost of equals, until no neighbours form a piece."""
        rank, parts = self.rank, list(word)
        if len(parts) > LONG:
            return self.merge_long(parts)
        none, rank_of = len(rank), rank.get
        ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = rank_of(parts[k - 1] + parts[k], none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a, b):
            if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, b, len(parts[a]) + len(parts[b])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p]

    def encode_word(self, word: str) -> tuple[list[int], list[int]]:
        """(ids, characters that each covers); a character without a piece becomes its bytes, the last of which covers it."""
        ids, sizes = [], []
        for part in self.merge(word):
            found = self.ids.get(part)
            if found is None and self.fallback:
                spelled = part.encode()
                ids += [self.bytes[b] for b in spelled]
                sizes += [0] * (len(spelled) - 1) + [len(part)]
            elif found is None and ids and ids[-1] == self.unknown:
                sizes[-1] += len(part)
            else:
                ids.append(self.unknown if found is None else found)
                sizes.append(len(part))
        return ids, sizes

    def plain_word(self, word: str, first: bool) -> bytes:
        """(id, source byte length) pairs, as int32 bytes, of a part of a text that no character map changes."""
        shown, lead, pairs = word.replace(" ", MARK), first and self.dummy, []
        if lead or MARK in word:
            ids, sizes = self.encode_word(MARK + shown if lead else shown)
            chars = ([0] if lead else []) + [len(c.encode()) for c in word]
            at = 0
            for k, size in zip(ids, sizes):
                pairs += k, sum(chars[at:at + size])
                at += size
            return array("i", pairs).tobytes()
        known, plain = self.ids.get, word.isascii()
        for part in self.merge(shown):
            k = known(part)
            if k is None:
                spelled = part.encode()
                for byte in spelled[:-1]:
                    pairs += self.bytes[byte], 0
                pairs += self.bytes[spelled[-1]], len(spelled)
            else:  # a mark stands for a space, one byte of the source
                pairs += k, len(part) if plain else len(part.encode()) - 2 * part.count(MARK)
        return array("i", pairs).tobytes()

    def remembered(self, word: str) -> bytes:
        """plain_word with a cache of two generations: words in use move to the young one, the old one is dropped whole."""
        row = self.old.get(word)
        if row is None:
            row = self.plain_word(word, False)
            if len(word) > LONG:
                return row
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = row
        return row

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): the pieces and their spans of source bytes."""
        if self.plain and self.split and self.fallback:
            found = self.split.findall(text)
            if not found:
                return (np.zeros(0, np.int32),) * 3
            rows = [self.plain_word(found[0], True)]
            for word in found[1:]:
                rows.append(self.young.get(word) or self.remembered(word))
            pairs = np.frombuffer(b"".join(rows), np.int32).reshape(-1, 2)
            ends = np.cumsum(pairs[:, 1], dtype=np.int32)
            return pairs[:, 0], np.concatenate([[0], ends[:-1]]).astype(np.int32), ends
        shown, align = self.normalise(text)
        ids, sizes = self.encode_word(shown)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        at = np.array(align, np.int64)[bounds]
        return np.array(ids, np.int32), at[:-1].astype(np.int32), at[1:].astype(np.int32)

    def decode(self, ids) -> str:
        surface = self.surface
        ids = ids.tolist() if hasattr(ids, "tolist") else ids
        data = b"".join([surface[k] for k in ids])
        if self.dummy or self.squeeze:
            first = next((k for k in ids if self.kind[k] != CONTROL), None)
            if first is not None and self.kind[first] == NORMAL:
                data = data.lstrip(b" ") if self.squeeze else data.removeprefix(b" ")
        return data.decode(errors="replace")


@lru_cache(maxsize=2)
def loaded(data: bytes) -> PieceModel:
    return PieceModel(data)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True) -> DataFrame:
    """(id, ids, begins, ends, decoded) for every row: piece ids, their byte spans in the source, and the text the ids give back."""
    with open(model_path, "rb") as file:  # a vocabulary file beside the program, not an input
        model_data = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = loaded(model_data.value)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                found, size, start = [], 0, at
                while at < batch.num_rows and size < BATCH_BYTES:
                    text = texts[at].as_py() or ""
                    ids, begins, ends = model.encode(text)
                    if end_id:
                        last = np.array([ends[-1] if len(ends) else 0], np.int32)
                        ids, begins, ends = np.append(ids, np.int32(model.end)), np.append(begins, last), np.append(ends, last)
                    found.append((ids, begins, ends, model.decode(ids)))
                    size += len(text)
                    at += 1
                bounds = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([x[k] for x in found]))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([names.slice(start, at - start), *lists, pa.array([x[3] for x in found], pa.string())], ["id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(F.col("id").alias("doc_id"), *more, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    return digests(encode_texts(documents(spark, sf_dir), model_path()))
