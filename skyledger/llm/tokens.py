"""Token ids of whole texts, and a word-aligned binary format for them (Simple-8b).

Encoding: each 64-bit little-endian word holds a selector in its top four bits and as many
ids of equal width as fit into the other 60. Selector 15 is an escape: its other bits hold
one id that no selector has room for. File: ``S8B1``, then blocks. A block holds whole documents and
begins with ``u32 documents, u32 ids, u32 words``, then the doc_ids (i64; the smallest value
stands for null), the ids per document (u32) and the words. The manifest keeps the offset of
every block, so blocks can be read alone, and a block is decoded selector by selector with
array operations.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm import common

#: Ids per word and bits per id of selectors 0 to 14. Fixed values of the format.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
#: Selectors in use for ids: zeros and the one-bit word are rare in text but legal.
MAGIC = b"S8B1"
NULL_ID = -(1 << 63)
#: Ids that a block holds at most, unless one document has more.
BLOCK_IDS = 1 << 16
#: Spans whose ids a worker remembers; then it starts anew.
CACHE_SPANS = 300_000


#: Classes of bytes between which every pre-tokenization in use cuts: letters, digits and
#: marks that begin no contraction. Letters are those of ASCII and two-byte Latin-1 ones.
_OTHER, _LETTER, _DIGIT, _MARK = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[list(b".,!?%&*$#|:;")] = _MARK
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_STEM = re.compile("( ?)[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the UTF-8 bytes of a character.

    Printable bytes stand for themselves; the others, in order, for the letters from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x100)}


class CachedTokenizer:
    """Ids of texts by the tokenizers library, which sees each distinct span of text once.

    Texts are cut into spans only where the tokenizer's own pre-tokenization always cuts, so
    the ids of the spans joined are the ids of the whole text: at ASCII white space if its
    normalizer drops white space (``drops_space``), else before a space or line end with a letter or digit
    after it; and between plain letters, digits and marks. Spans are found by 64-bit hashes.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = Tokenizer.from_file(path), drops_space
        parts = json.loads(self.tokenizer.to_str())
        kinds = json.dumps([parts["normalizer"], parts["pre_tokenizer"]])
        self.lowers = '"Lowercase"' in kinds
        self.plain = parts["model"]["type"] == "BPE" and '"ByteLevel"' in kinds
        self.special = [t["content"].encode() for t in parts["added_tokens"]]
        self.letters = _byte_letters()
        self._clear()

    def _clear(self):
        self.count, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        # An open hash table; slot numbers are the top bits of a hash, 0 marks a free slot.
        self.bits = 16
        self.keys, self.places = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of known spans, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        mask = (1 << self.bits) - 1
        while len(left):
            there = self.keys[slot]
            same = there == hashes[left]
            out[left[same]] = self.places[slot[same]]
            go = ~same & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray):
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        mask = (1 << self.bits) - 1
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            chosen = free[one]
            self.keys[taken] = hashes[left[chosen]]
            self.places[taken] = numbers[left[chosen]]
            go = np.ones(len(left), bool)
            go[chosen] = False
            left, slot = left[go], (slot[go] + 1) & mask

    def _learn(self, hashes: np.ndarray, spans: list[bytes]):
        ids: list[list[int]] = []
        hard = []
        for k, span in enumerate(spans):
            text = span.decode()
            if self.plain and _STEM(text):
                # Plain letters, maybe after a space, are one piece for the merges.
                ids.append([t.id for t in self.tokenizer.model.tokenize(text.translate(self.letters))])
            else:
                hard.append((k, text))
                ids.append([])
        if hard:
            encoded = self.tokenizer.encode_batch_fast([t for _, t in hard], add_special_tokens=False)
            for (k, _), e in zip(hard, encoded):
                ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, new, total = self.count, len(spans), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + new > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        self.length[n : n + new] = sizes
        self.first[n : n + new] = self.used + np.cumsum(sizes) - sizes
        self.count, self.used = n + new, self.used + total
        if self.count * 2 > len(self.keys):
            old = self.keys != 0
            keys, places = self.keys[old], self.places[old]
            self.bits = (4 * self.count).bit_length()
            self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._insert(keys, places)
        self._insert(hashes, np.arange(n, n + new))

    def _spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the spans of some texts, ascending."""
        n = len(raw)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] != _OTHER) & (kind[:-1] != _OTHER)
        if self.drops_space:
            blank = (raw == 0x20) | (raw == 0x0A) | (raw == 0x09) | (raw == 0x0D)
            cut[:-1] |= blank
            cut[1:] |= blank
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], n)
            inside = ~blank[starts]
            return starts[inside], ends[inside]
        begins = (kind == _LETTER) | (kind == _DIGIT)
        begins[1:][(raw[:-1] == 0xC3)] = False
        # What a text begins with says nothing about the end of the text before it.
        begins[offsets[offsets < n]] = False
        line = raw[:-1] == 0x0A
        cut[:-2] |= ((raw[:-1] == 0x20) | line) & begins[1:]
        cut[1:-1] |= line & begins[1:]
        starts = np.flatnonzero(cut[:-1])
        return starts, np.append(starts[1:], n)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in one array, and how many there are before each text."""
        if any(t in raw.tobytes() for t in self.special):
            # A special token may reach over cuts: such texts go to the library whole.
            ids = [
                self.tokenizer.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids
                for a, b in zip(offsets.tolist(), offsets[1:].tolist())
            ]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            return flat, np.append(0, np.cumsum(sizes))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.lowers:
            raw = raw.copy()
            raw[(raw >= 0x41) & (raw <= 0x5A)] += 0x20
            after = np.flatnonzero(raw[:-1] == 0xC3) + 1
            raw[after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]] += 0x20
        starts, ends = self._spans(raw, offsets)
        hashes = common.span_hashes(raw, starts, ends) | np.uint64(1)
        number = self._find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, one = np.unique(hashes[missing], return_index=True)
            if self.count + len(new) > CACHE_SPANS:
                self._clear()
                missing = np.arange(len(hashes))
                new, one = np.unique(hashes, return_index=True)
            picked = missing[one]
            data = raw.tobytes()
            self._learn(new, [data[a:b] for a, b in zip(starts[picked].tolist(), ends[picked].tolist())])
            number[missing] = self._find(hashes[missing])
        first, length = self.first[number], self.length[number]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        flat = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], length)]
        return flat, total[np.searchsorted(starts, offsets)]

    def encode_all(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """The ids of each text as uint32, with ``end`` appended."""
        raw, offsets = common.text_buffers(texts)
        out, extra = [], end is not None
        for a, b in common.chunks(offsets):
            flat, places = self._encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if extra:
                flat = np.insert(flat, places[1:], end)
                places = places + np.arange(len(places))
            out.extend(flat[x:y] for x, y in zip(places.tolist(), places[1:].tolist()))
        return out


_TOKENIZERS: dict[tuple[str, bool], CachedTokenizer] = {}


def cached_tokenizer(path: str, drops_space: bool) -> CachedTokenizer:
    """The worker's own tokenizer; its words stay known to later tasks of the worker."""
    key = (path, drops_space)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = CachedTokenizer(path, drops_space)
    return _TOKENIZERS[key]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 32-bit ids; each word takes as many ids as it can."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    values = ids.astype(np.uint64)
    if int(values.max()) >= 1 << 32:
        raise ValueError("ids must be below 2^32")
    bits = np.zeros(n, np.int64)
    some = values > 0
    bits[some] = np.floor(np.log2(values[some].astype(np.float64))).astype(np.int64) + 1
    # For each selector: does a word that starts here hold only ids narrow enough? The last
    # word of a block may be padded, so places past the end count as fitting.
    choice = np.full(n, ESCAPE, np.int8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        wide = np.zeros(n + 1, np.int64)
        np.cumsum(bits > width, out=wide[1:])
        ends = np.minimum(np.arange(n) + count, n)
        choice[wide[ends] == wide[:-1]] = selector
    taken = np.array([*COUNTS, 1], np.int64)[choice]
    # The chain of words: from each start to the next one.
    following = (np.arange(n) + taken).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = following[at]
    first = np.array(starts, np.int64)
    selectors = choice[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            words[mine] |= values[first[mine]]
            continue
        width = WIDTHS[selector]
        if not width:
            continue
        for k in range(COUNTS[selector]):
            there = first[mine] + k
            inside = there < n
            words[mine[inside]] |= values[there[inside]] << np.uint64(k * width)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of some words, with one array operation per selector and place."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    taken = np.array([*COUNTS, 1], np.int64)[selectors]
    first = np.cumsum(taken) - taken
    out = np.zeros(int(taken.sum()), np.uint32)
    for selector in np.unique(selectors).tolist():
        mine = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[first[mine]] = (words[mine] & np.uint64((1 << 60) - 1)).astype(np.uint32)
            continue
        width = WIDTHS[selector]
        mask = np.uint64((1 << width) - 1)
        for k in range(COUNTS[selector] if width else 0):
            out[first[mine] + k] = ((words[mine] >> np.uint64(k * width)) & mask).astype(np.uint32)
    return out[:n]


def _block(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    words = pack(flat)
    return (
        struct.pack("<III", len(doc_ids), len(flat), len(words))
        + np.array(doc_ids, "<i8").tobytes()
        + np.array([len(x) for x in ids], "<u4").tobytes()
        + words.astype("<u8").tobytes()
    )


MANIFEST = "shard int, number int, file string, documents bigint, ids bigint, bytes bigint, sha256 string, blocks array<bigint>"


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end: int,
    drops_space: bool,
    shard_bytes: int = 8 << 20,
    file_bytes: int = 16 << 20,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Write the ids of ``doc_id, text`` in ascending doc_id order, files in shards.

    A file is closed by the block that takes it past ``file_bytes``.

    A null text is empty and has the end id alone. Documents without doc_id come first.
    Equal doc_ids are ordered by text. No rows: no files. Other columns are ignored. Returns the
    manifest, a written table that also commits the write.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = common.range_cuts(rows, "doc_id", F.octet_length("text").cast("bigint") + F.lit(16), shard_bytes)
    fs, base = common.store(folder)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_tokenizer(tokenizer, drops_space)
        fs, base = common.store(folder)
        schema = pa.schema([
            ("shard", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()),
            ("bytes", pa.int64()), ("sha256", pa.string()), ("blocks", pa.list_(pa.int64())),
        ])
        state = {"shard": None}

        def begin(shard, number):
            state.update(shard=shard, number=number, data=[MAGIC], size=len(MAGIC), blocks=[], docs=0, total=0, ids=[], held=0, names=[])

        def flush():
            if state["names"]:
                block = _block(state["names"], state["ids"])
                state["blocks"].append(state["size"])
                state["data"].append(block)
                state["size"] += len(block)
                state["docs"] += len(state["names"])
                state["total"] += state["held"]
                state.update(names=[], ids=[], held=0)

        def close():
            if state["shard"] is None:
                return None
            flush()
            data, name = b"".join(state["data"]), f"ids-{state['shard']:06d}-{state['number']:05d}.s8b"
            common.commit_file(fs, f"{base}/{name}", data)
            row = (state["shard"], state["number"], name, state["docs"], state["total"], len(data), hashlib.sha256(data).hexdigest(), state["blocks"])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            shards = batch.column("shard").to_pylist()
            names = batch.column("doc_id").to_pylist()
            encoded = encoder.encode_all(batch.column("text"), end)
            for shard, name, ids in zip(shards, names, encoded):
                if shard != state["shard"] or state["size"] >= file_bytes:
                    number = state["number"] + 1 if shard == state["shard"] else 0
                    if (done := close()) is not None:
                        yield done
                    begin(shard, number)
                if state["held"] and state["held"] + len(ids) > block_ids:
                    flush()
                state["names"].append(NULL_ID if name is None else name)
                state["ids"].append(ids)
                state["held"] += len(ids)
        if (done := close()) is not None:
            yield done

    manifest = (
        rows.withColumn("shard", common.shard_of("doc_id", cuts))
        .repartition(len(cuts) + 1, "shard")
        .sortWithinPartitions("shard", "doc_id", "text")
        .select("shard", "doc_id", "text")
        .mapInArrow(write, MANIFEST)
    )
    manifest.write.parquet(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, folder: str, *, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) per document, from the files.

    ``start`` counts the ids of all documents before. The running sum is over one row per
    file; the rows of a file are read block by block, one block in memory.
    """
    before = F.sum("ids").over(Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "number", "file", "bytes", "blocks", F.coalesce(before, F.lit(0)).alias("base"))
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if keep_ids:
        schema, kinds = [*schema, ("ids", pa.list_(pa.int64()))], kinds + ", ids array<bigint>"
    schema = pa.schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["base"]
                with fs.open_input_file(f"{base}/{row['file']}") as stream:
                    if stream.size() != row["bytes"] or stream.read(4) != MAGIC:
                        raise ValueError(f"{row['file']} is not the file of the manifest")
                    for offset in row["blocks"]:
                        stream.seek(offset)
                        n_docs, n_ids, n_words = struct.unpack("<III", stream.read(12))
                        names = np.frombuffer(stream.read(8 * n_docs), "<i8")
                        sizes = np.frombuffer(stream.read(4 * n_docs), "<u4").astype(np.int64)
                        ids = unpack(np.frombuffer(stream.read(8 * n_words), "<u8"), n_ids)
                        ends = np.cumsum(sizes)
                        parts = [ids[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
                        columns = {
                            "doc_id": pa.array(names, mask=names == NULL_ID), "start": start + ends - sizes,
                            "n_tokens": sizes, "ids_crc32": [crc_of(p) for p in parts],
                        }
                        if keep_ids:
                            columns["ids"] = [p.tolist() for p in parts]
                        yield common.batch_of(columns, schema)
                        start += n_ids

    return files.repartition(max(1, manifest.count()), "file").mapInArrow(read, kinds)
