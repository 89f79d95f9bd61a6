"""Token ids in binary files of patched frame-of-reference blocks.

File format, all numbers little-endian:

    "PFR1"
    blocks, one for every 256 ids (the last is filled up with its minimum):
        minimum u32, width u8, bytes of an exception u8, exceptions u16
        256 offsets from the minimum, their low ``width`` bits packed
        place u8 of each exception, then the bits above ``width`` of each, in so many bytes
    start of each block u64            the block index
    document ids i64 (null ids first, as 0), then ids per document u64
    blocks u64, documents u64, documents with null id u64, ids u64, "PFR1"

``width`` is the bit length of the block's 85th percentile offset (``PERCENTILE``), so a few
large ids do not widen a block; those that do not fit are its exceptions. The index gives
any block in one step: ``read_ids`` reads a range of ids without the rest.

Documents are moved once, into ranges of ascending document id of about ``FILE_BYTES`` of
text. A task encodes its range, with the id of the end of a text appended, and writes it as one
file, as a stream. Every attempt of a task writes a name of its own, and only the files named in
the manifest, which Spark commits, belong to the result: a lost executor leaves no wrong
file. Files go to any store that Arrow's file systems reach.

Encoding is by the tokenizers library. A text is cut before single blanks between words,
where no token crosses, and a worker encodes each distinct piece once (REMEMBERED at a time). New
pieces that begin and end at such cuts go through the library many in one string; the bytes of
each token tell which piece it is of.

Defined results: a null or empty text is its end id alone; rows with one id are ordered by
the text's hash (equal ones are alike), null ids come first; repeated rows are documents of
their own; a table without rows gives no files. Strings of special tokens in a text are
ordinary text. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.session import ensure_checkpoint_dir

from .common import table, text_of, written

BLOCK = 256
PERCENTILE = 85
FILE_BYTES = 1 << 26
MAGIC = b"PFR1"
END_ID = 2
#: Texts are encoded together up to so many bytes, about so many distinct pieces are
#: remembered in a task, and so many from task to task.
TOGETHER, REMEMBERED, KEPT = 1 << 22, 1 << 19, 1 << 17
#: Blanks between two words. No pattern of a byte-level tokenizer takes both the blank and what is before it.
CUT = re.compile(r"(?<=\S)(?= \S)")
NONE, BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
#: Pieces with a cut at both ends: between two of them is a single blank between words again. So many go in one string.
WHOLE, STRUNG = r"(?s)\A [^\s\x0b\x1c-\x1f\x{85}\p{Z}](.*[^\s\x0b\x1c-\x1f\x{85}\p{Z}])?\z", 1 << 10
#: A blank at either end, or beside other white space.
UNEVEN = r"^ | $| [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "


# -- blocks ------------------------------------------------------------------

def packed_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (a multiple of BLOCK), and the size of each in bytes."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint32)
    n = len(rows)
    low = rows.min(axis=1)
    offset = rows - low[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    bound = np.partition(offset, at, axis=1)[:, at].astype(np.uint64)
    width = np.zeros(n, np.int64)
    for b in range(32):
        width += bound >> np.uint64(b) > 0
    high = offset >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width == 32] = 0
    outlier = high > 0
    many = outlier.sum(axis=1)
    largest = high.max(axis=1)
    wide = (largest > 0).astype(np.int64) + (largest >> 8 > 0) + (largest >> 16 > 0) + (largest >> 24 > 0)
    size = 8 + BLOCK // 8 * width + (1 + wide) * many
    start = np.append(0, np.cumsum(size))
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4")[:, None].view(np.uint8)
    head[:, 4], head[:, 5] = width, wide
    head[:, 6:] = many.astype("<u2")[:, None].view(np.uint8)
    out[start[:-1, None] + np.arange(8)] = head
    for b in np.unique(width):
        if b:
            some = np.flatnonzero(width == b)
            bits = np.unpackbits(offset[some].astype("<u4")[:, :, None].view(np.uint8), axis=2, bitorder="little", count=int(b))
            body = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            out[start[some][:, None] + 8 + np.arange(BLOCK // 8 * b)] = body
    block, place = np.nonzero(outlier)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
        first = start[block] + 8 + BLOCK // 8 * width[block]
        out[first + nth] = place
        values = high[block, place].astype("<u4")[:, None].view(np.uint8)
        at = (first + many[block] + wide[block] * nth)[:, None] + np.arange(4)
        used = np.arange(4) < wide[block][:, None]
        out[at[used]] = values[used]
    return out.tobytes(), size


def unpacked_blocks(data: bytes, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``start`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    start = start.astype(np.int64)
    head = raw[start[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint32)
    width, wide = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    many = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    for b in np.unique(width):
        if b:
            some = np.flatnonzero(width == b)
            body = raw[start[some][:, None] + 8 + np.arange(BLOCK // 8 * b)]
            bits = np.unpackbits(body, axis=1, bitorder="little").reshape(len(some), BLOCK, b)
            full = np.packbits(bits, axis=2, bitorder="little")
            padded = np.zeros((len(some), BLOCK, 4), np.uint8)
            padded[:, :, :full.shape[2]] = full
            out[some] = padded.view("<u4")[:, :, 0]
    block = np.repeat(np.arange(len(start)), many)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
        first = start[block] + 8 + BLOCK // 8 * width[block]
        place = raw[first + nth]
        used = np.arange(4) < wide[block][:, None]
        parts = np.zeros(used.shape, np.uint8)
        parts[used] = raw[((first + many[block] + wide[block] * nth)[:, None] + np.arange(4))[used]]
        values = parts.view("<u4")[:, 0]
        out[block, place] |= values.astype(np.uint32) << width[block].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


# -- files -------------------------------------------------------------------

class TokenWriter:
    """Writes documents to one file, block by block."""

    def __init__(self, stream):
        self.stream, self.at, self.total = stream, len(MAGIC), 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.nulls, self.rest = 0, np.zeros(0, np.uint32)
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids one after the other."""
        self.nulls += sum(i is None for i in doc_ids)
        self.docs.append((np.array([i or 0 for i in doc_ids], np.int64), lengths.astype(np.uint64)))
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for a in range(0, whole, 4096 * BLOCK):
            self._blocks(ids[a:min(a + 4096 * BLOCK, whole)])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        data, sizes = packed_blocks(ids)
        self.stream.write(data)
        self.sizes.append(sizes)

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.append(self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.uint32)))
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        starts = len(MAGIC) + np.cumsum(sizes) - sizes
        doc_ids = np.concatenate([np.zeros(0, np.int64), *[d for d, _ in self.docs]])
        lengths = np.concatenate([np.zeros(0, np.uint64), *[n for _, n in self.docs]])
        for part in (starts.astype("<u8"), doc_ids.astype("<i8"), lengths.astype("<u8"), np.array([len(starts), len(doc_ids), self.nulls, self.total], "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(MAGIC)
        self.stream.close()


class TokenFile:
    """Reads a file: its documents, and any range of its ids."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(36, size - 36)
        if tail[-4:] != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        blocks, docs, self.nulls, self.total = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        foot = size - 36 - 8 * blocks - 16 * docs
        index = self.file.read_at(8 * blocks + 16 * docs, foot)
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), foot).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.lengths = np.frombuffer(index, "<u8", docs, 8 * blocks + 8 * docs).astype(np.int64)

    def read_ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to, not including, ``last``."""
        last = min(last, self.total)
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return unpacked_blocks(data, self.starts[a:b] - self.starts[a])[first - a * BLOCK:last - a * BLOCK]

    def documents(self, together: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, its ids) of every document, in order; so many ids are read at once, or one document."""
        ends = np.cumsum(self.lengths)
        k = 0
        while k < len(ends):
            first = int(ends[k] - self.lengths[k])
            m = max(int(np.searchsorted(ends, first + together, "right")), k + 1)
            ids = self.read_ids(first, int(ends[m - 1]))
            for j in range(k, m):
                to = int(ends[j]) - first
                yield (None if j < self.nulls else int(self.doc_ids[j])), ids[to - int(self.lengths[j]):to]
            k = m


# -- Spark -------------------------------------------------------------------

def segments(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + n[i] - 1 of all i, one after the other."""
    spot = np.cumsum(n) - n
    return np.repeat(first - spot, n) + np.arange(int(n.sum()))


class Encoder:
    """Encodes texts piece by piece; each distinct piece goes through the tokenizer once."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        # Bytes of each token, written in the byte-level alphabet: a letter a byte.
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.pieces = pa.array([], pa.large_string())
        self.ids, self.sizes, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self, most: int) -> None:
        """Drop the pieces that were met once only, and the rarest of the others where they are too many."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > most:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[:most]])
        first = (np.cumsum(self.sizes) - self.sizes)[often]
        self.ids, self.sizes = self.ids[segments(first, self.sizes[often])], self.sizes[often]
        self.pieces, self.met = self.pieces.take(pa.array(often)), np.ones(len(often), np.int64)
        pa.default_memory_pool().release_unused()

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        ids: list[list[int]] = []
        for k in range(0, len(texts), 1 << 14):  # an encoding takes far more memory than its ids
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k:k + (1 << 14)], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has. Pieces that are cut at both ends are strung together."""
        whole = pc.match_substring_regex(pieces, WHOLE).to_numpy(zero_copy_only=False)
        parts = []
        for at in np.split(np.flatnonzero(whole), np.arange(STRUNG << 4, whole.sum(), STRUNG << 4)):
            some = pieces.take(pa.array(at))
            ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64))
            words = some.to_pylist()
            ids, _ = self.each(["".join(words[k:k + STRUNG]) for k in range(0, len(words), STRUNG)])
            read = np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(read, ends)
            # Not so where a tokenizer changes its text, or is not of bytes: each piece alone, then.
            if len(at) and (len(read) == 0 or read[-1] != ends[-1] or not np.array_equal(read[last], ends)):
                ids, sizes = self.each(words)
            else:
                sizes = np.diff(last + 1, prepend=0)
            parts.append((at, ids, sizes))
        alone = np.flatnonzero(~whole)
        parts.append((alone, *self.each(pieces.take(pa.array(alone)).to_pylist())))
        at, ids, sizes = (np.concatenate(column) for column in zip(*parts))
        back = np.argsort(at, kind="stable")
        return ids[segments((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece; new ones are encoded."""
        coded = pieces.cast(pa.large_string()).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.pieces)
        new = pc.is_null(found)
        fresh = coded.dictionary.filter(new)
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at[new.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(fresh))
        if len(fresh):
            ids, sizes = self.coded(fresh)
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.met = np.append(self.met, np.zeros(len(fresh), np.int64))
        numbers = at[coded.indices.to_numpy()]
        self.met += np.bincount(numbers, minlength=len(self.pieces))
        return numbers

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece numbers, how many pieces each text has, and which text comes at which place."""
        odd = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        # Where every blank stands between two words, they all cut.
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten()
        heads = words.take(pa.array(bounds[:-1], pa.int64()))  # no blank before a text's first word
        others = [CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        rest = pa.array([p for c in others for p in c], pa.large_string())
        codes = self.numbers(pa.concat_arrays([pc.binary_join_element_wise(NONE, words, BLANK), heads, rest]))
        codes[bounds[:-1]] = codes[len(words):len(words) + len(heads)]
        codes = np.append(codes[:len(words)], codes[len(words) + len(heads):])
        return codes, np.append(np.diff(bounds), np.array([len(c) for c in others], np.int64)), np.append(np.flatnonzero(~odd), np.flatnonzero(odd))

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids per text and all ids, each text followed by the end id."""
        if len(self.pieces) > REMEMBERED:
            self.forget(REMEMBERED // 2)
        codes, many, order = self.cut(texts.cast(pa.large_string()))
        n = self.sizes[codes]
        ids = self.ids[segments((np.cumsum(self.sizes) - self.sizes)[codes], n)]
        # Ids per text, then the texts in their own order again.
        total = np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(many))])
        first = np.cumsum(total) - total
        back = np.argsort(order, kind="stable")
        total, first = total[back], first[back]
        if end_id is None:
            return total, ids[segments(first, total)]
        out = np.full(int(total.sum()) + len(total), end_id, np.uint32)
        out[segments(np.cumsum(total + 1) - total - 1, total)] = ids[segments(first, total)]
        return total + 1, out


def encoder_of(tokenizer_json: str) -> Encoder:
    """The encoder of this worker process, which keeps its pieces from task to task."""
    # Code that travels with the job has no module to keep state in.
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # every core has a task of its own
        kept[name] = Encoder(tokenizer_json)
    return kept[name]


def token_files(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID,
    folder: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write token files in ascending document id; returns the manifest: path, n_docs, n_ids, base (ids before the file)."""
    spark = docs.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    folder = f"{folder}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a bounded file; executors need no copy of their own
    text = text_of(text_col)
    # Numbered, so that rows with one id and text lie in several ranges where they are many.
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.monotonically_increasing_id().alias("seq"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("th"), F.col("seq")]
    ranged = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, first, n_docs = None, "", None, 0
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                path = f"{folder}/{uuid.uuid4().hex}.tok"
                store, name = fs.FileSystem.from_uri(path)
                store.create_dir(name.rpartition("/")[0])
                writer = TokenWriter(store.open_output_stream(name))
                first = {c: batch.column(c)[0].as_py() for c in ("id", "th", "seq")}
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // TOGETHER)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                n, ids = encoder.encode(batch.column("text").slice(a, b - a), end_id)
                writer.add(batch.column("id").slice(a, b - a).to_pylist(), n, ids)
            n_docs += len(batch)
        encoder.forget(KEPT)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{**first, "path": path, "n_docs": n_docs, "n_ids": writer.total}], schema)

    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    files = written(ranged.mapInArrow(run, "id bigint, th bigint, seq bigint, path string, n_docs bigint, n_ids bigint"))
    # One row a file.
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))


def documents_of(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files, one task a file."""
    manifest = written(manifest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows: list[tuple] = []
                at = base
                for doc, ids in TokenFile(path).documents():
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 1 << 16:
                        yield table_of(rows)
                        rows = []
                yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "base")
    return files.repartition(max(1, files.count())).mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return documents_of(manifest).withColumnRenamed("id", "doc_id")
