"""Token-ID output: Arrow IPC files of equal-length sequences, and their reader.

``write_sequences`` encodes documents with a public tokenizer, appends an end id to each,
joins the ids in ascending order of the documents and cuts them into rows of ``length``
ids. Every task writes one Arrow file in the IPC *file* form (the stream form plus a footer
of batch offsets). All batches of a file but the last have ``BATCH_ROWS`` rows, so a reader
(``SequenceReader``) maps the file and reaches row i, its ids and its mask, as views of the
mapping, without copying or decoding and without reading other rows:

* ``ids``    fixed_size_list<uint16 or uint32>[length]
* ``mask``   fixed_size_list<bool>[length], true for real ids, false for the padding of a
  file's last row
* ``last``   fixed_size_list<bool>[length], true at the end id of a document (an id 0 may
  also be ordinary text, so the end can't be found by value)
* ``docs``   list<int64>, ids of the documents that end in the row

A file is written under a temporary name and renamed, so a repeated or speculative task
replaces a file by an equal one. Edge cases: a null or empty text is one end id; a null
document id sorts first and is kept, in the order of the texts' hashes; repeated rows are
written as often as they occur; very long texts are encoded in segments of about
``SEGMENT`` bytes; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import MULTIPLIERS, documents, kept, mix, new_path, powers, stored

LENGTH = 2048
#: Rows of a record batch: 1,024 x 2,048 ids are 4 MB.
BATCH_ROWS = 1024
END_ID = 0
#: Bytes of text worked on at once.
SEGMENT = 1 << 18

#: White space beside white space or at an end, where pieces don't stand alone.
_ODD = re.compile(r"^\s|\s$|\s\s")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_OTHERS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[4])
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: What follows a piece.
LINE_END, TEXT_END = 1, 2


def odd(text: str) -> bool:
    if text.isascii() and not any(c in text for c in _OTHERS):
        return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS)
    return _ODD.search(text) is not None


class TextEncoder:
    """Encodes texts piece by piece, remembering pieces.

    The byte-level pre-tokenizer cuts at every single space or line end between two other
    characters, and between letters and the punctuation that ends a word. So what stands
    between such places is encoded alone and the ids are joined. Texts repeat their words, so
    only unseen pieces go through the tokenizer. Pieces are found again with numpy, for a whole
    segment at once, by a 64-bit hash and their length in a table of open addresses, and their
    ids are gathered from a pool. At most ``limit`` pieces are remembered; then the table is
    emptied.
    """

    def __init__(self, path: str, limit: int = 1_200_000, bits: int = 22):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.bits = Tokenizer.from_file(path), limit, bits
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.after = (np.zeros(0, self.dtype), self.fresh(["\n"])[0], np.array([END_ID], self.dtype))
        self._empty()

    def fresh(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _empty(self) -> None:
        self.tags, self.slots, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
        self.starts, self.counts, self.sizes = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.pool, self.filled = np.zeros(1 << 18, self.dtype), 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        found, at = np.full(len(key), -1, np.int32), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = np.arange(len(key))
        while len(rows):
            tag = self.tags[at]
            hit = tag == key[rows]
            found[rows[hit]] = self.slots[at[hit]]
            on = ~hit & (tag != 0)
            rows, at = rows[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return found

    def _learn(self, keys: list[int], pieces: list[bytes], spaced: list[bool]) -> None:
        texts = [(" " if s else "") + p.decode("utf-8", "surrogatepass") for p, s in zip(pieces, spaced)]
        ids = array(self.code)
        counts = []
        for at in range(0, len(texts), 4096):  # what it returns is large
            for x in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False):
                ids.extend(found := x.ids)
                counts.append(len(found))
        flat = np.frombuffer(ids, self.dtype) if ids else np.zeros(0, self.dtype)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(keys) > len(self.starts):
            self.starts, self.counts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.sizes))
        new = slice(self.n, self.n + len(keys))
        self.counts[new] = counts
        self.starts[new] = self.filled + np.cumsum(counts) - counts
        self.sizes[new] = [len(p) for p in pieces]
        self.pool[self.filled : self.filled + len(flat)] = flat
        tags, slots, shift, last = self.tags, self.slots, 64 - self.bits, (1 << self.bits) - 1
        for slot, key in enumerate(keys, self.n):
            at = key >> shift
            while tags[at]:
                at = (at + 1) & last
            tags[at], slots[at] = key, slot
        self.n, self.filled = self.n + len(keys), self.filled + len(flat)

    def _segment(self, held: list[tuple[bytes, bool]], spaced: bool) -> list[np.ndarray]:
        """Ids of consecutive stretches of texts (bytes up to a separator and with it, whether the
        text ends there); ``spaced``: the first piece follows a space."""
        whole = b"".join(x for x, _ in held)
        data = np.frombuffer(whole, np.uint8)
        stops = np.flatnonzero((data == 32) | (data == 10))
        if self.n + 2 * len(stops) > max(self.limit, 3 * len(stops)) or self.n + 2 * len(stops) > 1 << self.bits:
            self._empty()
        starts = np.r_[0, stops[:-1] + 1]
        lasts = np.searchsorted(stops, np.cumsum([len(x) for x, _ in held]) - 1)
        after = (data[stops] == 10).astype(np.int8)
        before = np.r_[spaced, data[stops[:-1]] == 32]
        after[lasts[[e for _, e in held]]] = TEXT_END
        # the marks after a word's last letter, up to eight, are a piece of their own
        cut, rows = stops.copy(), np.arange(len(stops))
        for _ in range(8):
            rows = rows[(cut[rows] > starts[rows]) & _MARK[data[cut[rows] - 1]]]
            cut[rows] -= 1
        two = (cut < stops) & (cut > starts) & _LETTER[data[cut - 1]]
        n = 1 + two
        end = np.cumsum(n) - 1
        tail = end[two]
        starts, stops, before, after = (np.repeat(x, n) for x in (starts, stops, before, after))
        starts[tail], stops[tail - 1], before[tail], after[tail - 1] = cut[two], cut[two], False, 0
        lasts = end[lasts]
        power, inverse = powers(len(data) + 1)
        total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)]
        key = mix(mix((total[stops] - total[starts]) * inverse[starts]) + before * MULTIPLIERS[2])
        key[key == 0] = 1
        found = self._find(key)
        if len(missed := np.flatnonzero(found < 0)):
            new, at = np.unique(key[missed], return_index=True)
            at = missed[at]
            self._learn(new.tolist(), [whole[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())], before[at].tolist())
            found[missed] = self._find(key[missed])
        if (self.sizes[found] != stops - starts).any():
            raise RuntimeError("two pieces of text have one hash")
        counts = self.counts[found].astype(np.int64)
        ends = np.cumsum(counts + np.array([len(x) for x in self.after])[after])
        sums = np.cumsum(counts)
        inside = np.arange(sums[-1])
        ids = np.empty(ends[-1], self.dtype)
        shift = np.r_[0, ends[:-1]] - (sums - counts)
        ids[inside + np.repeat(shift, counts)] = self.pool[inside + np.repeat(self.starts[found] - (sums - counts), counts)]
        for kind in (LINE_END, TEXT_END):
            there = ends[after == kind]
            for k, value in enumerate(self.after[kind][::-1], 1):
                ids[there - k] = value
        return np.split(ids, ends[lasts[:-1]])

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text with the end id, in one or more parts, and whether a part is a text's last."""
        held: list[tuple[bytes, bool]] = []
        size, spaced = 0, False
        for text in texts:
            if not text or odd(text):
                if held:
                    yield from zip(self._segment(held, spaced), [e for _, e in held])
                    held, size, spaced = [], 0, False
                # white space beside a cut: the text as it is
                yield (self.fresh([text])[0] if text else self.after[0]), False
                yield self.after[TEXT_END], True
                continue
            data, at = text.encode("utf-8", "surrogatepass") + b"\n", 0
            while at < len(data):
                stop = data.find(b" ", at + SEGMENT) + 1 or len(data)
                held.append((data[at:stop], stop == len(data)))
                size, at = size + stop - at, stop
                if size >= SEGMENT:
                    yield from zip(self._segment(held, spaced), [e for _, e in held])
                    held, size, spaced = [], 0, at < len(data)
        if held:
            yield from zip(self._segment(held, spaced), [e for _, e in held])


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:", "", path))


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("last", pa.list_(pa.bool_(), length)),
            ("docs", pa.list_(pa.int64())),
        ]
    )


class SequenceFile:
    """Writes ids of documents to one file; holds at most a batch and a document."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        self.length, self.dtype, self.schema = length, dtype, _schema(dtype, length)
        (self.fs, self.path), self.tokens, self.rows = _file_system(path), 0, 0
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sink = self.fs.open_output_stream(self.part)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.ends: list[int] = []
        self.docs: list[int | None] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)

    def end(self, doc_id: int | None) -> None:
        """The ids of a document are complete."""
        self.ends.append(self.size - 1)
        self.docs.append(doc_id)
        if self.size >= BATCH_ROWS * self.length:
            self._flush(self.size // (BATCH_ROWS * self.length) * BATCH_ROWS)

    def _flush(self, rows: int) -> None:
        flat, n = np.concatenate(self.held), rows * self.length
        ends = np.array(self.ends, np.int64)
        inside = int(np.searchsorted(ends, n))
        ids, mask, last = np.zeros(n, self.dtype), np.zeros(n, bool), np.zeros(n, bool)
        real = min(n, len(flat))
        ids[:real], mask[:real], last[ends[:inside]] = flat[:real], True, True
        offsets = np.searchsorted(ends[:inside], np.arange(rows + 1) * self.length).astype(np.int32)
        for at in range(0, rows, BATCH_ROWS):
            k = min(BATCH_ROWS, rows - at)
            cut = slice(at * self.length, (at + k) * self.length)
            fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), type=self.schema.field(i).type) for i, x in enumerate((ids, mask, last))]
            docs = pa.ListArray.from_arrays(pa.array(offsets[at : at + k + 1] - offsets[at]), pa.array(self.docs[offsets[at] : offsets[at + k]], pa.int64()))
            self.writer.write_batch(pa.RecordBatch.from_arrays([*fixed, docs], schema=self.schema))
        self.rows += rows
        self.held = [flat[n:]] if len(flat) > n else []
        self.size = max(0, len(flat) - n)
        self.ends, self.docs = [x - n for x in self.ends[inside:]], self.docs[inside:]

    def close(self) -> None:
        if self.size:
            self._flush(-(-self.size // self.length))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


def write_sequences(docs: DataFrame, path: str, tokenizer: str, length: int = LENGTH, order_by: tuple = ("doc_id",)) -> DataFrame:
    """Write the files below ``path`` and return one row per file: shard, path, n_rows, n_tokens, base.

    ``base`` is the number of ids in all files before. Documents are dealt by ranges of
    ``order_by``, so no task holds more than its range, and the files in order are the ids
    of all documents in order.
    """
    text = F.col("text").cast("string")
    order = [*[F.col(c) if isinstance(c, str) else c for c in order_by], F.xxhash64(text)]  # the hash deals out null and repeated ids
    keyed = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("doc_id").cast("long"), text.alias("text"))
    keys = [f"k{i}" for i in range(len(order))]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(tokenizer, lambda: TextEncoder(tokenizer))
        shard, out = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows and out is None:
                name = f"{path}/shard-{shard:06d}.arrow"
                out = SequenceFile(name, encoder.dtype, length)
            ids = iter(batch.column("doc_id").to_pylist())
            for found, whole in encoder([x or "" for x in batch.column("text").to_pylist()]):
                out.add(found)
                if whole:
                    out.end(next(ids))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_rows": pa.array([out.rows], pa.int64()), "n_tokens": pa.array([out.tokens], pa.int64())})

    files = (
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys, "doc_id", "text")
        .mapInArrow(write, "shard int, path string, n_rows long, n_tokens long")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files, "shards").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class SequenceReader:
    """Random access to the rows of a file. A local file is mapped: what is returned are views of
    the mapping. Of a remote one the footer and the batches asked for are read."""

    def __init__(self, path: str):
        fs, inner = _file_system(path)
        self.source = pa.memory_map(inner) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(inner)
        self.reader = pa.ipc.open_file(self.source)
        last = self.reader.num_record_batches - 1
        self.rows = last * BATCH_ROWS + self.reader.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Row i: its ids, and its mask as packed bits."""
        if not 0 <= i < self.rows:
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // BATCH_ROWS), i % BATCH_ROWS
        ids, mask = batch.column("ids"), batch.column("mask")
        length = ids.type.list_size
        return ids.values.slice(row * length, length).to_numpy(zero_copy_only=True), mask.values.slice(row * length, length)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids, in order."""
        held: list[np.ndarray] = []
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            ids = batch.column("ids").values.to_numpy()
            real = int(batch.column("mask").values.true_count)
            bits = np.frombuffer(batch.column("last").values.buffers()[1], np.uint8)[: -(-len(ids) // 8)]
            ends = np.flatnonzero(np.unpackbits(bits, count=len(ids), bitorder="little")) + 1
            at = 0
            for end, doc_id in zip(ends.tolist(), batch.column("docs").values.to_pylist()):
                yield doc_id, np.concatenate([*held, ids[at:end]]) if held else ids[at:end]
                held, at = [], end
            if at < real:
                held.append(ids[at:real].copy())

    def close(self) -> None:
        self.source.close()


def sequence(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of row i of a file."""
    return SequenceReader(path)[i]


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's ids in a file, in order."""
    reader = SequenceReader(path)
    yield from reader.documents()
    reader.close()


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in read_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return shards.repartition("shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the 50k byte-level vocabulary, written and read back."""
    import public_tokenizers

    shards = write_sequences(documents(spark, sf_dir), new_path(spark, "sequences"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(shards)
