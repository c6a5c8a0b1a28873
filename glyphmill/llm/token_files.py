"""Token-ID files: Arrow IPC files whose record batches hold fixed-size lists of token ids and masks.

Layout of one run: ``shard-NNNNN.arrow`` (columns ``ids`` FixedSizeList<uint16|uint32>[L] and ``mask``
FixedSizeList<bool>[L]) and ``shard-NNNNN.docs.arrow`` (``doc_id``, ``n_tokens``, in the order of the ids). The
documents of a shard follow one another without gaps; only a shard's last sequence is padded (mask false). A memory
map of a local file gives any sequence without a copy. Shards hold ascending ranges of doc_id.

Defined cases: a null text counts as empty and gives the end id alone; a null doc_id comes first; repeated rows are
kept, each on its own; an empty table makes no file and no row; texts are encoded whole, whatever their length, and run
over as many sequences as they need; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.session import fresh_path
from glyphmill.llm.common import bucket_tree, id_bounds, partitions, settle
from glyphmill.llm.runs import Lists, code_points, pieces_of, ranges

END_ID = 1
#: Bytes of text of a batch, runs that are remembered, and runs that the library gets as one text.
CHUNK, MOST_KNOWN, TOGETHER = 1 << 19, 500_000, 512
#: The parts of a tokenizer file under which a text's ids are those of its runs, one after the other.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BLANK, OTHER, LETTER, DIGIT, SIGN = 0, 1, 2, 3, 4
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _kinds() -> np.ndarray:
    """Kinds of code points. Letters are those that no normalization or lower-casing turns into anything but a letter."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x530):
        c = chr(code)
        low = c.lower()
        if c.isalpha() and len(low) == 1 and low.isalpha() and unicodedata.is_normalized("NFC", c + low):
            out[code] = LETTER
        elif code < 128 and not c.isspace() and c.isprintable() and c != "'":
            out[code] = DIGIT if c.isdigit() else SIGN
    out[[9, 10, 13, 32]] = BLANK
    return out


class Encoder:
    """Encodes with the tokenizers library, each distinct run once.

    Where the file's normalizer and pre-tokenizer are the known ones, no token holds white space, two kinds of plain
    characters or two digits, so a text is cut there and its ids are those of its runs in order. Runs are named by
    62 bits and compared within a batch. With another file, and for texts with a sign of an added token, the library gets whole texts.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype).newbyteorder("<")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.by_runs = file.get("normalizer") == _NORMALIZER and file.get("pre_tokenizer") == _PRE_TOKENIZER and not file.get("post_processor") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        self.added = [t["content"] for t in file.get("added_tokens", ())]
        self.by_runs &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] or set(t["content"]) & set(" \t\r\n") for t in file.get("added_tokens", ()))
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kinds = _kinds()
        self.known = Lists(self.dtype, MOST_KNOWN)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, codes: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new runs. Runs of one kind are one word each: many go as one text and are told apart by their ends."""
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        runs = [text[a : a + n] for a, n in zip(low.tolist(), sizes.tolist(), strict=True)]
        plain = np.minimum.reduceat(self.kinds[codes[ranges(low, sizes)]], np.cumsum(sizes) - sizes) > OTHER
        words = [r for r, p in zip(runs, plain, strict=True) if p]
        found = self._whole([" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        flat = np.concatenate([np.zeros(0, self.dtype), *found])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end each run with a token of its own")
        each = self._whole([r for r, p in zip(runs, plain, strict=True) if not p])
        count = np.zeros(len(runs), np.int64)
        count[plain], count[~plain] = np.diff(ends, prepend=0), [len(e) for e in each]
        order = np.argsort(~plain, kind="stable")
        begin = np.zeros(len(runs), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([flat, *each])[ranges(begin, count)], count

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        bodies = [t or "" for t in texts]
        whole = [k for k, t in enumerate(bodies) if t and (not self.by_runs or any(a in t for a in self.added))]
        apart = dict(zip(whole, self._whole([bodies[k] for k in whole]), strict=True))
        for k in whole:
            bodies[k] = ""
        codes = code_points("".join(bodies)).copy()
        codes[(codes >= 65) & (codes <= 90)] += 32
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        edge = np.cumsum(sizes) - sizes
        kind = self.kinds[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] != OTHER) & (kind[:-1] != OTHER) | (kind[1:] == BLANK) | (kind[:-1] == BLANK)) | ((kind[1:] == DIGIT) & (kind[:-1] == DIGIT))
        cut[edge[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        real = kind[starts] != BLANK if len(starts) else cut
        starts, ends = starts[real], ends[real]
        if len(starts):
            flat, counts = self.known.of(self.known.numbers(codes, starts, ends, lambda low, sizes: self._runs(codes, low, sizes)))
            cuts = np.concatenate([[0], np.cumsum(counts)])[np.append(np.searchsorted(starts, edge), len(starts))]
        else:
            flat, cuts = np.zeros(0, self.dtype), np.zeros(len(bodies) + 1, np.int64)
        for k in range(len(bodies)):
            yield apart[k] if k in apart else flat[cuts[k] : cuts[k + 1]]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many([text]))


def encoder(path: str, dtype: str) -> Encoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def encoded(df: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, dtype: str = "uint16", bounds: list | None = None) -> DataFrame:
    """Rows (part, doc_id, n_tokens, ids): ids as compressed little-endian bytes, the end id appended."""
    part = bucket_tree(F.col(key), bounds or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, dtype)
        settle(enc.known)
        end = np.array([end_id], enc.dtype).tobytes()
        pack = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for piece in pieces_of(batch, 2, CHUNK):
                raw = [ids.tobytes() + end for ids in enc.encode_many(piece.column(2).to_pylist())]
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array([len(r) // enc.dtype.itemsize for r in raw], pa.int64()), pa.array([pack.compress(r, asbytes=True) for r in raw], pa.binary())], ["part", "doc_id", "n_tokens", "ids"])

    return df.select(part.alias("part"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "part int, doc_id long, n_tokens long, ids binary")


def write_token_files(df: DataFrame, tokenizer_path: str, path: str | None = None, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, dtype: str = "uint16", sequence: int = 1024, batch_sequences: int = 256, parts: int | None = None) -> DataFrame:
    """Writes the files under ``path`` (any file system pyarrow knows; default: the shared folder), ascending by key.

    Returns the manifest, one row per shard: part, file, n_docs, n_tokens and start, the number of ids in all shards
    before it. A repeated task writes the same file again under another name and moves it into place.
    """
    spark = df.sparkSession
    parts = parts or partitions(spark)
    path = path or fresh_path(spark, "token-ids")
    bounds = id_bounds(df, key, parts)
    rows = encoded(df, tokenizer_path, key=key, text=text, end_id=end_id, dtype=dtype, bounds=bounds)
    ordered = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if batch.num_rows and shard is None:
                shard = ShardWriter(path, batch.column(0)[0].as_py(), dtype, sequence, batch_sequences)
            for doc, n, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                shard.add(doc, n, ids.as_buffer())
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long").collect()  # a row for each shard
    start, out = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        out.append((m["part"], m["file"], m["n_docs"], m["n_tokens"], start))
        start += m["n_tokens"]
    return spark.createDataFrame(out, "part int, file string, n_docs long, n_tokens long, start long")


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(use_mmap=True), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Streams documents into one shard; memory is one batch of sequences and the list of documents."""

    def __init__(self, path: str, part: int, dtype: str, sequence: int, batch_sequences: int):
        self.fs, folder = _file_system(path)
        self.fs.create_dir(folder, recursive=True)
        self.part, self.dtype, self.sequence, self.block = part, np.dtype(dtype), sequence, sequence * batch_sequences
        self.name = f"shard-{part:05d}.arrow"
        self.file, self.to = f"{path}/{self.name}", f"{folder}/{self.name}"
        self.tmp = f"{folder}/.{self.name}.{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.codec, self.held, self.n_held = pa.Codec("zstd"), [], 0
        self.docs, self.lengths = [], []

    def add(self, doc, n: int, packed) -> None:
        ids = np.frombuffer(self.codec.decompress(packed, decompressed_size=n * self.dtype.itemsize), self.dtype)
        self.docs.append(doc)
        self.lengths.append(n)
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for at in range(0, full, self.block):
                self._batch(flat[at : at + self.block])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _batch(self, flat: np.ndarray) -> None:
        real = len(flat)
        padded = np.concatenate([flat, np.zeros(-real % self.sequence, self.dtype)])
        cells = [pa.array(padded), pa.array(np.arange(len(padded)) < real)]
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(c, self.sequence) for c in cells], schema=self.schema))

    def close(self) -> dict:
        if self.n_held:
            self._batch(np.concatenate(self.held))
        self.out.close()
        self.sink.close()
        index = pa.record_batch([pa.array(self.docs, pa.int64()), pa.array(self.lengths, pa.int64())], ["doc_id", "n_tokens"])
        with self.fs.open_output_stream(self.tmp + ".docs") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_batch(index)
        self.fs.move(self.tmp + ".docs", self.to.removesuffix(".arrow") + ".docs.arrow")
        self.fs.move(self.tmp, self.to)
        return {"part": self.part, "file": self.file, "n_docs": len(self.docs), "n_tokens": sum(self.lengths)}


class TokenShard:
    """Random access to one shard: ``sequence(i)`` is a view of the mapped file."""

    def __init__(self, file: str):
        system, local = _file_system(file)
        self.source = system.open_input_file(local)
        self.reader = pa.ipc.open_file(self.source)
        with system.open_input_file(local.removesuffix(".arrow") + ".docs.arrow") as index:
            docs = pa.ipc.open_file(index).read_all()
        self.doc_ids, self.lengths = docs.column("doc_id").to_pylist(), docs.column("n_tokens").to_numpy()
        self.length = self.reader.schema.field("ids").type.list_size
        self.first = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of the i-th sequence."""
        batch = self.reader.get_batch(i // self.first)
        row = i % self.first
        ids, mask = batch.column("ids"), batch.column("mask")
        return ids.values.slice((ids.offset + row) * self.length, self.length).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + row) * self.length, self.length)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each document's ids, read batch by batch."""
        batches = (self.reader.get_batch(k) for k in range(self.reader.num_record_batches))
        held = np.zeros(0, np.uint16)
        for doc, n in zip(self.doc_ids, self.lengths, strict=True):
            pieces, have = [held], len(held)
            while have < n:
                batch = next(batches)
                ids, mask = batch.column("ids").flatten(), batch.column("mask").flatten()
                more = ids.to_numpy()[: mask.true_count]
                pieces.append(more)
                have += len(more)
            flat = np.concatenate(pieces) if len(pieces) > 1 else held
            yield doc, flat[:n]
            held = flat[n:]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads the shards of a manifest back: doc_id, start, n_tokens, ids_crc32 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, ids in TokenShard(file).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartitionByRange(max(1, partitions(manifest.sparkSession)), "part")
    return spread.select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
