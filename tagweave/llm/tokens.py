"""Token ids in flat binary files, and the tokenizer that packing shares.

File format, one pair per range of documents: ``ids-NNNNN.bin`` holds all ids as
little-endian unsigned integers (16 bits if the vocabulary fits, else 32), and
``ids-NNNNN.idx`` one little-endian signed 64-bit offset per document plus the end, in
ids from the file's start.  ``manifest`` (Parquet) lists the committed files with counts
and each file's base, the prefix sum of ids before it.  Tasks write under a temporary
name and rename; a repeated task renames equal bytes over its own.

Documents are sorted by (doc_id, hash of the text), null ids first; null texts are
empty and still get their end id.  An empty table gives an empty manifest.

Ids are those of the plain library call (``encode`` with add_special_tokens=False): a
text that holds an added token literally, such as <|endoftext|>, gets that token's id.

Ids are integers, or text that Spark casts to them.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: A space between two characters that aren't white space starts a token of its own in the
#: byte-level pattern, so that a text may be cut before it without changing any id.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces kept with their ids in a task, and one text's pieces: half of them the latest, half those before.
CACHE = 1_200_000
#: Pieces that a worker keeps between tasks: those it met first, which are the frequent ones.
IDLE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _pattern() -> tuple[re.Pattern, re.Pattern]:
    """The byte-level pattern, and the characters for which the library's may differ.

    Letters and numbers are those whose class has been the same since Unicode 3.2, so that no
    version of the tables matters; all other characters beyond the first plane, controls that
    are white space for some only, and younger ones, are left to the library.
    """
    old, kinds = unicodedata.ucd_3_2_0, {"L": [], "N": [], "?": []}
    for i in range(1 << 16):
        x = chr(i)
        kind, before = unicodedata.category(x), old.category(x)
        moved = kind[0] != before[0] and {kind[0], before[0]} & {"L", "N", "Z"}
        unsure = before in ("Cn", "Cs") or moved or x in "\x1c\x1d\x1e\x1f\x85\u180e"
        kind = "?" if unsure else kind[0]
        if kind in kinds:
            kinds[kind].append(i)
    ranges = {}
    for kind, found in kinds.items():
        at = np.array(found)
        edge = np.flatnonzero(np.diff(at) > 1)
        ranges[kind] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]]))
    letter, number = ranges["L"], ranges["N"]
    # fixed value: the pattern of byte-level tokenizers, letters first (no other branch may start with one)
    whole = rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
    return re.compile(whole), re.compile(rf"[{ranges['?']}\U00010000-\U0010ffff]")


def _byte_names() -> dict[int, str]:
    """How byte-level models write bytes: printable ones as they are in Latin-1, the others, in turn, from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Pieces with their ids; one that isn't here is asked of ``learn`` and stays, so that a whole text is looked up in one pass."""

    def __init__(self, learn, pieces=()):
        super().__init__(pieces)
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.learn(piece)
        return found


class Encoder:
    """Ids of whole texts by the tokenizers library; pieces that recur are encoded once.

    A byte-level tokenizer cuts a text by a pattern and encodes each piece by itself.  So the
    pieces are cut here, and the library's model encodes those that aren't known yet.  Pieces
    with characters whose class depends on the version of Unicode, and all texts of other kinds of
    tokenizers, go through the library as they are.

    ``plain``: texts that hold an added token go through the plain call; else special tokens are spelled out.
    """

    _own: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, plain: bool = False):
        c.quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)") if plain else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known, self.before = _Known(self._learned), {}
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        cutter = str(self.tokenizer.pre_tokenizer)
        self.by_piece = cutter.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cutter and self.tokenizer.normalizer is None and type(self.model).__name__ == "BPE" and not self.model.dropout
        self.names = _byte_names()

    @classmethod
    def of(cls, path: str, plain: bool = False) -> "Encoder":
        if (path, plain) not in cls._own:
            cls._own[path, plain] = cls(path, plain)
        return cls._own[path, plain]

    @classmethod
    def rest(cls) -> None:
        for own in cls._own.values():
            own.known, own.before = _Known(own._learned, itertools.islice(own.known.items(), IDLE)), {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _with_added(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return self.whole(text)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _learned(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            if piece.isascii() and piece.lstrip(" ").isalnum():
                name = piece.replace(" ", self.names[0x20])
            elif _pattern()[1].search(piece):
                return self.whole(piece)
            else:
                name = piece.encode().decode("latin-1").translate(self.names)
            found = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(name)])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        cut, unsure = _pattern()
        for text in texts:
            if self.added and self.added.search(text):
                out.append(self._with_added(text))
                continue
            if not self.by_piece:
                out.append(self.whole(text))
                continue
            if len(self.known) > CACHE // 2:
                self.known, self.before = _Known(self._learned), self.known
            if unsure.search(text):
                pieces = [p for run in _CUT.split(text) for p in ([run] if unsure.search(run) else cut.findall(run))]
            else:
                pieces = cut.findall(text)
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


c.at_rest.append(Encoder.rest)


def texts_of(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b is not None else "" for b in column.to_pylist()]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://") if "://" in uri else "file://" + uri)


def put(fs: pafs.FileSystem, path: str, data: list) -> None:
    """Writes under a temporary name, then renames; repeated, it ends with the same file."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        for d in data:
            f.write(d)
    fs.move(temporary, path)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest (file, n_docs, n_ids, bytes, sha, base), read from the folder."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    data = data.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        coder, number = Encoder.of(tokenizer, plain=True), TaskContext.get().partitionId()
        fs, at = file_system(f"{folder}/ids-{number:05d}.bin")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        temporary, offsets, ids, end = f"{at}.{uuid.uuid4().hex}.tmp", [0], [], np.array([end_id], coder.dtype).tobytes()
        checksum, stream = 0, None
        for b in batches:
            ids.append(b.column(0))
            stream = stream or fs.open_output_stream(temporary)
            for i in range(0, b.num_rows, 256):
                for x in coder.encode(texts_of(b.column(1)[i : i + 256])):
                    stream.write(x + end)
                    checksum = zlib.crc32(x + end, checksum)
                    offsets.append(offsets[-1] + len(x) // coder.dtype.itemsize + 1)
        if not stream:
            return
        stream.close()
        fs.move(temporary, at)
        keys = pa.concat_arrays(ids)
        put(fs, at[:-4] + ".idx", [np.array(offsets, "<i8").tobytes()])
        put(fs, at[:-4] + ".key", [keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes()])
        yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([offsets[-1]], pa.int64()), "width": pa.array([coder.dtype.itemsize], pa.int32()), "crc32": pa.array([checksum], pa.int64())})

    files = c.stored(data.mapInArrow(c.tidy(run), "file int, n_docs long, n_ids long, width int, crc32 long"), "files")
    # one row per file: prefix sums of per-file totals, the ids stay where they are
    c.running(files, "file", "n_ids", "base").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def mapped(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """The file as an array, memory-mapped where the file system is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file_ok) of each document in the files, in the manifest's order."""
    files = spark.read.parquet(f"{folder}/manifest")
    files = files.repartition(max(1, min(files.count(), 100_000)), "file")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, at = file_system(f"{folder}/ids-{row['file']:05d}")
                ids, offsets = mapped(fs, at + ".bin", f"<u{row['width']}"), mapped(fs, at + ".idx", "<i8")
                n = row["n_docs"]
                raw = mapped(fs, at + ".key", "u1")
                if len(offsets) != n + 1 or len(ids) != row["n_ids"] or len(raw) != 9 * n:
                    raise ValueError(f"file {row['file']} doesn't have the size that the manifest gives")
                keys = pa.array(raw[: 8 * n].view("<i8"), pa.int64(), mask=raw[8 * n :].astype(bool))
                sums = np.fromiter((zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, n)
                for k in range(0, n, 1 << 16):
                    s = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([keys[s], pa.array(row["base"] + offsets[:-1][s], pa.int64()), pa.array(np.diff(offsets)[s], pa.int64()), pa.array(sums[s], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(c.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = c.new_path(spark, "token-files")
    write(c.table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
