"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

`write_tokens` range-partitions the documents by doc_id; each partition becomes one shard of three flat
little-endian files under the output folder: `<shard>.ids` (ids, uint16 where the vocabulary fits,
uint32 otherwise), `<shard>.off` (int64, n+1 offsets of the documents within the shard) and
`<shard>.doc` (int64 doc_ids). `manifest.json` has the dtype, each shard's base (the prefix sum of
the ids before it) and how many of its documents, the first ones, have a null id. `read_tokens` maps the files into memory, a task per shard. Files are written under
a name of the attempt and then renamed, so a repeated task leaves whole files.

Cases: null or empty text is the end id alone; a null doc_id sorts first and is read back as null;
repeated doc_ids are kept, each with its own offset, in the order of their texts' hashes (so one id or
none in many rows is spread over shards too), equal rows being interchangeable; very long texts are one
document; an empty table has no shards; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crcs, fresh_dir, strings, word_codes

VOCABULARY = "word_bpe_49k.json"
END = 1
# a run of Latin-1 letters with other marks after it: the tokenizer lowers letters one by one and splits the marks off
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-^`{-~]*)$"
JOINED = 1000  # words that one call of the tokenizer gets as one text


def _put_at(a: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """a with `new` from place `at`; grown by doubling."""
    if at + len(new) > len(a):
        a = np.concatenate([a[:at], np.zeros(max(at, len(new), 4096) + len(new), a.dtype)])
    a[at : at + len(new)] = new
    return a


class Encoder:
    """Texts to ids with a tokenizer file whose pieces never cross white space.

    The ids of a text are those of its words in order. Arrow codes the words of a block and cuts them into
    their lower-cased letters and their marks; the tokenizer gets parts that are new, many runs of letters
    as one text (its pieces show where a word ends), and numpy strings the ids together. About `most` parts
    are remembered. tests/llm compares this with encoding whole texts.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] | None = {"": 0, "\n": 1}  # nothing, and the end id
        self.ids, self.ends, self.used = np.array([END], self.dtype), np.array([0, 1]), 2

    def pack(self) -> None:
        """Keeps the parts between tasks as flat arrays; the dictionary is made again when needed."""
        if self.parts is not None:
            self.packed, self.parts = pa.array(list(self.parts), pa.string()), None
            self.ids, self.ends = self.ids[: self.ends[self.used - 1]].copy(), self.ends[: self.used].copy()
        pa.default_memory_pool().release_unused()

    def _learn(self, texts: list[str], each: bool) -> None:
        """Takes the ids of new parts: one by one, or many runs of letters as one text."""
        if not texts:
            return
        joined = texts if each else [" ".join(texts[k : k + JOINED]) for k in range(0, len(texts), JOINED)]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(coded), self.dtype)
        to = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) if each else np.flatnonzero(self.closes[ids]) + 1
        if len(to) != len(texts) or to[-1] != len(ids):
            raise ValueError("the tokenizer's pieces don't show where words end")
        start, n = self.ends[self.used - 1], self.used + len(texts)
        self.ids = _put_at(self.ids, start, ids)
        self.ends = _put_at(self.ends, self.used, start + to)
        self.parts.update(zip(texts, range(self.used, n)))
        self.used = n

    def _places(self, coded: pa.DictionaryArray, runs: np.ndarray | None) -> np.ndarray:
        """The part of each text; runs: which of them are runs of letters."""
        codes, texts = coded.indices.to_numpy(zero_copy_only=False), strings(coded.dictionary)
        at = np.fromiter(map(self.parts.get, texts, repeat(-1)), np.int32, len(texts))
        new = at < 0
        if new.any():
            alone = np.ones(len(texts), bool)
            if runs is not None:
                alone[codes[runs]] = False
            for each, own in ((False, np.flatnonzero(new & ~alone)), (True, np.flatnonzero(new & alone))):
                at[own] = self.used + np.arange(len(own))
                self._learn([texts[k] for k in own], each)
        return at[codes]

    def flat_blocks(self, column: pa.Array):
        """start, ids, offsets: blocks of texts from row `start`, the ids of all with the end ids, the texts' places in them."""
        for start, texts in blocks(column):
            if self.parts is None:
                self.parts = dict(zip(strings(self.packed), range(len(self.packed))))
            if self.used > self.most:
                self._forget()
            off, codes, words = word_codes(pc.replace_substring(texts, "\n", " "))
            found = pc.extract_regex(words, PLAIN)
            plain = found.is_valid()
            letters = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "letters")), words).dictionary_encode()
            first = self._places(letters, plain.to_numpy(zero_copy_only=False))
            second = self._places(pc.fill_null(pc.struct_field(found, "marks"), "").dictionary_encode(), None)
            order = np.insert(np.stack([first, second], 1)[codes].ravel(), 2 * off[1:], 1)
            begin = np.concatenate([[0], self.ends[: self.used]])
            size = np.diff(begin)[order]
            to = np.cumsum(size)
            ids = self.ids[np.repeat(begin[order] - to + size, size) + np.arange(to[-1] if len(to) else 0)]
            yield start, ids, np.concatenate([[0], to[2 * off[1:] + np.arange(len(texts))]])

    def encode(self, column: pa.Array) -> list[bytes]:
        """Each text's ids and the end id, as bytes of self.dtype."""
        return [ids[a:b].tobytes() for _, ids, off in self.flat_blocks(column) for a, b in zip(off, off[1:])]


_ENCODERS: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str):
    """This worker's encoder for the file, for one task; between tasks it keeps what it knows in flat arrays."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        _ENCODERS[path].pack()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, chunks) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for c in chunks:
            f.write(c)
    fs.move(part, path)


def write_tokens(docs: DataFrame, out: str, *, tokenizer: str | None = None, shards: int | None = None) -> list[dict]:
    """Writes docs (doc_id, text) to `out`, a folder that all executors reach; returns the manifest's shards.

    Only the shards' names and sizes come to the driver, one short row for each file.
    """
    spark = docs.sparkSession
    path = tokenizer or vocabulary_path()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches):
        from pyspark import TaskContext

        fs, at = _fs(out)
        name = f"shard-{TaskContext.get().partitionId():06d}"
        doc, lengths, nulls = [], [], 0

        def ids(own):
            nonlocal nulls
            for b in batches:
                doc.append(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                nulls += b.column("doc_id").null_count
                for _, coded, off in own.flat_blocks(b.column("text")):
                    lengths.append(np.diff(off))
                    yield coded.tobytes()

        with encoder(path) as own:
            _put(fs, f"{at}/{name}.ids", ids(own))
        if not lengths:
            fs.delete_file(f"{at}/{name}.ids")
            return
        off = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
        _put(fs, f"{at}/{name}.off", [off.astype("<i8").tobytes()])
        _put(fs, f"{at}/{name}.doc", [np.concatenate(doc).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(off) - 1], "n_null": [nulls], "n_ids": [int(off[-1])], "dtype": [own.dtype.str]})

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(shards, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(run, "shard string, n_docs long, n_null long, n_ids long, dtype string")
        .collect()
    )
    rows = sorted((r.asDict() for r in rows), key=lambda r: r["shard"])
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows], dtype=np.int64)])
    rows = [r | {"base": int(x)} for r, x in zip(rows, bases)]
    fs, at = _fs(out)
    _put(fs, f"{at}/manifest.json", [json.dumps({"end": END, "shards": rows}).encode()])
    return rows


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark, out: str, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files under `out`: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    fs, at = _fs(out)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, at = _fs(out)
        for b in batches:
            for r in b.to_pylist():
                ids, off, doc = (_mapped(fs, f"{at}/{r['shard']}.{x}", t) for x, t in (("ids", r["dtype"]), ("off", "<i8"), ("doc", "<i8")))
                for k in range(0, len(doc), 4096):
                    d, o = np.array(doc[k : k + 4096]), np.array(off[k : k + 4097])
                    own = np.array(ids[o[0] : o[-1]])
                    none = np.arange(k, k + len(d)) < r["n_null"]  # null ids come first
                    cols = [pa.array(d, mask=none), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crcs(own, o[:-1] - o[0], o[1:] - o[0]))]
                    cols += [pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(own.astype(np.int64)))] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    listed = spark.createDataFrame(shards, "shard string, n_docs long, n_null long, n_ids long, dtype string, base long")
    return listed.repartition(len(shards), "shard").mapInArrow(run, schema)


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Writes docs to a new shared folder and returns what the files hold, per document."""
    out = fresh_dir(docs.sparkSession, "tokens")
    write_tokens(docs, out)
    return read_tokens(docs.sparkSession, out)
