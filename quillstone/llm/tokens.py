"""Token ids as an Arrow file of equal-length sequences.

Documents are dealt out by range of doc_id; each task encodes its documents in
ascending order, appends the end id to each, and writes one shard: an Arrow IPC file
whose batches hold two fixed-size lists, input_ids (uint16, or uint32 for a larger
vocabulary) and mask (true for an id, false for padding of the last sequence). Sequences lie one after another in one buffer,
so sequence k of a shard is a slice of a memory map, without a copy. A second Arrow
file beside it holds the shard's documents: doc_id, first id, number of ids.

Encoding: the tokenizer drops white space between words and never joins across ASCII
white space, so the ids of a text are those of its words, one after another; a task
encodes every distinct word once and looks up the rest. `check_splits` proves the
property for a tokenizer by its settings; a tokenizer without it encodes whole texts.

Recovery: a shard's content follows from its input alone; a task writes to a name of
its own attempt and moves the finished file into place, so a retried or lost task
writes the same file again.

Defined results: null text counts as empty, an empty text has the end id alone; rows of
equal doc_id lie by text; a null doc_id comes first; repeated rows are all written; an
empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, freeing, one_per_task, opened, publish, remembered

END_ID = 2
SEQUENCE = 1024
#: Sequences in a batch of the file.
BATCH = 256
#: Distinct words that a Python worker remembers at most, beside those of the texts in hand.
WORDS_HELD = 600_000
MANIFEST = "first_doc long, shard int, path string, n_docs long, n_tokens long, n_sequences long"
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that normalisation leaves as they are; _SPLIT takes a run of them whole.
LETTERS = "a-zß-öø-ÿα-ωа-џ"
_STEM = re.compile(f"^([{LETTERS}]*)(.*)$", re.MULTILINE).findall
#: Ids one after another, and how many each word has.
Pieces = tuple[np.ndarray, np.ndarray]


def check_splits(tokenizer_json: str) -> bool:
    """Whether ids of a text are the ids of its lower-cased words (runs without ASCII white space) in order.

    Encoder lower-cases words before it looks them up and takes only words with `<|` for ones that may
    hold an added token, so a tokenizer that keeps case or has other added tokens encodes whole texts.
    """
    j = json.loads(tokenizer_json)
    steps = (j.get("normalizer") or {}).get("normalizers", [])
    plain = any(s["type"] == "Lowercase" for s in steps) and all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for s in steps)
    pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    cuts = pre.get("type") == "Split" and pre.get("pattern") == {"Regex": _SPLIT} and pre.get("behavior") == "Removed" and pre.get("invert")
    added = all("<|" in a["content"] and not (set(a["content"]) & set(" \t\n\r\x0b\x0c")) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in j.get("added_tokens", []))
    return bool(plain and cuts and added and not j.get("post_processor") and not j.get("truncation") and not j.get("padding"))


def stem_encoder(whole, tokenizer_json: str):
    """Encodes words of LETTERS with the same model, without the steps that do nothing to them, and by id whether a token ends a word; None where settings are others.

    The model is shared, not copied.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    j = json.loads(tokenizer_json)
    model, vocabulary = j["model"], whole.get_vocab(with_added_tokens=False)
    steps = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    suffix = model.get("end_of_word_suffix")
    if not check_splits(tokenizer_json) or model["type"] != "BPE" or model.get("dropout") or not suffix or j["pre_tokenizer"]["pretokenizers"][1:] != steps:
        return None
    stems = Tokenizer(whole.model)
    stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return stems, ends


@lru_cache(maxsize=2)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        settings = f.read()
    whole = Tokenizer.from_file(path)
    return whole, check_splits(settings), stem_encoder(whole, settings)


class Encoder:
    """Encodes texts (UTF-8) to arrays of ids.

    A distinct word has a code, and codes lead to ids in one array, so the ids of many texts are taken
    from it at once. With more than `words_held` words all are forgotten before the next texts. A new
    word is a stem of LETTERS and a rest; stems go through the model many at a time, as its tokens tell
    where a stem ends.
    """

    def __init__(self, path: str, end_id: int = END_ID, words_held: int = WORDS_HELD):
        self.tokenizer, self.by_word, self.stems = _encoder(path)
        self.kind = id_type(self.tokenizer.get_vocab_size(), end_id)
        self.end, self.most = np.array([end_id], self.kind), words_held
        self._forget()

    def _forget(self) -> None:
        #: Codes by word, in order of appearance; None is the end of a text.
        self.codes: defaultdict[bytes | None, int] = defaultdict(count(1).__next__, {None: 0})
        self.ids, self.starts, self.sizes = self.end, np.zeros(1, np.int64), np.ones(1, np.int64)

    def _fresh(self, texts: list[bytes]) -> Pieces:
        found = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.array([len(i) for i in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), self.kind, sizes.sum()), sizes

    def _fresh_stems(self, stems: list[bytes]) -> Pieces:
        """The same for words of LETTERS."""
        model, ends = self.stems
        (e,) = model.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)
        ids = np.array(e.ids, dtype=self.kind)
        stops = np.flatnonzero(ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(stems) else self._fresh(stems)

    def _codes(self, words: Iterable[bytes | None], n: int) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, n)

    def _taken(self, codes: np.ndarray) -> Pieces:
        sizes = self.sizes[codes]
        at = np.repeat(self.starts[codes] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes

    def _put(self, words: list[bytes], pieces: list[Pieces]) -> None:
        if words:
            codes, sizes = self._codes(words, len(words)), np.concatenate([s for _, s in pieces])
            self.starts[codes], self.sizes[codes] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
            self.ids = np.concatenate([self.ids, *(i for i, _ in pieces)])

    def _learn(self) -> None:
        """Ids of the words that have a code alone."""
        codes, known = self.codes, len(self.starts)
        stems: list[bytes] = []
        whole: list[bytes] = []
        two: list[bytes] = []
        parts: list[int] = []
        while known < len(codes):
            new = list(islice(reversed(codes), len(codes) - known))
            known = len(codes)
            if self.stems is None:
                whole += new
                continue
            for w, (stem, rest) in zip(new, _STEM(b"\n".join(new).decode()), strict=True):
                if not rest:
                    stems.append(w)
                elif not stem or rest[0] > "\x7f" or rest[0].isalpha() or "<|" in rest:
                    whole.append(w)
                else:  # an ASCII mark or digit after a letter begins a token of its own; either part may get a code here
                    two.append(w)
                    parts += codes[s := stem.encode()], codes[w[len(s) :]]
        more = np.zeros(known - len(self.starts), np.int64)
        self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self._put(stems, [self._fresh_stems(stems[i : i + 4096]) for i in range(0, len(stems), 4096)])
        self._put(whole, [self._fresh(whole[i : i + 4096]) for i in range(0, len(whole), 4096)])
        if two:
            ids, sizes = self._taken(np.array(parts))
            self._put(two, [(ids, sizes.reshape(-1, 2).sum(axis=1))])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        if not self.by_word:
            ids, sizes = self._fresh(texts)
            return [np.concatenate([i, self.end]) for i in np.split(ids, np.cumsum(sizes)[:-1])]
        if len(self.codes) > self.most:
            self._forget()
        # bytes.lower() and split() know ASCII alone; the tokenizer lower-cases as well, but reads special tokens first
        split: list[list[bytes | None]] = [[*(t if b"<|" in t else t.lower()).split(), None] for t in texts]
        n = np.cumsum([len(words) for words in split])
        try:
            codes = self._codes(chain.from_iterable(split), n[-1])
            self._learn()
        except BaseException:
            self._forget()  # no code is left without ids
            raise
        ids, sizes = self._taken(codes)
        return np.split(ids, np.cumsum(sizes)[n[:-1] - 1])


def encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks of a Python worker that encode, which so remembers words from one to the next; tasks of another kind drop it."""
    return remembered((path, end_id), lambda: Encoder(path, end_id))


def id_type(vocabulary: int, end_id: int) -> np.dtype:
    """Two bytes where all ids fit, else four."""
    return np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")


class ShardWriter:
    """Writes equal-length sequences and the documents' places."""

    def __init__(self, uri: str, name: str, sequence: int, kind: np.dtype):
        self.system, folder = opened(uri)
        self.system.create_dir(folder, recursive=True)
        self.final, self.part = f"{folder}/{name}", f"{folder}/.{name}.{os.getpid()}.{os.urandom(6).hex()}"
        self.width = sequence
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.place = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.system.open_output_stream(self.part)
        self.ids = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.system.open_output_stream(self.part + ".docs")
        self.index = pa.ipc.new_file(self.index_out, self.place)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = self.n_sequences = 0

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.width) for v in (flat, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += len(flat) // self.width

    def add(self, doc_ids: list[int | None], encoded: list[np.ndarray]) -> None:
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.place))
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(encoded)
        self.held += encoded
        self.n_held += int(sizes.sum())
        step = self.width * BATCH
        if self.n_held >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for i in range(0, whole, step):
                self._write(flat[i : i + step], step)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.width)), len(flat))
        for writer, stream in ((self.ids, self.out), (self.index, self.index_out)):
            writer.close()
            stream.close()
        publish(self.system, self.part + ".docs", self.final + ".docs")
        publish(self.system, self.part, self.final)


def write_shards(docs: DataFrame, uri: str, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) below uri and returns the manifest: one row per shard (MANIFEST) with `base`, the ids in all shards before it."""

    @partial(freeing, keeps=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, writer, first = TaskContext.get().partitionId(), encoder(tokenizer, end_id), None, None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                writer, first = ShardWriter(uri, f"shard-{shard:06d}.arrow", sequence, encode.kind), b.column(0)[0].as_py()
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                writer.add(part.column(0).to_pylist(), encode([t or b"" for t in part.column(1).to_pylist()]))
        if writer is not None:
            writer.close()
            name = f"{uri}/shard-{shard:06d}.arrow"
            yield pa.RecordBatch.from_pydict({"first_doc": pa.array([first], pa.int64()), "shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    manifest = cut(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_sequences(path: str) -> pa.ChunkedArray:
    """The sequences of one shard as a table over a memory map, where the file is local."""
    system, name = opened(path)
    source = pa.memory_map(name) if system.type_name == "local" else system.open_input_file(name)
    return pa.ipc.open_file(source).read_all()


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document, read back from the files of a manifest."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _documents(path, base)

    return one_per_task(manifest.select("path", "base")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, base: int) -> Iterator[pa.RecordBatch]:
    system, name = opened(path)
    with system.open_input_file(name + ".docs") as f:
        index = pa.ipc.open_file(f).read_all().combine_chunks()
    local = system.type_name == "local"
    with pa.memory_map(name) if local else system.open_input_file(name) as source:
        file = pa.ipc.open_file(source)
        at, offset, flat = 0, 0, None
        starts, sizes = index["start"].to_numpy(), index["n_tokens"].to_numpy()
        crcs = np.zeros(len(starts), dtype=np.int64)
        for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            while flat is None or offset + len(flat) < start + size:  # batches are taken up as documents reach them
                more = file.get_batch(at).column(0).flatten().to_numpy(zero_copy_only=True)
                keep = flat[start - offset :] if flat is not None and start - offset < len(flat) else more[:0]
                offset += 0 if flat is None else len(flat) - len(keep)
                flat, at = np.concatenate([keep, more]) if len(keep) else more, at + 1
            crcs[k] = zlib.crc32(np.ascontiguousarray(flat[start - offset : start - offset + size], dtype="<u4"))
    for i in range(0, len(starts), 10_000):
        j = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays([index["doc_id"].chunk(0)[j] if len(starts) else pa.array([], pa.int64()), pa.array(starts[j] + base), pa.array(sizes[j]), pa.array(crcs[j])], ["doc_id", "start", "n_tokens", "ids_crc32"])
