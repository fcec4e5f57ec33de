"""Operator 1, token-ID output: one zstd frame per document under a shared dictionary, with an offset index.

Layout under the output path: ``blocks`` (Parquet, not compressed again) holds one row per block of about
``block_bytes``: shard, block, first_doc, last_doc, token_start (ids before it in its shard), doc_ids, n_tokens, offsets
(byte ranges of the documents' frames inside payload, one more than there are documents), dict_hash, payload;
``dictionary`` holds dict_hash and the dictionary; ``manifest`` holds shard, tokens, token_base (ids before the shard).
Shards are ranges of doc_id, so (shard, block, position) is ascending doc_id order. A document is read by one
block row (found by first_doc/last_doc), one slice of its payload and one frame: nothing else is decompressed.

Nulls: a null text is the empty text (only the end id); null doc_ids sort first. Repeated rows are kept, in the order
of the text's hash. An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, parts_for, small_batches, table, text_bytes

BLOCKS = "shard int, block int, first_doc long, last_doc long, token_start long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, dict_hash string, payload binary"
#: Texts of these characters alone may go word by word: normalisation, case and white space hold no surprise there.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
#: The tokenizer's own pre-tokenisation, for lower-cased texts of PLAIN characters.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """A dict that makes missing values and starts anew when it holds most entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Encoder:
    """Texts to little-endian uint32 ids by the tokenizers library, whose answers for words are remembered.

    Texts of PLAIN characters without the tokenizer's special strings are lower-cased, split at white space and pre-tokenised here, which the tests hold against
    the library; the library's model then encodes each new word once. Other texts go to the library whole. Either memory
    (of chunks between white space, of pre-tokens) holds ``most`` entries at most.
    """

    def __init__(self, path: str, most: int = 200_000):
        import struct

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = _expects(self.tok)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        letters, model = _byte_alphabet(), self.tok.model

        def word(w: str) -> bytes:
            x = model.tokenize(w if w.isascii() else "".join([letters[b] for b in w.encode()]))
            return struct.pack(f"<{len(x)}I", *[t.id for t in x])

        words = _Memo(word, most).__getitem__

        def chunk(c: str) -> bytes:
            return words(c) if c.isalpha() else b"".join(map(words, PRETOKEN.findall(c)))

        self.chunks = _Memo(chunk, most).__getitem__

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return self.whole(texts)
        plain = [bool(PLAIN.fullmatch(t)) and not any(x in t for x in self.special) for t in texts]
        rest = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        return [b"".join(map(self.chunks, t.lower().split())) if p else next(rest) for t, p in zip(texts, plain)]


def _expects(tok) -> bool:
    """Whether tok is of the kind that PRETOKEN was written for: BPE with word ends, lower case, byte letters."""
    import json

    spec = json.loads(tok.to_str())
    pre = json.dumps(spec.get("pre_tokenizer"))
    return spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(spec.get("normalizer")) and "ByteLevel" in pre and r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstd dictionary for serialized id arrays; b'' if there is nothing to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve as raw content
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 16 << 20, block_bytes: int = 1 << 20, dict_bytes: int = 32 << 10, dict_docs: int = 400, level: int = 1, order: list | None = None) -> None:
    """Encode docs (doc_id, text) and write the layout above to path, in ascending doc_id order or that of the columns order.
    read_document() finds a doc_id in either; in other orders it may look into more blocks.

    dict_docs bounds the documents that the dictionary is trained on (those with the smallest hashes, at most 16,384
    characters of each); every document is encoded and written whole.
    """
    import numpy as np

    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(f"place{k}") for k, c in enumerate(order or [])])
    # the ids first, so that a task hands on dict_docs numbers at most, whatever the number of tasks
    ids = [r[0] for r in d.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(dict_docs).collect()]
    sample = [r[0] for r in d.where(F.col("doc_id").isin(ids)).select(F.substring("text", 1, 16384)).limit(2 * dict_docs).collect()] if ids else []
    pieces = [b[i : i + 2048] for b in Encoder(tokenizer_path).encode(sample) for i in range(0, len(b), 2048)]
    raw = train_dictionary(pieces, dict_bytes)
    dict_hash = sha256(raw).hexdigest()
    n = parts_for(text_bytes(d), shard_bytes)
    small_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        dic = _dictionary(raw)
        comp = zstandard.ZstdCompressor(level=level, dict_data=dic) if dic else zstandard.ZstdCompressor(level=level)
        enc = Encoder(tokenizer_path)
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((x, pa.int64()) for x in names[2:5]), *((x, pa.list_(pa.int64())) for x in names[5:8]), ("dict_hash", pa.string()), ("payload", pa.binary())])
        block, start, ids, counts, offsets, payload = 0, 0, [], [], [0], []

        def flush():
            known = [i for i in ids if i is not None] or [None]
            row = [shard, block, min(known), max(known), start, ids, counts, offsets, dict_hash, b"".join(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, b in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    frame = comp.compress(b + end)
                    ids.append(doc)
                    counts.append(len(b) // 4 + 1)
                    offsets.append(offsets[-1] + len(frame))
                    payload.append(frame)
                    if offsets[-1] >= block_bytes:
                        yield flush()
                        block, start = block + 1, start + sum(counts)
                        ids, counts, offsets, payload = [], [], [0], []
        if ids:
            yield flush()

    by = [F.col(f"place{k}") for k in range(len(order))] if order else [F.col("doc_id"), F.xxhash64("text")]
    placed = d.repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "text")
    placed.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.sql(f"SELECT '{dict_hash}' AS dict_hash, unhex('{raw.hex()}') AS dictionary").write.parquet(f"{path}/dictionary")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("tokens"))
    # one row per shard (of 16 MiB of text), so the running total may stand in one partition
    from pyspark.sql import Window

    total.withColumn("token_base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32, ids_bytes (compressed size)."""
    raw = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}  # one row

    def decode(batches):
        import pyarrow as pa
        import zstandard

        made = {}
        for batch in batches:
            for r in batch.to_pylist():
                h = r["dict_hash"]
                if h not in made:
                    if sha256(raw[h]).hexdigest() != h:
                        raise ValueError("the dictionary is not the one the block was written with")
                    dic = _dictionary(raw[h])
                    made[h] = zstandard.ZstdDecompressor(dict_data=dic) if dic else zstandard.ZstdDecompressor()
                pay, off, at, rows = memoryview(r["payload"]), r["offsets"], r["token_start"], []
                for i, doc in enumerate(r["doc_ids"]):
                    b = made[h].decompress(pay[off[i] : off[i + 1]])
                    if len(b) != 4 * r["n_tokens"][i]:
                        raise ValueError(f"document {doc}: the index and the frame differ")
                    rows.append((r["shard"], doc, at, len(b) // 4, zlib.crc32(b), off[i + 1] - off[i]))
                    at += len(b) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 5)], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids_bytes"])

    docs = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids_bytes long")
    base = spark.read.parquet(f"{path}/manifest").select("shard", "token_base")
    return docs.join(base, "shard").select("doc_id", (F.col("at") + F.col("token_base")).alias("start"), "n_tokens", "ids_crc32", "ids_bytes")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each document named doc_id, by the index alone: other frames stay compressed."""
    import numpy as np
    import zstandard

    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    dic = _dictionary(raw)
    d = zstandard.ZstdDecompressor(dict_data=dic) if dic else zstandard.ZstdDecompressor()
    b = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    b = b.select(F.posexplode("doc_ids").alias("i", "doc"), "offsets", "payload").where(F.col("doc") == doc_id)
    frames = b.select(F.expr("substring(payload, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))").alias("f"))
    return [np.frombuffer(d.decompress(bytes(r["f"])), "<u4").tolist() for r in frames.collect()]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return read_token_files(spark, path).drop("ids_bytes")
