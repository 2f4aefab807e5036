"""Harmonic packing of tokenised documents into sequences of ``CAPACITY`` tokens.

A document's tokens (with its end id) are cut into pieces that lie in reciprocal-capacity classes: class k
takes pieces of which exactly k fill a sequence, and each of its bins receives k pieces. Cuts are made at
capacity, capacity/2, ... down to ``SMALLEST`` (classes 1, 2, 4, ... fill without padding); what is left,
shorter than ``SMALLEST``, stays whole and is binned by its exact length, so that a bin of k pieces of
length l pads less than l tokens.

Workers fill bins independently: pieces are numbered within (bucket of ids, length), a count of each
bucket gives every bucket its first number in the class, and number // k is the bin. Only the last bin of
every class can be short; these remainders (at most k - 1 pieces of each length, a bound that does not
depend on the input) are laid end to end, longest first.

Defined results: NULL text is empty and gives the end id alone; NULL ids are kept and packed; repeated rows
of one id are packed each (their pieces are told apart by ``copy``); an empty table gives no pieces; other
columns are ignored. Special strings inside texts are read as the library reads them by default.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import materialize, own_tables
from quotemill.llm.token_counts import byte_alphabet, tokenizer_path

CAPACITY = 2048
SMALLEST = 64
END_ID = 1
MAX_CHUNKS = 600_000

#: Stretches that no token crosses: Latin letters up to a mark or space, or another run of non-space, both
#: with the space before them; or white space.
_CHUNK = re.compile(r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+(?=[\s.,;:!?']|\Z)| ?\S+|\s+(?!\S)|\s+")
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python's patterns only


class Encoder:
    """Token ids as bytes, little-endian unsigned 32-bit. The vocabulary file's merges are run by tiktoken,
    whose ranks are the vocabulary's ids; texts with special strings or with control characters that
    the two pattern engines read differently go through ``tokenizers`` whole. The first ``MAX_CHUNKS``
    distinct stretches of text keep their ids (a bounded table), later ones are encoded each time."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.letters = tiktoken.Encoding("letters", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _chunk(self, c: str) -> bytes:
        ids = array("I", self.letters(c) if c[-1].isalpha() and c[c[0] == " " :].isalpha() else self.pieces(c)).tobytes()
        if len(self.known) < MAX_CHUNKS:
            self.known[c] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _CONTROL) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        get, chunk = self.known.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in _CHUNK.findall(text)])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, smallest: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, copy, start, length, ids_crc32, doc_tokens`` of every piece, encoded once."""
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = _encoder(tokenizer_path(tokenizer))
        for b in batches:
            rows = []
            for doc, text, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = encoder.encode(text) + tail
                start, total = 0, len(data) // 4
                for n in cuts(total, capacity, smallest):
                    rows.append((doc, copy, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), total))
                    start += n
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    return d.mapInArrow(run, "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long")


@own_tables
def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, smallest: int = SMALLEST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: ``doc_id, copy, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = materialize(pieces(docs, tokenizer, end_id, capacity, smallest, id_col, text_col))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("copy", "start"), F.lit(4 * parts))).withColumn("k", F.floor(F.lit(capacity) / F.col("length")))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("copy", "start")) - 1
    counts = materialize(p.groupBy("bucket", "length").agg(F.count("*").alias("here")))
    in_class = Window.partitionBy("length")
    first = counts.select("bucket", "length", (F.sum("here").over(in_class.orderBy("bucket")) - F.col("here")).alias("base"), F.sum("here").over(in_class).alias("all"))
    n = p.withColumn("local", local).join(first, ["bucket", "length"]).withColumn("number", F.col("base") + F.col("local"))
    n = n.withColumn("bin", F.floor(F.col("number") / F.col("k"))).withColumn("full", (F.col("bin") + 1) * F.col("k") <= F.col("all"))
    n = materialize(n.drop("bucket", "local", "base", "all"))

    full = n.filter("full").withColumn("sequence_id", F.col("length") * F.lit(1 << 44) + F.col("bin")).withColumn("offset", F.col("number") % F.col("k") * F.col("length"))

    # The remainders: lengths that halve the capacity close up exactly; short ones leave room for one more.
    order = Window.partitionBy("short").orderBy(F.desc("length"), "copy", "start")
    rest = n.filter("NOT full").withColumn("short", F.col("length") < smallest)
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("before", F.coalesce(before, F.lit(0)))
    room = F.when(F.col("short"), F.lit(capacity - smallest + 1)).otherwise(F.lit(capacity))
    rest = rest.withColumn("sequence_id", F.when(F.col("short"), F.lit(1)).otherwise(F.lit(0)) * F.lit(1 << 40) + F.floor(F.col("before") / room))
    rest = rest.withColumn("offset", F.col("before") - F.min("before").over(Window.partitionBy("sequence_id")))
    cols = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*cols).unionByName(rest.select(*cols))
