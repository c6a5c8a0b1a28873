"""Document fingerprints: quartile bucket digests.

A text's UTF-8 bytes are cut into all byte triplets of a five-byte window's first byte (six); each is hashed into one of
``BUCKETS`` counters. The counters' quartiles turn each counter into two bits. The digest is the length's code and
these bits in hexadecimal. Two digests differ by a bounded score: the distances of the codes (0 to 3, the largest
counting double, as 6) and of the lengths (at most ``LENGTH_MOST``). Likeness is 1 - score / the score that digests of
independent codes have on average, 0 at least.

Defined cases: null or empty text: all counters zero, every code 0, length code 0. Equal texts have equal digests.
Repeated rows are kept, each with the row after it (equal keys follow their texts); a null key comes first; a single row
follows itself; an empty table gives no rows; texts may be of any length; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bucket_tree, id_bounds, partitions

BUCKETS = 256
LENGTH_MOST = 12
#: Offsets of a triplet's second and third byte from its first, within five bytes.
TRIPLETS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
_COST = np.array([0, 1, 2, 6])
_ODD = (np.uint16(40503), np.uint16(25931), np.uint16(60493))


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many hashed byte triplets fall into each bucket."""
    out = np.zeros(buckets, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint16)
    first, second, third = b * _ODD[0], b * _ODD[1], b * _ODD[2]
    shift = np.uint16(16 - int(math.log2(buckets)))
    for k, (i, j) in enumerate(TRIPLETS):
        n = len(b) - j
        if n > 0:
            mixed = (first[:n] + second[i : i + n]) ^ (third[j : j + n] + np.uint16(k * 7919))
            mixed *= np.uint16(40503)
            out += np.bincount(mixed >> shift, minlength=buckets)
    return out


def digest(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Length code and the buckets' codes, as small integers."""
    c = counts(data, buckets)
    ranked = np.sort(c)
    q1, q2, q3 = (ranked[buckets * k // 4 - 1] for k in (1, 2, 3))
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    return np.concatenate([[length_code(len(data))], codes]).astype(np.uint8)


def length_code(n: int) -> int:
    """Grows by 1 with each factor of about 1.19; at most 255."""
    return min(255, round(4 * math.log2(n + 1)))


def to_hex(codes: np.ndarray) -> str:
    two_bits = codes[1:].reshape(-1, 4)
    packed = two_bits[:, 0] << 6 | two_bits[:, 1] << 4 | two_bits[:, 2] << 2 | two_bits[:, 3]
    return f"{codes[0]:02x}{packed.astype(np.uint8).tobytes().hex()}"


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests; at most ``most_difference``."""
    codes = _COST[np.abs(a[1:].astype(np.int16) - b[1:])].sum()
    return int(codes) + min(LENGTH_MOST, abs(int(a[0]) - int(b[0])))


def most_difference(buckets: int = BUCKETS) -> int:
    return 6 * buckets + LENGTH_MOST


def usual_difference(buckets: int = BUCKETS) -> float:
    """The mean score of two digests whose codes are even and independent and whose lengths differ most."""
    codes = np.arange(4)
    return buckets * float(_COST[np.abs(codes[:, None] - codes)].mean()) + LENGTH_MOST


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 1 - difference(a, b) / usual_difference(len(a) - 1))


def from_hex(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    codes = np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], 1).reshape(-1)
    return np.concatenate([raw[:1], codes])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and its likeness to both that and the next text by key.

    Rows are dealt by ranges of the key, so that each text crosses the network once; the first row of a range also
    goes to the range before it (the very first to the last). Rows with equal keys are ordered by their text.
    """
    spark = df.sparkSession
    bounds = id_bounds(df, key, parts or partitions(spark))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("part", bucket_tree(F.col("doc_id"), bounds))
    firsts = sorted(rows.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("low")).collect())  # one row a range
    ghosts = [(firsts[k]["low"], firsts[k - 1]["part"]) for k in range(len(firsts))]
    also = spark.createDataFrame(ghosts, "low long, ghost_part int")  # as many rows as there are ranges
    dealt = (
        rows.join(F.broadcast(also), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("low"), "left")
        .withColumn("to", F.array(F.struct("part", F.lit(False).alias("ghost")), F.struct(F.col("ghost_part").alias("part"), F.lit(True).alias("ghost"))))
        .select("doc_id", "text", F.explode("to").alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.ghost").alias("ghost"), "doc_id", "text")
        .where("part is not null")
    )
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("ghost", F.col("doc_id").asc_nulls_first(), "text").select("ghost", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = None, [], False
        for batch in batches:
            for ghost, doc, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done:
                    continue
                own = digest(body.encode())
                if held:
                    before, old, mark = held
                    new = edited_text(old, body)
                    raw = new.encode()
                    near = digest(raw)
                    rows.append((before, len(old), hashlib.sha256(raw).hexdigest(), to_hex(mark), to_hex(near), likeness(mark, near), likeness(mark, own)))
                held, done = (doc, body, own), ghost
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays(_columns(rows), schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(rows), schema=_SCHEMA)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)]
